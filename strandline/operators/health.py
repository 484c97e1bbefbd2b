"""Run health and scorecards over operation events and quality reports.

One operation may hold any share of the events, so ranks over durations use the counting passes, and
everything else is an aggregate with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div
from ..functions.quantiles import group_quantiles

# --- fixed values: scorecard limits ------------------------------------------------------------------
WARN_SCORE, CRITICAL_SCORE = 70.0, 50.0
SLOWDOWN = 1.4


def data_health(report: DataFrame, expected_sources: int = 3, age_hours: float = 0.0) -> DataFrame:
    """Score, status and the five capped penalties from the entity report."""
    ok = F.col("status") == "success"
    a = report.agg(F.count("*").alias("files"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("n_rows"))), F.lit(0)).alias("rows"),
                   F.coalesce(F.sum(F.when(ok, F.col("final_nulls"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(ok, F.col("outliers"))), F.lit(0)).alias("outliers"),
                   F.countDistinct(F.when(ok, F.col("source"))).alias("live"))
    cap = lambda x, m: F.least(x, F.lit(float(m)))
    z = F.lit(0.0)
    a = a.select(
        cap(F.coalesce(div("nulls", "rows"), z) * 100, 25).alias("null_penalty"), cap(F.coalesce(div("outliers", "rows"), z) * 120, 20).alias("outlier_penalty"),
        cap(F.coalesce(div("failed", "files"), F.lit(1.0)) * 50, 50).alias("schema_penalty"), cap((F.lit(expected_sources) - F.col("live")) * 15.0, 45).alias("source_penalty"),
        F.lit(0.0 if age_hours <= 24 else min((age_hours - 24) * 0.8, 20.0)).alias("freshness_penalty"))
    total = F.col("null_penalty") + F.col("outlier_penalty") + F.col("schema_penalty") + F.col("source_penalty") + F.col("freshness_penalty")
    a = a.withColumn("score", F.greatest(F.lit(0.0), 100.0 - total))
    return a.withColumn("status", F.when(F.col("score") < CRITICAL_SCORE, "critical").when(F.col("score") < WARN_SCORE, "warning").otherwise("good"))


def session_summary(ops: DataFrame, run: Column) -> DataFrame:
    """(run, operations, components, kinds, duration, successes, success_rate, error_rate)."""
    a = ops.groupBy(run.alias("run")).agg(F.count("*").alias("operations"), F.countDistinct("component").alias("components"), F.countDistinct("operation").alias("kinds"),
                                          F.sum("duration_seconds").alias("duration"), F.count_if("success").alias("successes"))
    rate = F.col("successes") / F.col("operations")
    return a.withColumn("success_rate", rate).withColumn("error_rate", 1 - rate)


def run_comparison(runs: DataFrame) -> DataFrame:
    """The latest run next to the one before; two rows are kept, so no window over all runs is needed."""
    two = runs.orderBy(F.desc("run")).limit(2)
    a = two.agg(F.max_by("duration", "run").alias("duration"), F.min_by("duration", "run").alias("duration_before"), F.max_by("operations", "run").alias("operations"),
                F.min_by("operations", "run").alias("operations_before"), F.count("*").alias("_n")).where(F.col("_n") == 2)
    return a.select("duration", "duration_before", (F.col("duration") - F.col("duration_before")).alias("duration_delta"), "operations", "operations_before",
                    (F.col("operations") - F.col("operations_before")).alias("operations_delta"))


def alerts(health: DataFrame, comparison: DataFrame) -> DataFrame:
    """(severity, title, value)."""
    low = health.where(F.col("score") < WARN_SCORE).select(F.when(F.col("score") < CRITICAL_SCORE, "critical").otherwise("warning").alias("severity"), F.lit("data_quality_dropped").alias("title"), F.col("score").alias("value"))
    slow = comparison.where((F.col("duration_before") > 0) & (F.col("duration") > SLOWDOWN * F.col("duration_before"))).select(
        F.lit("warning").alias("severity"), F.lit("run_slowed_down").alias("title"), F.col("duration").alias("value"))
    return low.unionByName(slow)


def service_level(ops: DataFrame, key: str = "operation") -> DataFrame:
    """(key, events, success_rate, error_rate, p95_seconds, throughput): P95 is the element at floor(0.95 (n - 1))."""
    a = ops.groupBy(key).agg(F.count("*").alias("events"), F.avg(F.col("success").cast("double")).alias("success_rate"), div(F.count("*"), F.sum("duration_seconds")).alias("throughput"))
    p = group_quantiles(ops, [key], "duration_seconds", {"p95_seconds": 0.95}, interpolate=False)
    return a.join(p, key, "left").select(key, "events", "success_rate", (1 - F.col("success_rate")).alias("error_rate"), F.coalesce("p95_seconds", F.lit(0.0)).alias("p95_seconds"), "throughput")


def trailing_levels(ops: DataFrame, seconds: tuple[int, ...] = (300, 3600), as_of: Column | None = None) -> DataFrame:
    """(span, operation, events, success_rate, error_rate, p95_seconds) over the last seconds before as_of."""
    last = as_of if as_of is not None else ops.select(F.max("ts")).scalar()
    d = ops.withColumn("_age", F.unix_micros(last) - F.unix_micros("ts")).where(F.col("_age") <= max(seconds) * 1_000_000)
    d = d.withColumn("span", F.explode(F.array(*[F.lit(s) for s in seconds]))).where(F.col("_age") <= F.col("span") * F.lit(1_000_000).cast("long"))
    d = d.withColumn("key", F.concat_ws("|", F.col("span"), "operation"))
    s = service_level(d, "key")
    return s.select(F.split_part("key", F.lit("|"), F.lit(1)).cast("long").alias("span"), F.split_part("key", F.lit("|"), F.lit(2)).alias("operation"), "events", "success_rate", "error_rate", "p95_seconds")


def error_counts(ops: DataFrame, by: str) -> DataFrame:
    return ops.where(~F.col("success")).groupBy(by).agg(F.count("*").alias("errors"))


def band(c: str, *steps: tuple[str, float, str], otherwise: str = "red", unknown: str = "yellow") -> Column:
    """Traffic light: the first step whose comparison holds."""
    out = F.when(F.col(c).isNull(), unknown)
    for how, limit, colour in steps:
        out = out.when(F.col(c) <= limit if how == "<=" else F.col(c) >= limit, colour)
    return out.otherwise(otherwise)


def traffic_lights(t: DataFrame) -> DataFrame:
    """Colours for whichever of these columns exist: risk_score, r2, null_pct, coverage_pct, audit_status + failed, passed + severity."""
    if "risk_score" in t.columns:
        t = t.withColumn("risk_light", band("risk_score", ("<=", 0.45, "green"), ("<=", 0.70, "yellow")))
    if "r2" in t.columns:
        t = t.withColumn("r2_light", band("r2", (">=", 0.05, "green"), (">=", -0.75, "yellow")))
    if "null_pct" in t.columns:
        t = t.withColumn("null_light", band("null_pct", ("<=", 10.0, "green"), ("<=", 25.0, "yellow")))
    if "coverage_pct" in t.columns:
        t = t.withColumn("coverage_light", band("coverage_pct", (">=", 80.0, "green"), (">=", 50.0, "yellow")))
    if "audit_status" in t.columns:
        bad = F.upper("audit_status").isin("CRITICAL", "FAIL", "ERROR")
        t = t.withColumn("audit_light", F.when(F.upper("audit_status") == "PASS", "green").when(bad & (F.col("failed") > 2), "red").otherwise("yellow"))
    if "severity" in t.columns:
        t = t.withColumn("gate_light", F.when(F.col("passed") & F.col("severity").isin("pass", "ok"), "green").when(F.col("severity") == "warn", "yellow").otherwise("red"))
    return t


def quick_diagnostics(report: DataFrame, dead: DataFrame, sources: DataFrame, at: str = "at") -> DataFrame:
    """(failed, failed_entities, missing_sources, last_dead_letter): sources(source, missing); the latest dead letter by its
    time, by entity where times are equal. The lists name failures only."""
    failed = F.col("status") == "failed"
    a = report.agg(F.count_if(failed).alias("failed"), F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col("entity")))), ",").alias("failed_entities"))
    b = dead.agg(F.max_by(F.struct("entity", "error_type"), F.struct(at, "entity")).alias("_d"))
    c = sources.agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("missing"), F.col("source")))), ",").alias("m"))
    return a.select("failed", "failed_entities", c.scalar().alias("missing_sources"), b.select(F.concat_ws(": ", "_d.entity", "_d.error_type")).scalar().alias("last_dead_letter"))
