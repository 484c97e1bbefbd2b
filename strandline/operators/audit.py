"""Audit of the wide table: breadth, coverage, density, plausibility, continuity, survivorship, roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div, messages, series, values_table
from ..functions.quantiles import sized_quantiles
from .gold import any_value_of, business_index

# --- fixed values: audit limits ---------------------------------------------------------------------
BREADTH_FLOOR = 0.75
COVERAGE_FLOOR_PCT = 70.0
NULL_LIMIT_PCT = 25.0
ROW_LIMIT_PCT = 90.0
ZERO_VARIANCE_LIMIT = 2
QUALITY_FLOOR = 60.0
STALE_BUSINESS_DAYS = 20
ZERO_VOLUME_RUN = 10
MAX_ANNUAL_RETURN = 2.0
MAX_RETURN_PER_VOL = 4.0
MAX_GROWTH = 1000.0


def breadth(catalog: DataFrame, expected: Sequence[tuple[str, int]]) -> DataFrame:
    """(source, expected, observed, economies, ratio): landed entities against the configured number."""
    eco = F.split_part(F.col("entity"), F.lit("__"), F.lit(2))
    seen = catalog.groupBy("source").agg(F.countDistinct("entity").alias("observed"), F.countDistinct(F.when(eco != "", F.upper(eco))).alias("economies"))
    j = values_table(catalog.sparkSession, ("source", "expected"), expected).join(seen, "source", "left")
    zero = F.lit(0).cast("long")
    obs = F.coalesce("observed", zero)
    return j.select("source", "expected", obs.alias("observed"), F.coalesce("economies", zero).alias("economies"),
                    F.coalesce(F.round(div(obs, F.col("expected")), 4), F.lit(1.0)).alias("ratio"))


def coverage(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(source, row_coverage_pct, cell_fill_pct, all_sources_pct, active_sources) in one aggregate."""
    active = sum((any_value_of(cs).cast("int") for cs in groups.values()), F.lit(0))
    items = []
    for s, cs in groups.items():
        fill = sum((F.count(c) for c in cs), F.lit(0)) / (F.count("*") * len(cs)) * 100
        items.append(F.struct(F.lit(s).alias("source"), (F.avg(any_value_of(cs).cast("double")) * 100).alias("row_coverage_pct"), fill.alias("cell_fill_pct")))
    a = df.withColumn("_active", active).agg(F.array(*items).alias("a"), (F.avg((F.col("_active") == len(groups)).cast("double")) * 100).alias("all_sources_pct"),
                                             F.avg("_active").alias("active_sources"))
    return a.select(F.inline("a"), "all_sources_pct", "active_sources")


def source_issues(breadth_t: DataFrame, coverage_t: DataFrame) -> DataFrame:
    j = breadth_t.join(coverage_t, "source", "left")
    iss = messages((F.col("ratio") < BREADTH_FLOOR, "breadth_low"), (F.coalesce("row_coverage_pct", F.lit(0.0)) < COVERAGE_FLOOR_PCT, "row_coverage_low"))
    n = F.size("issues")
    return j.withColumn("issues", iss).withColumn("status", F.when(n == 0, "pass").when(n <= 2, "warn").otherwise("fail")).select("source", "issues", "status")


def density(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_pct, zero_variance, all_zero) plus the table's overall figures on each row; one aggregate."""
    items = [F.struct(F.lit(c).alias("column"), (F.avg(F.col(c).isNull().cast("double")) * 100).alias("null_pct"),
                      F.coalesce(F.stddev_samp(c) == 0, F.lit(False)).alias("zero_variance"),
                      ((F.count(c) > 0) & F.coalesce(F.sum(F.abs(c)) == 0, F.lit(False))).alias("all_zero")) for c in columns]
    total = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)) / (F.count("*") * len(columns)) * 100
    a = df.agg(F.array(*items).alias("a"), total.alias("table_null_pct"), (F.avg(any_value_of(columns).cast("double")) * 100).alias("row_non_null_pct"))
    return a.select(F.inline("a"), "table_null_pct", "row_non_null_pct")


def density_status(d: DataFrame) -> DataFrame:
    a = d.agg(F.max("table_null_pct").alias("null_pct"), F.max("row_non_null_pct").alias("row_non_null_pct"), F.count_if("zero_variance").alias("zero_variance"))
    iss = messages((F.col("null_pct") >= NULL_LIMIT_PCT, "null_density_high"), (F.col("row_non_null_pct") <= ROW_LIMIT_PCT, "row_coverage_low"),
                   (F.col("zero_variance") > ZERO_VARIANCE_LIMIT, "too_many_zero_variance_columns"))
    a = a.withColumn("issues", iss)
    return a.withColumn("status", F.when(F.size("issues") == 0, "pass").when(F.array_contains("issues", "null_density_high"), "fail").otherwise("warn"))


def plausibility(df: DataFrame, ret: str = "log_return") -> DataFrame:
    """One row: largest absolute return against max(0.5, median + 8 MAD), bad prices and volumes, mean quality.

    Medians run over all rows of all tickers, so beyond the in-task size they are found by counting passes.
    """
    keyed = df.select(F.lit(1).alias("k"), F.col(ret).alias("r"))
    n = df.count()
    med = sized_quantiles(keyed, ["k"], "r", {"median": 0.5}, n)
    mad = sized_quantiles(keyed.join(F.broadcast(med), "k").withColumn("dev", F.abs(F.col("r") - F.col("median"))), ["k"], "dev", {"mad": 0.5}, n)
    bad = [F.count_if(F.col("close") <= 0).alias("bad_prices"), F.count_if(F.col("volume") < 0).alias("bad_volumes")]
    q = F.avg("quality_score") if "quality_score" in df.columns else F.lit(None).cast("double")
    a = df.agg(F.lit(1).alias("k"), F.max(F.abs(ret)).alias("max_abs"), F.stddev_samp(ret).alias("std"), q.alias("quality"), *bad)
    j = a.join(F.broadcast(med), "k").join(F.broadcast(mad), "k").drop("k")
    j = j.withColumn("dynamic_limit", F.greatest(F.lit(0.5), F.col("median") + 8.0 * F.greatest("mad", F.lit(1e-9))))
    iss = messages((F.col("max_abs") > F.greatest(F.lit(1.0), F.col("dynamic_limit")), "extreme_log_return"), (F.col("bad_prices") > 0, "non_positive_prices"),
                   (F.col("bad_volumes") > 0, "negative_volume"), (F.col("quality") < QUALITY_FLOOR, "low_average_quality"))
    return j.withColumn("issues", iss)


def business_gap(a: Column, b: Column) -> Column:
    """Business days in [a, b] minus one, not below zero."""
    return F.greatest(business_index(b) - business_index(F.date_sub(a, 1)) - 1, F.lit(0))


def continuity(df: DataFrame, allowed_gap: int = 10) -> DataFrame:
    """(ticker, rows, repeated, cadence, max_gap, median_gap, allowed_gap, ok): repeated days collapse in an aggregate first."""
    one = df.where(F.col("date").isNotNull() & F.col("ticker").isNotNull() & F.col("close").isNotNull()).groupBy("ticker", "date").agg(F.count("*").alias("_copies"))
    prev = F.lag("date").over(series("ticker"))
    d = one.withColumn("_p", prev).withColumn("_m", (F.year("date") - F.year("_p")) * 12 + F.month("date") - F.month("_p")).withColumn("_g", business_gap(F.col("_p"), F.col("date")))
    a = d.groupBy("ticker").agg(
        F.count("*").alias("rows"), (F.sum("_copies") - F.count("*")).alias("repeated"), F.percentile("_m", F.lit(0.5)).alias("_mm"),
        F.max("_m").alias("_mmax"), F.max("_g").alias("_gmax"), F.percentile("_g", F.lit(0.5)).alias("_gm"))
    monthly = F.coalesce(F.col("_mm") >= 1.0, F.lit(False)) & (F.col("rows") >= 3)
    zero = F.lit(0).cast("long")
    a = a.select("ticker", "rows", "repeated", F.when(F.col("rows") < 2, "unknown").when(monthly, "monthly").otherwise("business_day").alias("cadence"),
                 F.coalesce(F.when(monthly, F.col("_mmax").cast("long")).otherwise(F.col("_gmax").cast("long")), zero).alias("max_gap"),
                 F.coalesce(F.when(monthly, F.col("_mm")).otherwise(F.col("_gm")), F.lit(0.0)).alias("median_gap"),
                 F.when(monthly, 1).otherwise(allowed_gap).cast("long").alias("allowed_gap"))
    return a.withColumn("ok", (F.col("max_gap") <= F.col("allowed_gap")) & ~((F.col("repeated") > 0) & (F.col("median_gap") == 0)))


def survivorship(df: DataFrame) -> DataFrame:
    """(ticker, stale_days, zero_volume_run, flags): early disappearance and long spells without volume."""
    last = df.select(F.max("date")).scalar()
    w = series("ticker")
    d = df.withColumn("_z", F.coalesce("volume", F.lit(0.0)) <= 0)
    d = d.withColumn("_run", F.count_if(~F.col("_z")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy("ticker", "_run").agg(F.count_if("_z").alias("_len"), F.max("date").alias("_last"))
    a = runs.groupBy("ticker").agg(F.max("_last").alias("_last"), F.max("_len").alias("zero_volume_run"))
    a = a.withColumn("_max", last).withColumn("stale_days", business_gap(F.col("_last"), F.col("_max")).cast("long"))
    return a.select("ticker", "stale_days", "zero_volume_run", messages((F.col("stale_days") > STALE_BUSINESS_DAYS, "stale_coverage"), (F.col("zero_volume_run") > ZERO_VOLUME_RUN, "zero_volume")).alias("flags"))


def impossible_results(df: DataFrame, ret: str = "log_return") -> DataFrame:
    a = df.groupBy("ticker").agg(F.count(ret).alias("n"), (F.exp(F.avg(ret) * 252) - 1).alias("annual_return"), (F.stddev_samp(ret) * F.sqrt(F.lit(252.0))).alias("volatility"), F.exp(F.sum(ret)).alias("growth"))
    enough = F.col("n") >= 252
    iss = messages((enough & (F.col("annual_return") > MAX_ANNUAL_RETURN), "annual_return"), (enough & (F.col("volatility") > 1e-8) & (div("annual_return", "volatility") > MAX_RETURN_PER_VOL), "return_per_volatility"),
                   ((F.col("n") >= 30) & (F.col("growth") > MAX_GROWTH), "growth"))
    return a.withColumn("issues", iss).withColumn("edge_score", F.when(F.size("issues") > 0, 0.0).otherwise(100.0))


def governance_review(decisions: DataFrame, meta: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """(keys, lag_findings, over_strict, status): publication lag of at least 45 rows and whether a block looks too strict."""
    findings = meta.where(F.col("source").isin("fred", "worldbank") & (F.col("lag_rows") < 45)).select(F.count("*")).scalar()
    strict = ~F.col("passed") & F.coalesce(F.col("risk_score") < 0.6, F.lit(False))
    hard = ~F.col("passed") & ~strict & ~F.coalesce(F.col("oos_r2") >= -0.50, F.lit(True)) & ~F.coalesce(F.col("risk_score") <= 0.70, F.lit(True))
    return decisions.select(*keys, "passed", findings.alias("lag_findings"), strict.alias("over_strict"), F.when(F.col("passed"), "pass").when(hard, "fail").otherwise("warn").alias("status"))


def roll_up(checks: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, failed, warned, status, edge_score, usable) from (key, check, status, edge_score); few checks per key."""
    sev = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("check"))))
    a = checks.groupBy(key).agg(sev("fail").alias("failed"), sev("warn").alias("warned"), F.min("edge_score").alias("_e"))
    n = F.size("failed")
    status = F.when(n > 0, "CRITICAL").when(F.size("warned") > 0, "WARN").otherwise("PASS")
    e = F.coalesce("_e", F.lit(100.0))
    edge = F.when(e == 0, 0.0).when(n > 3, F.greatest(F.lit(0.0), e - (n - 3) * 10)).when(status == "WARN", F.least(e, F.lit(75.0))).otherwise(e)
    return a.select(key, "failed", "warned", status.alias("status"), edge.alias("edge_score"), ((n <= 2) & (edge > 0)).alias("usable"))


def ticker_density(df: DataFrame, expected: DataFrame, min_years: float = 10.0, null_fail: float = 15.0) -> DataFrame:
    """(ticker, rows, null_pct, years, status) for every expected ticker; absent ones are MISSING."""
    a = df.groupBy("ticker").agg(F.count("*").alias("rows"), (F.avg(F.col("adj_close").isNull().cast("double")) * 100).alias("null_pct"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"))
    j = expected.select("ticker").distinct().join(a, "ticker", "left")
    st = F.when(F.col("rows").isNull(), "MISSING").when((F.col("null_pct") > null_fail) | (F.col("years") < 5), "FAIL").when((F.col("null_pct") < 5) & (F.col("years") >= min_years), "OK").otherwise("WARN")
    return j.select("ticker", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.round(F.coalesce("null_pct", F.lit(100.0)), 2).alias("null_pct"), F.round(F.coalesce("years", F.lit(0.0)), 1).alias("years"), st.alias("status"))


def sector_coverage(universe: DataFrame, present: DataFrame) -> DataFrame:
    """(sector, candidates, present, covered): universe(sector, ticker, place) semi-joined with the tickers at hand."""
    have = universe.join(present.select("ticker").distinct(), "ticker", "left_semi").groupBy("sector").agg(F.count("*").alias("present"))
    n = F.coalesce("present", F.lit(0).cast("long"))
    return universe.groupBy("sector").agg(F.count("*").alias("candidates")).join(have, "sector", "left").select("sector", "candidates", n.alias("present"), (n > 0).alias("covered"))


def diversification(cov: DataFrame) -> DataFrame:
    return cov.agg(F.count("*").alias("sectors"), F.count_if("covered").alias("covered"), F.round(F.avg(F.col("covered").cast("double")) * 100, 1).alias("score"))


def expansion_candidates(universe: DataFrame, present: DataFrame) -> DataFrame:
    """First missing ticker of each sector with at most one ticker at hand."""
    thin = sector_coverage(universe, present).where(F.col("present") <= 1).select("sector", "present")
    absent = universe.join(present.select("ticker").distinct(), "ticker", "left_anti").groupBy("sector").agg(F.min_by("ticker", "place").alias("ticker"))
    return thin.join(absent, "sector").select("sector", "ticker", (F.col("present") == 0).alias("new_sector"))


def issue_list(*rules: tuple[str, str, DataFrame]) -> DataFrame:
    """(priority, issue, n): one row per rule whose table of offenders is not empty."""
    out = None
    for priority, issue, offenders in rules:
        one = offenders.agg(F.count("*").alias("n")).select(F.lit(priority).alias("priority"), F.lit(issue).alias("issue"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("n") > 0)


def health_score(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count("*").alias("issues"), F.greatest(F.lit(0.0), 100.0 - F.count("*") * 10.0).alias("score"))
