"""Standardise, validate and impute raw entities.

Input shape: (source, entity, economy, date, seq, measure, value), one row per cell, so one plan covers
every numeric column of every source. A raw entity is not calendar-bound (it may hold copies), so only
aggregates with map-side combine, the histogram quantiles and the blocked fill touch it. Entities with
repeated days are set aside before any window over an entity runs.

The clipping limits are full-sample quantiles and the backward fill looks ahead; both are kept because
results must agree, and downstream validation uses train-only limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import quantiles as Q
from ..functions.columns import clip, messages, series, values_table
from ..functions.fills import fill_both_ways
from ..functions.quantiles import sized_quantiles
from ..functions.stage import broadcast_counted, small_side, stage

CELL = ("source", "entity", "measure")
ENTITY = ("source", "entity")
KEY_MEASURES = ("close", "value")


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def align_dates(df: DataFrame, source: str = "source", date: str = "date") -> DataFrame:
    """Parse, drop what is no date, keep days for prices and month ends for macro sources."""
    parsed = F.try_to_timestamp(F.col(date).cast("string")).cast("date")
    return df.withColumn(date, parsed).where(F.col(date).isNotNull()).withColumn(
        date, F.when(F.col(source).isin("fred", "worldbank"), F.last_day(date)).otherwise(F.col(date)))


def base_entity(entity: str | Column = "entity") -> Column:
    return F.split_part(entity if isinstance(entity, Column) else F.col(entity), F.lit("__"), F.lit(1))


def is_percentage() -> Column:
    hit = F.lit(False)
    for source, names in X.PERCENT_ENTITIES.items():
        hit = hit | ((F.col("source") == source) & base_entity().isin(*names))
    return hit


def scale_percentages(raw: DataFrame) -> DataFrame:
    """Divide percentage entities by 100 when their maximum exceeds 1; adds unit_normalized."""
    tops = raw.where(is_percentage() & (F.col("measure") == "value")).groupBy(*ENTITY).agg(F.max("value").alias("_top"))
    hit = F.coalesce(F.col("_top") > 1.0, F.lit(False))
    return raw.join(small_side(tops), list(ENTITY), "left").withColumn("unit_normalized", hit).withColumn(
        "value", F.when(hit, F.col("value") / 100.0).otherwise(F.col("value"))).drop("_top")


def with_contract(df: DataFrame) -> DataFrame:
    """Contract of the entity, else of its source, else the global default. Both sides are fixed lists."""
    names = X.CONTRACT_COLUMNS[2:]
    table = values_table(df.sparkSession, X.CONTRACT_COLUMNS, X.CONTRACTS)
    own = table.where(F.col("entity").isNotNull()).select(
        F.col("source").alias("_s1"), F.col("entity").alias("_e1"), *[F.col(n).alias(f"_own_{n}") for n in names])
    src = table.where(F.col("entity").isNull()).select(F.col("source").alias("_s2"), *[F.col(n).alias(f"_src_{n}") for n in names])
    out = df.join(F.broadcast(own), (F.col("source") == F.col("_s1")) & (base_entity() == F.col("_e1")), "left").join(
        F.broadcast(src), F.col("source") == F.col("_s2"), "left")
    keep = [F.col(c) for c in df.columns]
    return out.select(*keep, *[F.coalesce(f"_own_{n}", f"_src_{n}", F.lit(d)).alias(n) for n, d in zip(names, X.CONTRACT_DEFAULT)])


def cell_stats(raw: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Per (source, entity, measure): rows, days, nulls, mean, std. The day count groups by day first.

    Quantiles are added on request, for tables whose size was checked.
    """
    q = [F.percentile("value", F.lit(p)).alias(k) for k, p in (quantiles or {}).items()]
    return raw.groupBy(*CELL).agg(
        F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_days"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("top"), *q)


def entity_stats(stats: DataFrame) -> DataFrame:
    """Per entity: rows, days, nulls and the worst null percentage with its column."""
    pct = 100.0 * F.col("nulls") / F.col("n_rows")
    worst = F.min(F.struct((-pct).alias("neg"), F.col("measure").alias("m")))
    return stats.groupBy(*ENTITY).agg(
        F.max("n_rows").alias("n_rows"), F.max("n_days").alias("n_days"), F.sum("nulls").alias("initial_nulls"), worst.alias("_w")
    ).select("*", (-F.col("_w.neg")).alias("worst_null_pct"), F.col("_w.m").alias("worst_column")).drop("_w")


def preflight(stats: DataFrame, catalog: DataFrame, min_rows: int = X.MIN_ROWS, share: float = X.MIN_ROWS_SHARE) -> DataFrame:
    """(source, entity, n_rows, expected_rows, enough_rows, enough_share) against the landed row counts."""
    exp = catalog.select(*ENTITY, F.col("rows").alias("expected_rows"))
    need = F.greatest(F.lit(1), F.floor(F.col("expected_rows") * share))
    return stats.join(exp, list(ENTITY), "left").select(
        *ENTITY, "n_rows", "expected_rows", (F.col("n_rows") >= min_rows).alias("enough_rows"),
        F.coalesce(F.col("n_rows") >= need, F.lit(True)).alias("enough_share"))


def schema_drift(df: DataFrame, source: str) -> DataFrame:
    """(source, n_rows, missing): required staged columns absent after name normalisation."""
    have = [c.lower().replace(" ", "_") for c in df.columns]
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(source).alias("source"), "n_rows", F.array_sort(F.array_except(
        F.array(*[F.lit(c) for c in X.REQUIRED_STAGED[source]]), F.array(*[F.lit(c) for c in have]))).alias("missing"))


def dynamic_null_limit(history: DataFrame, last: int = X.HISTORY_ROWS) -> DataFrame:
    """(source, entity, base, null_limit) from the last runs: max(base, min(70, mean + 2 std_pop))."""
    w = series(ENTITY, []).orderBy(F.desc("run"))
    recent = history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    agg = with_contract(recent.groupBy(*ENTITY).agg((F.avg("worst_null_pct") + 2 * F.stddev_pop("worst_null_pct")).alias("_a")))
    base = F.col("null_tolerance_pct")
    return agg.select(*ENTITY, base.alias("base"), F.greatest(base, F.least(F.lit(X.NULL_LIMIT_CEILING), F.col("_a"))).alias("null_limit"))


def null_severity(n_rows, worst, limit, buffer: float = X.WARN_TO_FAIL_BUFFER) -> Column:
    severe = F.least(F.lit(100.0), F.col(limit) + buffer)
    return F.when(F.col(n_rows) < 10, "ok").when(F.col(worst) > severe, "fail").when(F.col(worst) > F.col(limit), "warn").otherwise("ok")


def outlier_counts(raw: DataFrame, stats: DataFrame) -> DataFrame:
    """Cells beyond the contract's z limit, per entity."""
    lim = with_contract(stats.where(F.col("std") > 0)).select(*CELL, "mean", "std", "z_limit")
    far = F.abs((F.col("value") - F.col("mean")) / F.col("std")) > F.col("z_limit")
    return raw.join(small_side(lim), list(CELL)).groupBy(*ENTITY).agg(F.count_if(far).alias("outliers"))


def biggest_cell(stats: DataFrame) -> int:
    """Rows of the largest (source, entity, measure): the size check that picks the in-task or the counting way."""
    return stats.agg(F.max("n_rows")).first()[0] or 0


def winsorise(raw: DataFrame, stats: DataFrame, lo: float = 0.01, hi: float = 0.99, biggest: int | None = None) -> DataFrame:
    """Clip cells at the group's exact P1/P99 where the contract says so and the group varies."""
    todo = with_contract(stats.where(F.col("std") > 0)).where("winsorise").select(*CELL)
    biggest = biggest_cell(stats) if biggest is None else biggest
    lim = sized_quantiles(raw.join(small_side(todo), list(CELL), "left_semi"), CELL, "value", {"_lo": lo, "_hi": hi}, biggest)
    out = raw.join(small_side(lim), list(CELL), "left")
    return out.withColumn("value", F.when(F.col("_lo").isNull(), F.col("value")).otherwise(
        clip("value", F.col("_lo"), F.col("_hi")))).drop("_lo", "_hi")


def impute(raw: DataFrame, biggest: int | None = None) -> DataFrame:
    """Fill forward, then backward, in date order; adds `filled`."""
    return fill_both_ways(raw, CELL, "value", biggest_group=biggest)


def repeated_days(stats: DataFrame) -> DataFrame:
    """Market entities that hold a day more than once."""
    return stats.where((F.col("source") == "yfinance") & (F.col("n_days") < F.col("n_rows"))).select(*ENTITY).distinct()


def range_violations(raw: DataFrame) -> DataFrame:
    """(source, entity, rule, violations) for every range rule in one aggregate."""
    price = (F.col("source") == "yfinance") & (F.col("measure") != "volume")
    rules = {
        "price_positive": price & (F.col("value") <= 0),
        "volume_not_negative": (F.col("measure") == "volume") & (F.col("value") < 0),
        "source_known": ~F.col("source").isin(*X.SOURCES),
        "date_present": F.col("date").isNull(),
    }
    agg = raw.groupBy(*ENTITY).agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return agg.unpivot(list(ENTITY), list(rules), "rule", "violations")


def max_daily_move(prices: DataFrame, value: str = "value", limit: float = X.MAX_DAILY_MOVE) -> DataFrame:
    """Largest absolute change of consecutive closes per entity (entities with one row per day)."""
    prev = F.lag(value).over(series(ENTITY))
    move = F.abs(F.try_divide(F.col(value), prev) - 1)
    return prices.where(F.col("measure") == "close").withColumn("_m", move).groupBy(*ENTITY).agg(
        F.max("_m").alias("max_move")).withColumn("ok", F.coalesce(F.col("max_move") <= limit, F.lit(True)))


def date_uniqueness(raw: DataFrame) -> DataFrame:
    one = raw.where(F.col("measure").isin(*KEY_MEASURES))
    return one.groupBy(*ENTITY).agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_days")).withColumn(
        "unique", F.col("n_rows") == F.col("n_days"))


def order_violations(df: DataFrame, key: str, order: str, stamp: str, block: int = 100_000) -> DataFrame:
    """Rows whose stamp lies before that of the row ingested just before, per key.

    Keys may be arbitrarily large: rows are compared inside blocks of ingest order, and each block's
    first row with the last row of the block before.
    """
    d = df.select(key, F.col(order).alias("_o"), F.col(stamp).alias("_t"), F.floor(F.col(order) / block).alias("_b"))
    inner = d.withColumn("_p", F.lag("_t").over(series([key, "_b"], "_o")))
    per = inner.groupBy(key, "_b").agg(
        F.count_if(F.col("_t") < F.col("_p")).alias("_v"), F.min_by("_t", "_o").alias("_first"), F.max_by("_t", "_o").alias("_last"))
    edge = F.col("_first") < F.lag("_last").over(series(key, "_b"))
    return per.withColumn("_e", F.coalesce(edge.cast("long"), F.lit(0))).groupBy(key).agg(
        F.sum(F.col("_v") + F.col("_e")).alias("violations"))


def economy_codes(raw: DataFrame) -> DataFrame:
    """(economy, n_rows, ok): three upper-case letters."""
    return raw.where(F.col("source") == "worldbank").groupBy("economy").agg(F.count("*").alias("n_rows")).withColumn(
        "ok", F.coalesce(F.col("economy").rlike("^[A-Z]{3}$"), F.lit(False)))


def indicator_null_share(raw: DataFrame) -> DataFrame:
    share = F.avg(F.col("value").isNull().cast("double"))
    return raw.where(F.col("measure") == "value").groupBy(*ENTITY).agg(share.alias("null_share")).withColumn(
        "ok", F.col("null_share") < X.INDICATOR_NULL_SHARE)


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast what can be cast, NULL otherwise, and drop columns that are not declared."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in types.items() if c in df.columns])


def quality_score(initial_nulls, imputed, outliers, rows, columns) -> Column:
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    rows = F.greatest(F.col(rows), F.lit(1))
    nulls = unit(F.col(initial_nulls) / F.greatest(rows * F.col(columns), F.lit(1)))
    pen = F.least(nulls * 100, F.lit(40.0)) + F.least(unit(F.col(imputed) / rows) * 100, F.lit(30.0)) + F.least(
        unit(F.col(outliers) / rows) * 100, F.lit(20.0))
    return F.greatest(F.lit(0.0), 100.0 - pen)


def column_count() -> Column:
    n = F.lit(1)
    for s, k in X.SCHEMA_COLUMNS.items():
        n = F.when(F.col("source") == s, F.lit(k + X.AUDIT_COLUMNS)).otherwise(n)
    return n


def verdicts(stats: DataFrame, catalog: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Verdict per entity: everything that can reject it before it is filled."""
    ent = entity_stats(stats)
    pre = preflight(ent, catalog).drop("n_rows")
    v = ent.join(pre, list(ENTITY))
    if history is None:
        v = with_contract(v).withColumn("null_limit", F.col("null_tolerance_pct")).drop(*X.CONTRACT_COLUMNS[2:])
    else:
        v = with_contract(v).join(dynamic_null_limit(history).drop("base"), list(ENTITY), "left").withColumn(
            "null_limit", F.coalesce("null_limit", "null_tolerance_pct")).drop(*X.CONTRACT_COLUMNS[2:])
    v = v.withColumn("severity", null_severity("n_rows", "worst_null_pct", "null_limit"))
    repeated = (F.col("source") == "yfinance") & (F.col("n_days") < F.col("n_rows"))
    err = (
        F.when(~F.col("enough_rows"), "too_few_rows").when(~F.col("enough_share"), "below_catalog_share")
        .when(F.col("severity") == "fail", "too_many_nulls").when(repeated, "repeated_days")
    )
    return v.withColumn("pre_error", err)


def clean(raw: DataFrame, catalog: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean rows, entity report). Rejected entities appear in the report with error_type set.

    Three passes over the raw table: statistics, quantiles, and one that scales, counts outliers, clips and
    fills. Statistics and filled rows are written out, as several results read them.
    """
    hit = is_percentage() & (F.col("measure") == "value") & F.coalesce(F.col("top") > 1.0, F.lit(False))
    small = raw.count() <= Q.SMALL_GROUP  # then no group can exceed a task and quantiles come with the statistics
    stats = cell_stats(raw, {"_lo": 0.01, "_hi": 0.99} if small else None).withColumn("unit", F.when(hit, 100.0).otherwise(1.0))
    stats = stage(stats.withColumn("mean", F.col("mean") / F.col("unit")).withColumn("std", F.col("std") / F.col("unit")))
    v = verdicts(stats, catalog, history)
    biggest = biggest_cell(stats)
    passed = v.where(F.col("pre_error").isNull()).select(*ENTITY)
    kept = stats.join(passed, list(ENTITY), "left_semi").withColumnRenamed("unit", "_unit")
    cells = with_contract(kept).select(*CELL, "mean", "std", "_unit", "z_limit", "winsorise")
    clips = (F.col("std") > 0) & F.col("winsorise")
    if small:
        cells = cells.join(kept.select(*CELL, "_lo", "_hi"), list(CELL)).withColumn("_lo", F.when(clips, F.col("_lo"))).withColumn("_hi", F.when(clips, F.col("_hi")))
    else:
        lim = sized_quantiles(raw.join(broadcast_counted(cells.where(clips).select(*CELL), stats.count()), list(CELL), "left_semi"), CELL, "value", {"_lo": 0.01, "_hi": 0.99}, biggest)
        cells = cells.join(lim, list(CELL), "left")
    d = raw.join(broadcast_counted(cells, stats.count()), list(CELL)).withColumn("value", F.col("value") / F.col("_unit"))
    d = d.withColumn("outlier", F.coalesce((F.col("std") > 0) & (F.abs((F.col("value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))) > F.col("z_limit")), F.lit(False)))
    d = d.withColumn("value", F.when(F.col("_lo").isNull(), F.col("value")).otherwise(clip("value", F.col("_lo") / F.col("_unit"), F.col("_hi") / F.col("_unit"))))
    d = d.withColumn("unit_normalized", F.col("_unit") > 1).drop("mean", "std", "_unit", "z_limit", "winsorise", "_lo", "_hi")
    filled = stage(impute(d, biggest).drop("value").withColumnRenamed("filled", "value"))
    price = (F.col("source") == "yfinance") & (F.col("measure") != "volume")
    after = filled.groupBy(*ENTITY).agg(
        F.count_if("outlier").alias("outliers"),
        F.count_if(F.col("value").isNull()).alias("final_nulls"),
        F.count_if(price & (F.col("value") <= 0) | (F.col("measure") == "volume") & (F.col("value") < 0)).alias("bad_range"),
        F.count_if((F.col("source") == "worldbank") & ~F.coalesce(F.col("economy").rlike("^[A-Z]{3}$"), F.lit(False))).alias("bad_code"))
    moves = max_daily_move(filled).drop("max_move").withColumnRenamed("ok", "move_ok")
    rep = v.join(after, list(ENTITY), "left").join(moves, list(ENTITY), "left")
    err = (
        F.when(F.col("pre_error").isNotNull(), F.col("pre_error")).when(F.col("bad_range") > 0, "value_out_of_range")
        .when(~F.coalesce("move_ok", F.lit(True)), "daily_move_too_large").when(F.col("bad_code") > 0, "economy_code")
        .when((F.col("source") == "worldbank") & (F.col("final_nulls") / F.col("n_rows") >= X.INDICATOR_NULL_SHARE), "too_many_nulls")
    )
    zero = F.lit(0).cast("long")
    rep = rep.withColumn("error_type", err).withColumn("status", F.when(F.col("error_type").isNull(), "success").otherwise("failed"))
    rep = rep.withColumn("imputed_count", F.coalesce(F.col("initial_nulls") - F.col("final_nulls"), zero)).withColumn(
        "outliers", F.coalesce("outliers", zero)).withColumn("_columns", column_count())
    rep = rep.withColumn("quality_score", F.when(F.col("status") == "success", quality_score(
        "initial_nulls", "imputed_count", "outliers", "n_rows", "_columns")))
    rep = rep.withColumn("warnings", messages(
        (F.col("severity") == "warn", "elevated_missingness"),
        (F.col("outliers") / F.greatest("n_rows", F.lit(1)) > X.OUTLIER_WARN_RATIO, "high_outlier_intensity")))
    keep = [*ENTITY, "status", "error_type", "n_rows", "initial_nulls", "final_nulls", "imputed_count", "outliers", "worst_column",
            "worst_null_pct", "null_limit", "severity", "quality_score", "warnings"]
    rep = rep.select(*keep)
    audit = rep.where(F.col("status") == "success").select(
        *ENTITY, "imputed_count", F.col("outliers").alias("outliers_clipped"), F.col("n_rows").alias("initial_rows"),
        "initial_nulls", "quality_score")
    return filled.drop("outlier").join(broadcast_counted(audit, stats.count()), list(ENTITY)), rep


def dead_letters(report: DataFrame) -> DataFrame:
    msg = F.concat(F.col("entity"), F.lit(" ("), F.col("source"), F.lit("): "), F.col("error_type"))
    return report.where(F.col("status") == "failed").select(*ENTITY, "error_type", msg.alias("error_message"))


def source_report(spark: SparkSession, report: DataFrame) -> DataFrame:
    """(source, success, failed, missing) for every expected source."""
    counts = report.groupBy("source").pivot("status", ["success", "failed"]).agg(F.count("entity"))
    zero = F.lit(0).cast("long")
    ok = F.coalesce("success", zero)
    return values_table(spark, ("source",), [(s,) for s in X.SOURCES]).join(counts, "source", "left").select(
        "source", ok.alias("success"), F.coalesce("failed", zero).alias("failed"), (ok == 0).alias("missing"))


def run_totals(report: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    zero = F.lit(0).cast("long")
    return report.agg(
        F.count("*").alias("entities"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("imputed_count"))), zero).alias("imputed"),
        F.coalesce(F.sum(F.when(ok, F.col("outliers"))), zero).alias("clipped"))


def append_history(report: DataFrame, path: str, run_id: str) -> None:
    """Append this run's quality metrics; one task's commit is atomic, so a lost executor leaves no partial run."""
    report.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("at"), *report.columns).write.mode("append").parquet(path)
