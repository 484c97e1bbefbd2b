"""Standardise, validate, impute (SLV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import nudged, rounded
from ..functions.stage import stage
from ..operators import silver as S
from ..sources import bindings as B
from ..sources import ingest as I
from .ctes import cte, sql
from .q_sources import _sink_path
from .registry import query

cte("raw_typed", "SELECT *, split_part(entity, '__', 1) AS base FROM raw", "raw")
cte("with_contract", """SELECT r.*, coalesce(o.null_tolerance_pct, d.null_tolerance_pct, 30.0) AS null_tolerance_pct,
    coalesce(o.z_limit, d.z_limit, 4.5) AS z_limit, coalesce(o.winsorise, d.winsorise, true) AS winsorise,
    coalesce(o.unit, d.unit, 'unknown') AS unit, coalesce(o.kind, d.kind, 'unknown') AS kind
    FROM raw_typed r LEFT JOIN contracts o ON o.source = r.source AND o.entity = r.base
    LEFT JOIN contracts d ON d.source = r.source AND d.entity IS NULL""", "raw_typed", "contracts")
PCT = "((source = 'fred' AND base IN ('inflation', 'unemployment_rate')) OR (source = 'worldbank' AND base = 'gdp_growth'))"
cte("scaled", f"""SELECT * REPLACE (CASE WHEN unit_normalized THEN value / 100.0 ELSE value END AS value) FROM (
    SELECT *, coalesce({PCT} AND max(value) OVER (PARTITION BY source, entity) > 1.0, false) AS unit_normalized FROM with_contract)""", "with_contract")
cte("cell", """SELECT source, entity, measure, count(*) AS n_rows, count(DISTINCT date) AS n_days, count(*) FILTER (value IS NULL) AS nulls,
    avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.01) AS q_lo, quantile_cont(value, 0.99) AS q_hi,
    any_value(null_tolerance_pct) AS null_tolerance_pct, any_value(z_limit) AS z_limit, any_value(winsorise) AS winsorise FROM scaled GROUP BY 1, 2, 3""", "scaled")
cte("ent", """SELECT source, entity, max(n_rows) AS n_rows, max(n_days) AS n_days, CAST(sum(nulls) AS BIGINT) AS initial_nulls,
    max(100.0 * nulls / n_rows) AS worst_null_pct, arg_min(measure, (-100.0 * nulls / n_rows, measure)) AS worst_column,
    any_value(null_tolerance_pct) AS null_limit FROM cell GROUP BY 1, 2""", "cell")
SEVERITY = """CASE WHEN n_rows < 10 THEN 'ok' WHEN worst_null_pct > least(100.0, null_limit + 15) THEN 'fail'
    WHEN worst_null_pct > null_limit THEN 'warn' ELSE 'ok' END"""
cte("verdict", f"""SELECT *, {SEVERITY} AS severity, CASE WHEN n_rows < 10 THEN 'too_few_rows' WHEN {SEVERITY} = 'fail' THEN 'too_many_nulls'
    WHEN source = 'yfinance' AND n_days < n_rows THEN 'repeated_days' END AS pre_error FROM ent""", "ent")
cte("wins", """SELECT s.*, CASE WHEN c.std > 0 AND c.winsorise AND s.value IS NOT NULL THEN greatest(c.q_lo, least(c.q_hi, s.value)) ELSE s.value END AS w
    FROM scaled s JOIN cell c USING (source, entity, measure)""", "scaled", "cell")
FILL = """coalesce(last_value({v} IGNORE NULLS) OVER (PARTITION BY source, entity, measure ORDER BY date, seq ROWS UNBOUNDED PRECEDING),
    first_value({v} IGNORE NULLS) OVER (PARTITION BY source, entity, measure ORDER BY date, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
cte("good", f"SELECT * REPLACE ({FILL.format(v='w')} AS value) FROM wins SEMI JOIN (SELECT * FROM verdict WHERE pre_error IS NULL) g USING (source, entity)",
    "wins", "verdict")
cte("outl", """SELECT source, entity, count(*) FILTER (abs((value - mean) / std) > c.z_limit) AS outliers FROM scaled s
    JOIN cell c USING (source, entity, measure) WHERE c.std > 0 GROUP BY 1, 2""", "scaled", "cell")
cte("moves", """SELECT source, entity, max(m) AS max_move FROM (SELECT source, entity,
    abs(value / nullif(lag(value) OVER (PARTITION BY source, entity ORDER BY date), 0) - 1) AS m FROM good WHERE measure = 'close') GROUP BY 1, 2""", "good")
cte("report", f"""SELECT v.source, v.entity, CASE WHEN e IS NULL THEN 'success' ELSE 'failed' END AS status, e AS error_type, v.n_rows, initial_nulls, final_nulls,
    coalesce(initial_nulls - final_nulls, 0) AS imputed_count, CASE WHEN pre_error IS NULL THEN outliers ELSE 0 END AS outliers, worst_column, worst_null_pct,
    null_limit, severity, v.n_rows * (CASE v.source WHEN 'yfinance' THEN 16 WHEN 'fred' THEN 10 ELSE 11 END) AS cells
    FROM (SELECT v.*, a.final_nulls, coalesce(o.outliers, 0) AS outliers, CASE WHEN pre_error IS NOT NULL THEN pre_error WHEN bad_range > 0 THEN 'value_out_of_range'
      WHEN max_move > {X.MAX_DAILY_MOVE} THEN 'daily_move_too_large' END AS e
      FROM verdict v LEFT JOIN (SELECT source, entity, count(*) FILTER (value IS NULL) AS final_nulls,
        count(*) FILTER ((source = 'yfinance' AND measure <> 'volume' AND value <= 0) OR (measure = 'volume' AND value < 0)) AS bad_range FROM good GROUP BY 1, 2) a USING (source, entity)
      LEFT JOIN outl o USING (source, entity) LEFT JOIN moves m USING (source, entity)) v""", "verdict", "good", "outl", "moves")
QUALITY = """CASE WHEN status = 'success' THEN greatest(0.0, 100.0 - (least(least(1.0, initial_nulls / cells) * 100, 40.0)
    + least(least(1.0, greatest(0.0, imputed_count / n_rows)) * 100, 30.0) + least(least(1.0, outliers / n_rows) * 100, 20.0))) END"""


def _raw(spark, d):
    """The uncleaned rows as a landed table: every step below reads it more than once."""
    return stage(B.raw_entities(spark, d))


def _clean(spark, d):
    raw = _raw(spark, d)
    return S.clean(raw, I.catalog(raw.where(F.col("measure").isin("close", "value"))))


@query("slv1_snake_case", sql("SELECT ticker, count(adj_close) AS n_adj_close, round(sum(volume), 2) AS volume FROM px GROUP BY 1", "px"))
def _(spark, d):
    px = B.bars(spark, d).select("ticker", F.col("adj_close").alias("Adj Close"), F.col("volume").alias("VOLUME"))
    return S.snake_case_columns(px).groupBy("ticker").agg(F.count("adj_close").alias("n_adj_close"), nudged(F.sum("volume"), 2).alias("volume"))


@query("slv2_align_dates", """SELECT source, date, count(*) AS n_rows FROM (
    SELECT 'yfinance' AS source, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'fred', last_day(o_orderdate) FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1, 2""")
def _(spark, d):
    o = B.table(spark, d, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    both = o.select(F.explode(F.array(F.lit("yfinance"), F.lit("fred"))).alias("source"), text.alias("date"))
    return S.align_dates(both).groupBy("source", "date").agg(F.count("*").alias("n_rows"))


@query("slv3_percentage_scaling", sql("""SELECT source, entity, measure, any_value(unit_normalized) AS unit_normalized, round(max(value), 6) AS top,
    round(avg(value), 6) AS mean FROM scaled GROUP BY 1, 2, 3""", "scaled"))
def _(spark, d):
    return S.scale_percentages(_raw(spark, d)).groupBy(*S.CELL).agg(
        F.first("unit_normalized").alias("unit_normalized"), nudged(F.max("value"), 6).alias("top"), nudged(F.avg("value"), 6).alias("mean"))


@query("slv4_preflight_rows", sql("""SELECT source, entity, n_rows, n_rows * 2 AS expected_rows, n_rows >= 10 AS enough_rows, true AS enough_share FROM ent""", "ent"))
def _(spark, d):
    raw = _raw(spark, d)
    cat = I.catalog(raw.where(F.col("measure").isin("close", "value"))).withColumn("rows", F.col("rows") * 2)
    return S.preflight(S.entity_stats(S.cell_stats(raw)), cat)


@query("slv5_schema_drift", sql("""SELECT 'fred' AS source, count(*) AS n_rows, 'source_system,value' AS missing FROM macro
    UNION ALL SELECT 'worldbank', count(*), 'source_system' FROM ind""", "macro", "ind"))
def _(spark, d):
    a = S.schema_drift(B.macro(spark, d).drop("value"), "fred")
    b = S.schema_drift(B.indicators(spark, d), "worldbank")
    return a.unionByName(b).withColumn("missing", F.array_join("missing", ","))


@query("slv6_worst_null_pct", sql("SELECT source, entity, initial_nulls, round(worst_null_pct, 6) AS worst_null_pct, worst_column FROM ent", "ent"))
def _(spark, d):
    return rounded(S.entity_stats(S.cell_stats(_raw(spark, d))).drop("n_rows", "n_days"))


cte("history", """SELECT source, entity, run, max(p) AS worst_null_pct FROM (SELECT source, entity, year(date) AS run, measure,
    100.0 * count(*) FILTER (value IS NULL) / count(*) AS p FROM raw GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", "raw")
cte("null_limits", """SELECT source, entity, any_value(null_tolerance_pct) AS base, greatest(any_value(null_tolerance_pct),
      least(70.0, avg(worst_null_pct) + 2 * stddev_pop(worst_null_pct))) AS null_limit
    FROM (SELECT *, row_number() OVER (PARTITION BY source, entity ORDER BY run DESC) AS r FROM history) h
    JOIN (SELECT DISTINCT source, entity, null_tolerance_pct FROM with_contract) USING (source, entity) WHERE r <= 3 GROUP BY 1, 2""", "history", "with_contract")


def _history(spark, d):
    """One past run per calendar year of the raw rows."""
    y = _raw(spark, d).groupBy("source", "entity", F.year("date").alias("run"), "measure").agg(
        (100.0 * F.count_if(F.col("value").isNull()) / F.count("*")).alias("p"))
    return y.groupBy("source", "entity", "run").agg(F.max("p").alias("worst_null_pct"))


@query("slv7_dynamic_null_limit", sql("SELECT source, entity, base, round(null_limit, 6) AS null_limit FROM null_limits", "null_limits"))
def _(spark, d):
    return rounded(S.dynamic_null_limit(_history(spark, d), last=3))


@query("slv8_null_severity", sql(f"SELECT source, entity, severity, count(*) AS n FROM (SELECT source, entity, {SEVERITY} AS severity FROM ent) GROUP BY 1, 2, 3", "ent"))
def _(spark, d):
    raw = _raw(spark, d)
    return S.verdicts(S.cell_stats(raw), I.catalog(raw)).groupBy("source", "entity", "severity").agg(F.count("*").alias("n"))


@query("slv9_outlier_count", sql("SELECT source, entity, outliers FROM outl", "outl"))
def _(spark, d):
    raw = stage(S.scale_percentages(B.raw_entities(spark, d)))
    return S.outlier_counts(raw, S.cell_stats(raw))


@query("slv10_winsorise", sql("SELECT source, entity, measure, date, seq, round(w + 1e-7, 4) AS value FROM wins", "wins"))
def _(spark, d):
    raw = stage(S.scale_percentages(B.raw_entities(spark, d)))
    return rounded(S.winsorise(raw, S.cell_stats(raw)).select(*S.CELL, "date", "seq", (F.col("value") + 1e-7).alias("value")), 4)


@query("slv11_fill", sql(f"SELECT source, entity, measure, date, seq, round({FILL.format(v='value')} + 1e-7, 4) AS filled FROM scaled", "scaled"))
def _(spark, d):
    return rounded(S.impute(S.scale_percentages(_raw(spark, d))).select(*S.CELL, "date", "seq", (F.col("filled") + 1e-7).alias("filled")), 4)


WARN = """concat_ws(',', CASE WHEN severity = 'warn' THEN 'elevated_missingness' END,
    CASE WHEN outliers / greatest(n_rows, 1) > 0.1 THEN 'high_outlier_intensity' END)"""


@query("slv12_imputation_report", sql(f"SELECT source, entity, initial_nulls, final_nulls, imputed_count, outliers, {WARN} AS warnings FROM report", "report"))
def _(spark, d):
    rep = _clean(spark, d)[1]
    return rep.select("source", "entity", "initial_nulls", "final_nulls", "imputed_count", "outliers", F.array_join("warnings", ",").alias("warnings"))


@query("slv13_range_rules", sql("""SELECT source, entity, rule, CASE rule WHEN 'price_positive' THEN a WHEN 'volume_not_negative' THEN b ELSE 0 END AS violations FROM (
    SELECT source, entity, count(*) FILTER (source = 'yfinance' AND measure <> 'volume' AND value <= 0) AS a, count(*) FILTER (measure = 'volume' AND value < 0) AS b FROM raw GROUP BY 1, 2),
    (VALUES ('price_positive'), ('volume_not_negative'), ('source_known'), ('date_present')) AS r(rule)""", "raw"))
def _(spark, d):
    return S.range_violations(_raw(spark, d))


@query("slv14_max_daily_move", sql(f"SELECT source, entity, round(max_move, 6) AS max_move, max_move <= {X.MAX_DAILY_MOVE} AS ok FROM moves", "moves"))
def _(spark, d):
    raw = stage(S.scale_percentages(B.raw_entities(spark, d)))
    stats = S.cell_stats(raw)
    once = raw.join(S.repeated_days(stats), ["source", "entity"], "left_anti").where(F.col("source") == "yfinance")
    kept = stats.join(S.repeated_days(stats), ["source", "entity"], "left_anti").where(F.col("source") == "yfinance")
    return rounded(S.max_daily_move(S.impute(S.winsorise(once, kept)), "filled"))


@query("slv15_unique_dates", sql("""SELECT source, entity, count(*) AS n_rows, count(DISTINCT date) AS n_days, count(*) = count(DISTINCT date) AS "unique"
    FROM raw WHERE measure IN ('close', 'value') GROUP BY 1, 2""", "raw"))
def _(spark, d):
    return S.date_uniqueness(_raw(spark, d))


@query("slv15_ordered_dates", """SELECT event_type, count(*) FILTER (ts < p) AS violations FROM (
    SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) GROUP BY 1""")
def _(spark, d):
    return S.order_violations(B.table(spark, d, "events"), "event_type", "event_id", "ts", block=500)


@query("slv16_economy_code", """SELECT economy, count(*) AS n_rows, regexp_full_match(economy, '[A-Z]{3}') AS ok FROM (
    SELECT upper(substr(r_name, 1, 3)) AS economy FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def _(spark, d):
    c = B.table(spark, d, "customer").join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = c.select(F.explode(F.array(F.upper(F.substring("r_name", 1, 3)), F.col("n_name"))).alias("economy"))
    return S.economy_codes(both.withColumn("source", F.lit("worldbank")))


@query("slv17_indicator_null_share", sql("""SELECT source, entity, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share,
    avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) < 0.3 AS ok FROM raw WHERE measure = 'value' GROUP BY 1, 2""", "raw"))
def _(spark, d):
    return rounded(S.indicator_null_share(_raw(spark, d)))


@query("slv18_coerce_types", """SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value, count(*) AS n
    FROM orders GROUP BY 1, 2""")
def _(spark, d):
    o = B.table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(F.col("o_totalprice").cast("string")).alias("value"), "o_custkey")
    return S.coerce(o, {"date": "date", "value": "double", "volume": "double"}).groupBy("date", "value").agg(F.count("*").alias("n"))


@query("slv19_quality_score", sql(f"""SELECT source, entity, imputed_count, outliers AS outliers_clipped, n_rows AS initial_rows, initial_nulls,
    round({QUALITY}, 6) AS quality_score FROM report WHERE status = 'success'""", "report"))
def _(spark, d):
    good, _ = _clean(spark, d)
    cols = ["source", "entity", "imputed_count", "outliers_clipped", "initial_rows", "initial_nulls", "quality_score"]
    return rounded(good.select(*cols).distinct())


@query("slv20_dead_letters", sql("""SELECT source, entity, error_type, entity || ' (' || source || '): ' || error_type AS error_message FROM report WHERE status = 'failed'""", "report"))
def _(spark, d):
    return S.dead_letters(_clean(spark, d)[1])


@query("slv21_source_report", sql("""SELECT s.source, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'success') = 0 AS missing FROM (VALUES ('yfinance'), ('fred'), ('worldbank')) s(source) LEFT JOIN report USING (source) GROUP BY 1""", "report"))
def _(spark, d):
    return S.source_report(spark, _clean(spark, d)[1])


@query("slv22_quality_history", sql("SELECT 'r1' AS run_id, source, entity, initial_nulls, worst_column FROM report UNION ALL SELECT 'r2', source, entity, initial_nulls, worst_column FROM report", "report"))
def _(spark, d):
    rep, path = _clean(spark, d)[1], _sink_path(spark)
    for run in ("r1", "r2"):
        S.append_history(rep, path, run)
    return spark.read.parquet(path).select("run_id", "source", "entity", "initial_nulls", "worst_column")


@query("slv23_run_totals", sql("""SELECT count(*) AS entities, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed,
    CAST(coalesce(sum(imputed_count) FILTER (status = 'success'), 0) AS BIGINT) AS imputed, CAST(coalesce(sum(outliers) FILTER (status = 'success'), 0) AS BIGINT) AS clipped FROM report""", "report"))
def _(spark, d):
    return S.run_totals(_clean(spark, d)[1])


@query("slv24_contract_lookup", sql("SELECT DISTINCT source, entity, kind, unit, null_tolerance_pct, z_limit, winsorise FROM with_contract", "with_contract"))
def _(spark, d):
    return S.with_contract(_raw(spark, d).select("source", "entity").distinct())
