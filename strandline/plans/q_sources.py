"""Sources and sinks (SRC)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import nudged, rounded, values_sql
from ..functions.stage import staged_folder
from ..sources import bindings as B
from ..sources import ingest as I
from .ctes import cte, sql
from .registry import query

PRICE_COLS = ["open", "high", "low", "close", "adj_close", "volume"]
R6 = ", ".join(f"round({c}, 6) AS {c}" for c in PRICE_COLS)


@query("src1_scan_entities", """SELECT l_returnflag AS entity, count(*) AS n_rows, min(CAST(l_shipdate AS DATE)) AS first_date,
    max(CAST(l_shipdate AS DATE)) AS last_date, round(sum(l_quantity), 2) AS volume FROM lineitem GROUP BY 1""")
def _(spark, d):
    df = I.scan(spark, f"{d}/lineitem.parquet", "l_returnflag string, l_shipdate timestamp_ntz, l_quantity double")
    return df.groupBy(F.col("l_returnflag").alias("entity")).agg(
        F.count("*").alias("n_rows"), F.min(F.to_date("l_shipdate")).alias("first_date"),
        F.max(F.to_date("l_shipdate")).alias("last_date"), nudged(F.sum("l_quantity"), 2).alias("volume"))


@query("src2_entity_from_file", """SELECT 'ORDERS' AS entity, count(*) AS n_rows FROM orders
    UNION ALL SELECT 'LINEITEM', count(*) FROM lineitem UNION ALL SELECT 'CUSTOMER', count(*) FROM customer""")
def _(spark, d):
    parts = [I.scan(spark, f"{d}/{t}.parquet").select(I.entity_from_file().alias("entity")) for t in ("orders", "lineitem", "customer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("entity").agg(F.count("*").alias("n_rows"))


def _messy(spark, d):
    px = B.bars(spark, d)
    return px.select("ticker", F.col("date").alias(" DateTime "), F.col("open").alias("OPEN"), F.col("high").alias("High"),
                     F.col("low").alias("low"), F.col("close").alias("close"),
                     F.when(F.dayofmonth("date") > 15, F.col("adj_close")).alias("adj_close"),
                     F.col("close").alias("Adjusted__Close"), F.col("volume").alias("VOLUME"))


@query("src3_canonical_columns", sql(f"""SELECT ticker, date AS "Date", round(open, 6) AS "Open", round(high, 6) AS "High", round(low, 6) AS "Low",
    round(close, 6) AS "Close", round(CASE WHEN day(date) > 15 THEN adj_close ELSE close END, 6) AS "Adj Close", volume AS "Volume" FROM px""", "px"))
def _(spark, d):
    return rounded(I.canonical_columns(_messy(spark, d), "yfinance"))


@query("src4_collapse_duplicates", sql("""SELECT ticker, count(*) AS n_rows, count(*) AS n_known,
    round(sum(CASE WHEN day(date) > 15 THEN adj_close ELSE close END), 4) AS adj_total FROM px GROUP BY 1""", "px"))
def _(spark, d):
    df = I.canonical_columns(_messy(spark, d), "yfinance")
    return df.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.count("Adj Close").alias("n_known"),
                                    nudged(F.sum("Adj Close"), 4).alias("adj_total"))


@query("src5_adjusted_close_fallback", sql("""SELECT ticker, date, round(coalesce(CASE WHEN month(date) > 6 THEN adj_close END, close), 6) AS adj
    FROM px""", "px"))
def _(spark, d):
    px = B.bars(spark, d).select("ticker", "date", F.col("close").alias("Close"),
                                 F.when(F.month("date") > 6, F.col("adj_close")).alias("Adj Close"))
    return I.with_adjusted_close(px).select("ticker", "date", nudged("Adj Close", 6).alias("adj"))


def _wide(spark, d):
    """All indicators with one column per year that the data has; their number is that of calendar years."""
    ind = B.indicators(spark, d)
    years = [r["y"] for r in ind.select(F.year("date").alias("y")).distinct().orderBy("y").collect()]
    return ind.groupBy("series", "economy").pivot("date", [f"{y}-12-31" for y in years]).agg(F.first("value")).toDF("series", "economy", *[f"YR{y}" for y in years])


@query("src6_unpivot_years", sql("""SELECT series, economy, CAST(year(date) AS VARCHAR) AS "Date", round(value, 4) AS value FROM ind""", "ind"))
def _(spark, d):
    return rounded(I.years_to_long(_wide(spark, d), ["series", "economy"]), 4)


@query("src7_year_end_dates", sql("""SELECT series, CASE WHEN economy = 'ASI' THEN 'WLD' ELSE economy END AS economy, date AS "Date", round(value, 4) AS value
    FROM ind WHERE economy <> 'EUR'""", "ind"))
def _(spark, d):
    long = I.years_to_long(_wide(spark, d), ["series", "economy"])
    bad = long.withColumn("Date", F.when(F.col("economy") == "EUR", F.concat(F.lit("n/a "), "Date")).otherwise(F.col("Date"))).withColumn(
        "economy", F.when(F.col("economy") == "ASI", None).otherwise(F.lower("economy")))
    return rounded(I.year_end_dates(bad), 4)


@query("src8_required_columns", sql("""SELECT 'yfinance' AS source, count(*) AS n_rows, true AS ok FROM px
    UNION ALL SELECT 'fred', count(*), false FROM macro""", "px", "macro"))
def _(spark, d):
    a = I.required_columns(I.canonical_columns(_messy(spark, d), "yfinance"), "yfinance")
    b = I.required_columns(B.macro(spark, d).drop("value"), "fred")
    return a.unionByName(b).drop("missing")


@query("src9_ingest_audit", sql("SELECT source_system, count(*) AS n_rows, count(*) AS n_stamped FROM (SELECT 'fred' AS source_system FROM macro) GROUP BY 1", "macro"))
def _(spark, d):
    return I.with_ingest_audit(B.macro(spark, d), "fred").groupBy("source_system").agg(
        F.count("*").alias("n_rows"), F.count("ingested_at").alias("n_stamped"))


def _sink_path(spark):
    return f"{staged_folder(spark)}/{uuid.uuid4().hex}"


@query("src10_parquet_sink", sql(f"SELECT ticker, date, {R6} FROM px", "px"))
def _(spark, d):
    path = _sink_path(spark)
    I.write_parquet(B.bars(spark, d), path, "gold", ["ticker"])
    return rounded(spark.read.schema(I.PRICE_SCHEMA).parquet(path))


@query("src11_catalog", sql("SELECT source, entity, count(*) AS rows, max(date) AS last_update FROM raw GROUP BY 1, 2", "raw"))
def _(spark, d):
    return I.catalog(B.raw_entities(spark, d))


cte("proxy_ret", """SELECT ticker, date, ln(adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date)) AS ret FROM px_day""", "px_day")
cte("proxy", f"""SELECT date, 100 * exp(sum(ret) OVER (ORDER BY date)) AS value FROM (
    SELECT date, greatest(-{X.PROXY_CLIP}, least({X.PROXY_CLIP}, avg(ret))) AS ret FROM proxy_ret WHERE ret IS NOT NULL GROUP BY date)""", "proxy_ret")


@query("src12_market_proxy", sql("SELECT date, round(value, 6) AS value FROM proxy", "proxy"))
def _(spark, d):
    return rounded(I.market_proxy(B.bars(spark, d, "p_brand", "day")))


@query("src13_year_end_resample", sql("""SELECT make_date(CAST(year(date) AS INT), 12, 31) AS date, round(max_by(value, date), 6) AS value FROM proxy GROUP BY 1""", "proxy"))
def _(spark, d):
    return rounded(I.year_last(I.market_proxy(B.bars(spark, d, "p_brand", "day"))))


FACTORS = [(n, 0.92 + (sum(map(ord, n + i)) % 17) / 100.0) for i, n in X.MACRO_SERIES.items()]


@query("src14_proxy_fan_out", sql(f"""SELECT series, date, round(value * factor, 5) AS value FROM proxy, ({values_sql(("series", "factor"), FACTORS)})""", "proxy"))
def _(spark, d):
    return rounded(I.fan_out_proxy(I.market_proxy(B.bars(spark, d, "p_brand", "day")), list(X.MACRO_SERIES.items())), 5)


EXPECTED = [("yfinance", 6), ("fred", 8), ("worldbank", 25), ("news", 2)]


@query("src15_ingest_summary", sql(f"""SELECT e.source, e.expected, coalesce(s.success, 0) AS success, greatest(e.expected - coalesce(s.success, 0), 0) AS failed,
    coalesce(s.success, 0) = 0 AS missing FROM ({values_sql(("source", "expected"), EXPECTED)}) e
    LEFT JOIN (SELECT source, count(DISTINCT entity) AS success FROM raw GROUP BY 1) s ON e.source = s.source""", "raw"))
def _(spark, d):
    return I.ingest_summary(spark, I.catalog(B.raw_entities(spark, d)), EXPECTED)


@query("src16_result_sinks", sql("SELECT series, date, round(value, 4) AS value FROM macro", "macro"))
def _(spark, d):
    path = _sink_path(spark)
    df = rounded(B.macro(spark, d), 4)
    I.write_result(df.where(F.col("series") <= "f"), path + "/csv", "csv")
    I.write_result(df.where(F.col("series") > "f"), path + "/json", "json")
    schema = "series string, date date, value double"
    return spark.read.schema(schema).option("header", True).csv(path + "/csv").unionByName(spark.read.schema(schema).json(path + "/json"))


@query("src17_column_summary", sql(" UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM px'
    for c in PRICE_COLS), "px"))
def _(spark, d):
    return rounded(I.column_summary(B.bars(spark, d), PRICE_COLS), 4)


@query("src18_fingerprint")
def _(spark, d):
    return I.fingerprint(rounded(B.bars(spark, d)), ["ticker"])
