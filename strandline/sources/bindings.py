"""Shapes the operators expect, bound to the relational test tables.

Prices come from line items joined to parts and are reduced to one row per (ticker, period) by an
aggregate with map-side combine, so a ticker, part or day that holds a third of all line items is
collapsed before the shuffle. Everything downstream works on calendar-bound series. The join carries no
hint: the planner broadcasts `part` only when its measured size is under the session's limit and
otherwise sorts and merges, where adaptive execution splits a hot part key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# order priority -> macro series it stands for; two yearly measures -> structural series
MACRO_BINDING = {
    "1-URGENT": "inflation", "2-HIGH": "energy_index", "3-MEDIUM": "fed_funds_rate",
    "4-NOT SPECIFIED": "consumer_sentiment", "5-LOW": "industrial_production",
}
MACRO_NAMES = tuple(MACRO_BINDING.values())
INDICATOR_NAMES = ("gdp_growth", "trade_openness")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, ticker: str = "p_type", unit: str = "week") -> DataFrame:
    """(ticker, date, open, high, low, close, adj_close, volume), one row per ticker and period."""
    items = table(spark, sf_dir, "lineitem")
    day = F.to_date(F.date_trunc(unit, "l_shipdate")) if unit != "day" else F.to_date("l_shipdate")
    if ticker.startswith("p_"):
        items = items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return items.groupBy(F.upper(ticker).alias("ticker"), day.alias("date")).agg(
        F.avg(price).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")).alias("adj_close"),
        F.sum("l_quantity").alias("volume"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, value): monthly, one row per series and month end."""
    name = F.create_map(*[F.lit(x) for kv in MACRO_BINDING.items() for x in kv])[F.col("o_orderpriority")]
    return table(spark, sf_dir, "orders").groupBy(
        name.alias("series"), F.last_day("o_orderdate").alias("date")
    ).agg(F.avg("o_totalprice").alias("value"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, economy, date, value): yearly, per region code."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.upper(F.substring("r_name", 1, 3)).alias("economy"))
    yearly = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("date"))
        .agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("economy", "date").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    )
    pair = F.explode(F.array(
        F.struct(F.lit("gdp_growth").alias("series"), (F.col("s") / 1e6).alias("value")),
        F.struct(F.lit("trade_openness").alias("series"), (F.col("s") / F.col("n") / 1e3).alias("value")),
    )).alias("p")
    return yearly.select("economy", "date", pair).select("p.series", "economy", "date", "p.value")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, operation, component, duration_seconds, success, event_id) from the event table."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"),
        F.col("user_id").alias("component"), F.col("value").alias("duration_seconds"),
        (F.col("event_type") != "error").alias("success"), "event_id")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector): first brand of a part type."""
    return table(spark, sf_dir, "part").groupBy(F.upper("p_type").alias("ticker")).agg(F.min("p_brand").alias("sector"))


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned rows of all three sources in one long shape:
    (source, entity, economy, date, seq, measure, value).

    The dirt is written by calendar rule so that any engine derives the same rows: values of the first
    three days of a month are missing for prices, year-end prices are inflated fifty-fold, one ticker
    repeats its mid-month rows, and one macro series lacks its winter months.
    """
    px = bars(spark, sf_dir)
    dom = F.dayofmonth("date")
    spoiled = lambda c: F.when(dom <= 3, None).when((F.month("date") == 12) & (dom >= 25), F.col(c) * 50).otherwise(F.col(c))
    px = px.select("ticker", "date", F.explode(F.when(
        (F.col("ticker") == "PROMO") & dom.between(14, 16), F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))).alias("seq"), spoiled("close").alias("close"), spoiled("adj_close").alias("adj_close"),
        "open", "high", "low", "volume")
    names = ["open", "high", "low", "close", "adj_close", "volume"]
    px = px.unpivot(["ticker", "date", "seq"], names, "measure", "value").select(
        F.lit("yfinance").alias("source"), F.col("ticker").alias("entity"), F.lit(None).cast("string").alias("economy"),
        "date", F.col("seq").cast("long").alias("seq"), "measure", "value")
    mac = macro(spark, sf_dir).select(
        F.lit("fred").alias("source"), F.col("series").alias("entity"), F.lit(None).cast("string").alias("economy"), "date",
        F.lit(0).cast("long").alias("seq"), F.lit("value").alias("measure"),
        F.when((F.col("series") == "industrial_production") & F.month("date").isin(1, 2, 11, 12), None)
        .otherwise(F.col("value")).alias("value"))
    ind = indicators(spark, sf_dir).select(
        F.lit("worldbank").alias("source"), F.concat_ws("__", "series", F.lower("economy")).alias("entity"), "economy",
        "date", F.lit(0).cast("long").alias("seq"), F.lit("value").alias("measure"), "value")
    return px.unionByName(mac).unionByName(ind)
