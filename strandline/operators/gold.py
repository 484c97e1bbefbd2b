"""Build the wide (ticker, date) table.

The as-of join never searches: each slow series is expanded to the calendar days on which its value is
the latest one within the tolerance, pivoted to one row per day, and met by equality on date. That side
has at most one row per calendar day, so broadcasting it is safe whatever the size of the price table,
and prices are read once and never shuffled for the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import clip, div, log_ratio, series, values_table


def union_entities(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("ticker", F.upper("ticker"))


def valid_dates(df: DataFrame, date: str = "date") -> DataFrame:
    parsed = F.try_to_timestamp(F.col(date).cast("string")).cast("date")
    return df.withColumn(date, parsed).where(F.col(date).isNotNull())


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last row per key in ingest order, as an aggregate: copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def with_returns(prices: DataFrame, price: str = "adj_close", limit: float = X.RETURN_CLIP) -> DataFrame:
    """raw_return and log_return clipped to the limit; one row per (ticker, date)."""
    raw = log_ratio(price, F.lag(price).over(series("ticker")))
    return prices.withColumn("raw_return", raw).withColumn("log_return", clip("raw_return", -limit, limit))


def clipped_returns(df: DataFrame, limit: float = X.RETURN_CLIP) -> DataFrame:
    return df.groupBy("ticker").agg(F.count("raw_return").alias("n_returns"), F.count_if(F.abs("raw_return") > limit).alias("n_clipped"))


def asof_calendar(slow: DataFrame, tolerance_days: int | None, until: Column | None = None, order: str | None = None) -> DataFrame:
    """(series, date, value, source_date): the row of each series that is latest on each day.

    A value holds for the tolerance, or without one up to `until`, the last day that will be asked for. Of rows on
    one date the last by `order` stands (the ingest order), or the greatest value where none is named.
    """
    slow = keep_last(slow, ["series", "date"], order or "value").select("series", "date", "value")
    if tolerance_days is None and until is None:
        raise ValueError("without a tolerance the last day must be given")
    reach = F.date_add("date", tolerance_days) if tolerance_days is not None else F.greatest(F.to_date(until), F.col("date"))
    upto = F.coalesce(F.least(F.date_sub(F.lead("date").over(series("series")), 1), reach), reach)
    return slow.withColumn("_to", upto).where(F.col("_to") >= F.col("date")).select(
        "series", F.col("date").alias("source_date"), "value", F.explode(F.sequence("date", "_to")).alias("date"))


def aggregate_economies(ind: DataFrame, how: str | Sequence[str] = "mean") -> DataFrame:
    """(series, date, value) over the economies of a date; `last` follows economy code. Several ways give a column each, from one aggregate."""
    ways = {
        "mean": F.avg("value"), "median": F.percentile("value", F.lit(0.5)), "sum": F.sum("value"),
        "last": F.max_by("value", F.when(F.col("value").isNotNull(), F.col("economy"))),
    }
    asked = {"value": how} if isinstance(how, str) else {h: h for h in how}
    return ind.groupBy("series", "date").agg(*[ways.get(h, ways["mean"]).alias(name) for name, h in asked.items()])


def business_index(d: Column | str) -> Column:
    """Number of business days up to a date; weekends count as the Friday before."""
    d = F.col(d) if isinstance(d, str) else d
    n = F.datediff(d, F.lit("1900-01-01").cast("date"))  # a Monday
    return F.floor(n / 7) * 5 + F.least(n % 7, F.lit(4))


def previous_business_day(d: Column | str) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def business_days(df: DataFrame, date: str = "date") -> DataFrame:
    """Every business day between the least and greatest date."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)


def indicator_calendar(ind: DataFrame, mode: str = "carry", tolerance_days: int = X.INDICATOR_TOLERANCE_DAYS) -> DataFrame:
    """(series, date, value, source_date) per calendar day from yearly anchors.

    Anchors move to the business day before a weekend, so none is lost. `carry` holds the last anchor;
    `linear` walks to the next one by business-day position, which looks ahead and exists for parity.
    Values end `tolerance_days` after the anchor.
    """
    snapped = ind.withColumn("date", previous_business_day("date"))
    w = series("series")
    nxt = snapped.withColumn("_d1", F.lead("date").over(w)).withColumn("_v1", F.lead("value").over(w))
    upto = F.least(F.date_sub("_d1", 1), F.date_add("date", tolerance_days))
    days = nxt.select("series", F.col("date").alias("source_date"), "value", "_d1", "_v1", F.explode(F.sequence("date", upto)).alias("date"))
    if mode != "linear":
        return days.select("series", "date", "value", "source_date")
    part = div(business_index("date") - business_index("source_date"), business_index("_d1") - business_index("source_date"))
    v = F.when(F.col("_v1").isNull(), F.col("value")).otherwise(F.col("value") + (F.col("_v1") - F.col("value")) * part)
    return days.select("series", "date", v.alias("value"), "source_date")


def widen(calendar: DataFrame, names: Sequence[str], ages: bool = True) -> DataFrame:
    """One row per date with a value and an age column per series."""
    cols = []
    for n in names:
        mine = F.col("series") == n
        cols.append(F.max(F.when(mine, F.col("value"))).alias(n))
        if ages:
            cols.append(F.max(F.when(mine, F.datediff("date", "source_date"))).alias(f"age_days_{n}"))
    return calendar.groupBy("date").agg(*cols)


def require_columns(df: DataFrame, expected: Sequence[str]) -> None:
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError("expected columns are missing: " + ", ".join(missing))


def master_table(prices: DataFrame, macro: DataFrame, macro_names: Sequence[str], ind: DataFrame | None = None,
                 ind_names: Sequence[str] = (), how: str = "mean", mode: str = "carry",
                 macro_days: int = X.MACRO_TOLERANCE_DAYS, ind_days: int = X.INDICATOR_TOLERANCE_DAYS) -> DataFrame:
    """Prices with clipped log returns, macro and structural values as known on the day, and their ages."""
    out = with_returns(prices)
    out = out.join(F.broadcast(widen(asof_calendar(macro, macro_days), macro_names)), "date", "left")
    if ind is not None:
        cal = indicator_calendar(aggregate_economies(ind, how), mode, ind_days)
        out = out.join(F.broadcast(widen(cal, ind_names)), "date", "left")
    require_columns(out, ["date", "ticker", "close", "log_return", "volume", *macro_names, *ind_names])
    return out


def any_value_of(columns: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("double") for c in columns]).isNotNull()


def source_usage(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(source, usage_pct): share of rows with any value of the source."""
    items = [F.struct(F.lit(s).alias("source"), (F.avg(any_value_of(cs).cast("double")) * 100).alias("usage_pct")) for s, cs in groups.items()]
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))


def staleness(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(source, max_age_days, median_age_days). Ages are tolerance-bound integers, so they are counted first."""
    items = [F.struct(F.lit(s).alias("source"), F.col(f"age_days_{c}").alias("age")) for s, cs in groups.items() for c in cs]
    counted = df.select(F.inline(F.array(*items))).where(F.col("age").isNotNull()).groupBy("source", "age").agg(F.count("*").alias("n"))
    return counted.groupBy("source").agg(
        F.max("age").cast("long").alias("max_age_days"), F.percentile("age", F.lit(0.5), F.col("n")).alias("median_age_days"))


def unused_sources(usage: DataFrame) -> DataFrame:
    return usage.where(F.col("usage_pct") == 0)


def null_density(df: DataFrame, columns: Sequence[str], alert_pct: float = X.NULL_ALERT_PCT) -> DataFrame:
    """(column, null_pct, alert) from one aggregate."""
    items = [F.struct(F.lit(c).alias("column"), F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2).alias("null_pct")) for c in columns]
    return df.agg(F.array(*items).alias("a")).select(F.inline("a")).withColumn("alert", F.col("null_pct") > alert_pct)


def contract(df: DataFrame, expected: dict[str, Sequence[str]]) -> DataFrame:
    """(source, column_name, observed, n_values, n_rows): expected columns against what the table holds; a column without any value is not observed."""
    names = sorted({c for cs in expected.values() for c in cs if c in df.columns})
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in names])
    items = [F.struct(F.lit(s).alias("source"), F.lit(c).alias("column_name"), (F.col(f"n_{c}") if c in names else F.lit(0).cast("long")).alias("n_values"), F.col("n_rows").alias("n_rows")) for s, cs in expected.items() for c in sorted(cs)]
    return counts.select(F.inline(F.array(*items))).select("source", "column_name", (F.col("n_values") > 0).alias("observed"), "n_values", "n_rows")


def for_ticker(df: DataFrame, ticker: str | None) -> DataFrame:
    """Rows of the ticker, or the whole table when it has none (one filtered existence test)."""
    if not ticker:
        return df
    scoped = df.where(F.col("ticker") == ticker)
    return df if scoped.isEmpty() else scoped


def candidate_factors(df: DataFrame, columns: Sequence[str], min_rows: int = 30) -> DataFrame:
    """(column, position, n): columns with enough values that are not constant.

    min <> max states "more than one distinct value" without counting distinct values.
    """
    items = [F.struct(F.lit(c).alias("column"), F.lit(i).cast("long").alias("position"), F.count(c).alias("n"),
                      F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")) for i, c in enumerate(columns)]
    return df.agg(F.array(*items).alias("a")).select(F.inline("a")).where(
        (F.col("n") >= min_rows) & (F.col("lo") < F.col("hi"))).drop("lo", "hi")


def inverse_volatility_weights(df: DataFrame, lookback_days: int = 252, min_returns: int = 20) -> DataFrame:
    """(ticker, volatility, weight): weights sum to 1 over the tickers with enough recent returns."""
    last = df.select(F.max("date")).scalar()
    recent = df.where(F.col("date") >= F.date_sub(last, lookback_days))
    vol = recent.groupBy("ticker").agg(F.count("log_return").alias("n"), (F.stddev_samp("log_return") * F.sqrt(F.lit(252.0))).alias("volatility"))
    vol = vol.where(F.col("n") >= min_returns).select("ticker", "volatility", (1 / F.greatest("volatility", F.lit(1e-8))).alias("_inv"))
    total = vol.select(F.sum("_inv")).scalar()
    return vol.select("ticker", "volatility", F.round(F.col("_inv") / total, 8).alias("weight"))


def bounded_fill(slow: DataFrame, limit: int = 5) -> DataFrame:
    """Forward fill over at most `limit` rows."""
    return slow.withColumn("value", F.last("value", ignorenulls=True).over(series("series").rowsBetween(-limit, 0)))


def merged_frame(prices: DataFrame, slow: DataFrame, names: Sequence[str], limit: int = 5) -> DataFrame:
    """Prices with bounded-filled series as of each day, no tolerance; rows with nothing are dropped."""
    last_day = prices.agg(F.max("date").alias("last")).scalar()
    wide = widen(asof_calendar(bounded_fill(slow, limit), None, last_day), names, ages=False)
    out = prices.join(F.broadcast(wide), "date", "left")
    return out.where(any_value_of([c for c in out.columns if c not in ("date", "ticker")]))
