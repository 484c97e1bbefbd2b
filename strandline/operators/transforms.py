"""Stationary and mixed-frequency transforms over the wide table, for every ticker at once.

All columns of a panel are computed over one window specification, so the table is shuffled and sorted
by ticker once. Target and features stay on their row; the supervised frame needs no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import div, ffill, finite, log_ratio, rolling, running, series, values_table, whole


def source_of(name: str) -> str:
    n = name.strip().lower()
    if n in X.MARKET_COLUMNS:
        return "yfinance"
    return "worldbank" if n in X.INDICATORS.values() or n.endswith("_wb") else "fred"


def is_return_like(name: str) -> bool:
    return any(t in name.strip().lower() for t in X.RETURN_WORDS)


def is_rate_like(name: str) -> bool:
    return any(t in name.strip().lower() for t in X.RATE_WORDS)


def native_horizon(name: str) -> int:
    return X.NATIVE_HORIZON.get(source_of(name), 1)


def classify(names: DataFrame, column: str = "column") -> DataFrame:
    """source, return-like, rate-like and native horizon for a table of column names."""
    n = F.lower(F.trim(column))
    src = F.when(n.isin(*X.MARKET_COLUMNS), "yfinance").when(
        n.isin(*X.INDICATORS.values()) | n.endswith("_wb"), "worldbank").otherwise("fred")
    hor = F.when(F.col("source") == "yfinance", 1).when(F.col("source") == "fred", 21).otherwise(252)
    return names.withColumn("source", src).withColumn("return_like", n.rlike("|".join(X.RETURN_WORDS))).withColumn(
        "rate_like", n.rlike("|".join(X.RATE_WORDS))).withColumn("native_horizon", hor.cast("long"))


def resolve_horizon(features: Sequence[str], least: int = 1, most: int | None = None) -> int:
    h = max([1, least, *[native_horizon(f) for f in features]])
    return h if most is None else min(h, max(1, most))


def stationary(name: str, now: Column, before: Column, all_positive: Column, as_is: bool = False) -> Column:
    """As-is, difference, log difference when every value is positive, else relative change."""
    if as_is or is_return_like(name):
        return finite(now)
    if is_rate_like(name):
        return finite(now - before)
    return finite(F.when(all_positive, log_ratio(now, before)).otherwise(div(now, before) - 1))


def method_of(name: str, all_positive: Column, as_is: bool = False) -> Column:
    if as_is or is_return_like(name):
        return F.lit("as_is")
    if is_rate_like(name):
        return F.lit("diff")
    return F.when(all_positive, "log_diff").otherwise("pct_change")


def with_stationary(df: DataFrame, name: str, out: str, keys="ticker", as_is: bool = False, src: str | None = None) -> DataFrame:
    c = F.col(src or name)
    pos = F.coalesce(F.min(c).over(whole(keys)) > 0, F.lit(False))
    return df.withColumn(out, stationary(name, c, F.lag(c).over(series(keys)), pos, as_is)).withColumn(f"{out}_method", method_of(name, pos, as_is))


def with_interpolated(df: DataFrame, column: str, out: str, keys="ticker") -> DataFrame:
    """Linear by row position between known values, forward only, then carried forward."""
    w = series(keys)
    d = df.withColumn("_i", F.row_number().over(w))
    point = F.when(F.col(column).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(column).alias("v")))
    d = d.withColumn("_a", F.last(point, ignorenulls=True).over(running(w))).withColumn(
        "_b", F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, b = F.col("_a"), F.col("_b")
    mid = a["v"] + (b["v"] - a["v"]) * div(F.col("_i") - a["i"], b["i"] - a["i"])
    v = F.when(F.col(column).isNotNull(), F.col(column)).when(a.isNull(), None).when(b.isNull(), a["v"]).otherwise(mid)
    return d.withColumn(out, v).drop("_i", "_a", "_b")


def with_volatility_regime(df: DataFrame, ret: str = "log_return", window: int = 30, quantile: float = 0.75) -> DataFrame:
    """Rolling volatility against its own quantile per ticker: label and 0/1 flag."""
    n = max(5, window)
    d = df.withColumn("rolling_vol", rolling(F.stddev_samp, ret, series("ticker"), n, max(5, window // 2)))
    limit = F.percentile("rolling_vol", F.lit(quantile)).over(whole("ticker"))
    high = F.coalesce(F.col("rolling_vol") >= limit, F.lit(False))
    return d.withColumn("regime_high", high.cast("long")).withColumn(
        "regime", F.when(high, "high_volatility").otherwise("low_volatility"))


def is_release(column: Column, w) -> Column:
    """A known value that differs from the last known one before it."""
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    close = F.abs(column - before) <= 1e-8 + 1e-5 * F.abs(before)
    return column.isNotNull() & (before.isNull() | ~close)


def with_release_transform(df: DataFrame, name: str, src: str, out: str, keys="ticker") -> DataFrame:
    """Transform only the rows on which a value is released, measured against the release before, and carry."""
    w, c = series(keys), F.col(src)
    d = df.withColumn("_rel", F.when(is_release(c, w), c))
    d = d.withColumn("_prev", F.last("_rel", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    pos = F.coalesce(F.min("_rel").over(whole(keys)) > 0, F.lit(False))
    # a NULL transform (first release) must not hide: only a non-null one replaces what is carried
    d = d.withColumn("_t", F.when(F.col("_rel").isNotNull(), stationary(name, F.col("_rel"), F.col("_prev"), pos)))
    return d.withColumn(out, ffill("_t", w)).drop("_rel", "_prev", "_t")


def forward_target(name: str, column: str, h: int, keys="ticker") -> Column:
    """Next-h-rows outcome: summed return, log ratio when all positive, else difference. h > 1."""
    w, c = series(keys), F.col(column)
    if is_return_like(name):
        f = w.rowsBetween(1, h)
        return finite(F.when(F.count(c).over(f) == h, F.sum(c).over(f)))
    ahead = F.lead(c, h).over(w)
    return finite(F.when(F.min(c).over(whole(keys)) > 0, log_ratio(ahead, c)).otherwise(ahead - c))


def with_target(df: DataFrame, name: str, h: int, out: str, keys="ticker") -> DataFrame:
    if h <= 1:
        return with_stationary(df, name, out, keys, as_is=is_return_like(name)).drop(f"{out}_method")
    return df.withColumn(out, forward_target(name, name, h, keys))


def with_panel_columns(df: DataFrame, columns: Sequence[str], keys="ticker", macro_lag: int = 0, as_is: Sequence[str] = (),
                       prefix: str = "t_") -> DataFrame:
    """Adds the stationary, point-in-time form of every column.

    Columns move through the same few window layers together, so the number of window steps does not grow
    with the number of columns and all share the one placement and sort by (keys, date).
    """
    lag_rows = max(X.PUBLICATION_LAG_ROWS, macro_lag)
    w, every = series(keys), whole(keys)
    market = [c for c in columns if source_of(c) == "yfinance"]
    slow = [c for c in columns if source_of(c) != "yfinance"]
    upto = lambda n: w.rowsBetween(Window.unboundedPreceding, -n)
    # layer 1: what is known after the publication lag now and a row ago; neighbours for interpolation
    layer = {}
    for c in slow:
        layer[f"_x_{c}"] = F.last(c, ignorenulls=True).over(upto(lag_rows))
        layer[f"_b_{c}"] = F.last(c, ignorenulls=True).over(upto(lag_rows + 1))
    if market:
        df = df.withColumn("_i", F.row_number().over(w))
    for c in market:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        layer[f"_p_{c}"] = F.last(point, ignorenulls=True).over(running(w))
        layer[f"_n_{c}"] = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns(layer)
    # plain expressions: release values and interpolated prices
    flat = {}
    for c in slow:
        x, b = F.col(f"_x_{c}"), F.col(f"_b_{c}")
        same = F.abs(x - b) <= 1e-8 + 1e-5 * F.abs(b)
        flat[f"_r_{c}"] = F.when(x.isNotNull() & (b.isNull() | ~same), x)
    for c in market:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        mid = p["v"] + (n["v"] - p["v"]) * div(F.col("_i") - p["i"], n["i"] - p["i"])
        flat[f"_x_{c}"] = F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNull(), None).when(n.isNull(), p["v"]).otherwise(mid)
    df = df.withColumns(flat)
    # layer 2: the value before, and whether every value is positive
    layer = {}
    for c in slow:
        layer[f"_q_{c}"] = F.last(f"_r_{c}", ignorenulls=True).over(upto(1))
    for c in market:
        layer[f"_q_{c}"] = F.lag(f"_x_{c}").over(w)
    df = df.withColumns(layer)
    df = df.withColumns({f"_m_{c}": F.coalesce(F.min(f"_r_{c}" if c in slow else f"_x_{c}").over(every) > 0, F.lit(False)) for c in columns})
    flat = {f"_t_{c}": F.when(F.col(f"_r_{c}").isNotNull(), stationary(c, F.col(f"_r_{c}"), F.col(f"_q_{c}"), F.col(f"_m_{c}"))) for c in slow}
    flat |= {prefix + c: stationary(c, F.col(f"_x_{c}"), F.col(f"_q_{c}"), F.col(f"_m_{c}"), c in as_is) for c in market}
    df = df.withColumns(flat)
    # layer 3: a release holds until the next
    df = df.withColumns({prefix + c: ffill(f"_t_{c}", w) for c in slow}) if slow else df
    return df.drop("_i", *[f"_{k}_{c}" for c in columns for k in "xbpnrqmt"])


def stationary_panel(df: DataFrame, columns: Sequence[str], macro_lag: int = 0, as_is: Sequence[str] = ()) -> DataFrame:
    """(ticker, date, columns): every column stationary and known at the time; complete rows only."""
    out = with_panel_columns(df, columns, macro_lag=macro_lag, as_is=as_is)
    return out.select("ticker", "date", *[F.col(f"t_{c}").alias(c) for c in columns]).na.drop(subset=list(columns))


def panel_meta(df: DataFrame, columns: Sequence[str], macro_lag: int = 0) -> DataFrame:
    """(column_name, source, lag_rows, native_horizon) of a panel."""
    rows = []
    for c in columns:
        s = source_of(c)
        rows.append((c, s, 0 if s == "yfinance" else max(X.PUBLICATION_LAG_ROWS, macro_lag), native_horizon(c)))
    return values_table(df.sparkSession, ("column_name", "source", "lag_rows", "native_horizon"), rows)


def publication_lag(columns: Sequence[str], macro_lag: int = 0) -> int:
    """Largest lag that a panel of these columns applies."""
    return max((0 if source_of(c) == "yfinance" else max(X.PUBLICATION_LAG_ROWS, macro_lag) for c in columns), default=0)


def supervised_frame(df: DataFrame, target: str, features: Sequence[str], macro_lag: int = 0, align: bool = True,
                     least: int = 1, most: int | None = None, keep: Sequence[str] = (), complete: bool = True) -> DataFrame:
    """(ticker, date, target, features): forward target next to the panel; complete rows only, or all rows with a target."""
    h = resolve_horizon(features, least, most) if align else 1
    d = with_target(df, target, h, "_y")
    d = with_panel_columns(d, features, macro_lag=macro_lag)
    return d.select("ticker", "date", *keep, F.col("_y").alias(target), *[F.col(f"t_{c}").alias(c) for c in features]).na.drop(
        subset=[target, *features] if complete else [target])


def importance_by_source(importance: DataFrame, feature: str = "feature", value: str = "importance", keys: Sequence[str] = ()) -> DataFrame:
    """Sum of absolute importance and its share per source."""
    c = classify(importance.withColumnRenamed(feature, "column")).groupBy(*keys, "source").agg(F.sum(F.abs(value)).alias("importance"))
    total = c.groupBy(*keys).agg(F.sum("importance").alias("_t"))
    j = c.join(total, list(keys)) if keys else c.withColumn("_t", total.select("_t").scalar())
    return j.select(*keys, "source", "importance", F.coalesce(div("importance", "_t"), F.lit(0.0)).alias("share"))
