"""Relations between series, per ticker in one pass."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import div, finite, rolling, series


def correlation_matrix(panel: DataFrame, columns: Sequence[str], key: str = "ticker") -> DataFrame:
    """(key, row_name, col_name, corr) from one aggregate; every pair is computed once and mirrored."""
    pairs = list(combinations(columns, 2))
    wide = panel.groupBy(key).agg(*[finite(F.corr(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cell = lambda a, b, c: F.struct(F.lit(a).alias("row_name"), F.lit(b).alias("col_name"), c.alias("corr"))
    cells = [cell(a, a, F.lit(1.0)) for a in columns]
    for i, (a, b) in enumerate(pairs):
        cells += [cell(a, b, F.col(f"c{i}")), cell(b, a, F.col(f"c{i}"))]
    return wide.select(key, F.inline(F.array(*cells)))


def stressed_matrix(matrix: DataFrame, strength: float, target: float = X.STRESSED_CORRELATION) -> DataFrame:
    a, t = max(0.0, min(strength, 1.0)), max(-1.0, min(target, 1.0))
    moved = F.when(F.col("row_name") == F.col("col_name"), 1.0).otherwise(F.col("corr") + a * (t - F.col("corr")))
    return matrix.withColumn("corr", moved)


def _pair_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Correlations between two blocks of tickers on their common dates, as matrix products."""
    one, two = int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
    left = pdf[pdf["block"] == one].pivot(index="date", columns="ticker", values="value")
    right = pdf[pdf["block"] == two].pivot(index="date", columns="ticker", values="value")
    dates = left.index.intersection(right.index)
    a, b = left.loc[dates].to_numpy(float), right.loc[dates].to_numpy(float)
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    a, b = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    fa, fb = ma.astype(float), mb.astype(float)
    n, sa, sb, sab = fa.T @ fb, a.T @ fb, fa.T @ b, a.T @ b
    saa, sbb = (a * a).T @ fb, fa.T @ (b * b)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = (n * sab - sa * sb) / np.sqrt((n * saa - sa**2) * (n * sbb - sb**2))
    t1, t2 = np.array(left.columns), np.array(right.columns)
    i, j = np.meshgrid(np.arange(len(t1)), np.arange(len(t2)), indexing="ij")
    keep = (t1[i] < t2[j]) if one == two else np.ones(i.shape, bool)
    c = c[keep]
    return pd.DataFrame({"one": t1[i[keep]], "two": t2[j[keep]], "n": n[keep].astype("int64"), "corr": np.where(np.isfinite(c), c, np.nan)})


def cross_ticker_matrix(returns: DataFrame, value: str = "log_return", block: int = 128) -> DataFrame:
    """(one, two, n, corr) for every pair of tickers over their common dates.

    Tickers are hashed into blocks; each pair of blocks is one task that multiplies two calendar-bound
    matrices. A row travels once per block pair it takes part in, instead of once per partner ticker.
    """
    data = returns.where(F.col(value).isNotNull()).select("ticker", "date", F.col(value).alias("value"))
    n_tickers = data.select(F.countDistinct("ticker")).first()[0]
    blocks = max(1, math.ceil(n_tickers / block))
    placed = data.withColumn("block", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("long"))
    fan = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "ticker", "date", "value", "block", F.least("block", "_o").alias("one"), F.greatest("block", "_o").alias("two"))
    out = fan.groupBy("one", "two").applyInPandas(_pair_block, "one string, two string, n long, corr double")
    # blocks are hashed, so a pair may come out in either order
    return out.select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two"), "n", finite("corr").alias("corr"))


def target_links(panel: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(ticker, feature, corr, place): links to the target, strongest first."""
    items = [F.struct(F.lit(c).alias("feature"), finite(F.corr(target, c)).alias("corr")) for c in columns]
    links = panel.groupBy("ticker").agg(F.array(*items).alias("a")).select("ticker", F.inline("a"))
    w = Window.partitionBy("ticker").orderBy(F.desc_nulls_last(F.abs("corr")), "feature")
    return links.withColumn("place", F.row_number().over(w).cast("long"))


def static_elasticity(frame: DataFrame, y: str, x: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """beta = cov/var and beta * mean(x)/mean(y); the plain beta where mean(y) is near zero."""
    a = frame.groupBy(*keys).agg(F.count("*").alias("n"), div(F.covar_samp(y, x), F.var_samp(x)).alias("beta"),
                                 F.avg(y).alias("mean_y"), F.avg(x).alias("mean_x"))
    ok = F.abs("mean_y") > 1e-10
    return a.withColumn("elasticity", F.when(ok, F.col("beta") * div("mean_x", "mean_y")).otherwise(F.col("beta"))).withColumn("computable", ok)


def rolling_elasticity(frame: DataFrame, y: str, x: str, window: int = 90) -> DataFrame:
    """(ticker, date, beta, elasticity) over the last `window` rows, full windows only."""
    w = series("ticker")
    full = F.count("*").over(w.rowsBetween(-(window - 1), 0)) >= window
    f = w.rowsBetween(-(window - 1), 0)
    beta = F.when(full, div(F.covar_samp(y, x).over(f), F.var_samp(x).over(f)))
    mx, my = rolling(F.avg, x, w, window), rolling(F.avg, y, w, window)
    e = F.when(F.abs("_my") > 1e-10, F.col("beta") * div("_mx", "_my"))
    d = frame.withColumn("beta", finite(beta)).withColumn("_mx", mx).withColumn("_my", my).withColumn("elasticity", finite(e))
    return d.where(F.col("elasticity").isNotNull()).select("ticker", "date", "beta", "elasticity")


def lag_scan(frame: DataFrame, y: str, x: str, max_lag: int, min_pairs: int = 20, min_lag: int = 0,
             keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """(keys, lag, n, corr) of y[t] with x[t - lag].

    The last max_lag + 1 values of x travel with each row as an array from the one window over the
    series; exploding them feeds a map-side combined aggregate on the same partitioning, so the scan
    costs one shuffle of the series, not one per lag.
    """
    past = F.collect_list(F.struct(F.col(x).alias("v"))).over(series(list(keys)).rowsBetween(-max_lag, 0))
    d = frame.select(*keys, F.col(y).alias("_y"), past.alias("_p")).where(F.col("_y").isNotNull())
    d = d.select(*keys, "_y", F.size("_p").alias("_n"), F.posexplode("_p"))
    d = d.select(*keys, "_y", (F.col("_n") - 1 - F.col("pos")).cast("long").alias("lag"), F.col("col.v").alias("_x"))
    d = d.where(F.col("_x").isNotNull() & (F.col("lag") >= min_lag))
    return d.groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.corr("_y", "_x").alias("_c")).select(
        *keys, "lag", "n", F.when(F.col("n") >= min_pairs, finite("_c")).alias("corr"))


def best_lag(scan: DataFrame, reference_lag: int, publication_lag: int = X.PUBLICATION_LAG_ROWS, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Lag of the strongest correlation (the shortest on a tie) next to the reference lag."""
    known = F.col("corr").isNotNull()
    top = F.max(F.when(known, F.struct(F.abs("corr").alias("a"), (-F.col("lag")).alias("l"), F.col("corr").alias("c"))))
    a = scan.groupBy(*keys).agg(top.alias("_t"), F.max(F.when(F.col("lag") == reference_lag, F.col("corr"))).alias("reference_corr"))
    return a.select(*keys, (-F.col("_t.l")).alias("best_lag"), (publication_lag - F.col("_t.l")).alias("effective_lag"),
                    F.col("_t.c").alias("best_corr"), "reference_corr")


def half_life(scan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, base_corr, half_life): first lag whose absolute correlation is at most half that of lag 0."""
    base = F.max(F.when(F.col("lag") == 0, F.col("corr"))).over(Window.partitionBy(*keys))
    d = scan.withColumn("_b", base)
    hit = (F.col("lag") > 0) & (F.abs("corr") <= 0.5 * F.abs("_b"))
    return d.groupBy(*keys).agg(F.max("_b").alias("base_corr"), F.min(F.when(hit, F.col("lag"))).alias("half_life"))


def long_features(frame: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, x): one row per feature, without a shuffle."""
    return frame.select(*keep, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])))


def top_lags(scan: DataFrame, n: int = 20, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """The n strongest (feature, lag) pairs per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.abs("corr")), "feature", "lag")
    return scan.where(F.col("corr").isNotNull()).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def mean_abs_correlation(matrix: DataFrame, key: str = "ticker") -> DataFrame:
    return matrix.groupBy(key).agg(F.avg(F.abs("corr")).alias("strength"))
