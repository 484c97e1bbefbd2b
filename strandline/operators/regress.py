"""Factor regressions, scenario impacts, model selection and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import sums as S
from ..functions.columns import clip, finite, log_ratio, series, values_table, whole
from ..functions.stage import stage
from .relate import long_features

RIDGE_GRID = (1e-2, 1e-1, 1.0, 10.0)


def factor_betas(frame: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """(ticker, factor, n, beta, alpha, r2): one-factor least squares for every factor at once."""
    d = long_features(frame, factors, ["ticker", y]).where(F.col("x").isNotNull() & F.col(y).isNotNull())
    return d.groupBy("ticker", F.col("feature").alias("factor")).agg(
        F.count("*").alias("n"), finite(F.regr_slope(y, "x")).alias("beta"), finite(F.regr_intercept(y, "x")).alias("alpha"), finite(F.regr_r2(y, "x")).alias("r2"))


def resolve_scenarios(spark, overrides: Sequence[tuple[str, str, float]] = ()) -> DataFrame:
    """(scenario, factor, shock): presets with custom shocks taking precedence; a new name is a custom scenario."""
    base = values_table(spark, ("scenario", "factor", "base_shock"), X.SCENARIO_SHOCKS)
    if not overrides:
        return base.withColumnRenamed("base_shock", "shock")
    own = values_table(spark, ("scenario", "factor", "own_shock"), overrides)
    return base.join(own, ["scenario", "factor"], "full_outer").select("scenario", "factor", F.coalesce("own_shock", "base_shock").alias("shock"))


def shocks_in_moves(shocks: DataFrame, macro: DataFrame) -> DataFrame:
    """Shocks next to the months known of their factor, and as multiples of its usual monthly move (deviation of log changes)."""
    step = F.col("value") / F.lag("value").over(Window.partitionBy("series").orderBy("date"))
    moves = macro.withColumn("move", F.when(step > 0, F.log(step))).groupBy(F.col("series").alias("factor")).agg(F.count("*").alias("n_months"), F.stddev_samp("move").alias("usual_move"))
    return shocks.join(moves, "factor", "left").withColumn("shock_in_moves", F.try_divide("shock", "usual_move"))


def scenario_impacts(betas: DataFrame, shocks: DataFrame, sectors: DataFrame | None = None, target: str = "log_return") -> DataFrame:
    """(ticker, scenario, factor_impact, direct_shock, total): shocks met by betas on factor.

    A shock on the target itself is added as is; in a sector scenario only for tickers of that sector.
    """
    spark = betas.sparkSession
    betas = stage(betas)  # read twice below; a row per ticker and factor
    scope = values_table(spark, X.SCENARIO_COLUMNS, X.SCENARIOS).select("scenario", "sector_scope")
    factor = betas.join(F.broadcast(shocks), "factor").groupBy("ticker", "scenario").agg(F.sum(F.col("beta") * F.col("shock")).alias("factor_impact"))
    names = [r for r in dict.fromkeys(s for s, *_ in X.SCENARIOS)]
    tickers = betas.select("ticker").distinct()
    if sectors is not None:
        tickers = tickers.join(sectors, "ticker", "left")
    else:
        tickers = tickers.withColumn("sector", F.lit(None).cast("string"))
    every = tickers.select("ticker", "sector", F.explode(F.array(*[F.lit(n) for n in names])).alias("scenario"))
    direct = shocks.where(F.col("factor") == target).select("scenario", F.col("shock").alias("_d"))
    j = every.join(F.broadcast(scope), "scenario").join(F.broadcast(direct), "scenario", "left").join(factor, ["ticker", "scenario"], "left")
    match = F.col("sector_scope").isNull() | F.coalesce(F.lower(F.trim("sector")) == F.lower("sector_scope"), F.lit(False))
    zero = F.lit(0.0)
    d = F.when(match, F.coalesce("_d", zero)).otherwise(zero)
    fi = F.coalesce("factor_impact", zero)
    return j.select("ticker", "scenario", fi.alias("factor_impact"), d.alias("direct_shock"), (fi + d).alias("total"))


def anchor_window(df: DataFrame, windows: Sequence[tuple[str, str, str]], name: str | None = None) -> DataFrame:
    """Rows inside named date windows, labelled with the event; one window when a name is given."""
    rows = [w for w in windows if name is None or w[0] == name]
    w = values_table(df.sparkSession, ("event", "_from", "_to"), rows).select("event", F.to_date("_from").alias("_from"), F.to_date("_to").alias("_to"))
    return df.join(F.broadcast(w), F.col("date").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def winsorise_columns(frame: DataFrame, columns: Sequence[str], lo: float = 0.01, hi: float = 0.99, train: Column | None = None) -> DataFrame:
    """Clip columns at quantiles of the ticker (of its train rows when given); adds `clipped`, the cells moved."""
    w = whole("ticker")
    moved = F.lit(0)
    d = frame
    for c in columns:
        base = F.when(train, F.col(c)) if train is not None else F.col(c)
        d = d.withColumn(f"_q_{c}", F.percentile(base, F.array(F.lit(lo), F.lit(hi))).over(w))
    for c in columns:
        q = F.col(f"_q_{c}")
        moved = moved + F.coalesce(((F.col(c) < q[0]) | (F.col(c) > q[1])).cast("int"), F.lit(0))
    d = d.withColumn("clipped", moved)
    for c in columns:
        d = d.withColumn(c, clip(c, F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]))
    return d.drop(*[f"_q_{c}" for c in columns])


def engineered(frame: DataFrame, factors: Sequence[str], key: str = "ticker") -> DataFrame:
    """Squares where a factor takes more than two values, and products of the first four factors."""
    w = whole(key)
    d = frame
    for f in factors:
        # more than two distinct values: some value lies strictly between the least and the greatest
        lo, hi = F.min(f).over(w), F.max(f).over(w)
        d = d.withColumn(f"_m_{f}", (F.col(f) > lo) & (F.col(f) < hi))
        d = d.withColumn(f"{f}__sq", F.when(F.max(F.col(f"_m_{f}")).over(w), F.col(f) * F.col(f))).drop(f"_m_{f}")
    first = list(factors)[:4]
    for i, a in enumerate(first):
        for b in first[i + 1:]:
            d = d.withColumn(f"{a}__x__{b}", F.col(a) * F.col(b))
    return d


def median_imputed(frame: DataFrame, columns: Sequence[str], key: str = "ticker") -> DataFrame:
    for c in columns:
        frame = frame.withColumn(c, F.coalesce(F.col(c), F.percentile(c, F.lit(0.5)).over(whole(key))))
    return frame


def missing_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing")) for c in columns]
    return frame.agg(F.count("*").alias("n_rows"), F.array(*items).alias("a")).select(F.inline("a"), "n_rows")


def with_folds(frame: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """fold 0 is only trained on; folds 1..k are tested in turn, k = clamp(n // 60, 2, 5)."""
    w = Window.partitionBy(*keys)
    d = frame.withColumn("_i", F.row_number().over(w.orderBy("date")) - 1).withColumn("_n", F.count("*").over(w))
    d = d.withColumn("_k", F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.col("_n") / 60))))
    d = d.withColumn("_size", F.floor(F.col("_n") / (F.col("_k") + 1)))
    start = F.col("_n") - F.col("_k") * F.col("_size")
    f = F.when(F.col("_i") < start, 0).otherwise(1 + F.floor(F.try_divide(F.col("_i") - start, F.col("_size"))))
    return d.withColumn("fold", f.cast("long")).drop("_i", "_n", "_k", "_size")


def ridge_cv(frame: DataFrame, y: str, xs: Sequence[str], alphas: Sequence[float] = RIDGE_GRID, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """(keys, fold, alpha, r2, rmse, n_train, n_test): one pass of sums, every fold and penalty solved from them."""
    e = S.expanding_sums(with_folds(frame, keys), list(keys), "fold", xs, y)
    e = e.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return e.withColumn("_s", S.ridge_score_udf("train", "test", "alpha")).select(*keys, "fold", "alpha", "_s.*")


def best_alpha(cv: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    m = cv.groupBy(*keys, "alpha").agg(F.avg("r2").alias("mean_r2"))
    return m.groupBy(*keys).agg(F.max_by("alpha", F.struct("mean_r2", (-F.col("alpha")).alias("a"))).alias("alpha"), F.max("mean_r2").alias("mean_r2"))


def choose_lag(frames: dict[int, DataFrame], y: str, xs: Sequence[str], cv=None) -> DataFrame:
    """(ticker, lag, mean_r2, chosen): fold R2 per candidate publication lag, the shortest lag on a tie."""
    tagged = [f.select("ticker", "date", y, *xs).withColumn("lag", F.lit(k).cast("long")) for k, f in frames.items()]
    all_ = tagged[0]
    for t in tagged[1:]:
        all_ = all_.unionByName(t)
    s = (cv or (lambda f: ridge_cv(f, y, xs, (0.5,), ("ticker", "lag"))))(all_)
    m = s.groupBy("ticker", "lag").agg(F.avg("r2").alias("mean_r2"))
    w = Window.partitionBy("ticker").orderBy(F.desc("mean_r2"), "lag")
    return m.withColumn("chosen", F.row_number().over(w) == 1)


def choose_subset(frame: DataFrame, y: str, xs: Sequence[str], top: int | None = None) -> DataFrame:
    """(ticker, members, size, r2, place): every feature subset scored on every fold from the same sums.

    One row per (ticker, subset), so the 2^p subsets spread over tasks; top keeps the best of each ticker by request.
    """
    e = S.expanding_sums(with_folds(frame), ["ticker"], "fold", xs, y)
    per = e.groupBy("ticker").agg(F.collect_list(F.struct("train", "test")).alias("folds"))
    names = F.array(*[F.lit(x) for x in xs])
    masks = per.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2 ** len(xs) - 1).cast("long"))))
    d = masks.select("ticker", S.subset_score_udf("folds", names, "mask").alias("s")).select("ticker", "s.*")
    w = Window.partitionBy("ticker").orderBy(F.desc("r2"), "size", "members")
    d = d.withColumn("place", F.row_number().over(w).cast("long"))
    return d if top is None else d.where(F.col("place") <= top)


def ols_report(frame: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """(keys, factor, coef, se, p_value, r2, adj_r2, intercept, n); p from the normal tail."""
    names = F.array(*[F.lit(x) for x in xs])
    return S.block_sums(frame, list(keys), xs, y).select(*keys, F.inline(S.ols_udf("sums", names)))


def inflation_factors(frame: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(x) for x in xs])
    return S.block_sums(frame, ["ticker"], xs, y).select("ticker", F.inline(S.vif_udf("sums", names)))


def importance(report: DataFrame, frame: DataFrame, xs: Sequence[str]) -> DataFrame:
    """abs(coef) * std(x) per (ticker, factor)."""
    sd = frame.groupBy("ticker").agg(F.array(*[F.struct(F.lit(x).alias("factor"), F.stddev_samp(x).alias("std")) for x in xs]).alias("a")).select("ticker", F.inline("a"))
    return report.join(sd, ["ticker", "factor"]).withColumn("importance", F.abs("coef") * F.col("std"))


def forecast_input(df: DataFrame, column: str) -> DataFrame:
    """(ticker, date, v): as is for returns, log return for closes, first difference otherwise."""
    prev = F.lag(column).over(series("ticker"))
    v = F.col(column) if column == "log_return" else log_ratio(column, prev) if column == "close" else F.col(column) - prev
    return df.select("ticker", "date", finite(v).alias("v")).where(F.col("v").isNotNull())


def ar_forecast(series_df: DataFrame, order: int = 1, steps: int = 10) -> DataFrame:
    """(ticker, step, forecast, lower, upper): autoregression by cross-product sums, band of 90 %."""
    w = series("ticker")
    lags = [f"l{k}" for k in range(1, order + 1)]
    d = series_df.select("ticker", "date", "v", *[F.lag("v", k).over(w).alias(f"l{k}") for k in range(1, order + 1)])
    tail = d.groupBy("ticker").agg(F.max_by(F.array("v", *lags), "date").alias("last"))
    sums = S.block_sums(d.na.drop(subset=lags), ["ticker"], lags, "v")
    return sums.join(tail, "ticker").select("ticker", F.inline(S.ar_forecast_udf("sums", "last", F.lit(steps))))


def arma_forecast(series_df: DataFrame, p: int = 1, q: int = 1, steps: int = 10, long: int = 10) -> DataFrame:
    """(ticker, step, forecast, lower, upper) of ARMA(p, q) for every series at once, band of 90 %, by Hannan and Rissanen's two regressions.

    A long autoregression gives shocks; values are then regressed on p earlier values and q earlier shocks. Both are solved from
    cross-product sums, so each stage is one aggregate over all series.
    """
    w = series("ticker")
    lags = [f"l{k}" for k in range(1, max(long, p) + 1)]
    d = series_df.select("ticker", "date", "v", *[F.lag("v", k).over(w).alias(f"l{k}") for k in range(1, max(long, p) + 1)])
    full = d.na.drop(subset=lags[:long])
    first = S.block_sums(full, ["ticker"], lags[:long], "v").withColumn("_m", S.ridge_udf("sums", F.lit(0.0))).select("ticker", "_m.intercept", "_m.coef")
    fit = F.col("intercept")
    for i, c in enumerate(lags[:long]):
        fit = fit + F.col("coef")[i] * F.col(c)
    shocks = full.join(first, "ticker").withColumn("e", F.col("v") - fit)
    errors = [f"e{k}" for k in range(1, q + 1)]
    both = shocks.select("ticker", "date", "v", *lags[:p], "e", *[F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, q + 1)])
    tail = both.groupBy("ticker").agg(F.max_by(F.array("v", *lags[:p - 1]), "date").alias("values"), F.max_by(F.array("e", *errors[:q - 1]), "date").alias("errors"))
    sums = S.block_sums(both.na.drop(subset=[*lags[:p], *errors]), ["ticker"], [*lags[:p], *errors], "v")
    return sums.join(tail, "ticker").select("ticker", F.inline(S.arma_forecast_udf("sums", "values", "errors", F.lit(steps))))


def lagged_matrix(frame: DataFrame, xs: Sequence[str], lags: Sequence[int]) -> tuple[DataFrame, list[str]]:
    w = series("ticker")
    names = [f"{x}_lag{k}" for x in xs for k in lags]
    return frame.select("ticker", "date", "log_return", *[F.lag(x, k).over(w).alias(f"{x}_lag{k}") for x in xs for k in lags]).na.drop(), names


def lagged_grid(frame: DataFrame, xs: Sequence[str], lags: Sequence[int], alphas: Sequence[float] = RIDGE_GRID, train_share: float = 0.8) -> DataFrame:
    """(ticker, alpha, r2, place): ridge grid on lagged features, scored on the last part of each series."""
    m, names = lagged_matrix(frame, xs, lags)
    w = Window.partitionBy("ticker")
    m = m.withColumn("block", (F.row_number().over(w.orderBy("date")) > F.floor(F.count("*").over(w) * train_share)).cast("long"))
    e = S.expanding_sums(m, ["ticker"], "block", names, "log_return").withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    s = e.withColumn("_s", S.ridge_score_udf("train", "test", "alpha")).select("ticker", "alpha", "_s.*")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("r2"), "alpha")).cast("long"))
