"""Model validation and governance tables, per ticker."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sums as S
from ..functions.columns import div, finite, messages, rolling, running, series, whole
from ..functions.stage import stage
from .regress import choose_lag, winsorise_columns
from .relate import long_features

# --- fixed values: governance limits ----------------------------------------------------------------
R2_FLOOR = -0.10
R2_BANDS = ((0.10, 0.10), (0.00, 0.20), (-0.10, 0.30), (-0.25, 0.45), (-0.50, 0.70))
RISK_WEIGHTS = {"leakage": 0.35, "stationarity": 0.25, "stability": 0.20, "performance": 0.20}
ADF_CRITICAL = -2.86
KPSS_CRITICAL = 0.463
MIN_TRAIN = 24
POLICY = {
    "min_r2": -0.25, "max_normalized_shift": 2.5, "max_leakage_flags": 1.0, "min_stationary_ratio": 0.10, "min_walk_forward_r2": -0.25,
    "max_model_risk_score": 0.6, "model_risk_warn_threshold": 0.4, "model_risk_fail_threshold": 0.6, "factor_concentration_warn_threshold": 0.65,
    "freshness_warn_days": 60.0,
}
REGIME_SHIFT_FACTOR = {"stress": 1.2, "crisis": 1.4}
REGIME_RISK_EXTRA = {"stress": 0.05, "crisis": 0.1}
CRISIS_R2_RELIEF = 0.05
# error function by rational approximation (absolute error below 1.5e-7)
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def with_split(frame: DataFrame, min_train: int = MIN_TRAIN, test_share: float = 0.2) -> DataFrame:
    """is_train by position: train rows = max(min_train, min(floor(n * (1 - share)), n - 5))."""
    w = Window.partitionBy("ticker")
    n = F.count("*").over(w)
    cut = F.greatest(F.lit(min_train), F.least(F.floor(n * (1 - test_share)), n - 5))
    return frame.withColumn("is_train", F.row_number().over(w.orderBy("date")) <= cut)


def split_bounds(split: DataFrame) -> DataFrame:
    tr = F.col("is_train")
    return split.groupBy("ticker").agg(
        F.count_if(tr).alias("train_rows"), F.count_if(~tr).alias("test_rows"), F.min(F.when(tr, F.col("date"))).alias("train_start"),
        F.max(F.when(tr, F.col("date"))).alias("train_end"), F.min(F.when(~tr, F.col("date"))).alias("test_start"), F.max(F.when(~tr, F.col("date"))).alias("test_end"))


def clip_by_train(split: DataFrame, columns: Sequence[str]) -> DataFrame:
    return winsorise_columns(split, columns, train=F.col("is_train"))


def choose_lag_by_split(frames: dict[int, DataFrame], y: str, xs: Sequence[str]) -> DataFrame:
    """Lag by ridge R2 on one 80/20 chronological split."""
    def cv(all_):
        w = Window.partitionBy("ticker", "lag")
        b = all_.withColumn("block", (F.row_number().over(w.orderBy("date")) > F.floor(F.count("*").over(w) * 0.8)).cast("long"))
        e = S.expanding_sums(b, ["ticker", "lag"], "block", xs, y)
        return e.withColumn("_s", S.ridge_score_udf("train", "test", F.lit(0.5))).select("ticker", "lag", "_s.*")
    return choose_lag(frames, y, xs, cv)


def regression_metrics(pred: DataFrame, keys: Sequence[str] = ("ticker",), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    a = pred.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(e * e).alias("_sse"), F.var_pop(actual).alias("_v"), F.avg(F.abs(e)).alias("mae"))
    return a.select(*keys, "n", (1 - div("_sse", F.col("_v") * F.col("n"))).alias("r2"), "mae", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"))


def bounded_r2(r2: Column | str) -> Column:
    return F.greatest(F.lit(R2_FLOOR), F.col(r2) if isinstance(r2, str) else r2)


def r2_risk(r2: Column | str) -> Column:
    c = F.col(r2) if isinstance(r2, str) else r2
    out = None
    for limit, risk in R2_BANDS:
        out = F.when(c >= limit, risk) if out is None else out.when(c >= limit, risk)
    return F.when(c.isNotNull(), out.otherwise(1.0))


def baselines(split: DataFrame, y: str) -> DataFrame:
    """(ticker, model, n, r2, mae, rmse) of train mean, mean of the last five train values and zero on the test rows."""
    w = whole("ticker")
    tr = F.when(F.col("is_train"), F.col(y))
    back = F.row_number().over(Window.partitionBy("ticker", "is_train").orderBy(F.desc("date")))
    d = split.withColumn("_b", back).withColumn("_mean", F.avg(tr).over(w))
    d = d.withColumn("_recent", F.avg(F.when(F.col("is_train") & (F.col("_b") <= 5), F.col(y))).over(w)).where(~F.col("is_train"))
    items = [F.struct(F.lit(m).alias("model"), p.alias("predicted")) for m, p in
             (("mean_predictor", F.col("_mean")), ("recent_mean_predictor", F.col("_recent")), ("zero_drift", F.lit(0.0)))]
    return regression_metrics(d.select("ticker", F.col(y).alias("actual"), F.inline(F.array(*items))), ("ticker", "model"))


def ridge_baseline(split: DataFrame, y: str, xs: Sequence[str], alpha: float = 0.5) -> DataFrame:
    b = split.withColumn("block", (~F.col("is_train")).cast("long"))
    e = S.expanding_sums(b, ["ticker"], "block", xs, y).withColumn("_s", S.ridge_score_udf("train", "test", F.lit(alpha)))
    return e.select("ticker", F.lit("ridge_baseline").alias("model"), F.col("_s.n_test").alias("n"), F.col("_s.r2").alias("r2"), F.col("_s.rmse").alias("rmse"))


def with_windows(frame: DataFrame, windows: int = 4, min_train: int = MIN_TRAIN, min_test: int | None = None) -> DataFrame:
    """window 0 is the first training block; windows 1..k follow in steps of max(min_test, (n - min_train) / k), the last to the end.

    min_test, unless given, grows with the series: clamp(n // max(10, 3 * windows), 12, 60).
    """
    w = Window.partitionBy("ticker")
    d = frame.withColumn("_i", F.row_number().over(w.orderBy("date")) - 1).withColumn("_n", F.count("*").over(w))
    least = F.greatest(F.lit(12), F.least(F.lit(60), F.floor(F.col("_n") / max(10, 3 * windows)))) if min_test is None else F.lit(min_test)
    d = d.withColumn("_least", least).withColumn("_step", F.greatest(F.col("_least"), F.floor((F.col("_n") - min_train) / windows)))
    win = F.when(F.col("_i") < min_train, 0).otherwise(F.least(F.lit(windows), 1 + F.floor((F.col("_i") - min_train) / F.col("_step")))).cast("long")
    d = d.withColumn("window", win)
    d = d.withColumn("_rows", F.count("*").over(Window.partitionBy("ticker", "window")))
    return d.where((F.col("window") == 0) | (F.col("_rows") >= F.col("_least"))).drop("_i", "_n", "_step", "_rows", "_least")


def walk_forward(frame: DataFrame, y: str, xs: Sequence[str], windows: int = 4, min_train: int = MIN_TRAIN, min_test: int | None = None) -> DataFrame:
    """(ticker, window, r2, rmse, n_train, n_test): least squares on everything before each window."""
    e = S.expanding_sums(with_windows(frame, windows, min_train, min_test), ["ticker"], "window", xs, y)
    return e.withColumn("_s", S.ridge_score_udf("train", "test", F.lit(0.0))).select("ticker", "window", "_s.*")


def walk_forward_summary(wf: DataFrame, floor: float = -2.0) -> DataFrame:
    a = wf.groupBy("ticker").agg(
        F.count("*").alias("windows"), F.avg("r2").alias("avg_r2"), F.percentile("r2", F.lit(0.5)).alias("median_r2"),
        F.avg(F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col("r2")))).alias("clipped_avg_r2"), F.min("r2").alias("worst_r2"),
        F.percentile("r2", F.array(F.lit(0.1), F.lit(0.9))).alias("_q"), F.max("r2").alias("_max"))
    many = F.col("windows") >= 4
    return a.select("ticker", "windows", "avg_r2", "median_r2", "clipped_avg_r2", "worst_r2",
                    F.when(many, F.col("_q")[0]).otherwise(F.col("worst_r2")).alias("band_low"), F.when(many, F.col("_q")[1]).otherwise(F.col("_max")).alias("band_high"))


def walk_forward_predictions(frame: DataFrame, y: str, xs: Sequence[str], alpha: float = 0.5, **kw) -> tuple[DataFrame, DataFrame]:
    """(predictions, coefficients): out-of-window predictions and the fitted model of each window."""
    d = with_windows(frame, **kw)
    e = S.expanding_sums(d, ["ticker"], "window", xs, y)
    m = e.withColumn("_m", S.ridge_udf("train", F.lit(alpha))).select("ticker", "window", "_m.*")
    p = S.predict(d, m, ["ticker", "window"], xs).select("ticker", "window", "date", F.col(y).alias("actual"), "predicted", "z")
    names = F.array(*[F.lit(x) for x in xs])
    c = m.select("ticker", "window", F.inline(F.arrays_zip(names.alias("factor"), F.col("coef").alias("coef"))))
    return p, c


def bootstrap_band(pred: DataFrame, draws: int = 200, confidence: float = 0.90, seed: int = 42) -> DataFrame:
    """(ticker, n, point, low, high, mean, std, draws) of R2 by circular block bootstrap with independent block starts.

    A block is a difference of running sums of y, y^2 and e^2, so a draw looks up two rows per block and no row is resampled. Starts are hashes of
    (seed, ticker, draw, block): the same on any partitioning. n rows give ceil(n / b) blocks of b = max(2, floor(sqrt(n))), the last one cut at n rows.
    """
    w, every = series("ticker"), whole("ticker")
    e = F.col("actual") - F.col("predicted")
    d = pred.select("ticker", "date", "actual", "predicted").withColumn("_n", F.count("*").over(every)).withColumn("_y", F.col("actual") - F.avg("actual").over(every)).where("_n >= 5")
    parts = {"y": F.col("_y"), "yy": F.col("_y") * F.col("_y"), "ee": e * e}
    upto = d.withColumn("_i", F.row_number().over(w)).select("ticker", "_i", *[F.sum(c).over(running(w)).alias(k) for k, c in parts.items()])
    point = d.groupBy("ticker").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"t_{k}") for k, c in parts.items()])
    b = F.greatest(F.lit(2), F.floor(F.sqrt("n")).cast("int"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "ticker", "draw", "block")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    blocks = point.select("ticker", "n", b.alias("b"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select(
        "*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("b")).cast("int") - 1)).alias("block"))
    blocks = blocks.withColumn("_from", F.floor(u * F.col("n"))).withColumn("_to", F.col("_from") + F.least("b", F.col("n") - F.col("block") * F.col("b")))
    # running sums at both ends, and once the whole series where a block passes its end
    ends = blocks.select("ticker", "draw", F.inline(F.array(
        F.struct(F.col("_from").alias("_i"), F.lit(-1).alias("sign")), F.struct(F.when(F.col("_to") > F.col("n"), F.col("_to") - F.col("n")).otherwise(F.col("_to")).alias("_i"), F.lit(1).alias("sign")),
        F.struct(F.when(F.col("_to") > F.col("n"), F.col("n")).otherwise(F.lit(0)).alias("_i"), F.lit(1).alias("sign"))))).where("_i > 0")
    sums = ends.join(upto, ["ticker", "_i"]).groupBy("ticker", "draw").agg(*[F.sum(F.col("sign") * F.col(k)).alias(k) for k in parts])
    spread = F.col("yy") / F.col("n") - (F.col("y") / F.col("n")) ** 2
    r2 = F.when(spread > 1e-12, F.greatest(F.lit(-10.0), F.least(F.lit(1.0), 1 - F.col("ee") / F.col("n") / spread)))
    each = sums.join(point, "ticker").select("ticker", r2.alias("r2"))
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    band = each.groupBy("ticker").agg(F.percentile("r2", F.array(F.lit(lo), F.lit(hi))).alias("q"), F.avg("r2").alias("mean"), F.stddev_pop("r2").alias("std"), F.count("r2").alias("draws"))
    whole_r2 = 1 - div("t_ee", "t_yy")
    return point.join(band, "ticker").select("ticker", "n", whole_r2.alias("point"), F.coalesce(F.col("q")[0], whole_r2).alias("low"), F.coalesce(F.col("q")[1], whole_r2).alias("high"),
                                             F.coalesce("mean", whole_r2).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"), "draws")


MAX_LAGS = 8


def unit_roots(levels: DataFrame, keys: Sequence[str] = ("ticker", "feature"), value: str = "x", max_lags: int = MAX_LAGS) -> DataFrame:
    """(keys, n, lags, kpss, adf) with lags = min(8, max(1, n // 50)).

    kpss: level stationarity with Bartlett weights. adf: t statistic of the level in a regression of the change on the level before and `lags` earlier changes.
    One placement of a series serves both: lagged levels give every product, one aggregate sums them.
    """
    keys = list(keys)
    w, every, v = series(keys), whole(keys), F.col(value)
    lagged = {f"_l{k}": F.lag(value, k).over(w) for k in range(1, max_lags + 2)}
    d = levels.where(v.isNotNull()).withColumns({"_i": F.row_number().over(w), "_sum": F.sum(value).over(running(w)), "_n": F.count(value).over(every), "_mean": F.avg(value).over(every), **lagged})
    lags = F.least(F.lit(max_lags), F.greatest(F.lit(1), F.floor(F.col("_n") / 50)))
    d = d.withColumns({"_k": lags, "_e": v - F.col("_mean"), "_s": F.col("_sum") - F.col("_i") * F.col("_mean")})
    long_run = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, max_lags + 1):
        product = F.col("_e") * (F.col(f"_l{k}") - F.col("_mean"))
        long_run = long_run + 2 * F.coalesce(F.sum(F.when(F.col("_k") >= k, product * (1 - k / (F.col("_k") + 1.0)))), F.lit(0.0))
    changes = [F.when(F.col("_k") >= k, F.col(f"_l{k}") - F.col(f"_l{k + 1}")).otherwise(0.0) for k in range(1, max_lags + 1)]
    z = [F.lit(1.0), F.col("_l1"), *changes, v - F.col("_l1")]
    inside = F.col("_i") > F.col("_k") + 1
    sums = F.array(*[F.sum(F.when(inside, z[i] * z[j])) for i in range(len(z)) for j in range(i, len(z))])
    a = d.groupBy(*keys).agg(F.max("_n").alias("n"), F.max("_k").cast("long").alias("lags"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), long_run.alias("_lr"), sums.alias("_p"))
    adf = F.when(F.col("_p")[0].isNotNull(), finite(S.first_t_udf("_p", F.col("lags") + 1)))
    return a.select(*keys, "n", "lags", div(F.col("_ss") / (F.col("n") * F.col("n")), F.col("_lr") / F.col("n")).alias("kpss"), adf.alias("adf"))


def stationarity(frame: DataFrame, columns: Sequence[str], min_rows: int = 20) -> DataFrame:
    """(ticker, feature, n, lags, adf, kpss, is_stationary) by critical values at 5 %; unknown below `min_rows`."""
    t = unit_roots(long_features(frame, columns, ["ticker", "date"]))
    ok = (F.col("adf") < ADF_CRITICAL) & (F.col("kpss") < KPSS_CRITICAL)
    return t.withColumn("is_stationary", F.when(F.col("n") >= min_rows, F.coalesce(ok, F.lit(False))))


def leakage(frame: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """(ticker, factor, n, corr, lead_corr, lag_corr, flags): near-perfect links and factors that know the future."""
    w = series(["ticker", "feature"])
    d = long_features(frame, factors, ["ticker", "date", y]).withColumn("_lead", F.lead("x").over(w)).withColumn("_lag", F.lag("x").over(w))
    a = d.groupBy("ticker", F.col("feature").alias("factor")).agg(
        F.count("*").alias("n"), finite(F.corr(y, "x")).alias("corr"), finite(F.corr(y, "_lead")).alias("lead_corr"), finite(F.corr(y, "_lag")).alias("lag_corr"),
        (F.count("*") - F.countDistinct("date")).alias("repeated"))
    margin = F.when(F.col("n") >= 60, 0.15).otherwise(0.25)
    flags = messages((F.col("repeated") > 0, "repeated_timestamps"), (F.abs("corr") > 0.995, "near_perfect_correlation"),
                     (F.abs("lead_corr") > F.abs("lag_corr") + margin, "possible_future_leakage"))
    return a.withColumn("flags", flags).drop("repeated")


def two_sided_p(r: Column, n: Column) -> Column:
    """Normal tail of Fisher's z of a correlation."""
    z = F.abs(F.atanh(r)) * F.sqrt(n - 3)
    x = z / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def false_discovery(links: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(ticker, factor, p_value, significant, flagged): Benjamini-Hochberg within a ticker."""
    d = links.where(F.col("corr").isNotNull()).withColumn("p_value", two_sided_p(F.col("corr"), F.col("n")))
    w = whole("ticker")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("p_value", "factor"))
    d = d.withColumn("_r", rank).withColumn("_m", F.count("*").over(w))
    d = d.withColumn("_top", F.max(F.when(F.col("p_value") <= F.col("_r") / F.col("_m") * alpha, F.col("_r"))).over(w))
    sig = F.coalesce(F.col("_r") <= F.col("_top"), F.lit(False))
    limit = F.when(F.col("n") >= 60, 0.95).otherwise(0.98)
    return d.select("ticker", "factor", "n", "corr", "p_value", sig.alias("significant"), (sig & (F.abs("corr") > limit)).alias("flagged"))


def rolling_extremes(frame: DataFrame, y: str, window: int = 24) -> DataFrame:
    w = series("ticker")
    d = frame.withColumn("_m", rolling(F.avg, y, w, window)).withColumn("_s", rolling(F.stddev_samp, y, w, window))
    return d.groupBy("ticker").agg(F.max("_m").alias("max_mean"), F.min("_m").alias("min_mean"), F.max("_s").alias("max_std"), F.min("_s").alias("min_std"))


def target_shift(split: DataFrame, y: str) -> DataFrame:
    tr, te = F.when(F.col("is_train"), F.col(y)), F.when(~F.col("is_train"), F.col(y))
    a = split.groupBy("ticker").agg(F.avg(tr).alias("_tm"), F.avg(te).alias("_em"), F.stddev_samp(tr).alias("_ts"), F.stddev_samp(te).alias("_es"))
    return a.select("ticker", (F.col("_em") - F.col("_tm")).alias("mean_shift"), (F.col("_es") - F.col("_ts")).alias("std_shift"),
                    (F.abs(F.col("_em") - F.col("_tm")) / F.greatest(F.abs("_ts"), F.lit(1e-9))).alias("normalized_shift"))


def concentration(coefs: DataFrame, keys: Sequence[str] = ("ticker",), factor: str = "factor", value: str = "coef") -> DataFrame:
    """Top factor, its share, share of the top three and the effective number of factors."""
    w = Window.partitionBy(*keys)
    d = coefs.withColumn("_w", div(F.abs(value), F.sum(F.abs(value)).over(w))).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_w"), factor)))
    return d.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col(factor))).alias("top_factor"), F.max("_w").alias("top_share"),
                                F.sum(F.when(F.col("_r") <= 3, F.col("_w"))).alias("top3_share"), div(F.lit(1.0), F.sum(F.col("_w") * F.col("_w"))).alias("effective_factors"))


def model_risk(t: DataFrame) -> DataFrame:
    """risk_score from leakage_flags, factors, stationary_ratio, normalized_shift and perf_r2."""
    one, zero = F.lit(1.0), F.lit(0.0)
    leak = F.least(one, F.col("leakage_flags") / F.greatest(F.lit(1), F.col("factors")))
    stat = F.coalesce(F.greatest(zero, 1 - F.col("stationary_ratio")), F.lit(0.5))
    stab = F.least(one, F.greatest(zero, F.col("normalized_shift") / 5.0))
    perf = F.coalesce(r2_risk("perf_r2"), one)
    w = RISK_WEIGHTS
    s = w["leakage"] * leak + w["stationarity"] * stat + w["stability"] * stab + w["performance"] * perf
    return t.withColumn("risk_score", F.least(one, F.greatest(zero, s)))


def trend_volatility(pred: DataFrame, window: int = 5) -> DataFrame:
    """Directional accuracy, R2 of rolling volatility and volatility ratio of predictions."""
    w = series("ticker")
    sign = F.signum(F.col("actual") - F.lag("actual").over(w)) == F.signum(F.col("predicted") - F.lag("predicted").over(w))
    d = pred.withColumn("_ok", sign).withColumn("_va", rolling(F.stddev_samp, "actual", w, window)).withColumn("_vp", rolling(F.stddev_samp, "predicted", w, window))
    e = F.col("_va") - F.col("_vp")
    a = d.groupBy("ticker").agg(F.avg(F.col("_ok").cast("double")).alias("direction"), F.sum(e * e).alias("_sse"), (F.var_pop("_va") * F.count("_va")).alias("_sst"),
                                F.stddev_samp("actual").alias("_sa"), F.stddev_samp("predicted").alias("_sp"))
    return a.select("ticker", "direction", (1 - div("_sse", "_sst")).alias("volatility_r2"), F.when(F.col("_sa") > 1e-12, F.col("_sp") / F.col("_sa")).alias("volatility_ratio"))


def freshness(meta: DataFrame, warn_days: int = 60) -> DataFrame:
    """Largest publication lag of a panel against the limit."""
    return meta.agg(F.coalesce(F.max("lag_rows"), F.lit(0)).alias("max_lag")).withColumn("aligned", F.col("max_lag") <= warn_days)


def stationary_ratio(tests: DataFrame, min_ratio: float = POLICY["min_stationary_ratio"]) -> DataFrame:
    """(ticker, considered, stationary, ratio, floor, ok); the floor is softer below four series."""
    a = tests.groupBy("ticker").agg(F.count("is_stationary").alias("considered"), F.count_if(F.col("is_stationary")).alias("stationary"))
    floor = F.when(F.col("considered") < 4, max(0.25, min_ratio - 0.10)).otherwise(min_ratio)
    return a.withColumn("ratio", div("stationary", "considered")).withColumn("floor", floor).withColumn("ok", F.coalesce(F.col("ratio") >= F.col("floor"), F.lit(True)))


def policy_for(tickers: DataFrame, overrides: DataFrame | None = None, regime: str = "normal") -> DataFrame:
    """One policy row per ticker: defaults, overrides of the ticker, then the regime's scaling."""
    p = tickers.select("ticker")
    if overrides is not None:
        have = [c for c in overrides.columns if c in POLICY]
        p = p.join(overrides.select("ticker", *[F.col(c).alias(f"_o_{c}") for c in have]), "ticker", "left")
    else:
        have = []
    for k, v in POLICY.items():
        p = p.withColumn(k, F.coalesce(F.col(f"_o_{k}"), F.lit(v)) if k in have else F.lit(v))
    p = p.drop(*[f"_o_{c}" for c in have])
    lo, hi = F.least("model_risk_warn_threshold", "model_risk_fail_threshold"), F.greatest("model_risk_warn_threshold", "model_risk_fail_threshold")
    p = p.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("model_risk_warn_threshold", F.col("_lo")).withColumn("model_risk_fail_threshold", F.col("_hi")).drop("_lo", "_hi")
    if regime in REGIME_SHIFT_FACTOR:
        p = p.withColumn("max_normalized_shift", F.col("max_normalized_shift") * REGIME_SHIFT_FACTOR[regime]).withColumn(
            "max_model_risk_score", F.least(F.lit(1.0), F.col("max_model_risk_score") + REGIME_RISK_EXTRA[regime]))
    if regime == "crisis":
        p = p.withColumn("min_r2", F.col("min_r2") - CRISIS_R2_RELIEF)
    return p


def gate(report: DataFrame, policy: DataFrame, hard_fail: bool = False) -> DataFrame:
    """Advisory and blocking reasons, severity and verdict per ticker.

    Report columns: oos_r2, r2_band_high, direction, volatility_r2, volatility_ratio, normalized_shift, leakage_flags, stationary_ratio,
    considered, wf_avg_r2, wf_band_high, windows_requested, windows_completed, top_share, max_lag, risk_score.
    """
    j = report.join(policy, "ticker")
    trend_ok = F.coalesce((F.col("direction") >= 0.55) & ((F.col("volatility_r2") >= 0) | F.col("volatility_ratio").between(0.5, 1.8)), F.lit(False))
    low = F.coalesce(F.col("oos_r2") < F.col("min_r2"), F.lit(False))
    ci = F.coalesce(F.col("r2_band_high") >= F.col("min_r2"), F.lit(False))
    r2_note = (F.when(ci, "oos_r2_low_but_band_clears").when(trend_ok, "oos_r2_low_but_trend_volatility_ok")
               .when(F.col("oos_r2") >= -0.10, "oos_r2_mildly_negative").otherwise("oos_r2_low"))
    wf_min = F.when(F.col("windows_completed") < F.col("windows_requested"), F.least(F.col("min_walk_forward_r2"), F.lit(-1.0))).otherwise(F.col("min_walk_forward_r2"))
    wf_low = F.coalesce(F.col("wf_avg_r2") < wf_min, F.lit(False))
    wf_note = (F.when(F.coalesce(F.col("wf_band_high") >= wf_min, F.lit(False)), "walk_forward_low_but_band_clears")
               .when((F.col("wf_avg_r2") < -5.0) & ~low, "walk_forward_unstable_but_oos_ok").otherwise("walk_forward_low"))
    floor = F.when(F.col("considered") < 4, F.greatest(F.lit(0.25), F.col("min_stationary_ratio") - 0.10)).otherwise(F.col("min_stationary_ratio"))
    gt = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.lit(False))
    advisory = messages((low, r2_note), (wf_low, wf_note), (gt("top_share", "factor_concentration_warn_threshold"), "factor_concentration"),
                        (gt("max_lag", "freshness_warn_days"), "publication_lag_exceeds_policy"), (gt("risk_score", "max_model_risk_score"), "model_risk_above_limit"))
    blocking = messages((gt("normalized_shift", "max_normalized_shift"), "mean_shift_above_limit"), (gt("leakage_flags", "max_leakage_flags"), "leakage_flags_above_limit"),
                        (F.coalesce((F.col("considered") > 0) & (F.col("stationary_ratio") < floor), F.lit(False)), "stationary_ratio_below_limit"))
    d = j.withColumn("advisory", advisory).withColumn("blocking", blocking)
    by_score = F.when(F.col("risk_score") >= F.col("model_risk_fail_threshold"), "fail").when(F.col("risk_score") >= F.col("model_risk_warn_threshold"), "warn").otherwise("pass")
    d = d.withColumn("_s", by_score)
    sev = F.when(F.col("_s") != "pass", F.col("_s")).when(F.size("advisory") > 0, "warn").when(F.size("blocking") > 0, "fail" if hard_fail else "warn").otherwise("pass")
    return d.select("ticker", "advisory", "blocking", sev.alias("severity"), ((F.size("blocking") == 0) | F.lit(not hard_fail)).alias("passed"), "risk_score", "wf_avg_r2")


def split_model(frame: DataFrame, y: str, xs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions of the test rows, coefficients in deviations of their factors): least squares on the train part, factors clipped by its quantiles."""
    split = clip_by_train(with_split(frame.select("ticker", "date", y, *xs)), xs)
    train = split.where("is_train")
    model = S.block_sums(train, ["ticker"], xs, y).withColumn("_m", S.ridge_udf("sums", F.lit(0.0))).select("ticker", "_m.*")
    predictions = S.predict(split.where("NOT is_train"), model, ["ticker"], xs).select("ticker", "date", F.col(y).alias("actual"), "predicted")
    names = F.array(*[F.lit(x) for x in xs])
    spread = train.groupBy("ticker").agg(F.array(*[F.stddev_pop(x) for x in xs]).alias("sd"))
    lines = F.arrays_zip(names.alias("factor"), F.zip_with("coef", "sd", lambda b, v: b * v).alias("coef"))
    return predictions, model.join(spread, "ticker").select("ticker", F.inline(lines))


def governance_report(frame: DataFrame, y: str, xs: Sequence[str], publication_lags: DataFrame, windows: int = 4, draws: int = 100) -> DataFrame:
    """What the gate reads, per ticker, from the model itself: test score with its band, walk-forward windows, leakage, shift of the target,
    unit-root tests of target and factors, concentration and risk. publication_lags: (ticker, max_lag).
    """
    frame = stage(frame.select("ticker", "date", y, *xs))
    predictions, coefs = split_model(frame, y, xs)
    predictions = stage(predictions)
    wf = walk_forward_summary(walk_forward(frame, y, xs, windows)).select("ticker", F.col("avg_r2").alias("wf_avg_r2"), F.col("clipped_avg_r2").alias("perf_r2"), F.col("band_high").alias("wf_band_high"), F.col("windows").alias("windows_completed"))
    links = stage(leakage(frame, y, xs))
    found = false_discovery(links).groupBy("ticker").agg(F.count_if("flagged").alias("_found"))
    leaks = links.groupBy("ticker").agg(F.sum(F.size("flags")).alias("_flags"), F.count("*").alias("factors")).join(found, "ticker", "left")
    leaks = leaks.select("ticker", "factors", (F.col("_flags") + F.coalesce("_found", F.lit(0))).alias("leakage_flags"))
    tests = stationary_ratio(stationarity(frame, [y, *xs])).select("ticker", "considered", F.col("ratio").alias("stationary_ratio"))
    parts = [regression_metrics(predictions).select("ticker", F.col("r2").alias("oos_r2")), bootstrap_band(predictions, draws).select("ticker", F.col("high").alias("r2_band_high")),
             trend_volatility(predictions), target_shift(with_split(frame), y).select("ticker", "normalized_shift"), tests, wf, concentration(coefs), publication_lags]
    out = leaks
    for part in parts:
        out = out.join(part, "ticker", "left")
    out = out.withColumns({"perf_r2": F.coalesce("perf_r2", "oos_r2"), "windows_requested": F.lit(windows), "windows_completed": F.coalesce("windows_completed", F.lit(0))})
    return model_risk(out)


SEVERITY_RANK = {"pass": 0, "warn": 1, "fail": 2}


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "fail", 2).when(F.col(c) == "warn", 1).otherwise(0)


def append_decisions(decisions: DataFrame, path: str, run_id: str) -> None:
    decisions.withColumn("run_id", F.lit(run_id)).withColumn("decided_at", F.current_timestamp()).write.mode("append").parquet(path)


def worst_decision(decisions: DataFrame) -> DataFrame:
    """(run_id, ticker, severity, decisions): the worst decision of each run, the higher risk first on a tie."""
    best = F.max(F.struct(severity_rank().alias("r"), F.col("risk_score"), F.col("ticker"), F.col("severity")))
    return decisions.groupBy("run_id").agg(best.alias("_b"), F.count("*").alias("decisions")).select(
        "run_id", F.col("_b.ticker").alias("ticker"), F.col("_b.severity").alias("severity"), F.col("_b.risk_score").alias("risk_score"), "decisions")


def decision_trend(decisions: DataFrame, last_n: int = 20, key: str = "ticker", order: str = "run_id") -> DataFrame:
    """Pass rate, severity counts, mean risk, worst walk-forward R2 and direction over the last n decisions per key."""
    w = Window.partitionBy(key)
    d = decisions.withColumn("_b", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("_b") <= last_n)
    d = d.withColumn("_known", F.count("risk_score").over(w)).withColumn("_pos", F.count("risk_score").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    early = F.col("_pos") <= F.floor(F.col("_known") / 2)
    sev = lambda s: F.count_if(F.col("severity") == s)
    a = d.groupBy(key).agg(F.count("*").alias("decisions"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), sev("pass").alias("n_pass"), sev("warn").alias("n_warn"),
                           sev("fail").alias("n_fail"), F.avg("risk_score").alias("mean_risk"), F.min("wf_avg_r2").alias("worst_r2"), F.max("_known").alias("_k"),
                           F.avg(F.when(~early, F.col("risk_score"))).alias("_late"), F.avg(F.when(early, F.col("risk_score"))).alias("_early"))
    delta = F.col("_late") - F.col("_early")
    way = F.when(F.col("_k") < 4, "stable").when(delta > 0.05, "deteriorating").when(delta < -0.05, "improving").otherwise("stable")
    return a.withColumn("direction", way).drop("_k", "_late", "_early")


def split_blocked(results: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("ticker",)) -> tuple[DataFrame, DataFrame]:
    """(allowed, blocked) rows of a result table by failed keys."""
    failed = decisions.where((F.col("severity") == "fail") | ~F.col("passed")).select(*keys).distinct()
    return results.join(failed, list(keys), "left_anti"), results.join(failed, list(keys), "left_semi")
