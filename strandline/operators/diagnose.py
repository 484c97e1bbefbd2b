"""Residual and drift diagnostics on predictions(ticker, date, actual, predicted) and coefficient windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div, finite, series, values_table, whole
from .relate import lag_scan

# --- fixed values: limits, critical values, penalties ------------------------------------------------
CHI2_95 = {1: 3.84, 2: 5.99, 3: 7.81, 4: 9.49, 5: 11.07, 6: 12.59, 7: 14.07, 8: 15.51, 9: 16.92, 10: 18.31}
PENALTIES = (
    ("SCALING_ISSUE", 6.0, "Near-zero mean returns make elasticity scaling unstable."),
    ("POOR_RISK_ADJ", 8.0, "Residuals look like noise: annualised Sharpe below -0.5."),
    ("EXCESS_DRAWDOWN", 6.0, "A stress scenario moves returns by more than 20 %."),
    ("REGIME_INSTABILITY", 5.0, "Rolling elasticity varies with the regime."),
    ("STALE_DATA", 4.0, "The test window lies too far back."),
    ("DIST_SHIFT", 6.0, "Early and recent residuals differ in distribution."),
    ("RESIDUAL_AUTOCORR", 4.0, "Residuals are serially correlated."),
    ("CI_QUALITY", 4.0, "The confidence band is degenerate or too wide."),
    ("SIGN_INSTABILITY", 4.0, "Elasticity changes sign too often."),
    ("UNCERTAINTY_GAP", 3.0, "Tail risk is understated against residuals."),
    ("PIPELINE_ROBUSTNESS", 5.0, "The run shows retries, schema errors or partial writes."),
    ("TEMPORAL_INTEGRITY", 7.0, "Train and test periods overlap or leave a gap."),
    ("BACKTEST_REALISM", 5.0, "Costs are missing or turnover is excessive."),
    ("EXPLAINABILITY_RISK", 4.0, "One factor dominates or contradicts its prior sign."),
    ("FEATURE_SHIFT", 6.0, "Features drift between train and test."),
    ("RESIDUAL_HETERO", 4.0, "Residual variance depends on the prediction."),
    ("COVERAGE_CALIBRATION", 5.0, "The 90 % band covers too little or too much."),
    ("SHAP_STABILITY", 4.0, "Feature importance changes between windows."),
    ("COEFF_CI_OVERLAP", 4.0, "Coefficient bands of consecutive windows do not overlap."),
    ("MULTICOLLINEARITY", 4.0, "Factors are collinear."),
    ("OUTLIERS", 12.0, "Too many outliers were clipped."),
)
# penalties that grow with what is found: these are the greatest
SCALED_PENALTIES = (
    ("DATA_GAPS", 35.0, "Sources are missing or entities failed."),
    ("LOOKAHEAD_BIAS", 20.0, "Factors know future returns."),
)
ANN = 252.0 ** 0.5


def residuals(pred: DataFrame) -> DataFrame:
    return pred.withColumn("e", F.col("actual") - F.col("predicted"))


def residual_ratios(res: DataFrame) -> DataFrame:
    """Annualised Sharpe and Sortino of residuals (population std), NULL below five rows."""
    down = F.when(F.col("e") < 0, F.col("e"))
    a = res.groupBy("ticker").agg(F.count("e").alias("n"), F.avg("e").alias("m"), F.stddev_pop("e").alias("s"), F.when(F.count(down) > 1, F.stddev_pop(down)).alias("d"))
    ok = F.col("n") >= 5
    return a.select("ticker", F.when(ok, div("m", "s") * ANN).alias("sharpe"), F.when(ok, div("m", F.coalesce("d", "s")) * ANN).alias("sortino"))


def worst_shock(impacts: DataFrame, limit: float = 0.20) -> DataFrame:
    return impacts.groupBy("ticker").agg(F.max(F.abs("impact")).alias("worst")).withColumn("exceeds", F.col("worst") > limit)


def high_vif(vif: DataFrame, limit: float = 5.0) -> DataFrame:
    return vif.groupBy("ticker").agg(F.max("vif").alias("max_vif"), F.array_sort(F.collect_list(F.when(F.col("vif") > limit, F.col("factor")))).alias("offenders"))


def regime_stability(rolling: DataFrame, value: str = "elasticity", resamples: int = 200, level: float = 0.95) -> DataFrame:
    """(ticker, n, cv, robust_cv, band_high, limit, stable) of rolling elasticities; the limit tightens with the sample.

    The verdict uses the upper bound of a bootstrap band of the robust ratio. A resample's picks are hashes of (ticker,
    resample, draw), so they are the same on any partitioning; a series is calendar-bound, and draws meet rows by equality.
    """
    ratio = lambda q: F.when(F.abs(q[1]) > 1e-10, (q[2] - q[0]) / F.abs(q[1]))
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = rolling.groupBy("ticker").agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), quartiles.alias("q"))
    lim = F.round(F.greatest(F.lit(2.5), 4.0 * F.greatest(F.lit(0.5), 1.0 - (F.col("n") - 8) * 0.02)), 2)
    d = rolling.where(F.col(value).isNotNull()).select("ticker", value, F.row_number().over(series("ticker")).cast("long").alias("_i"), F.count("*").over(whole("ticker")).alias("_n"))
    d = d.repartition("ticker")
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "ticker", "_b", "_i")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    picks = d.select("ticker", "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_b")).select("ticker", "_b", (F.floor(u * F.col("_n")) + 1).alias("_i"))
    each = picks.join(d.select("ticker", "_i", value), ["ticker", "_i"]).groupBy("ticker", "_b").agg(quartiles.alias("q"))
    band = each.select("ticker", ratio(F.col("q")).alias("r")).groupBy("ticker").agg(F.percentile("r", F.lit(level)).alias("band_high"))
    out = a.select("ticker", "n", F.when(F.abs("m") > 1e-10, F.col("s") / F.abs("m")).alias("cv"), ratio(F.col("q")).alias("robust_cv"), lim.alias("limit"))
    return out.join(band, "ticker", "left").withColumn("stable", F.coalesce("band_high", "robust_cv") < F.col("limit"))


def staleness(pred: DataFrame, as_of: str) -> DataFrame:
    lag = F.datediff(F.lit(as_of).cast("date"), F.max("date"))
    return pred.groupBy("ticker").agg(lag.cast("long").alias("lag_days")).withColumn("stale", F.col("lag_days") > F.when(F.col("lag_days") > 30, 21).otherwise(14))


def residual_shift(res: DataFrame, min_rows: int = 40) -> DataFrame:
    """First against last quarter of residuals: std ratio and mean shift."""
    w = Window.partitionBy("ticker")
    d = res.withColumn("_i", F.row_number().over(w.orderBy("date"))).withColumn("_n", F.count("*").over(w))
    d = d.withColumn("_k", F.greatest(F.lit(10), F.floor(F.col("_n") / 4)))
    early, late = F.when(F.col("_i") <= F.col("_k"), F.col("e")), F.when(F.col("_i") > F.col("_n") - F.col("_k"), F.col("e"))
    a = d.groupBy("ticker").agg(F.count("*").alias("n"), div(F.stddev_pop(late), F.stddev_pop(early)).alias("std_ratio"), F.abs(F.avg(late) - F.avg(early)).alias("mean_shift")).where(F.col("n") >= min_rows)
    return a.withColumn("shifted", F.coalesce((F.col("std_ratio") > 1.8) | (F.col("std_ratio") < 0.55), F.lit(False)) | (F.col("mean_shift") > 0.02))


def lag_one(res: DataFrame, limit: float = 0.2) -> DataFrame:
    d = res.withColumn("_p", F.lag("e").over(series("ticker")))
    return d.groupBy("ticker").agg(F.count("e").alias("n"), finite(F.corr("e", "_p")).alias("lag1")).withColumn("problem", F.when(F.col("n") >= 20, F.abs("lag1") > limit))


def band_quality(bands: DataFrame) -> DataFrame:
    width = F.col("high") - F.col("low")
    return bands.withColumn("reason", F.when(width <= 1e-6, "degenerate_interval").when(width > 0.6, "too_wide_interval").when(F.col("std") == 0, "zero_bootstrap_std"))


def sign_flips(rolling: DataFrame, value: str = "elasticity", limit: float = 0.4) -> DataFrame:
    d = rolling.where(F.col(value) != 0).withColumn("_f", (F.signum(value) != F.lag(F.signum(value)).over(series("ticker"))).cast("double"))
    return d.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("_f").alias("flip_ratio")).withColumn("unstable", F.when(F.col("n") >= 6, F.col("flip_ratio") > limit))


def tail_gap(res: DataFrame, tail: DataFrame) -> DataFrame:
    """CVaR below half of the P95 absolute residual understates the tail; tail(ticker, cvar)."""
    a = res.groupBy("ticker").agg(F.percentile(F.abs("e"), F.lit(0.95)).alias("p95_abs"))
    return a.join(tail, "ticker", "left").withColumn("gap", F.col("cvar").isNull() | (F.abs("cvar") < 0.5 * F.col("p95_abs")))


def split_integrity(bounds: DataFrame, max_gap: int = 30) -> DataFrame:
    r = (F.when(F.col("train_end") >= F.col("test_start"), "overlap").when((F.col("train_start") >= F.col("train_end")) | (F.col("test_start") >= F.col("test_end")), "not_monotonic")
         .when(F.datediff("test_start", "train_end") > max_gap, "excessive_gap"))
    return bounds.withColumn("reason", r)


def explainability(coefs: DataFrame, priors: Sequence[tuple[str, int]], limit: float = 0.85) -> DataFrame:
    """(ticker, top_factor, top_share, contradictions, problem): dominance and signs against a prior table."""
    p = values_table(coefs.sparkSession, ("factor", "prior"), priors)
    d = coefs.withColumn("_s", div(F.abs("coef"), F.sum(F.abs("coef")).over(whole("ticker")))).join(F.broadcast(p), "factor", "left")
    a = d.groupBy("ticker").agg(F.max_by("factor", "_s").alias("top_factor"), F.max("_s").alias("top_share"), F.count_if((F.col("coef") != 0) & (F.signum("coef") != F.col("prior"))).alias("contradictions"))
    return a.withColumn("problem", (F.col("top_share") > limit) | (F.col("contradictions") > 0))


def ks_statistic(sides: DataFrame, keys: Sequence[str] = ("ticker", "feature")) -> DataFrame:
    """(keys, ks): two-sample Kolmogorov-Smirnov of x between is_train and the rest, ties taken together."""
    g = whole(list(keys))
    upto = Window.partitionBy(*keys).orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    tr, te = F.col("is_train"), ~F.col("is_train")
    d = sides.where(F.col("x").isNotNull())
    d = d.withColumn("_a", div(F.count_if(tr).over(upto), F.count_if(tr).over(g))).withColumn("_b", div(F.count_if(te).over(upto), F.count_if(te).over(g)))
    return d.groupBy(*keys).agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("ks"))


def stability_index(sides: DataFrame, keys: Sequence[str] = ("ticker", "feature"), bins: int = 10) -> DataFrame:
    """(keys, psi): population stability over quantile bins of the train side; 0 when too few edges remain."""
    q = F.percentile(F.when(F.col("is_train"), F.col("x")), F.array(*[F.lit(i / bins) for i in range(bins + 1)])).over(whole(list(keys)))
    d = sides.where(F.col("x").isNotNull()).withColumn("_e", F.array_distinct(q)).withColumn("_n", F.size("_e"))
    pos = F.size(F.filter("_e", lambda e: e <= F.col("x")))
    pos = F.when(F.col("x") == F.element_at("_e", -1), F.col("_n") - 1).otherwise(pos)
    d = d.withColumn("_b", F.when((pos >= 1) & (pos < F.col("_n")), pos))
    cells = d.where(F.col("_b").isNotNull()).groupBy(*keys, "_n", "_b").agg(F.count_if("is_train").alias("_t"), F.count_if(~F.col("is_train")).alias("_c"))
    # every bin counts, also those no row falls into: both shares are floored, so an empty bin adds nothing
    w = Window.partitionBy(*keys)
    share = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col(c) / F.greatest(F.lit(1), F.sum(c).over(w))))
    s = cells.withColumn("_bt", share("_t")).withColumn("_bc", share("_c"))
    s = s.withColumn("_v", (F.col("_bc") - F.col("_bt")) * F.log(F.col("_bc") / F.col("_bt")))
    return s.groupBy(*keys).agg(F.when(F.max("_n") < 4, 0.0).otherwise(F.sum("_v")).alias("psi"))


def ljung_box(res: DataFrame, max_lag: int = 10) -> DataFrame:
    """(ticker, n, lags, q, critical, flagged)."""
    n = res.groupBy("ticker").agg(F.count("e").alias("n"))
    scan = lag_scan(res, "e", "e", max_lag, min_pairs=2, min_lag=1).drop("n").join(n, "ticker")
    scan = scan.withColumn("lags", F.least(F.lit(max_lag), F.greatest(F.lit(2), F.floor(F.col("n") / 8)))).where(F.col("lag") <= F.col("lags"))
    a = scan.groupBy("ticker", "n", "lags").agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("corr") * F.col("corr") / F.greatest(F.lit(1), F.col("n") - F.col("lag")))).alias("q"))
    crit = F.create_map(*[F.lit(float(x)) if i % 2 else F.lit(int(x)) for kv in CHI2_95.items() for i, x in enumerate(kv)])[F.col("lags").cast("int")]
    return a.withColumn("critical", crit).withColumn("flagged", F.col("q") > F.col("critical"))


def heteroskedasticity(res: DataFrame, limit: float = 3.84) -> DataFrame:
    e2 = F.col("e") * F.col("e")
    a = res.groupBy("ticker").agg(F.count("e").alias("n"), (finite(F.regr_r2(e2, "predicted")) * F.count("e")).alias("lm"))
    return a.withColumn("flagged", F.col("lm") > limit)


def band_coverage(res: DataFrame, z: float = 1.645, target: float = 0.90, tolerance: float = 0.08) -> DataFrame:
    d = res.withColumn("_s", F.stddev_pop("e").over(whole("ticker")))
    a = d.groupBy("ticker").agg(F.count("e").alias("n"), F.avg((F.abs("e") <= z * F.col("_s")).cast("double")).alias("coverage"))
    return a.withColumn("problem", F.abs(F.col("coverage") - target) > tolerance)


def importance_drift(coefs: DataFrame, keys: Sequence[str] = ("ticker",), window: str = "window") -> DataFrame:
    """(keys, mean_l1, flip_ratio, problem) of normalised importance between consecutive windows."""
    k = [*keys, window]
    s = coefs.groupBy(*k, "factor").agg(F.sum(F.abs("coef")).alias("_a")).withColumn("_s", div("_a", F.sum("_a").over(Window.partitionBy(*k))))
    nxt = s.select(*keys, (F.col(window) + 1).alias(window), "factor", F.col("_s").alias("_p"))
    known = s.select(*k).distinct()
    pairs = known.join(known.select(*keys, (F.col(window) + 1).alias(window)), k)
    zero = F.lit(0.0)
    l1 = s.select(*k, "factor", "_s").join(nxt, [*k, "factor"], "full_outer").join(pairs, k, "left_semi").groupBy(*k).agg(F.sum(F.abs(F.coalesce("_s", zero) - F.coalesce("_p", zero))).alias("l1"))
    top = s.groupBy(*k).agg(F.max_by("factor", F.struct("_s", "factor")).alias("top"))
    flip = top.withColumn("_f", (F.col("top") != F.lag("top").over(Window.partitionBy(*keys).orderBy(window))).cast("double")).groupBy(*keys).agg(F.avg("_f").alias("flip_ratio"))
    a = l1.groupBy(*keys).agg(F.avg("l1").alias("mean_l1")).join(flip, list(keys))
    return a.withColumn("problem", (F.col("mean_l1") > 0.9) | (F.col("flip_ratio") > 0.6))


def band_overlap(bands: DataFrame, keys: Sequence[str] = ("ticker", "factor"), window: str = "window") -> DataFrame:
    """(keys, pairs, overlap_ratio, problem) of coefficient bands (lo, hi) of consecutive windows."""
    w = Window.partitionBy(*keys).orderBy(window)
    over = ~((F.lag("hi").over(w) < F.col("lo")) | (F.col("hi") < F.lag("lo").over(w)))
    a = bands.withColumn("_o", over.cast("double")).groupBy(*keys).agg(F.count("_o").alias("pairs"), F.avg("_o").alias("overlap_ratio"))
    return a.withColumn("problem", (F.col("pairs") >= 2) & F.coalesce(F.col("overlap_ratio") < 0.5, F.lit(False)))


def backtest_realism(rows: DataFrame, position: str = "signal", has_costs: bool = True, limit: float = 3.0) -> DataFrame:
    """(ticker, turnover, reason): yearly turnover of a position series and whether costs were assumed."""
    d = rows.withColumn("_c", F.abs(F.col(position) - F.coalesce(F.lag(position).over(series("ticker")), F.lit(0.0))))
    a = d.groupBy("ticker").agg((F.sum("_c") / F.greatest(F.count("*") / 252.0, F.lit(1.0))).alias("turnover"))
    return a.withColumn("reason", F.lit("missing_costs") if not has_costs else F.when(F.col("turnover") > limit, "excessive_turnover"))


def run_robustness(ops: DataFrame, by: str = "component", retry_limit: int = 10) -> DataFrame:
    """(by, retries, failures, reason): retries are repeats of a failed operation by the same component."""
    a = ops.groupBy(by, "operation").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("f")).groupBy(by).agg(
        F.sum(F.greatest(F.col("f") - 1, F.lit(0))).alias("retries"), F.sum("f").alias("failures"))
    return a.withColumn("reason", F.when(F.col("retries") >= retry_limit, "retry_storm").when(F.col("failures") > 0, "failures"))


def worst_outlier_share(report: DataFrame) -> DataFrame:
    return report.where(F.col("status") == "success").agg(F.max(div("outliers", "n_rows")).alias("outlier_ratio"))


def diagnose(findings: DataFrame, keys: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, score, findings, limits) for every row of `keys`: 100 minus the penalty of each finding, 100 without any.

    A finding counts once per key, also if several checks raise it; its own `penalty`, if not NULL, replaces the fixed one.
    """
    p = values_table(findings.sparkSession, ("finding", "fixed", "limit_text"), (*PENALTIES, *SCALED_PENALTIES))
    own = F.max("penalty") if "penalty" in findings.columns else F.lit(None).cast("double")
    j = findings.groupBy(key, "finding").agg(own.alias("own")).join(F.broadcast(p), "finding").withColumn("penalty", F.coalesce("own", "fixed"))
    a = j.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.sum("penalty"))).alias("score"), F.array_sort(F.collect_set("finding")).alias("findings"), F.array_sort(F.collect_set("limit_text")).alias("limits"))
    none = F.array().cast("array<string>")
    return keys.join(a, key, "left").select(key, F.coalesce("score", F.lit(100.0)).alias("score"), F.coalesce("findings", none).alias("findings"), F.coalesce("limits", none).alias("limits"))


def finding(table: DataFrame, flag: Column | str, name: str, key: str = "ticker", penalty: Column | None = None) -> DataFrame:
    own = F.lit(None) if penalty is None else penalty
    return table.where(flag).select(key, F.lit(name).alias("finding"), own.cast("double").alias("penalty"))


def run_findings(*checks: tuple[str, DataFrame]) -> DataFrame:
    """(finding, penalty) of checks on the whole run: each table holds one row, its penalty, NULL where nothing was found."""
    rows = [t.select(F.lit(name).alias("finding"), F.col(t.columns[0]).cast("double").alias("penalty")) for name, t in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where(F.col("penalty").isNotNull())


def data_gap_penalty(report: DataFrame, sources: DataFrame) -> DataFrame:
    """8 for each missing source, at most 20, and 1 for each failed entity, at most 15; NULL for neither."""
    failed = report.agg(F.count_if(F.col("status") == "failed").alias("failed"))
    missing = sources.agg(F.count_if("missing").alias("missing"))
    total = F.least(F.lit(20.0), 8.0 * F.col("missing")) + F.least(F.lit(15.0), F.col("failed").cast("double"))
    return failed.crossJoin(missing).select(F.when(total > 0, total).alias("penalty"))


def outlier_penalty(share: DataFrame, limit: float = 0.05) -> DataFrame:
    """100 times the worst share of clipped rows, at most 12; NULL up to the limit."""
    r = F.col("outlier_ratio")
    return share.select(F.when(r > limit, F.least(F.lit(12.0), r * 100)).alias("penalty"))


def robustness_penalty(runs: DataFrame, penalty: float = 5.0) -> DataFrame:
    return runs.agg(F.when(F.count("reason") > 0, penalty).alias("penalty"))


def feature_shift(ks: DataFrame, psi: DataFrame, sides: DataFrame, limit: float = 0.2, min_rows: int = 30) -> DataFrame:
    """(ticker, feature, shifted): features with enough rows on both sides of the split."""
    n = sides.where(F.col("x").isNotNull()).groupBy("ticker", "feature").agg(F.count_if("is_train").alias("a"), F.count_if(~F.col("is_train")).alias("b"))
    d = n.where((F.col("a") >= min_rows) & (F.col("b") >= min_rows)).join(ks, ["ticker", "feature"], "left").join(psi, ["ticker", "feature"], "left")
    return d.select("ticker", "feature", (F.coalesce(F.col("ks") > limit, F.lit(False)) | F.coalesce(F.col("psi") > limit, F.lit(False))).alias("shifted"))


def lookahead_count(links: DataFrame) -> DataFrame:
    """(ticker, n): factors that know future returns, from leakage()."""
    return links.groupBy("ticker").agg(F.count_if(F.array_contains("flags", "possible_future_leakage")).alias("n"))
