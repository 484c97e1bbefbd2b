"""Risk measures per ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import ffill, log_ratio, series, whole


def close_returns(prices: DataFrame) -> DataFrame:
    """Adds r, the unclipped log return of the close."""
    return prices.withColumn("r", log_ratio("close", F.lag("close").over(series("ticker"))))


def ewm_volatility(df: DataFrame, span: int = 30, min_rows: int = 15) -> DataFrame:
    """(ticker, ewm_vol): bias-corrected exponentially weighted std at the last row, in closed form."""
    a = 2.0 / (span + 1.0)
    age = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))) - 1
    d = df.where(F.col("r").isNotNull()).withColumn("_w", F.pow(F.lit(1.0 - a), age))
    s = d.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_w")).alias("w2"),
                                F.sum(F.col("_w") * F.col("r")).alias("wx"), F.sum(F.col("_w") * F.col("r") * F.col("r")).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    var = (F.col("wxx") / F.col("w") - mean * mean) * F.try_divide(F.col("w") * F.col("w"), F.col("w") * F.col("w") - F.col("w2"))
    return s.select("ticker", F.when(F.col("n") >= min_rows, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("ewm_vol"))


def regime_moments(df: DataFrame, factor: str, mode: str = "auto", hi: float = 0.8, lo: float = 0.2, min_rows: int = 30) -> DataFrame:
    """(ticker, scenario, sample, mu, sigma): moments on rows of the high or low regime of the factor.

    `auto` takes the side the latest value lies on. With too few rows the full-sample moments stand.
    """
    d = df.withColumn("_m", ffill(factor, series("ticker")))
    q = F.percentile("_m", F.array(F.lit(hi), F.lit(lo))).over(whole("ticker"))
    d = d.withColumn("_q", q).withColumn("_hi", F.col("_q")[0]).withColumn("_lo", F.col("_q")[1])
    latest = F.max_by("_m", "date").over(whole("ticker"))
    high = {"high": F.lit(True), "low": F.lit(False)}.get(mode, latest >= F.col("_hi"))
    d = d.withColumn("_high", high)
    mask = F.when(F.col("_high"), F.col("_m") >= F.col("_hi")).otherwise(F.col("_m") <= F.col("_lo"))
    r = F.when(mask, F.col("r"))
    a = d.groupBy("ticker").agg(F.first("_high").alias("_h"), F.count(r).alias("sample"), F.avg("r").alias("_mu"), F.stddev_samp("r").alias("_sd"),
                                F.avg(r).alias("_cmu"), F.stddev_samp(r).alias("_csd"))
    use = F.col("sample") >= min_rows
    return a.select("ticker", F.when(F.col("_h"), "high").otherwise("low").alias("scenario"), "sample",
                    F.when(use, F.col("_cmu")).otherwise(F.col("_mu")).alias("mu"), F.when(use, F.col("_csd")).otherwise(F.col("_sd")).alias("sigma"))


def historical_var(df: DataFrame, ret: str = "r", level: float = 0.05) -> DataFrame:
    """(ticker, var, es): the 5 % quantile of returns and the mean at or below it, as positive numbers."""
    q = F.percentile(ret, F.lit(level)).over(whole("ticker"))
    return df.withColumn("_q", q).groupBy("ticker").agg(
        F.abs(F.first("_q")).alias("var"), F.abs(F.avg(F.when(F.col(ret) <= F.col("_q"), F.col(ret)))).alias("es"))


def parametric_var(moments: DataFrame, mu: str = "mu", sigma: str = "sigma") -> DataFrame:
    return moments.withColumn("var", F.abs(F.col(mu) + F.col(sigma) * X.Z_05)).withColumn("es", F.abs(F.col(mu) - F.col(sigma) * X.ES_FACTOR_05))


def risk_inputs(df: DataFrame, factor: str | None) -> DataFrame:
    """(ticker, last_price, drift, volatility, ewm_vol) from which scenarios and paths start."""
    base = df.groupBy("ticker").agg(F.max_by("close", "date").alias("last_price"), F.stddev_samp("r").alias("_base"), F.avg("r").alias("_mu"))
    ewm = ewm_volatility(df)
    j = base.join(ewm, "ticker")
    j = j.withColumn("ewm_vol", F.when(F.col("ewm_vol") > 0, F.col("ewm_vol")).otherwise(F.col("_base")))
    if factor:
        j = j.join(regime_moments(df, factor).select("ticker", "scenario", "mu", "sigma"), "ticker")
    else:
        j = j.withColumn("scenario", F.lit("baseline")).withColumn("mu", F.col("_mu")).withColumn("sigma", F.col("_base"))
    sigma = F.greatest("ewm_vol", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.col("ewm_vol")))
    return j.select("ticker", "scenario", "last_price", F.col("mu").alias("drift"), sigma.alias("volatility"), "ewm_vol")


def each_scenario() -> Column:
    """The fixed scenario list as an exploded literal."""
    return F.explode(F.array(*[F.struct(F.lit(s).alias("stress"), F.lit(d).alias("drift_shift"), F.lit(v).alias("vol_multiplier"), F.lit(j).alias("jump_shock"))
                               for s, _, d, v, j, _ in X.SCENARIOS])).alias("_s")


def scenario_bias(inputs: DataFrame) -> DataFrame:
    """Drift, volatility and first-day jump per (ticker, stress scenario)."""
    d = inputs.select("*", each_scenario()).select(*inputs.columns, "_s.*")
    return d.withColumn("drift", F.col("drift") + F.col("drift_shift")).withColumn(
        "volatility", F.col("volatility") * F.greatest(F.lit(0.1), F.col("vol_multiplier")))
