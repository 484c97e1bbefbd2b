"""Relations (REL) and risk measures (RSK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import rounded, values_sql
from ..operators import gold as G
from ..operators import relate as R
from ..operators import risk as K
from ..operators import transforms as T
from ..sources import bindings as B
from .ctes import cte, sql
from .q_gold import MAC, PANEL, master, panel, supervised
from .registry import query

PAIRS = [(a, b) for i, a in enumerate(PANEL) for b in PANEL[i + 1:]]
cte("cm_half", " UNION ALL ".join(f"SELECT ticker, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM panel_ok GROUP BY 1" for a, b in PAIRS), "panel_ok")
cte("cm", "SELECT ticker, a AS row_name, b AS col_name, c AS corr FROM cm_half UNION ALL SELECT ticker, b, a, c FROM cm_half UNION ALL "
    + " UNION ALL ".join(f"SELECT DISTINCT ticker, '{a}', '{a}', 1.0 FROM panel_ok" for a in PANEL), "cm_half", "panel_ok")


@query("rel1_correlation_matrix", sql("SELECT ticker, row_name, col_name, round(corr, 6) AS corr FROM cm", "cm"))
def _(spark, d):
    return rounded(R.correlation_matrix(panel(spark, d), PANEL))


@query("rel2_stressed_matrix", sql("SELECT ticker, row_name, col_name, round(CASE WHEN row_name = col_name THEN 1.0 ELSE corr + 0.35 * (0.85 - corr) END, 6) AS corr FROM cm", "cm"))
def _(spark, d):
    return rounded(R.stressed_matrix(R.correlation_matrix(panel(spark, d), PANEL), 0.35))


@query("rel3_cross_ticker", sql("""SELECT a.ticker AS one, b.ticker AS two, count(*) AS n, round(corr(a.log_return, b.log_return), 6) AS corr
    FROM ret_day a JOIN ret_day b ON a.date = b.date AND a.ticker < b.ticker WHERE a.log_return IS NOT NULL AND b.log_return IS NOT NULL GROUP BY 1, 2""", "ret_day"))
def _(spark, d):
    r = G.with_returns(B.bars(spark, d, "p_brand", "day"))
    return rounded(R.cross_ticker_matrix(r, block=8))


cte("links", " UNION ALL ".join(f"SELECT ticker, '{c}' AS feature, corr(log_return, {c}) AS corr FROM panel_ok GROUP BY 1" for c in MAC), "panel_ok")


@query("rel4_macro_links", sql("SELECT ticker, feature, round(corr, 6) AS corr, row_number() OVER (PARTITION BY ticker ORDER BY abs(corr) DESC, feature) AS place FROM links", "links"))
def _(spark, d):
    return rounded(R.target_links(panel(spark, d), "log_return", MAC))


cte("sup1", "SELECT ticker, date, y, inflation AS x FROM panel WHERE y IS NOT NULL AND inflation IS NOT NULL", "panel")
ELAST = """SELECT ticker, count(*) AS n, covar_samp(y, x) / var_samp(x) AS beta, avg(y) AS mean_y, avg(x) AS mean_x FROM sup1 GROUP BY 1"""


@query("rel5_static_elasticity", sql(f"""SELECT ticker, n, round(beta * 1e6, 4) AS beta_ppm, round(CASE WHEN abs(mean_y) > 1e-10 THEN beta * mean_x / mean_y ELSE beta END, 5) AS elasticity,
    abs(mean_y) > 1e-10 AS computable FROM ({ELAST})""", "sup1"))
def _(spark, d):
    e = R.static_elasticity(supervised(spark, d, ["inflation"]), "log_return", "inflation")
    return rounded(e.select("ticker", "n", (F.col("beta") * 1e6).alias("beta_ppm"), "elasticity", "computable"), 5, beta_ppm=4)


@query("rel6_rolling_elasticity", sql("""SELECT ticker, date, round(beta * 1e6, 3) AS beta_ppm, round(atan(beta * mx / my), 5) AS angle FROM (
    SELECT ticker, date, covar_samp(y, x) OVER f / var_samp(x) OVER f AS beta, avg(x) OVER f AS mx, avg(y) OVER f AS my, count(*) OVER f AS c FROM sup1
    WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 89 PRECEDING)) WHERE c >= 90 AND abs(my) > 1e-10""", "sup1"))
def _(spark, d):
    r = R.rolling_elasticity(supervised(spark, d, ["inflation"]), "log_return", "inflation", 90)
    return rounded(r.select("ticker", "date", (F.col("beta") * 1e6).alias("beta_ppm"), F.atan("elasticity").alias("angle")), 5, beta_ppm=3)


def scan_sql(src, y, x, lo, hi, least, keys="ticker"):
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""SELECT {ks}, k AS lag, count(*) AS n, CASE WHEN count(*) >= {least} THEN corr(a.{y}, b.{x}) END AS corr FROM
      (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS i FROM {src}) a JOIN (SELECT unnest(generate_series({lo}, {hi})) AS k) ks ON true
      JOIN (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS i FROM {src}) b ON {on} AND b.i = a.i - k
      WHERE a.{y} IS NOT NULL AND b.{x} IS NOT NULL GROUP BY ALL"""


cte("scan7", scan_sql("sup1", "y", "x", 0, 60, 20), "sup1")
cte("scan8", scan_sql("ret", "log_return", "log_return", 1, 20, 20), "ret")


@query("rel7_lag_scan", sql("SELECT ticker, lag, n, round(corr, 6) AS corr FROM scan7", "scan7"))
def _(spark, d):
    return rounded(R.lag_scan(supervised(spark, d, ["inflation"]), "log_return", "inflation", 60))


@query("rel7_best_lag", sql("""SELECT ticker, arg_max(lag, (abs(corr), -lag)) AS best_lag, 45 + arg_max(lag, (abs(corr), -lag)) AS effective_lag,
    round(arg_max(corr, (abs(corr), -lag)), 6) AS best_corr, round(max(corr) FILTER (lag = 30), 6) AS reference_corr FROM scan7 WHERE corr IS NOT NULL GROUP BY 1""", "scan7"))
def _(spark, d):
    return rounded(R.best_lag(R.lag_scan(supervised(spark, d, ["inflation"]), "log_return", "inflation", 60), 30))


@query("rel8_autocorrelation", sql("SELECT ticker, lag, n, round(corr, 6) AS corr FROM scan8", "scan8"))
def _(spark, d):
    return rounded(R.lag_scan(G.with_returns(B.bars(spark, d)), "log_return", "log_return", 20, min_lag=1))


DECAY = MAC
DECAY_LAGS = 180
WL = "OVER (PARTITION BY ticker ORDER BY date)"
def decay_step(f):
    """The stationary form of a feature, as SQL."""
    prev = f"lag({f}) {WL}"
    if T.is_rate_like(f):
        return f"{f} - {prev}"
    return f"CASE WHEN min({f}) OVER (PARTITION BY ticker) > 0 THEN ln({f} / nullif({prev}, 0)) ELSE {f} / nullif({prev}, 0) - 1 END"


cte("decay_in", " UNION ALL ".join(f"SELECT ticker, date, '{f}' AS feature, log_return AS y, {decay_step(f)} AS x FROM master" for f in DECAY), "master")
cte("scan9", scan_sql("decay_in", "y", "x", 0, DECAY_LAGS, 25, "ticker, feature"), "decay_in")


def decay_scan(spark, d):
    m = master(spark, d)
    for f in DECAY:
        m = T.with_stationary(m, f, f"s_{f}")
    m = m.select("ticker", "date", "log_return", *[F.col(f"s_{f}").alias(f) for f in DECAY])
    return R.lag_scan(R.long_features(m, DECAY, ["ticker", "date", "log_return"]), "log_return", "x", DECAY_LAGS, 25, keys=("ticker", "feature"))


@query("rel9_information_decay", sql("""SELECT ticker, feature, round(base, 6) AS base_corr, min(lag) FILTER (lag > 0 AND abs(corr) <= 0.5 * abs(base)) AS half_life FROM (
    SELECT *, max(corr) FILTER (lag = 0) OVER (PARTITION BY ticker, feature) AS base FROM scan9) GROUP BY ticker, feature, base""", "scan9"))
def _(spark, d):
    return rounded(R.half_life(decay_scan(spark, d), ["ticker", "feature"]))


cte("lvl", " UNION ALL ".join(f"SELECT ticker, date, '{f}' AS feature, log_return AS y, {f} AS x FROM master" for f in MAC), "master")
cte("scan10", scan_sql("lvl", "y", "x", 1, 20, 10, "ticker, feature"), "lvl")


@query("rel10_lag_table_top", sql("""SELECT ticker, feature, lag, n, round(corr, 5) AS corr FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(corr) DESC, feature, lag) AS place
    FROM scan10 WHERE corr IS NOT NULL) WHERE place <= 20""", "scan10"))
def _(spark, d):
    m = R.long_features(master(spark, d), MAC, ["ticker", "date", "log_return"])
    return rounded(R.top_lags(R.lag_scan(m, "log_return", "x", 20, 10, 1, ("ticker", "feature"))).drop("place"), 5)


@query("rel11_mean_abs_correlation", sql("SELECT ticker, round(avg(abs(corr)), 6) AS strength FROM cm GROUP BY 1", "cm"))
def _(spark, d):
    return rounded(R.mean_abs_correlation(R.correlation_matrix(panel(spark, d), PANEL)))


# --- risk -----------------------------------------------------------------------------------------
cte("cr", "SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM master", "master")
A = 2.0 / 31.0
cte("ewm", f"""SELECT ticker, CASE WHEN count(*) >= 15 THEN sqrt((sum(w * r * r) / sum(w) - (sum(w * r) / sum(w)) ** 2) * sum(w) ** 2 / (sum(w) ** 2 - sum(w * w))) END AS ewm_vol FROM (
    SELECT ticker, r, pow({1 - A!r}, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1) AS w FROM cr WHERE r IS NOT NULL) GROUP BY 1""", "cr")
cte("reg1", "SELECT *, last_value(inflation IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM cr", "cr")
cte("reg2", "SELECT ticker, quantile_cont(m, 0.8) AS hi, quantile_cont(m, 0.2) AS lo, max_by(m, date) >= quantile_cont(m, 0.8) AS h FROM reg1 GROUP BY 1", "reg1")
cte("moments", """SELECT ticker, CASE WHEN h THEN 'high' ELSE 'low' END AS scenario, sample, CASE WHEN sample >= 30 THEN cmu ELSE bmu END AS mu, CASE WHEN sample >= 30 THEN csd ELSE bsd END AS sigma FROM (
    SELECT ticker, any_value(h) AS h, count(r) FILTER (ok) AS sample, avg(r) AS bmu, stddev_samp(r) AS bsd, avg(r) FILTER (ok) AS cmu, stddev_samp(r) FILTER (ok) AS csd FROM (
      SELECT *, CASE WHEN h THEN m >= hi ELSE m <= lo END AS ok FROM reg1 JOIN reg2 USING (ticker)) GROUP BY 1)""", "reg1", "reg2")
cte("rin", "SELECT ticker, scenario, last_price, mu AS drift, greatest(ewm_vol, sigma) AS volatility, ewm_vol FROM moments JOIN ewm USING (ticker) JOIN (SELECT ticker, max_by(close, date) AS last_price FROM cr GROUP BY 1) USING (ticker)", "moments", "ewm", "cr")


def returns(spark, d):
    return K.close_returns(master(spark, d))


@query("rsk1_ewm_volatility", sql("SELECT ticker, round(ewm_vol, 6) AS ewm_vol FROM ewm", "ewm"))
def _(spark, d):
    return rounded(K.ewm_volatility(returns(spark, d)))


@query("rsk2_regime_moments", sql("SELECT ticker, scenario, sample, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM moments", "moments"))
def _(spark, d):
    return rounded(K.regime_moments(returns(spark, d), "inflation"))


@query("rsk3_historical_var", sql("""SELECT ticker, round(abs(any_value(q)), 6) AS var, round(abs(avg(r) FILTER (r <= q)), 6) AS es FROM cr
    JOIN (SELECT ticker, quantile_cont(r, 0.05) AS q FROM cr GROUP BY 1) USING (ticker) GROUP BY 1""", "cr"))
def _(spark, d):
    return rounded(K.historical_var(returns(spark, d)))


@query("rsk4_parametric_var", sql(f"""SELECT ticker, round(abs(drift + volatility * {X.Z_05}), 6) AS var, round(abs(drift - volatility * {X.ES_FACTOR_05}), 6) AS es FROM rin""", "rin"))
def _(spark, d):
    return rounded(K.parametric_var(K.risk_inputs(returns(spark, d), "inflation"), "drift", "volatility").select("ticker", "var", "es"))


@query("rsk5_scenario_bias", sql(f"""SELECT ticker, s.scenario AS stress, round(drift + drift_shift, 6) AS drift, round(volatility * greatest(0.1, vol_multiplier), 6) AS volatility, jump_shock
    FROM rin, ({values_sql(X.SCENARIO_COLUMNS, X.SCENARIOS)}) s""", "rin"))
def _(spark, d):
    b = K.scenario_bias(K.risk_inputs(returns(spark, d), "inflation"))
    return rounded(b.select("ticker", "stress", "drift", "volatility", "jump_shock"))
