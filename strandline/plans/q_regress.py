"""Regression and model selection (REG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import rounded, values_sql
from ..functions.quantiles import expanding_quantiles
from ..functions.stage import stage
from ..operators import regress as K
from ..operators import tournament as M
from ..operators import transforms as T
from ..sources import bindings as B
from .ctes import cte, fitted_sql, inverse_sql, least_squares, sql, tail_sql
from .q_gold import MAC, master, supervised
from .registry import query

WL = "OVER (PARTITION BY ticker ORDER BY date)"
cte("betas", " UNION ALL ".join(f"SELECT ticker, '{f}' AS factor, count(*) AS n, regr_slope(log_return, {f}) AS beta, regr_intercept(log_return, {f}) AS alpha, regr_r2(log_return, {f}) AS r2 FROM sup GROUP BY 1" for f in MAC), "sup")


@query("reg1_factor_betas", sql("SELECT ticker, factor, n, round(beta * 1e6, 4) AS beta_ppm, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM betas", "betas"))
def _(spark, d):
    b = K.factor_betas(supervised(spark, d), "log_return", MAC)
    return rounded(b.select("ticker", "factor", "n", (F.col("beta") * 1e6).alias("beta_ppm"), "alpha", "r2"), 6, beta_ppm=4)


OVER = [("stagflation", "inflation", 0.08), ("custom", "energy_index", 0.10), ("custom", "log_return", -0.02)]
cte("own", values_sql(("scenario", "factor", "own_shock"), OVER))
cte("presets", values_sql(("scenario", "factor", "base_shock"), X.SCENARIO_SHOCKS))


@query("reg2_scenarios", sql("""SELECT scenario, factor, round(shock, 6) AS shock, n_months, round(usual_move, 6) AS usual_move, round(shock / usual_move, 5) AS shock_in_moves FROM (SELECT scenario, factor, coalesce(own_shock, base_shock) AS shock FROM presets FULL JOIN own USING (scenario, factor))
    LEFT JOIN (SELECT series, count(*) AS n_months, stddev_samp(ln(value / p)) AS usual_move FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY date) AS p FROM macro) GROUP BY 1) ON series = factor""", "own", "presets", "macro"))
def _(spark, d):
    return rounded(K.shocks_in_moves(K.resolve_scenarios(spark, OVER), B.macro(spark, d)), 6, shock_in_moves=5)


SECT = "CASE WHEN ticker IN ('PROMO', 'SMALL') THEN 'technology' ELSE sector END"
cte("impact", f"""SELECT t.ticker, s.scenario, coalesce(f.fi, 0) AS factor_impact, CASE WHEN s.sector_scope IS NULL OR lower(t.sector) = lower(s.sector_scope) THEN coalesce(d.shock, 0) ELSE 0 END AS direct_shock
    FROM (SELECT ticker, {SECT} AS sector FROM sectors) t CROSS JOIN ({values_sql(X.SCENARIO_COLUMNS, X.SCENARIOS)}) s
    LEFT JOIN (SELECT ticker, scenario, sum(beta * base_shock) AS fi FROM betas JOIN presets USING (factor) GROUP BY 1, 2) f ON f.ticker = t.ticker AND f.scenario = s.scenario
    LEFT JOIN (SELECT scenario, base_shock AS shock FROM presets WHERE factor = 'log_return') d ON d.scenario = s.scenario""", "betas", "presets", "sectors")


@query("reg3_scenario_impacts", sql("SELECT ticker, scenario, round(factor_impact, 6) AS factor_impact, direct_shock::DOUBLE AS direct_shock, round(factor_impact + direct_shock, 6) AS total FROM impact", "impact"))
def _(spark, d):
    sec = B.sectors(spark, d).withColumn("sector", F.when(F.col("ticker").isin("PROMO", "SMALL"), "technology").otherwise(F.col("sector")))
    return rounded(K.scenario_impacts(K.factor_betas(supervised(spark, d), "log_return", MAC), K.resolve_scenarios(spark), sec))


EVENTS = [("crisis_97", "1997-07-01", "1998-03-31"), ("millennium", "1999-12-01", "2000-03-31")]


@query("reg4_anchor_window", sql(f"""SELECT ticker, event, count(*) AS n, round(avg(log_return), 6) AS mean_return FROM ret JOIN ({values_sql(("event", "a", "b"), EVENTS)}) e
    ON date BETWEEN CAST(a AS DATE) AND CAST(b AS DATE) GROUP BY 1, 2""", "ret"))
def _(spark, d):
    from ..operators import gold as G
    w = K.anchor_window(G.with_returns(B.bars(spark, d)), EVENTS)
    return rounded(w.groupBy("ticker", "event").agg(F.count("*").alias("n"), F.avg("log_return").alias("mean_return")))


Q = {f: f"quantile_cont({f}, [0.01, 0.99]) OVER (PARTITION BY ticker)" for f in MAC}
cte("winq", "SELECT *, " + ", ".join(f"{q} AS q_{f}" for f, q in Q.items()) + " FROM sup", "sup")


@query("reg5_winsorise_features", sql("SELECT ticker, CAST(sum(" + " + ".join(f"CAST({f} < q_{f}[1] OR {f} > q_{f}[2] AS INT)" for f in MAC) + ") AS BIGINT) AS clipped, "
    + ", ".join(f"round(avg(greatest(q_{f}[1], least(q_{f}[2], {f}))), 4) AS {f}" for f in MAC) + " FROM winq GROUP BY 1", "winq"))
def _(spark, d):
    w = K.winsorise_columns(supervised(spark, d), MAC)
    return rounded(w.groupBy("ticker").agg(F.sum("clipped").alias("clipped"), *[F.avg(f).alias(f) for f in MAC]), 4)


@query("reg6_engineered_features", sql("SELECT ticker, round(avg(inflation * inflation) / 1e6, 3) AS inflation_sq, round(avg(energy_index * energy_index), 6) AS energy_sq, count(CASE WHEN regime > 0 THEN NULL END) - count(*) + sum(regime) AS regime_sq, round(avg(inflation * energy_index), 4) AS cross_term FROM (SELECT *, CASE WHEN energy_index > 0 THEN 1 ELSE 0 END AS regime FROM sup) GROUP BY 1", "sup").replace("count(CASE WHEN regime > 0 THEN NULL END) - count(*) + sum(regime)", "0::BIGINT"))
def _(spark, d):
    s = supervised(spark, d).withColumn("regime", (F.col("energy_index") > 0).cast("double"))
    e = K.engineered(s, ["inflation", "energy_index", "regime"])
    a = e.groupBy("ticker").agg((F.avg("inflation__sq") / 1e6).alias("inflation_sq"), F.avg("energy_index__sq").alias("energy_sq"),
                                F.count("regime__sq").alias("regime_sq"), F.avg("inflation__x__energy_index").alias("cross_term"))
    return rounded(a, 6, inflation_sq=3, cross_term=4)


@query("reg7_median_imputation", sql("SELECT ticker, date, round(coalesce(g, median(g) OVER (PARTITION BY ticker)), 4) AS close FROM (SELECT *, CASE WHEN day(date) BETWEEN 5 AND 20 THEN NULL ELSE close END AS g FROM px)", "px"))
def _(spark, d):
    px = B.bars(spark, d).withColumn("close", F.when(~F.dayofmonth("date").between(5, 20), F.col("close")))
    return rounded(K.median_imputed(px, ["close"]).select("ticker", "date", "close"), 4)


def vif_sql(limit=12.0, least=2):
    """Uncentred inflation factors and step-wise removal of the largest one, every round written out; a factor that is out has the unit row."""
    p = len(MAC)
    cte("vif_m", "SELECT ticker, [" + ", ".join("[" + ", ".join(f"sum({a} * {b}) / sqrt(sum({a} * {a})) / sqrt(sum({b} * {b}))" for b in MAC) + "]" for a in MAC) + "] AS q FROM sup GROUP BY 1", "sup")
    prev = "SELECT ticker, q, " + ", ".join(f"TRUE AS k{i}" for i in range(p)) + " FROM vif_m"
    keep = ", ".join(f"k{i}" for i in range(p))
    for r in range(p - least + 1):
        rows = "[" + ", ".join("[" + ", ".join([*(f"CASE WHEN k{i} AND k{j} THEN q[{i + 1}][{j + 1}] ELSE {float(i == j)}::DOUBLE END" for j in range(p)), *(f"{float(i == j)}::DOUBLE" for j in range(p))]) + "]" for i in range(p)) + "]"
        cte(f"vif_a{r}", f"SELECT *, {rows} AS a FROM ({prev})", *(["vif_m"] if r == 0 else [f"vif_v{r - 1}"]))
        cte(f"vif_s{r}", inverse_sql(f"vif_a{r}", "ticker", p, f"q, {keep}"), f"vif_a{r}")
        cte(f"vif_v{r}", f"SELECT ticker, q, {keep}, [{', '.join(f'CASE WHEN k{i} THEN a[{i + 1}][{p + i + 1}] END' for i in range(p))}] AS v FROM vif_s{r}", f"vif_s{r}")
        worst = "list_max(v)"
        prev = "SELECT ticker, q, " + ", ".join(f"k{i} AND NOT coalesce(v[{i + 1}] = {worst} AND {worst} > {limit}, FALSE) AS k{i}" for i in range(p)) + f" FROM vif_v{r}"
    last = p - least
    return " UNION ALL ".join(f"SELECT ticker, '{f}' AS factor, CASE WHEN b.k{i} THEN b.v[{i + 1}] ELSE a.v[{i + 1}] END AS vif, b.k{i} AS kept FROM vif_v0 a JOIN vif_v{last} b USING (ticker)" for i, f in enumerate(MAC))


cte("vif", vif_sql(), "vif_v0", f"vif_v{len(MAC) - 2}")


@query("reg8_inflation_factors", sql("SELECT ticker, factor, round(vif, 4) AS vif, kept FROM vif", "vif"))
def _(spark, d):
    return rounded(K.inflation_factors(supervised(spark, d), "log_return", MAC), 4)


cte("folds", """SELECT *, CASE WHEN i < n - k * (n // (k + 1)) THEN 0 ELSE 1 + (i - (n - k * (n // (k + 1)))) // (n // (k + 1)) END AS fold FROM (
    SELECT *, greatest(2, least(5, n // 60)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM sup))""", "sup")


@query("reg9_time_folds", sql("SELECT ticker, CAST(fold AS BIGINT) AS fold, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM folds GROUP BY 1, 2", "folds"))
def _(spark, d):
    return K.with_folds(supervised(spark, d)).groupBy("ticker", "fold").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


cte("cv_train", f"""SELECT t.ticker, t.fold, t.alpha, r.log_return AS y, {", ".join(f"r.{x}" for x in MAC)} FROM (SELECT DISTINCT ticker, fold, alpha FROM folds CROSS JOIN (VALUES {", ".join(f"({a}::DOUBLE)" for a in K.RIDGE_GRID)}) g(alpha) WHERE fold > 0) t
    JOIN folds r ON r.ticker = t.ticker AND r.fold < t.fold""", "folds")
least_squares("cv_fit", "cv_train", "ticker, fold, alpha", MAC, "y", "cv_train", alpha="alpha")
cte("cv_score", f"""SELECT f.ticker, CAST(f.fold AS BIGINT) AS fold, f.alpha, any_value(f.n) AS n_train, count(*) AS n_test, 1 - sum((r.log_return - ({fitted_sql(MAC)})) ** 2) / (var_pop(r.log_return) * count(*)) AS r2,
    sqrt(avg((r.log_return - ({fitted_sql(MAC)})) ** 2)) AS rmse FROM cv_fit f JOIN folds r ON r.ticker = f.ticker AND r.fold = f.fold GROUP BY 1, 2, 3""", "cv_fit", "folds")


@query("reg10_ridge_cv", sql("SELECT ticker, fold, alpha, round(r2, 5) AS r2, round(rmse, 6) AS rmse, n_train, n_test FROM cv_score", "cv_score"))
def _(spark, d):
    return rounded(K.ridge_cv(supervised(spark, d), "log_return", MAC), 6, r2=5)


@query("reg10_best_alpha", sql("SELECT ticker, arg_max(alpha, (m, -alpha)) AS alpha, round(max(m), 5) AS mean_r2 FROM (SELECT ticker, alpha, avg(r2) AS m FROM cv_score GROUP BY 1, 2) GROUP BY 1", "cv_score"))
def _(spark, d):
    return rounded(K.best_alpha(K.ridge_cv(supervised(spark, d), "log_return", MAC)), 5)


@query("reg11_model_tournament")
def _(spark, d):
    return M.tournament(supervised(spark, d), "log_return", MAC)[0]


@query("reg11_refit")
def _(spark, d):
    s = stage(supervised(spark, d))
    return M.refit(*M.tournament(s, "log_return", MAC), s, "log_return", MAC)


PAIR = ["energy_index", "industrial_production"]
LINEAR = [(i, m, M.described(p), {"Linear": 0.0, "Ridge": 0.0, "Lasso": 1.0}.get(m, p.get("l1_ratio", 0.0)) * p.get("alpha", 0.0), p["alpha"] if m == "Ridge" else 0.0,
           p["alpha"] * (1 - p["l1_ratio"]) if m == "ElasticNet" else 0.0) for i, (m, p) in enumerate(M.linear_settings())]
cte("cd_rows", f"SELECT ticker, CAST(fold AS BIGINT) AS fold, log_return AS y, {PAIR[0]} AS a, {PAIR[1]} AS b FROM folds", "folds")
cte("cd_train", """SELECT t.ticker, t.fold, count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS q,
    covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb FROM (SELECT DISTINCT ticker, fold FROM cd_rows WHERE fold > 0) t JOIN cd_rows r ON r.ticker = t.ticker AND r.fold < t.fold GROUP BY 1, 2""", "cd_rows")
cte("cd_grid", values_sql(("variant", "model", "params", "one", "ridge", "two"), LINEAR))
cte("cd_start", "SELECT ticker, fold, variant, q, ca, cb, one, two + ridge / n AS two FROM cd_train CROSS JOIN cd_grid", "cd_train", "cd_grid")
# coordinate descent written as a recursion; without an absolute penalty the two equations are solved
cte("cd_steps", """WITH RECURSIVE s AS (SELECT *, 0::DOUBLE AS wa, 0::DOUBLE AS wb, 0 AS step FROM cd_start WHERE one > 0 UNION ALL
    SELECT ticker, fold, variant, q, ca, cb, one, two, va, sign(cb - q * va) * greatest(abs(cb - q * va) - one, 0) / (1 + two), step + 1 FROM (
      SELECT *, sign(ca - q * wb) * greatest(abs(ca - q * wb) - one, 0) / (1 + two) AS va FROM s WHERE step < 200)) SELECT * FROM s WHERE step = 200""", "cd_start")
cte("cd_fit", """SELECT ticker, fold, variant, wa, wb FROM cd_steps UNION ALL SELECT ticker, fold, variant, (ca * (1 + two) - cb * q) / ((1 + two) ** 2 - q * q), (cb * (1 + two) - ca * q) / ((1 + two) ** 2 - q * q) FROM cd_start WHERE one = 0""", "cd_steps", "cd_start")
cte("cd_score", """SELECT ticker, fold, variant, count(*) AS n_test, 1 - sum((y - my - wa * (a - ma) / sa - wb * (b - mb) / sb) ** 2) / (var_pop(y) * count(*)) AS r2
    FROM cd_fit JOIN cd_train USING (ticker, fold) JOIN cd_rows USING (ticker, fold) GROUP BY 1, 2, 3""", "cd_fit", "cd_train", "cd_rows")
cte("cd_mean", "SELECT *, avg(r2) OVER (PARTITION BY ticker, variant) AS mean_r2 FROM cd_score JOIN cd_grid USING (variant)", "cd_score", "cd_grid")


@query("reg11_linear_two_factors", sql("""SELECT ticker, model, params, fold, n_test, round(r2, 6) AS r2, round(mean_r2, 6) AS mean_r2, variant::INTEGER AS variant,
    variant = arg_min(variant, (ROUND(-mean_r2, 12), variant)) OVER (PARTITION BY ticker, model) AS winner, variant = arg_min(variant, (ROUND(-mean_r2, 12), variant)) OVER (PARTITION BY ticker) AS best FROM cd_mean""", "cd_mean"))
def _(spark, d):
    t = M.tournament(supervised(spark, d), "log_return", PAIR, forests=False)[0]
    return rounded(t.select("ticker", "model", "params", "fold", "n_test", "r2", "mean_r2", "variant", "winner", "best"))


LAGS = (45, 60, 75, 90)


def lag_frames(spark, d, lags=LAGS):
    m = stage(master(spark, d))
    return {k: T.supervised_frame(m, "log_return", MAC, macro_lag=k) for k in lags}


cte("lag_folds", """SELECT *, CASE WHEN i < n - k * (n // (k + 1)) THEN 0 ELSE 1 + (i - (n - k * (n // (k + 1)))) // (n // (k + 1)) END AS fold FROM (
    SELECT *, greatest(2, least(5, n // 60)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY ticker, lag ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker, lag) AS n FROM sup_lags))""", "sup_lags")
cte("lag_train", f"SELECT t.ticker, t.lag, t.fold, r.log_return AS y, {', '.join(f'r.{x}' for x in MAC)} FROM (SELECT DISTINCT ticker, lag, fold FROM lag_folds WHERE fold > 0) t JOIN lag_folds r ON r.ticker = t.ticker AND r.lag = t.lag AND r.fold < t.fold", "lag_folds")
least_squares("lag_fit", "lag_train", "ticker, lag, fold", MAC, "y", "lag_train", alpha="0.5")
cte("lag_score", f"""SELECT ticker, lag, avg(r2) AS m FROM (SELECT f.ticker, f.lag, f.fold, 1 - sum((r.log_return - ({fitted_sql(MAC)})) ** 2) / (var_pop(r.log_return) * count(*)) AS r2
    FROM lag_fit f JOIN lag_folds r ON r.ticker = f.ticker AND r.lag = f.lag AND r.fold = f.fold GROUP BY 1, 2, 3) GROUP BY 1, 2""", "lag_fit", "lag_folds")
CHOSEN = "SELECT ticker, lag, round(m, 5) AS mean_r2, lag = arg_min(lag, (-m, lag)) OVER (PARTITION BY ticker) AS chosen FROM "


@query("reg12_choose_lag", sql(CHOSEN + "lag_score", "lag_score"))
def _(spark, d):
    return rounded(K.choose_lag(lag_frames(spark, d), "log_return", MAC), 5)


SUB = 2 ** len(MAC)
cte("sub_train", f"SELECT t.ticker, t.fold, t.mask, r.log_return AS y, {', '.join(f'r.{x}' for x in MAC)} FROM (SELECT DISTINCT ticker, fold, mask FROM folds, (SELECT unnest(range(1, {SUB})) AS mask) WHERE fold > 0) t JOIN folds r ON r.ticker = t.ticker AND r.fold < t.fold", "folds")
least_squares("sub_fit", "sub_train", "ticker, fold, mask", MAC, "y", "sub_train", alpha="0.5", used=[f"mask & {1 << i} > 0" for i in range(len(MAC))])
cte("sub_score", f"""SELECT ticker, mask, avg(r2) AS r2 FROM (SELECT f.ticker, f.mask, f.fold, 1 - sum((r.log_return - ({fitted_sql(MAC)})) ** 2) / (var_pop(r.log_return) * count(*)) AS r2
    FROM sub_fit f JOIN folds r ON r.ticker = f.ticker AND r.fold = f.fold GROUP BY 1, 2, 3) GROUP BY 1, 2""", "sub_fit", "folds")
cte("sub_named", "SELECT ticker, r2, concat_ws('+', " + ", ".join(f"CASE WHEN mask & {1 << i} > 0 THEN '{x}' END" for i, x in enumerate(MAC)) + ") AS members, bit_count(mask)::BIGINT AS size FROM sub_score", "sub_score")


@query("reg13_choose_subset", sql("SELECT ticker, members, size, round(r2, 5) AS r2, row_number() OVER (PARTITION BY ticker ORDER BY r2 DESC, size, members) AS place FROM sub_named", "sub_named"))
def _(spark, d):
    return rounded(K.choose_subset(supervised(spark, d), "log_return", MAC), 5)


least_squares("ols", "sup", "ticker", MAC, "log_return", "sup")
cte("ols_lines", " UNION ALL ".join(f"""SELECT ticker, '{f}' AS factor, b[{i}] AS coef, sqrt(rss / (n - {len(MAC) + 1}) * inv[{i}] / n) / sd[{i}] AS se, 1 - rss / tss AS r2, c0 AS intercept, n FROM ols""" for i, f in enumerate(MAC, 1)), "ols")


@query("reg14_ols_report", sql(f"""SELECT ticker, factor, round(coef * 1e6, 4) AS coef_ppm, round(se * 1e6, 4) AS se_ppm, round({tail_sql('coef / se')}, 6) AS p_value, round(r2, 6) AS r2,
    round(1 - (1 - r2) * (n - 1) / (n - {len(MAC) + 1}), 6) AS adj_r2, round(intercept, 5) AS intercept, n FROM ols_lines""", "ols_lines"))
def _(spark, d):
    r = K.ols_report(supervised(spark, d), "log_return", MAC)
    return rounded(r.select("ticker", "factor", (F.col("coef") * 1e6).alias("coef_ppm"), (F.col("se") * 1e6).alias("se_ppm"), "p_value", "r2", "adj_r2", "intercept", "n"), 6, coef_ppm=4, se_ppm=4, intercept=5)


@query("reg14_ols_one_factor", sql("""SELECT ticker, 'energy_index' AS factor, round(beta, 5) AS coef, round(alpha, 6) AS intercept, round(r2, 6) AS r2,
    round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, n FROM betas WHERE factor = 'energy_index'""", "betas"))
def _(spark, d):
    r = K.ols_report(supervised(spark, d), "log_return", ["energy_index"])
    return rounded(r.select("ticker", "factor", "coef", "intercept", "r2", "adj_r2", "n"), 6, coef=5)


@query("reg15_importance", sql(" UNION ALL ".join(f"SELECT ticker, '{f}' AS factor, round(abs(b[{i}]) * sd[{i}] * sqrt(n / (n - 1.0)), 6) AS importance FROM ols" for i, f in enumerate(MAC, 1)), "ols"))
def _(spark, d):
    s = stage(supervised(spark, d))
    return rounded(K.importance(K.ols_report(s, "log_return", MAC), s, MAC).select("ticker", "factor", "importance"))


@query("reg15_importance_one_factor", sql("SELECT ticker, 'energy_index' AS factor, round(abs(regr_slope(log_return, energy_index)) * stddev_samp(energy_index), 6) AS importance FROM sup GROUP BY 1", "sup"))
def _(spark, d):
    s = supervised(spark, d)
    return rounded(K.importance(K.ols_report(s, "log_return", ["energy_index"]), s, ["energy_index"]).select("ticker", "factor", "importance"))


MISS = ["log_return", *MAC]


@query("reg16_missing_values", sql(" UNION ALL ".join(f'SELECT \'{c}\' AS "column", count(*) FILTER ({c} IS NULL) AS missing, count(*) AS n_rows FROM master' for c in MISS), "master"))
def _(spark, d):
    return K.missing_counts(master(spark, d), MISS)


@query("reg17_holdout_models")
def _(spark, d):
    return M.holdout_models(supervised(spark, d), "log_return", MAC)[0]


@query("reg17_holdout_predictions")
def _(spark, d):
    return M.holdout_models(supervised(spark, d), "log_return", MAC)[1]


cte("hold", """SELECT *, CASE WHEN i >= m THEN k + 1 WHEN i < m - k * (m // (k + 1)) THEN 0 ELSE 1 + (i - (m - k * (m // (k + 1)))) // (m // (k + 1)) END AS fold FROM (
    SELECT *, greatest(2, least(5, m // 60)) AS k FROM (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS m FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM sup)))""", "sup")


@query("reg17_train_quantiles", sql("SELECT ticker, CAST(f AS BIGINT) AS fold, feature, count(x) AS n, " + ", ".join(f"round(quantile_cont(x, {p}), 4) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75)) + " FROM (" + " UNION ALL ".join(
    f"SELECT t.ticker, t.fold AS f, '{x}' AS feature, {x} AS x FROM (SELECT DISTINCT ticker, fold FROM hold WHERE fold > 0) t JOIN hold r ON r.ticker = t.ticker AND r.fold < t.fold" for x in MAC) + ") GROUP BY 1, 2, 3", "hold"))
def _(spark, d):
    q = expanding_quantiles(M.holdout_folds(supervised(spark, d)), ["ticker"], "fold", 6, MAC, (0.25, 0.5, 0.75))
    folds = M.holdout_folds(supervised(spark, d)).groupBy("ticker").agg(F.max("fold").alias("last"))
    q = q.join(folds, "ticker").where("fold <= last")
    return rounded(q.select("ticker", "fold", "feature", "n", *[F.col("q")[i].alias(f"q{n}") for i, n in enumerate((25, 50, 75))]), 4)


EARLIER = ", ".join(f"lag(v, {k}) {WL} AS l{k}" for k in range(1, 11))
cte("arx", f"SELECT *, {EARLIER} FROM (SELECT ticker, date, ln(close / lag(close) {WL}) AS v FROM master) WHERE v IS NOT NULL", "master")
cte("ar2_rows", "SELECT * FROM arx WHERE l2 IS NOT NULL", "arx")
least_squares("ar2", "ar2_rows", "ticker", ["l1", "l2"], "v", "ar2_rows")
cte("ar2_steps", """WITH RECURSIVE s AS (SELECT a.ticker, c0, b[1] AS b1, b[2] AS b2, sqrt(rss / n) AS sigma, v AS f, l1 AS g, 1.0::DOUBLE AS p, 0.0::DOUBLE AS o, 0.0::DOUBLE AS var, 0 AS step FROM ar2 a JOIN (SELECT ticker, max_by(v, date) AS v, max_by(l1, date) AS l1 FROM arx GROUP BY 1) USING (ticker)
    UNION ALL SELECT ticker, c0, b1, b2, sigma, c0 + b1 * f + b2 * g, f, b1 * p + b2 * o, p, var + p * p, step + 1 FROM s WHERE step < 10) SELECT * FROM s WHERE step > 0""", "ar2", "arx")
BAND90 = "round(f, 6) AS forecast, round(f - 1.6448536269514722 * sigma * sqrt(var), 6) AS lower, round(f + 1.6448536269514722 * sigma * sqrt(var), 6) AS upper"


@query("reg18_ar_forecast", sql(f"SELECT ticker, step::BIGINT AS step, {BAND90} FROM ar2_steps", "ar2_steps"))
def _(spark, d):
    return rounded(K.ar_forecast(K.forecast_input(master(spark, d), "close"), 2, 10))


LONG = [f"l{k}" for k in range(1, 11)]
cte("long_rows", "SELECT * FROM arx WHERE l10 IS NOT NULL", "arx")
least_squares("long_fit", "long_rows", "ticker", LONG, "v", "long_rows")
cte("shocks", f"SELECT *, lag(e) {WL} AS e1 FROM (SELECT r.ticker, r.date, r.v, r.l1, r.v - ({fitted_sql(LONG)}) AS e FROM long_fit f JOIN long_rows r ON r.ticker = f.ticker)", "long_fit", "long_rows")
cte("arma_rows", "SELECT * FROM shocks WHERE e1 IS NOT NULL", "shocks")
least_squares("arma", "arma_rows", "ticker", ["l1", "e1"], "v", "arma_rows")
cte("arma_steps", """WITH RECURSIVE s AS (SELECT a.ticker, c0, b[1] AS phi, b[2] AS theta, sqrt(rss / n) AS sigma, v AS f, e, 1.0::DOUBLE AS p, 0.0::DOUBLE AS var, 0 AS step FROM arma a JOIN (SELECT ticker, max_by(v, date) AS v, max_by(e, date) AS e FROM shocks GROUP BY 1) USING (ticker)
    UNION ALL SELECT ticker, c0, phi, theta, sigma, c0 + phi * f + theta * e, 0.0, phi * p + CASE WHEN step = 0 THEN theta ELSE 0.0 END, var + p * p, step + 1 FROM s WHERE step < 10) SELECT * FROM s WHERE step > 0""", "arma", "shocks")


@query("reg18_arma_forecast", sql(f"SELECT ticker, step::BIGINT AS step, {BAND90} FROM arma_steps", "arma_steps"))
def _(spark, d):
    return rounded(K.arma_forecast(K.forecast_input(master(spark, d), "close"), 1, 1, 10))


cte("ar1", f"SELECT ticker, date, v, lag(v) {WL} AS l FROM (SELECT ticker, date, ln(close / lag(close) {WL}) AS v FROM master) WHERE v IS NOT NULL", "master")


@query("reg18_ar_one_step", sql("""SELECT ticker, round(c + b * last, 6) AS forecast, round(c + b * last - 1.6448536269514722 * s, 6) AS lower, round(c + b * last + 1.6448536269514722 * s, 6) AS upper FROM (
    SELECT ticker, b, c, last, sqrt(avg((v - c - b * l) ** 2)) AS s FROM ar1 JOIN (SELECT ticker, regr_slope(v, l) AS b, regr_intercept(v, l) AS c, max_by(v, date) AS last FROM ar1 GROUP BY 1) USING (ticker) WHERE l IS NOT NULL GROUP BY 1, 2, 3, 4)""", "ar1"))
def _(spark, d):
    f = K.ar_forecast(K.forecast_input(master(spark, d), "close"), 1, 1)
    return rounded(f.select("ticker", "forecast", "lower", "upper"))


cte("cv1", "SELECT *, energy_index AS x, log_return AS y FROM folds", "folds")
cte("cv2", """SELECT t.ticker, t.fold, 0.5 AS alpha, covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx, avg(x) AS mx, avg(y) AS my, count(*) AS n_train FROM (SELECT DISTINCT ticker, fold FROM cv1 WHERE fold > 0) t
    JOIN cv1 a ON a.ticker = t.ticker AND a.fold < t.fold GROUP BY 1, 2""", "cv1")


@query("reg10_ridge_cv_one_factor", sql("""SELECT ticker, CAST(fold AS BIGINT) AS fold, any_value(n_train) AS n_train, count(*) AS n_test, round(1 - sum((y - my - b * (x - mx)) ** 2) / (var_pop(y) * count(*)), 5) AS r2 FROM cv1
    JOIN (SELECT *, sxy / (sxx + alpha * sxx / n_train) AS b FROM cv2) USING (ticker, fold) GROUP BY 1, 2""", "cv1", "cv2"))
def _(spark, d):
    # folds are cut on the frame of all factors, as everywhere
    s = supervised(spark, d)
    return rounded(K.ridge_cv(s, "log_return", ["energy_index"], (0.5,)).select("ticker", "fold", "n_train", "n_test", "r2"), 5)


@query("reg19_forecast_input", sql(f"SELECT ticker, date, 'close' AS col, round(ln(close / lag(close) {WL}), 6) AS v FROM master QUALIFY v IS NOT NULL UNION ALL SELECT ticker, date, 'inflation', round(inflation - lag(inflation) {WL}, 4) AS v FROM master QUALIFY v IS NOT NULL", "master"))
def _(spark, d):
    m = master(spark, d)
    a = rounded(K.forecast_input(m, "close")).withColumn("col", F.lit("close"))
    return a.unionByName(rounded(K.forecast_input(m, "inflation"), 4).withColumn("col", F.lit("inflation")))


GRID_LAGS = (1, 5, 10)
LAGGED = [f"{x}_lag{k}" for x in MAC for k in GRID_LAGS]
cte("lagged", f"SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) <= floor(count(*) OVER (PARTITION BY ticker) * 0.8) AS is_train FROM (SELECT ticker, date, log_return, {', '.join(f'lag({x}, {k}) {WL} AS {x}_lag{k}' for x in MAC for k in GRID_LAGS)} FROM master) "
    f"WHERE log_return IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in LAGGED)}", "master")
cte("lagged_train", f"SELECT l.*, alpha FROM lagged l CROSS JOIN (VALUES {', '.join(f'({a}::DOUBLE)' for a in K.RIDGE_GRID)}) g(alpha) WHERE is_train", "lagged")
least_squares("lagged_fit", "lagged_train", "ticker, alpha", LAGGED, "log_return", "lagged_train", alpha="alpha")
cte("lagged_score", f"""SELECT f.ticker, f.alpha, any_value(f.n) AS n_train, count(*) AS n_test, 1 - sum((r.log_return - ({fitted_sql(LAGGED)})) ** 2) / (var_pop(r.log_return) * count(*)) AS r2, sqrt(avg((r.log_return - ({fitted_sql(LAGGED)})) ** 2)) AS rmse
    FROM lagged_fit f JOIN lagged r ON r.ticker = f.ticker AND NOT r.is_train GROUP BY 1, 2""", "lagged_fit", "lagged")


@query("reg20_lagged_grid", sql("SELECT ticker, alpha, round(r2, 5) AS r2, round(rmse, 6) AS rmse, n_train, n_test, row_number() OVER (PARTITION BY ticker ORDER BY r2 DESC, alpha) AS place FROM lagged_score", "lagged_score"))
def _(spark, d):
    return rounded(K.lagged_grid(master(spark, d), MAC, GRID_LAGS), 6, r2=5)
