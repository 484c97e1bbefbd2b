"""Audit (AUD), diagnostics (DIA), run health (OPS) and streams (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import rounded, values_sql
from ..functions.stage import stage
from ..operators import audit as A
from ..operators import backtest as K
from ..operators import diagnose as D
from ..operators import gold as G
from ..operators import health as H
from ..operators import regress as RG
from ..operators import relate as R
from ..operators import silver as S
from ..operators import transforms as T
from ..operators import validate as V
from ..sources import bindings as B
from ..sources import ingest as I
from ..streaming import cleaning, history, levels, trailing
from .ctes import cte, sql
from .q_backtest import ONE, naive_predictions
from .q_gold import GROUPS, IND, MAC, anyof, master, supervised
from .q_silver import _clean
from .q_sources import EXPECTED, _sink_path
from .q_validate import decisions
from .registry import ORACLES, query

WT = "OVER (PARTITION BY ticker ORDER BY date"
SRC3 = {k: GROUPS[k] for k in ("yfinance", "fred", "worldbank")}


@query("aud1_source_breadth", sql(f"""SELECT e.source, e.expected, coalesce(o, 0) AS observed, coalesce(c, 0) AS economies, ROUND(coalesce(o, 0) / e.expected, 4) AS ratio FROM ({values_sql(("source", "expected"), EXPECTED)}) e
    LEFT JOIN (SELECT source, count(DISTINCT entity) AS o, count(DISTINCT CASE WHEN contains(entity, '__') THEN upper(split_part(entity, '__', 2)) END) AS c FROM raw GROUP BY 1) s ON s.source = e.source""", "raw"))
def _(spark, d):
    return A.breadth(I.catalog(B.raw_entities(spark, d)), EXPECTED)


cte("cov", "SELECT " + ", ".join(f"avg(CASE WHEN {anyof(cs)} THEN 1.0 ELSE 0.0 END) * 100 AS r_{s}, ({' + '.join(f'count({c})' for c in cs)}) * 100.0 / (count(*) * {len(cs)}) AS f_{s}" for s, cs in SRC3.items())
    + ", avg(CASE WHEN " + " AND ".join(f"({anyof(cs)})" for cs in SRC3.values()) + " THEN 1.0 ELSE 0.0 END) * 100 AS all_pct, avg(" + " + ".join(f"CASE WHEN {anyof(cs)} THEN 1 ELSE 0 END" for cs in SRC3.values()) + ") AS act FROM master", "master")
cte("cov_l", " UNION ALL ".join(f"SELECT '{s}' AS source, r_{s} AS row_coverage_pct, f_{s} AS cell_fill_pct, all_pct AS all_sources_pct, act AS active_sources FROM cov" for s in SRC3), "cov")


@query("aud2_coverage", sql("SELECT source, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("row_coverage_pct", "cell_fill_pct", "all_sources_pct", "active_sources")) + " FROM cov_l", "cov_l"))
def _(spark, d):
    return rounded(A.coverage(master(spark, d), SRC3), 5)


@query("aud3_source_issues", sql(f"""SELECT *, CASE WHEN issues = '' THEN 'pass' ELSE 'warn' END AS status FROM (SELECT e.source, concat_ws(',', CASE WHEN coalesce(o, 0) / e.expected < 0.75 THEN 'breadth_low' END, CASE WHEN coalesce(row_coverage_pct, 0) < 70 THEN 'row_coverage_low' END) AS issues
    FROM ({values_sql(("source", "expected"), EXPECTED)}) e LEFT JOIN (SELECT source, count(DISTINCT entity) AS o FROM raw GROUP BY 1) s ON s.source = e.source LEFT JOIN cov_l ON cov_l.source = e.source)""", "raw", "cov_l"))
def _(spark, d):
    t = A.source_issues(A.breadth(I.catalog(B.raw_entities(spark, d)), EXPECTED), A.coverage(master(spark, d), SRC3))
    return t.withColumn("issues", F.array_join("issues", ","))


DENS = ["close", "volume", "log_return", *MAC, *IND, "flat", "nil"]
cte("dens", "SELECT *, 1.0::DOUBLE AS flat, 0.0::DOUBLE AS nil FROM master", "master")
cte("dens_t", "SELECT (" + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in DENS) + f") * 100.0 / (count(*) * {len(DENS)}) AS np FROM dens", "dens")


def dens(spark, d):
    return A.density(master(spark, d).withColumn("flat", F.lit(1.0)).withColumn("nil", F.lit(0.0)), DENS)


@query("aud4_density", sql('SELECT "column", round(null_pct, 5) AS null_pct, zero_variance, all_zero, round(np, 5) AS table_null_pct, 100.0::DOUBLE AS row_non_null_pct FROM (' + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) * 100.0 / count(*) AS null_pct, coalesce(stddev_samp({c}) = 0, false) AS zero_variance, coalesce(sum(abs({c})) = 0, false) AS all_zero FROM dens" for c in DENS) + "), dens_t", "dens", "dens_t"))
def _(spark, d):
    return rounded(dens(spark, d), 5)


cte("allret", "SELECT log_return AS r, close, volume FROM ret_day", "ret_day")


@query("aud5_plausibility", sql("""SELECT round(max_abs, 6) AS max_abs, round(std, 6) AS std, round(med, 6) AS median, round(mad, 6) AS mad, round(greatest(0.5, med + 8 * greatest(mad, 1e-9)), 6) AS dynamic_limit, bad_prices, bad_volumes,
    concat_ws(',', CASE WHEN max_abs > greatest(1.0, med + 8 * mad) THEN 'extreme_log_return' END) AS issues FROM (SELECT max(abs(r)) AS max_abs, stddev_samp(r) AS std, median(r) AS med, count(*) FILTER (close <= 0) AS bad_prices, count(*) FILTER (volume < 0) AS bad_volumes FROM allret),
    (SELECT median(abs(r - m)) AS mad FROM allret, (SELECT median(r) AS m FROM allret))""", "allret"))
def _(spark, d):
    p = A.plausibility(stage(G.with_returns(B.bars(spark, d, "p_brand", "day"))))
    return rounded(p.drop("quality").withColumn("issues", F.array_join("issues", ",")))


BI = "(floor(({d} - DATE '1900-01-01') / 7) * 5 + least(({d} - DATE '1900-01-01') % 7, 4))"


def gap(a, b):
    return f"CAST(greatest({BI.format(d=b)} - {BI.format(d=f'({a} - 1)')} - 1, 0) AS BIGINT)"


@query("aud6_continuity", sql(f"""SELECT ticker, count(*) AS rows, 0::BIGINT AS repeated, 'business_day' AS cadence, max(g) AS max_gap, CAST(median(g) AS DOUBLE) AS median_gap, 10::BIGINT AS allowed_gap, max(g) <= 10 AS ok FROM (
    SELECT *, {gap('p', 'date')} AS g FROM (SELECT ticker, date, lag(date) {WT}) AS p FROM px_flag)) GROUP BY 1""", "px_flag"))
def _(spark, d):
    return A.continuity(B.bars(spark, d, "l_returnflag", "day"))


cte("surv", "SELECT ticker, CASE WHEN ticker = 'SMALL' THEN CAST(date - 150 AS DATE) ELSE date END AS date, CASE WHEN ticker = 'PROMO' AND month(date) BETWEEN 4 AND 9 THEN 0 ELSE volume END AS v FROM px", "px")


@query("aud7_survivorship", sql(f"""SELECT ticker, stale_days, zero_volume_run, concat_ws(',', CASE WHEN stale_days > 20 THEN 'stale_coverage' END, CASE WHEN zero_volume_run > 10 THEN 'zero_volume' END) AS flags FROM (
    SELECT ticker, {gap('max(last)', '(SELECT max(date) FROM surv)')} AS stale_days, max(len) AS zero_volume_run FROM (SELECT ticker, run, count(*) FILTER (v <= 0) AS len, max(date) AS last FROM (
      SELECT *, count(*) FILTER (v > 0) {WT} ROWS UNBOUNDED PRECEDING) AS run FROM surv) GROUP BY 1, 2) GROUP BY 1)""", "surv"))
def _(spark, d):
    px = B.bars(spark, d).withColumn("date", F.when(F.col("ticker") == "SMALL", F.date_sub("date", 150)).otherwise(F.col("date")))  # one ticker ends early
    px = px.withColumn("volume", F.when((F.col("ticker") == "PROMO") & F.month("date").between(4, 9), 0.0).otherwise(F.col("volume")))
    return A.survivorship(px).withColumn("flags", F.array_join("flags", ","))


cte("imposs", "SELECT ticker, count(log_return) AS n, exp(avg(log_return) * 252) - 1 AS ar, stddev_samp(log_return) * sqrt(252) AS vol, exp(sum(log_return)) AS gr FROM ret GROUP BY 1", "ret")
cte("imposs2", "SELECT *, concat_ws(',', CASE WHEN n >= 252 AND ar > 2 THEN 'annual_return' END, CASE WHEN n >= 252 AND vol > 1e-8 AND ar / vol > 4 THEN 'return_per_volatility' END, CASE WHEN n >= 30 AND gr > 1000 THEN 'growth' END) AS issues FROM imposs", "imposs")


@query("aud8_impossible_results", sql("SELECT ticker, n, round(ar, 5) AS annual_return, round(vol, 5) AS volatility, round(gr, 5) AS growth, issues, CASE WHEN issues <> '' THEN 0.0 ELSE 100.0 END::DOUBLE AS edge_score FROM imposs2", "imposs2"))
def _(spark, d):
    return rounded(A.impossible_results(G.with_returns(B.bars(spark, d))).withColumn("issues", F.array_join("issues", ",")), 5)


@query("aud11_governance_review", sql("""SELECT run_id, ticker, passed, 0::BIGINT AS lag_findings, NOT passed AND risk_score < 0.6 AS over_strict, CASE WHEN passed THEN 'pass' WHEN NOT (risk_score < 0.6) AND NOT (wf_avg_r2 >= -0.5) AND NOT (risk_score <= 0.7) THEN 'fail' ELSE 'warn' END AS status
    FROM dec2""", "dec2"))
def _(spark, d):
    dec = decisions(spark, d).withColumn("oos_r2", F.col("wf_avg_r2"))
    return A.governance_review(dec, T.panel_meta(B.bars(spark, d), MAC), ("run_id", "ticker"))


def checks(spark, d):
    px = stage(G.with_returns(B.bars(spark, d)))
    a = A.impossible_results(px).select("ticker", F.lit("astronomical").alias("check"), F.when(F.size("issues") > 0, "fail").otherwise("pass").alias("status"), "edge_score")
    c = A.continuity(px, allowed_gap=3).select("ticker", F.lit("continuity").alias("check"), F.when(F.col("ok"), "pass").otherwise("warn").alias("status"), F.lit(100.0).alias("edge_score"))
    s = A.survivorship(px).select("ticker", F.lit("survivorship").alias("check"), F.when(F.size("flags") > 0, "warn").otherwise("pass").alias("status"), F.lit(100.0).alias("edge_score"))
    return a.unionByName(c).unionByName(s)


@query("aud12_roll_up", sql(f"""SELECT ticker, failed, warned, CASE WHEN failed <> '' THEN 'CRITICAL' WHEN warned <> '' THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN failed <> '' THEN 0.0 WHEN warned <> '' THEN 75.0 ELSE 100.0 END::DOUBLE AS edge_score, failed = '' AS usable FROM (
    SELECT ticker, CASE WHEN issues <> '' THEN 'astronomical' ELSE '' END AS failed, CASE WHEN g > 3 THEN 'continuity' ELSE '' END AS warned FROM imposs2 JOIN (SELECT ticker, max(g) AS g FROM (SELECT ticker, {gap('p', 'date')} AS g FROM (SELECT ticker, date, lag(date) {WT}) AS p FROM px)) GROUP BY 1) USING (ticker))""", "imposs2", "px"))
def _(spark, d):
    r = A.roll_up(checks(spark, d))
    return r.withColumn("failed", F.array_join("failed", ",")).withColumn("warned", F.array_join("warned", ","))


@query("aud13_ticker_density", sql("""SELECT t.ticker, coalesce(n, 0) AS rows, ROUND(coalesce(np, 100.0), 2) AS null_pct, ROUND(coalesce(y, 0.0), 1) AS years, CASE WHEN n IS NULL THEN 'MISSING' WHEN np > 15 OR y < 5 THEN 'FAIL' WHEN np < 5 AND y >= 6 THEN 'OK' ELSE 'WARN' END AS status FROM (
    SELECT DISTINCT ticker FROM px UNION ALL SELECT 'ABSENT') t LEFT JOIN (SELECT ticker, count(*) AS n, 100.0 * count(*) FILTER (adj_close IS NULL) / count(*) AS np, (max(date) - min(date)) / 365.25 AS y FROM px_dirty GROUP BY 1) USING (ticker)""", "px", "px_dirty"))
def _(spark, d):
    raw = B.raw_entities(spark, d).where((F.col("source") == "yfinance") & (F.col("measure") == "adj_close"))
    px = raw.select(F.col("entity").alias("ticker"), "date", F.col("value").alias("adj_close"))
    exp = B.bars(spark, d).select("ticker").distinct()
    exp = exp.unionByName(exp.agg(F.max(F.lit("ABSENT")).alias("ticker")))
    return A.ticker_density(px, exp, min_years=6.0)


# sectors are regions, their candidates the nations, present those with a well-funded supplier
cte("univ", "SELECT r_name AS sector, n_name AS ticker, n_nationkey AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
cte("present", "SELECT DISTINCT n_name AS ticker FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9300")
cte("seccov", "SELECT sector, count(*) AS candidates, count(*) FILTER (ticker IN (SELECT ticker FROM present)) AS present FROM univ GROUP BY 1", "univ", "present")


def universe(spark, d):
    n = B.table(spark, d, "nation")
    u = n.join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("sector"), F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("place"))
    p = B.table(spark, d, "supplier").where(F.col("s_acctbal") > 9300).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("ticker"))
    return u, p


@query("aud14_sector_coverage", sql("SELECT sector, candidates, present, present > 0 AS covered FROM seccov", "seccov"))
def _(spark, d):
    return A.sector_coverage(*universe(spark, d))


@query("aud14_diversification", sql("SELECT count(*) AS sectors, count(*) FILTER (present > 0) AS covered, ROUND(100.0 * count(*) FILTER (present > 0) / count(*), 1) AS score FROM seccov", "seccov"))
def _(spark, d):
    return A.diversification(A.sector_coverage(*universe(spark, d)))


@query("aud15_expansion", sql("SELECT sector, arg_min(ticker, place) AS ticker, any_value(present) = 0 AS new_sector FROM univ JOIN seccov USING (sector) WHERE present <= 1 AND ticker NOT IN (SELECT ticker FROM present) GROUP BY 1", "univ", "seccov", "present"))
def _(spark, d):
    return A.expansion_candidates(*universe(spark, d))


@query("aud16_issue_list", sql("""SELECT * FROM (SELECT 'high' AS priority, 'impossible_results' AS issue, count(*) AS n FROM imposs2 WHERE issues <> '' UNION ALL SELECT 'low', 'thin_sectors', count(*) FROM seccov WHERE present <= 1) WHERE n > 0""", "imposs2", "seccov"))
def _(spark, d):
    bad = A.impossible_results(G.with_returns(B.bars(spark, d))).where(F.size("issues") > 0)
    return A.issue_list(("high", "impossible_results", bad), ("low", "thin_sectors", A.sector_coverage(*universe(spark, d)).where(F.col("present") <= 1)))


@query("aud16_health_score", sql("SELECT count(*) AS issues, greatest(0.0, 100.0 - count(*) * 10.0)::DOUBLE AS score FROM (SELECT count(*) AS n FROM imposs2 WHERE issues <> '' UNION ALL SELECT count(*) FROM seccov WHERE present <= 1) WHERE n > 0", "imposs2", "seccov"))
def _(spark, d):
    bad = A.impossible_results(G.with_returns(B.bars(spark, d))).where(F.size("issues") > 0)
    return A.health_score(A.issue_list(("high", "impossible_results", bad), ("low", "thin_sectors", A.sector_coverage(*universe(spark, d)).where(F.col("present") <= 1))))


# --- diagnostics ------------------------------------------------------------------------------------------
cte("res", "SELECT *, actual - predicted AS e FROM pred_ok", "pred_ok")


def res(spark, d):
    return D.residuals(naive_predictions(spark, d))


@query("dia1_residual_ratios", sql("SELECT ticker, round(m / s * sqrt(252), 5) AS sharpe, round(m / dd * sqrt(252), 5) AS sortino FROM (SELECT ticker, avg(e) AS m, stddev_pop(e) AS s, stddev_pop(e) FILTER (e < 0) AS dd FROM res GROUP BY 1)", "res"))
def _(spark, d):
    return rounded(D.residual_ratios(res(spark, d)), 5)


@query("dia2_worst_shock", sql("SELECT ticker, round(max(abs(factor_impact + direct_shock)), 6) AS worst, max(abs(factor_impact + direct_shock)) > 0.2 AS exceeds FROM impact GROUP BY 1", "impact"))
def _(spark, d):
    sec = B.sectors(spark, d).withColumn("sector", F.when(F.col("ticker").isin("PROMO", "SMALL"), "technology").otherwise(F.col("sector")))
    i = RG.scenario_impacts(RG.factor_betas(supervised(spark, d), "log_return", MAC), RG.resolve_scenarios(spark), sec)
    return rounded(D.worst_shock(i.withColumnRenamed("total", "impact")))


@query("dia3_high_vif", sql("SELECT ticker, round(max(vif), 4) AS max_vif, coalesce(list(factor ORDER BY factor) FILTER (vif > 5), []) AS offenders FROM vif GROUP BY 1", "vif"))
def _(spark, d):
    return rounded(D.high_vif(RG.inflation_factors(supervised(spark, d), "log_return", MAC)), 4)


cte("roll_e", """SELECT ticker, date, beta * mx / my AS elasticity FROM (SELECT ticker, date, covar_samp(y, x) OVER f / var_samp(x) OVER f AS beta, avg(x) OVER f AS mx, avg(y) OVER f AS my, count(*) OVER f AS c FROM sup1
    WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 89 PRECEDING)) WHERE c >= 90 AND abs(my) > 1e-10""", "sup1")


def rolling(spark, d):
    return R.rolling_elasticity(supervised(spark, d, ["inflation"]), "log_return", "inflation", 90)


cte("roll_n", "SELECT ticker, elasticity, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM roll_e WHERE elasticity IS NOT NULL", "roll_e")
cte("resample", """SELECT ticker, quantile_cont(r, 0.95) AS band_high FROM (SELECT p.ticker, p.b, (quantile_cont(v.elasticity, 0.75) - quantile_cont(v.elasticity, 0.25)) / abs(quantile_cont(v.elasticity, 0.5)) AS r FROM (
    SELECT ticker, b, floor(('0x' || substr(md5(ticker || '|' || b || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n) + 1 AS i FROM roll_n, (SELECT unnest(generate_series(1, 200)) AS b)) p
    JOIN roll_n v ON v.ticker = p.ticker AND v.i = p.i GROUP BY 1, 2) GROUP BY 1""", "roll_n")


@query("dia4_regime_stability", sql("""SELECT ticker, n, round(robust_cv, 4) AS robust_cv, round(band_high, 4) AS band_high, lim AS "limit", band_high < lim AS stable FROM (
    SELECT ticker, count(*) AS n, (quantile_cont(elasticity, 0.75) - quantile_cont(elasticity, 0.25)) / abs(quantile_cont(elasticity, 0.5)) AS robust_cv,
    ROUND(greatest(2.5, 4.0 * greatest(0.5, 1.0 - (count(*) - 8) * 0.02)), 2)::DOUBLE AS lim FROM roll_e GROUP BY 1) JOIN resample USING (ticker)""", "roll_e", "resample"))
def _(spark, d):
    return rounded(D.regime_stability(rolling(spark, d)).drop("cv"), 4)


@query("dia5_staleness", sql("SELECT ticker, (DATE '2001-11-20' - max(date))::BIGINT AS lag_days, (DATE '2001-11-20' - max(date)) > CASE WHEN DATE '2001-11-20' - max(date) > 30 THEN 21 ELSE 14 END AS stale FROM pred_ok GROUP BY 1", "pred_ok"))
def _(spark, d):
    return D.staleness(naive_predictions(spark, d), "2001-11-20")


@query("dia6_residual_shift", sql("""SELECT ticker, n, round(sr, 5) AS std_ratio, round(ms, 6) AS mean_shift, coalesce(sr > 1.8 OR sr < 0.55, false) OR ms > 0.02 AS shifted FROM (SELECT ticker, count(*) AS n, stddev_pop(e) FILTER (i > n - k) / stddev_pop(e) FILTER (i <= k) AS sr,
    abs(avg(e) FILTER (i > n - k) - avg(e) FILTER (i <= k)) AS ms FROM (SELECT *, greatest(10, n // 4) AS k FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM res)) GROUP BY 1) WHERE n >= 40""", "res"))
def _(spark, d):
    return rounded(D.residual_shift(res(spark, d)), 6, std_ratio=5)


@query("dia7_lag_one", sql(f"SELECT ticker, count(*) AS n, round(corr(e, p), 6) AS lag1, abs(corr(e, p)) > 0.2 AS problem FROM (SELECT *, lag(e) {WT}) AS p FROM res) GROUP BY 1", "res"))
def _(spark, d):
    return rounded(D.lag_one(res(spark, d)))


@query("dia8_band_quality", sql("""SELECT ticker, round(q[1], 6) AS low, round(q[2], 6) AS high, CASE WHEN q[2] - q[1] <= 1e-6 THEN 'degenerate_interval' WHEN q[2] - q[1] > 0.6 THEN 'too_wide_interval' WHEN s = 0 THEN 'zero_bootstrap_std' END AS reason
    FROM (SELECT ticker, quantile_cont(e, [0.05, 0.95]) AS q, stddev_pop(e) AS s FROM res GROUP BY 1)""", "res"))
def _(spark, d):
    b = res(spark, d).groupBy("ticker").agg(F.percentile("e", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.stddev_pop("e").alias("std"))
    return rounded(D.band_quality(b.select("ticker", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "std")).drop("std"))


@query("dia9_sign_flips", sql(f"SELECT ticker, count(*) AS n, round(avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) FILTER (f IS NOT NULL), 6) AS flip_ratio, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) FILTER (f IS NOT NULL) > 0.4 AS unstable FROM (SELECT *, sign(elasticity) <> lag(sign(elasticity)) {WT}) AS f FROM roll_e WHERE elasticity <> 0) GROUP BY 1", "roll_e"))
def _(spark, d):
    return rounded(D.sign_flips(rolling(spark, d)))


@query("dia10_tail_gap", sql("""SELECT ticker, round(p, 6) AS p95_abs, round(c, 6) AS cvar, abs(c) < 0.5 * p AS gap FROM (SELECT ticker, quantile_cont(abs(e), 0.95) AS p FROM res GROUP BY 1) JOIN (SELECT ticker, avg(actual) FILTER (actual <= q) AS c FROM pred_ok
    JOIN (SELECT ticker, quantile_cont(actual, 0.05) AS q FROM pred_ok GROUP BY 1) USING (ticker) GROUP BY 1) USING (ticker)""", "res", "pred_ok"))
def _(spark, d):
    from ..operators.risk import historical_var
    r = res(spark, d)
    tail = historical_var(r, "actual").select("ticker", (-F.col("es")).alias("cvar"))
    return rounded(D.tail_gap(r, tail))


@query("dia11_split_integrity", sql("""SELECT ticker, CASE WHEN te >= vs THEN 'overlap' WHEN ts >= te OR vs >= ve THEN 'not_monotonic' WHEN vs - te > 30 THEN 'excessive_gap' END AS reason, (vs - te)::BIGINT AS gap_days FROM (
    SELECT ticker, min(date) FILTER (is_train) AS ts, max(date) FILTER (is_train) AS te, min(date) FILTER (NOT is_train) AS vs, max(date) FILTER (NOT is_train) AS ve FROM split GROUP BY 1)""", "split"))
def _(spark, d):
    b = D.split_integrity(V.split_bounds(V.with_split(supervised(spark, d))))
    return b.select("ticker", "reason", F.datediff("test_start", "train_end").cast("long").alias("gap_days"))


PRIORS = [("inflation", -1), ("consumer_sentiment", 1)]


def wbetas(spark, d):
    items = [F.struct(F.lit(f).alias("factor"), (F.regr_slope("log_return", f) * F.stddev_samp(f)).alias("coef")) for f in MAC]
    return supervised(spark, d).groupBy("ticker").agg(F.array(*items).alias("a")).select("ticker", F.inline("a"))


@query("dia12_explainability", sql(f"""SELECT ticker, max_by(factor, s) AS top_factor, round(max(s), 5) AS top_share, count(*) FILTER (coef <> 0 AND sign(coef) <> prior) AS contradictions, max(s) > 0.85 OR count(*) FILTER (coef <> 0 AND sign(coef) <> prior) > 0 AS problem FROM (
    SELECT *, abs(coef) / sum(abs(coef)) OVER (PARTITION BY ticker) AS s FROM imp) LEFT JOIN ({values_sql(("factor", "prior"), PRIORS)}) USING (factor) GROUP BY 1""", "imp"))
def _(spark, d):
    return rounded(D.explainability(wbetas(spark, d), PRIORS), 5)


cte("sides", "SELECT ticker, is_train, feature, x FROM split UNPIVOT (x FOR feature IN (" + ", ".join(MAC) + "))", "split")


def sides(spark, d):
    return R.long_features(V.with_split(supervised(spark, d)), MAC, ["ticker", "is_train"])


@query("dia13_ks_statistic", sql("""SELECT ticker, feature, round(max(abs(a / na - b / nb)), 6) AS ks FROM (SELECT ticker, feature, count(*) FILTER (is_train) OVER w AS a, count(*) FILTER (NOT is_train) OVER w AS b, count(*) FILTER (is_train) OVER g AS na, count(*) FILTER (NOT is_train) OVER g AS nb FROM sides
    WINDOW w AS (PARTITION BY ticker, feature ORDER BY x RANGE UNBOUNDED PRECEDING), g AS (PARTITION BY ticker, feature)) GROUP BY 1, 2""", "sides"))
def _(spark, d):
    return rounded(D.ks_statistic(sides(spark, d)))


cte("psi_e", "SELECT ticker, feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (is_train))) AS e FROM sides GROUP BY 1, 2", "sides")
cte("psi_b", "SELECT s.*, len(e) AS n, CASE WHEN x = e[len(e)] THEN len(e) - 1 ELSE len(list_filter(e, lambda v: v <= x)) END AS b FROM sides s JOIN psi_e USING (ticker, feature)", "sides", "psi_e")


@query("dia14_stability_index", sql("""SELECT ticker, feature, round(CASE WHEN max(n) < 4 THEN 0 ELSE sum((cp - bp) * ln(cp / bp)) END, 5) AS psi FROM (SELECT *, greatest(1e-6, least(1.0, t / greatest(1, sum(t) OVER g))) AS bp, greatest(1e-6, least(1.0, c / greatest(1, sum(c) OVER g))) AS cp FROM (
    SELECT ticker, feature, n, b, count(*) FILTER (is_train) AS t, count(*) FILTER (NOT is_train) AS c FROM psi_b WHERE b >= 1 AND b < n GROUP BY ALL) WINDOW g AS (PARTITION BY ticker, feature)) GROUP BY 1, 2""", "psi_b"))
def _(spark, d):
    return rounded(D.stability_index(sides(spark, d)), 5)


cte("lb_scan", """SELECT a.ticker, k AS lag, corr(a.e, b.e) AS c FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM res) a JOIN (SELECT unnest(generate_series(1, 10)) AS k) ks ON true
    JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM res) b ON a.ticker = b.ticker AND b.i = a.i - k GROUP BY 1, 2""", "res")


@query("dia15_ljung_box", sql("""SELECT ticker, n, l::BIGINT AS lags, round(n * (n + 2) * sum(c * c / greatest(1, n - lag)), 4) AS q, 18.31::DOUBLE AS critical, n * (n + 2) * sum(c * c / greatest(1, n - lag)) > 18.31 AS flagged FROM lb_scan
    JOIN (SELECT ticker, count(*) AS n, least(10, greatest(2, count(*) // 8)) AS l FROM res GROUP BY 1) USING (ticker) WHERE lag <= l GROUP BY 1, 2, 3""", "lb_scan", "res"))
def _(spark, d):
    return rounded(D.ljung_box(res(spark, d)), 4)


@query("dia16_heteroskedasticity", sql("SELECT ticker, count(*) AS n, round(regr_r2(e * e, predicted) * count(*), 5) AS lm, regr_r2(e * e, predicted) * count(*) > 3.84 AS flagged FROM res GROUP BY 1", "res"))
def _(spark, d):
    return rounded(D.heteroskedasticity(res(spark, d)), 5)


@query("dia17_band_coverage", sql("SELECT ticker, count(*) AS n, round(avg(CASE WHEN abs(e) <= 1.645 * s THEN 1.0 ELSE 0.0 END), 6) AS coverage, abs(avg(CASE WHEN abs(e) <= 1.645 * s THEN 1.0 ELSE 0.0 END) - 0.9) > 0.08 AS problem FROM (SELECT *, stddev_pop(e) OVER (PARTITION BY ticker) AS s FROM res) GROUP BY 1", "res"))
def _(spark, d):
    return rounded(D.band_coverage(res(spark, d)))


# yearly betas stand for coefficient windows
cte("ycoef", " UNION ALL ".join(f"SELECT ticker, year(date) AS \"window\", '{f}' AS factor, regr_slope(log_return, {f}) * stddev_samp({f}) AS coef, stddev_samp(log_return) / sqrt(count(*)) AS se FROM sup GROUP BY 1, 2" for f in ("inflation", "energy_index", "consumer_sentiment")), "sup")
cte("ynorm", 'SELECT *, abs(coef) / sum(abs(coef)) OVER (PARTITION BY ticker, "window") AS s FROM ycoef', "ycoef")


def ycoef(spark, d):
    items = [F.struct(F.lit(f).alias("factor"), (F.regr_slope("log_return", f) * F.stddev_samp(f)).alias("coef"), (F.stddev_samp("log_return") / F.sqrt(F.count("*").cast("double"))).alias("se")) for f in ("inflation", "energy_index", "consumer_sentiment")]
    s = supervised(spark, d).groupBy("ticker", F.year("date").cast("long").alias("window")).agg(F.array(*items).alias("a"))
    return s.select("ticker", "window", F.inline("a"))


@query("dia18_importance_drift", sql("""SELECT ticker, round(mean_l1, 5) AS mean_l1, round(flip_ratio, 6) AS flip_ratio, mean_l1 > 0.9 OR flip_ratio > 0.6 AS problem FROM (SELECT a.ticker, sum(abs(a.s - b.s)) / count(DISTINCT a."window") AS mean_l1 FROM ynorm a JOIN ynorm b ON a.ticker = b.ticker AND a.factor = b.factor AND a."window" = b."window" + 1 GROUP BY 1)
    JOIN (SELECT ticker, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) FILTER (f IS NOT NULL) AS flip_ratio FROM (SELECT ticker, top <> lag(top) OVER (PARTITION BY ticker ORDER BY w) AS f FROM (SELECT ticker, "window" AS w, max_by(factor, s) AS top FROM ynorm GROUP BY 1, 2)) GROUP BY 1) USING (ticker)""", "ynorm"))
def _(spark, d):
    return rounded(D.importance_drift(stage(ycoef(spark, d))), 6, mean_l1=5)


@query("dia19_band_overlap", sql("""SELECT ticker, factor, count(o) AS pairs, round(avg(CASE WHEN o THEN 1.0 ELSE 0.0 END) FILTER (o IS NOT NULL), 6) AS overlap_ratio, count(o) >= 2 AND avg(CASE WHEN o THEN 1.0 ELSE 0.0 END) FILTER (o IS NOT NULL) < 0.5 AS problem FROM (
    SELECT ticker, factor, NOT (lag(coef + se) OVER w < coef - se OR coef + se < lag(coef - se) OVER w) AS o FROM ycoef WINDOW w AS (PARTITION BY ticker, factor ORDER BY "window")) GROUP BY 1, 2""", "ycoef"))
def _(spark, d):
    b = ycoef(spark, d).withColumn("lo", F.col("coef") - F.col("se")).withColumn("hi", F.col("coef") + F.col("se"))
    return rounded(D.band_overlap(b))


@query("dia20_backtest_realism", sql(f"""SELECT ticker, round(sum(c) / greatest(count(*) / 252.0, 1.0), 5) AS turnover, CASE WHEN sum(c) / greatest(count(*) / 252.0, 1.0) > 3 THEN 'excessive_turnover' END AS reason FROM (
    SELECT ticker, abs(signal - coalesce(lag(signal) {WT}), 0)) AS c FROM bt WHERE {ONE}) GROUP BY 1""", "bt"))
def _(spark, d):
    x, _ = K.run(B.bars(spark, d))
    return rounded(D.backtest_realism(x), 5)


@query("dia21_run_robustness", sql("""SELECT component, CAST(sum(greatest(f - 1, 0)) AS BIGINT) AS retries, CAST(sum(f) AS BIGINT) AS failures, CASE WHEN sum(greatest(f - 1, 0)) >= 10 THEN 'retry_storm' WHEN sum(f) > 0 THEN 'failures' END AS reason FROM (
    SELECT component, operation, count(*) FILTER (NOT success) AS f FROM ops GROUP BY 1, 2) GROUP BY 1""", "ops"))
def _(spark, d):
    return D.run_robustness(B.operations(spark, d))


@query("dia22_worst_outlier_share", sql("SELECT round(max(outliers / n_rows), 6) AS outlier_ratio FROM report WHERE status = 'success'", "report"))
def _(spark, d):
    return rounded(D.worst_outlier_share(_clean(spark, d)[1]))


PEN = {k: v for k, v, _ in D.PENALTIES}
cte("find", f"""SELECT ticker, 'RESIDUAL_AUTOCORR' AS f FROM (SELECT ticker, abs(corr(e, p)) > 0.2 AS x FROM (SELECT *, lag(e) {WT}) AS p FROM res) GROUP BY 1) WHERE x
    UNION ALL SELECT ticker, 'RESIDUAL_HETERO' FROM res GROUP BY 1 HAVING regr_r2(e * e, predicted) * count(*) > 3.84
    UNION ALL SELECT ticker, 'COVERAGE_CALIBRATION' FROM (SELECT *, stddev_pop(e) OVER (PARTITION BY ticker) AS s FROM res) GROUP BY 1 HAVING abs(avg(CASE WHEN abs(e) <= 1.645 * s THEN 1.0 ELSE 0.0 END) - 0.9) > 0.08
    UNION ALL SELECT ticker, 'POOR_RISK_ADJ' FROM res GROUP BY 1 HAVING avg(e) / stddev_pop(e) * sqrt(252) < -0.5""", "res")


@query("dia23_diagnose_residual_codes", sql(f"""SELECT ticker, greatest(0.0, coalesce(least(100.0, 100.0 - sum(CASE f {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PEN.items())} END)), 100.0))::DOUBLE AS score, coalesce(string_agg(f, ',' ORDER BY f), '') AS findings FROM (SELECT DISTINCT ticker FROM res) LEFT JOIN find USING (ticker) GROUP BY 1""", "find", "res"))
def _(spark, d):
    r = stage(res(spark, d))
    f = D.finding(D.lag_one(r), "problem", "RESIDUAL_AUTOCORR").unionByName(D.finding(D.heteroskedasticity(r), "flagged", "RESIDUAL_HETERO")).unionByName(
        D.finding(D.band_coverage(r), "problem", "COVERAGE_CALIBRATION")).unionByName(D.finding(D.residual_ratios(r), F.col("sharpe") < -0.5, "POOR_RISK_ADJ"))
    return D.diagnose(f, r.select("ticker").distinct()).select("ticker", "score", F.array_join("findings", ",").alias("findings"))


def findings(spark, d, r):
    """All codes: the checks of dia1 to dia22, data gaps and look-ahead; r: residuals."""
    from ..operators.risk import historical_var
    f, sup, roll = D.finding, stage(supervised(spark, d)), stage(rolling(spark, d))
    split, coefs = stage(V.with_split(sup)), stage(ycoef(spark, d))
    sec = B.sectors(spark, d).withColumn("sector", F.when(F.col("ticker").isin("PROMO", "SMALL"), "technology").otherwise(F.col("sector")))
    impacts = RG.scenario_impacts(RG.factor_betas(sup, "log_return", MAC), RG.resolve_scenarios(spark), sec).withColumnRenamed("total", "impact")
    bands = r.groupBy("ticker").agg(F.percentile("e", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.stddev_pop("e").alias("std")).select("ticker", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "std")
    s = stage(R.long_features(split, MAC, ["ticker", "is_train"]))
    b = coefs.withColumn("lo", F.col("coef") - F.col("se")).withColumn("hi", F.col("coef") + F.col("se"))
    items = [F.struct(F.lit(x).alias("factor"), (F.regr_slope("log_return", x) * F.stddev_samp(x)).alias("coef")) for x in MAC]
    weights = sup.groupBy("ticker").agg(F.array(*items).alias("a")).select("ticker", F.inline("a"))
    why = F.col("reason").isNotNull()
    per = [
        f(sup.groupBy("ticker").agg(F.avg("log_return").alias("m")), F.abs("m") <= 1e-10, "SCALING_ISSUE"),
        f(D.residual_ratios(r), F.col("sharpe") < -0.5, "POOR_RISK_ADJ"),
        f(D.worst_shock(impacts), "exceeds", "EXCESS_DRAWDOWN"),
        f(D.high_vif(RG.inflation_factors(sup, "log_return", MAC)), F.size("offenders") > 0, "MULTICOLLINEARITY", penalty=F.least(F.lit(8.0), 4.0 * F.size("offenders"))),
        f(D.regime_stability(roll), ~F.col("stable"), "REGIME_INSTABILITY"),
        f(D.staleness(r, "2001-11-20"), "stale", "STALE_DATA"),
        f(D.residual_shift(r), "shifted", "DIST_SHIFT"),
        f(D.lag_one(r), "problem", "RESIDUAL_AUTOCORR"),
        f(D.band_quality(bands), why, "CI_QUALITY"),
        f(D.sign_flips(roll), "unstable", "SIGN_INSTABILITY"),
        f(D.tail_gap(r, historical_var(r, "actual").select("ticker", (-F.col("es")).alias("cvar"))), "gap", "UNCERTAINTY_GAP"),
        f(D.split_integrity(V.split_bounds(split)), why, "TEMPORAL_INTEGRITY"),
        f(D.explainability(weights, PRIORS), "problem", "EXPLAINABILITY_RISK"),
        f(D.feature_shift(D.ks_statistic(s), D.stability_index(s), s), "shifted", "FEATURE_SHIFT"),
        f(D.ljung_box(r), "flagged", "RESIDUAL_HETERO"),  # the reference has both tests under one code
        f(D.heteroskedasticity(r), "flagged", "RESIDUAL_HETERO"),
        f(D.band_coverage(r), "problem", "COVERAGE_CALIBRATION"),
        f(D.importance_drift(coefs), "problem", "SHAP_STABILITY"),
        f(D.band_overlap(b), "problem", "COEFF_CI_OVERLAP"),
        f(D.backtest_realism(K.run(B.bars(spark, d))[0]), why, "BACKTEST_REALISM"),
        f(D.lookahead_count(V.leakage(sup, "log_return", MAC)), F.col("n") > 0, "LOOKAHEAD_BIAS", penalty=F.least(F.lit(20.0), 8.0 * F.col("n"))),
    ]
    report = stage(_clean(spark, d)[1])
    run = D.run_findings(("DATA_GAPS", D.data_gap_penalty(report, S.source_report(spark, report))), ("OUTLIERS", D.outlier_penalty(D.worst_outlier_share(report))),
                         ("PIPELINE_ROBUSTNESS", D.robustness_penalty(D.run_robustness(B.operations(spark, d)))))
    out = r.select("ticker").distinct().crossJoin(F.broadcast(run))
    for t in per:
        out = out.unionByName(t)
    return out


CODES = {"POOR_RISK_ADJ": ("dia1_residual_ratios", "sharpe < -0.5"), "EXCESS_DRAWDOWN": ("dia2_worst_shock", "exceeds"), "REGIME_INSTABILITY": ("dia4_regime_stability", "NOT stable"), "STALE_DATA": ("dia5_staleness", "stale"),
         "DIST_SHIFT": ("dia6_residual_shift", "shifted"), "RESIDUAL_AUTOCORR": ("dia7_lag_one", "problem"), "CI_QUALITY": ("dia8_band_quality", "reason IS NOT NULL"), "SIGN_INSTABILITY": ("dia9_sign_flips", "unstable"),
         "UNCERTAINTY_GAP": ("dia10_tail_gap", "gap"), "TEMPORAL_INTEGRITY": ("dia11_split_integrity", "reason IS NOT NULL"), "EXPLAINABILITY_RISK": ("dia12_explainability", "problem"),
         "COVERAGE_CALIBRATION": ("dia17_band_coverage", "problem"), "SHAP_STABILITY": ("dia18_importance_drift", "problem"), "COEFF_CI_OVERLAP": ("dia19_band_overlap", "problem"), "BACKTEST_REALISM": ("dia20_backtest_realism", "reason IS NOT NULL")}


def all_codes_sql():
    """Findings of every check, from the SQL of the checks themselves; codes with a penalty of their own carry it."""
    none = "NULL::DOUBLE AS own"
    parts = [f"SELECT ticker, '{code}' AS f, {none} FROM ({ORACLES[name]}) WHERE {flag}" for code, (name, flag) in CODES.items()]
    parts += [f"SELECT ticker, 'RESIDUAL_HETERO', {none} FROM ({ORACLES[name]}) WHERE flagged" for name in ("dia15_ljung_box", "dia16_heteroskedasticity")]
    parts.append(f"SELECT ticker, 'MULTICOLLINEARITY', least(8.0, 4.0 * len(offenders))::DOUBLE FROM ({ORACLES['dia3_high_vif']}) WHERE len(offenders) > 0")
    parts.append(f"SELECT ticker, 'SCALING_ISSUE', {none} FROM sup GROUP BY 1 HAVING abs(avg(log_return)) <= 1e-10")
    parts.append(f"""SELECT ticker, 'FEATURE_SHIFT', {none} FROM (SELECT ticker, feature, count(*) FILTER (is_train) AS a, count(*) FILTER (NOT is_train) AS b FROM sides WHERE x IS NOT NULL GROUP BY 1, 2)
      LEFT JOIN ({ORACLES['dia13_ks_statistic']}) USING (ticker, feature) LEFT JOIN ({ORACLES['dia14_stability_index']}) USING (ticker, feature) WHERE a >= 30 AND b >= 30 AND (ks > 0.2 OR psi > 0.2)""")
    parts.append(f"""SELECT ticker, 'LOOKAHEAD_BIAS', least(20.0, 8.0 * count(*))::DOUBLE FROM (SELECT ticker, factor, count(*) AS n, corr(log_return, ld) AS lead_corr, corr(log_return, lg) AS lag_corr FROM (
      SELECT *, lead(v) OVER w AS ld, lag(v) OVER w AS lg FROM sup UNPIVOT (v FOR factor IN ({', '.join(MAC)})) WINDOW w AS (PARTITION BY ticker, factor ORDER BY date)) GROUP BY 1, 2) WHERE abs(lead_corr) > abs(lag_corr) + CASE WHEN n >= 60 THEN 0.15 ELSE 0.25 END GROUP BY 1""")
    run = """SELECT 'DATA_GAPS' AS f, (SELECT least(20.0, 8.0 * count(*)) FROM (VALUES ('yfinance'), ('fred'), ('worldbank')) v(s) WHERE s NOT IN (SELECT source FROM report WHERE status = 'success'))
        + (SELECT least(15.0, count(*)) FROM report WHERE status = 'failed') AS own
      UNION ALL SELECT 'OUTLIERS', CASE WHEN max(outliers / n_rows) > 0.05 THEN least(12.0, max(outliers / n_rows) * 100) END FROM report WHERE status = 'success'
      UNION ALL SELECT 'PIPELINE_ROBUSTNESS', CASE WHEN count(*) > 0 THEN 5.0 END FROM (""" + ORACLES["dia21_run_robustness"] + ") WHERE reason IS NOT NULL"
    parts.append(f"SELECT ticker, f, own::DOUBLE FROM (SELECT DISTINCT ticker FROM res), ({run}) WHERE own > 0")
    return " UNION ALL ".join(parts)


cte("every_code", all_codes_sql(), "sup", "sides", "res", "report")


@query("dia23_diagnose", sql(f"""SELECT ticker, round(coalesce(greatest(0.0, least(100.0, 100.0 - sum(coalesce(own, CASE f {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PEN.items())} END)))), 100.0), 4) AS score, coalesce(string_agg(f, ',' ORDER BY f), '') AS findings
    FROM (SELECT DISTINCT ticker FROM res) LEFT JOIN (SELECT ticker, f, max(own) AS own FROM every_code GROUP BY 1, 2) USING (ticker) GROUP BY 1""", "every_code", "res"))
def _(spark, d):
    r = stage(res(spark, d))
    return rounded(D.diagnose(findings(spark, d, r), r.select("ticker").distinct()).select("ticker", "score", F.array_join("findings", ",").alias("findings")), 4)


# --- run health --------------------------------------------------------------------------------------------
cte("health", """SELECT *, greatest(0.0, 100.0 - (null_penalty + outlier_penalty + schema_penalty + source_penalty + freshness_penalty)) AS score FROM (SELECT
    least(coalesce(sum(final_nulls) FILTER (ok) / nullif(sum(n_rows) FILTER (ok), 0), 0) * 100, 25.0) AS null_penalty, least(coalesce(sum(outliers) FILTER (ok) / nullif(sum(n_rows) FILTER (ok), 0), 0) * 120, 20.0) AS outlier_penalty,
    least(count(*) FILTER (NOT ok) / count(*) * 50, 50.0) AS schema_penalty, least((3 - count(DISTINCT source) FILTER (ok)) * 15.0, 45.0) AS source_penalty, 4.8 AS freshness_penalty FROM (SELECT *, status = 'success' AS ok FROM report))""", "report")


@query("ops1_data_health", sql("SELECT round(null_penalty, 5)::DOUBLE AS null_penalty, round(outlier_penalty, 5)::DOUBLE AS outlier_penalty, round(schema_penalty, 5)::DOUBLE AS schema_penalty, round(source_penalty, 5)::DOUBLE AS source_penalty, freshness_penalty::DOUBLE AS freshness_penalty, round(score, 5)::DOUBLE AS score, CASE WHEN score < 50 THEN 'critical' WHEN score < 70 THEN 'warning' ELSE 'good' END AS status FROM health", "health"))
def _(spark, d):
    return rounded(H.data_health(_clean(spark, d)[1], age_hours=30.0), 5)


cte("runs", "SELECT CAST(ts AS DATE) AS run, count(*) AS operations, count(DISTINCT component) AS components, count(DISTINCT operation) AS kinds, sum(duration_seconds) AS duration, count(*) FILTER (success) AS successes FROM ops GROUP BY 1", "ops")


def runs(spark, d):
    return H.session_summary(B.operations(spark, d), F.to_date("ts"))


@query("ops2_run_comparison", sql("""SELECT round(a.duration, 4) AS duration, round(b.duration, 4) AS duration_before, round(a.duration - b.duration, 4) AS duration_delta, a.operations, b.operations AS operations_before, a.operations - b.operations AS operations_delta
    FROM (SELECT * FROM runs ORDER BY run DESC LIMIT 1) a, (SELECT * FROM runs ORDER BY run DESC LIMIT 1 OFFSET 1) b""", "runs"))
def _(spark, d):
    return rounded(H.run_comparison(runs(spark, d)), 4)


@query("ops3_alerts", sql("""SELECT CASE WHEN score < 50 THEN 'critical' ELSE 'warning' END AS severity, 'data_quality_dropped' AS title, round(score, 4)::DOUBLE AS value FROM health WHERE score < 70
    UNION ALL SELECT 'warning', 'run_slowed_down', round(a.duration, 4) FROM (SELECT * FROM runs ORDER BY run DESC LIMIT 1) a, (SELECT * FROM runs ORDER BY run DESC LIMIT 1 OFFSET 1) b WHERE a.duration > 1.4 * b.duration""", "health", "runs"))
def _(spark, d):
    return rounded(H.alerts(H.data_health(_clean(spark, d)[1], age_hours=30.0), H.run_comparison(runs(spark, d))), 4)


P95 = "list_sort(list(duration_seconds))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1]"


@query("ops6_service_level", sql(f"SELECT operation, count(*) AS events, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(CASE WHEN success THEN 0.0 ELSE 1.0 END), 6) AS error_rate, round({P95}, 4) AS p95_seconds, round(count(*) / sum(duration_seconds), 6) AS throughput FROM ops GROUP BY 1", "ops"))
def _(spark, d):
    return rounded(H.service_level(B.operations(spark, d)), 6, p95_seconds=4)


@query("ops7_trailing_levels", sql(f"""SELECT span, operation, count(*) AS events, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(CASE WHEN success THEN 0.0 ELSE 1.0 END), 6) AS error_rate, round({P95}, 4) AS p95_seconds
    FROM ops, (VALUES (300::BIGINT), (3600::BIGINT), (86400::BIGINT)) s(span) WHERE epoch_us((SELECT max(ts) FROM ops)) - epoch_us(ts) <= span * 1000000 GROUP BY 1, 2""", "ops"))
def _(spark, d):
    return rounded(H.trailing_levels(B.operations(spark, d), (300, 3600, 86400)), 6, p95_seconds=4)


@query("ops8_session_summary", sql("SELECT run, operations, components, kinds, round(duration, 3) AS duration, successes, round(successes / operations, 6) AS success_rate, round(1 - successes / operations, 6) AS error_rate FROM runs", "runs"))
def _(spark, d):
    return rounded(runs(spark, d), 6, duration=3)


@query("ops9_error_counts", sql("SELECT component, count(*) AS errors FROM ops WHERE NOT success GROUP BY 1", "ops"))
def _(spark, d):
    return H.error_counts(B.operations(spark, d), "component")


@query("ops10_traffic_lights", sql("""SELECT run_id, ticker, CASE WHEN risk_score <= 0.45 THEN 'green' WHEN risk_score <= 0.7 THEN 'yellow' ELSE 'red' END AS risk_light, CASE WHEN wf_avg_r2 >= 0.05 THEN 'green' WHEN wf_avg_r2 >= -0.75 THEN 'yellow' ELSE 'red' END AS r2_light,
    CASE WHEN passed AND severity = 'pass' THEN 'green' WHEN severity = 'warn' THEN 'yellow' ELSE 'red' END AS gate_light FROM dec2""", "dec2"))
def _(spark, d):
    t = H.traffic_lights(decisions(spark, d).withColumnRenamed("wf_avg_r2", "r2"))
    return t.select("run_id", "ticker", "risk_light", "r2_light", "gate_light")


@query("ops13_quick_diagnostics", sql("""SELECT count(*) FILTER (status = 'failed') AS failed, coalesce(string_agg(DISTINCT entity, ',' ORDER BY entity) FILTER (status = 'failed'), '') AS failed_entities,
    (SELECT coalesce(string_agg(s, ',' ORDER BY s), '') FROM (VALUES ('yfinance'), ('fred'), ('worldbank')) v(s) WHERE s NOT IN (SELECT source FROM report WHERE status = 'success')) AS missing_sources,
    max_by(entity || ': ' || error_type, row(coalesce(seen_at, DATE '1900-01-01'), entity)) FILTER (status = 'failed') AS last_dead_letter
    FROM report LEFT JOIN (SELECT source, entity, max(date) AS seen_at FROM raw GROUP BY 1, 2) USING (source, entity)""", "report", "raw"))
def _(spark, d):
    rep = stage(_clean(spark, d)[1])
    seen = I.catalog(B.raw_entities(spark, d)).select("source", "entity", F.col("last_update").alias("at"))
    return H.quick_diagnostics(rep, S.dead_letters(rep).join(seen, ["source", "entity"], "left"), S.source_report(spark, rep))


# --- streams -------------------------------------------------------------------------------------------------
LEVELS = """SELECT from_ts, from_ts + INTERVAL 1 HOUR AS to_ts, operation, count(*) AS events, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
    round(quantile_disc(duration_seconds, 0.95), 6) AS p95_seconds FROM (
    SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS from_ts FROM ops, (SELECT unnest(generate_series(0, 11)) AS k)) GROUP BY 1, 2, 3"""


def shown(r):
    return rounded(r.select(F.col("from_ts").cast("timestamp_ntz").alias("from_ts"), F.col("to_ts").cast("timestamp_ntz").alias("to_ts"), "operation", "events", "success_rate", "p95_seconds"))


@query("str1_rolling_levels_stream", sql(LEVELS, "ops"))
def _(spark, d):
    path = _sink_path(spark)
    levels.run_to_table(levels.rolling_levels(levels.event_stream(spark, f"{d}/events*.parquet")), f"{path}/out", f"{path}/ckpt")
    return shown(levels.current_levels(spark, f"{path}/out"))


@query("str1_rolling_levels_batch", sql(LEVELS, "ops"))
def _(spark, d):
    return shown(levels.rolling_levels(B.operations(spark, d)))


@query("str2_incremental_validation", sql("SELECT operation, count(*) FILTER (success AND duration_seconds > 0) AS good, count(*) FILTER (NOT (success AND duration_seconds > 0)) AS dead FROM ops GROUP BY 1", "ops"))
def _(spark, d):
    path = _sink_path(spark)
    cleaning.run_cleaning(levels.event_stream(spark, f"{d}/events*.parquet"), path, f"{path}/ckpt")
    good = spark.read.parquet(f"{path}/good").select("operation", F.lit(1).alias("g"))
    dead = spark.read.parquet(f"{path}/dead").select("operation", F.lit(0).alias("g"))
    return good.unionByName(dead).groupBy("operation").agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("dead"))


@query("ops7_trailing_stream", sql(" UNION ALL ".join(f"""SELECT operation, event_id, {n}::BIGINT AS span, count(*) OVER w AS events, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) OVER w, 6) AS success_rate, round(quantile_disc(duration_seconds, 0.95) OVER w, 6) AS p95_seconds
    FROM ops WINDOW w AS (PARTITION BY operation ORDER BY ts RANGE BETWEEN INTERVAL {n} SECONDS PRECEDING AND CURRENT ROW)""" for n in trailing.SPANS), "ops"))
def _(spark, d):
    path = _sink_path(spark)
    trailing.run_trailing(trailing.trailing_stream(levels.event_stream(spark, f"{d}/events*.parquet")), f"{path}/out", f"{path}/ckpt")
    return rounded(trailing.latest(spark, f"{path}/out").drop("ts"))


def value_rules():
    return [(F.col("value").isNull(), "value_missing"), (F.col("value") <= 0, "value_out_of_range")]


def shards(ops):
    """Events of five entities; a failed operation has no value."""
    return ops.select(F.concat(F.lit("c"), F.col("component") % 5).alias("entity"), "ts", "event_id", F.when(F.col("success"), F.col("duration_seconds")).alias("value"))


@query("str2_validation_with_history", sql("""SELECT entity, day, n_rows, round(null_pct, 5) AS null_pct, round(null_limit, 5) AS null_limit, CASE WHEN n_rows < 10 THEN 'ok' WHEN null_pct > least(100.0, null_limit + """ + str(float(X.WARN_TO_FAIL_BUFFER)) + """) THEN 'fail' WHEN null_pct > null_limit THEN 'warn' ELSE 'ok' END AS severity,
    round(greatest(0.0, 100 - least(nulls * 100.0 / n_rows, 40.0) - least(bad * 100.0 / n_rows, 20.0)), 5) AS score, CASE WHEN n_rows >= 10 AND null_pct > least(100.0, null_limit + """ + str(float(X.WARN_TO_FAIL_BUFFER)) + """) THEN n_rows ELSE bad END AS dead FROM (
    SELECT *, greatest(15.0, least(70.0, coalesce(avg(null_pct) OVER w + 2 * stddev_pop(null_pct) OVER w, 0.0))) AS null_limit FROM (SELECT *, nulls * 100.0 / n_rows AS null_pct FROM (
      SELECT 'c' || (component % 5) AS entity, CAST(ts AS DATE) AS day, count(*) AS n_rows, count(*) FILTER (NOT success OR duration_seconds IS NULL) AS nulls, count(*) FILTER (NOT success OR duration_seconds IS NULL OR duration_seconds <= 0) AS bad FROM ops GROUP BY 1, 2))
    WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""", "ops"))
def _(spark, d):
    path = _sink_path(spark)
    history.run(shards(levels.event_stream(spark, f"{d}/events*.parquet")), path, f"{path}/ckpt", value_rules())
    dead = history.current(spark, path, "dead").groupBy("entity", "day").agg(F.count("*").alias("dead"))
    v = history.latest_verdicts(spark, path).join(dead, ["entity", "day"], "left")
    return rounded(v.select("entity", "day", "n_rows", "null_pct", "null_limit", "severity", "score", F.coalesce("dead", F.lit(0)).alias("dead")), 5)
