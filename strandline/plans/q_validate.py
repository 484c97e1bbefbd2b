"""Validation and governance (VAL), and the model-driven backtests that rest on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded, series, values_sql, values_table
from ..functions.stage import stage
from ..operators import backtest as K
from ..operators import tournament as M
from ..operators import transforms as T
from ..operators import validate as V
from ..sources import bindings as B
from .ctes import cte, fitted_sql, least_squares, sql
from .q_backtest import naive_predictions
from .q_gold import MAC, master, supervised
from .q_regress import CHOSEN, LAGS, lag_frames
from .q_sources import _sink_path
from .registry import query

WT = "OVER (PARTITION BY ticker ORDER BY date"
WTF = "OVER (PARTITION BY ticker, feature ORDER BY date"
cte("split", "SELECT *, i <= greatest(24, least(floor(n * 0.8), n - 5)) AS is_train FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM sup)", "sup")


cte("lag_split", "SELECT *, row_number() OVER (PARTITION BY ticker, lag ORDER BY date) <= floor(count(*) OVER (PARTITION BY ticker, lag) * 0.8) AS is_train FROM sup_lags", "sup_lags")
cte("lag_split_train", "SELECT * FROM lag_split WHERE is_train", "lag_split")
least_squares("lag_split_fit", "lag_split_train", "ticker, lag", MAC, "log_return", "lag_split_train", alpha="0.5")


def test_score(fit, rows, keys, condition, y="log_return"):
    """n_train, n_test, r2, rmse of fitted groups on rows that meet a condition."""
    on = " AND ".join(f"r.{k} = f.{k}" for k in keys)
    e = f"(r.{y} - ({fitted_sql(MAC)})) ** 2"
    return f"SELECT {', '.join(f'f.{k}' for k in keys)}, any_value(f.n) AS n_train, count(*) AS n_test, 1 - sum({e}) / (var_pop(r.{y}) * count(*)) AS r2, sqrt(avg({e})) AS rmse FROM {fit} f JOIN {rows} r ON {on} AND {condition} GROUP BY ALL"


cte("lag_split_score", f"SELECT ticker, lag, r2 AS m FROM ({test_score('lag_split_fit', 'lag_split', ('ticker', 'lag'), 'NOT r.is_train')})", "lag_split_fit", "lag_split")


@query("val1_choose_lag_by_split", sql(CHOSEN + "lag_split_score", "lag_split_score"))
def _(spark, d):
    return rounded(V.choose_lag_by_split(lag_frames(spark, d), "log_return", MAC), 5)


@query("val2_chronological_split", sql("""SELECT ticker, count(*) FILTER (is_train) AS train_rows, count(*) FILTER (NOT is_train) AS test_rows, min(date) FILTER (is_train) AS train_start, max(date) FILTER (is_train) AS train_end,
    min(date) FILTER (NOT is_train) AS test_start, max(date) FILTER (NOT is_train) AS test_end FROM split GROUP BY 1""", "split"))
def _(spark, d):
    return V.split_bounds(V.with_split(supervised(spark, d)))


cte("tq", "SELECT *, " + ", ".join(f"quantile_cont(CASE WHEN is_train THEN {f} END, [0.01, 0.99]) OVER (PARTITION BY ticker) AS q_{f}" for f in MAC) + " FROM split", "split")


@query("val3_clip_by_train", sql("SELECT ticker, date, is_train, " + ", ".join(f"round(greatest(q_{f}[1], least(q_{f}[2], {f})), 4) AS {f}" for f in MAC) + " FROM tq", "tq"))
def _(spark, d):
    return rounded(V.clip_by_train(V.with_split(supervised(spark, d)), MAC).select("ticker", "date", "is_train", *MAC), 4)


cte("base_pred", """SELECT ticker, log_return AS y, m, r FROM split JOIN (SELECT ticker, avg(log_return) FILTER (is_train) AS m, avg(log_return) FILTER (is_train AND b <= 5) AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, is_train ORDER BY date DESC) AS b FROM split) GROUP BY 1) USING (ticker) WHERE NOT is_train""", "split")


def metric_sql(src, keys, y, p):
    return f"SELECT {keys}, count(*) AS n, 1 - sum(({y} - {p}) ** 2) / (var_pop({y}) * count(*)) AS r2, avg(abs({y} - {p})) AS mae, sqrt(avg(({y} - {p}) ** 2)) AS rmse FROM {src} GROUP BY ALL"


@query("val4_baselines", sql("SELECT ticker, model, n, round(r2, 5) AS r2, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM (" + " UNION ALL ".join(
    metric_sql("base_pred", f"ticker, '{n}' AS model", "y", p) for n, p in (("mean_predictor", "m"), ("recent_mean_predictor", "r"), ("zero_drift", "0"))) + ")", "base_pred"))
def _(spark, d):
    return rounded(V.baselines(V.with_split(supervised(spark, d)), "log_return"), 6, r2=5)


cte("split_train", "SELECT * FROM split WHERE is_train", "split")
least_squares("split_fit", "split_train", "ticker", MAC, "log_return", "split_train", alpha="0.5")


@query("val4_ridge_baseline", sql(f"SELECT ticker, 'ridge_baseline' AS model, n_test AS n, round(r2, 5) AS r2, round(rmse, 6) AS rmse FROM ({test_score('split_fit', 'split', ('ticker',), 'NOT r.is_train')})", "split_fit", "split"))
def _(spark, d):
    return rounded(V.ridge_baseline(V.with_split(supervised(spark, d)), "log_return", MAC), 6, r2=5)


cte("pm", metric_sql("pred_ok", "ticker", "actual", "predicted"), "pred_ok")


@query("val5_regression_metrics", sql("SELECT ticker, n, round(r2, 5) AS r2, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM pm", "pm"))
def _(spark, d):
    return rounded(V.regression_metrics(naive_predictions(spark, d)), 6, r2=5)


BAND = "CASE " + " ".join(f"WHEN {{c}} >= {a} THEN {b}" for a, b in V.R2_BANDS) + " ELSE 1.0 END::DOUBLE"


@query("val6_r2_bands", sql(f"SELECT ticker, year, round(r2, 4) AS r2, round(greatest(-0.1, r2), 4) AS bounded_r2, {BAND.format(c='r2')} AS risk FROM ({metric_sql('pred_ok', 'ticker, year(date) AS year', 'actual', 'predicted')})", "pred_ok"))
def _(spark, d):
    m = V.regression_metrics(naive_predictions(spark, d).withColumn("year", F.year("date").cast("long")), ("ticker", "year"))
    return rounded(m.select("ticker", "year", "r2", V.bounded_r2("r2").alias("bounded_r2"), V.r2_risk("r2").alias("risk")), 4)


def windows_sql(source, first=V.MIN_TRAIN):
    least = "greatest(12, least(60, n // 12))"
    return f"""SELECT *, count(*) OVER (PARTITION BY ticker, win) AS in_win FROM (SELECT *, CASE WHEN i < {first} THEN 0 ELSE least(4, 1 + (i - {first}) // greatest({least}, (n - {first}) // 4)) END AS win FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM {source})) QUALIFY win = 0 OR in_win >= {least}"""


cte("wf", windows_sql("sup"), "sup")
cte("wf_train", f"SELECT t.ticker, t.win, r.log_return, {', '.join(f'r.{x}' for x in MAC)} FROM (SELECT DISTINCT ticker, win FROM wf WHERE win > 0) t JOIN wf r ON r.ticker = t.ticker AND r.win < t.win", "wf")
least_squares("wf_fit", "wf_train", "ticker, win", MAC, "log_return", "wf_train")
cte("wf_score", test_score("wf_fit", "wf", ("ticker", "win"), "TRUE"), "wf_fit", "wf")


@query("val7_walk_forward", sql('SELECT ticker, win AS "window", round(r2, 5) AS r2, round(rmse, 6) AS rmse, n_train, n_test FROM wf_score', "wf_score"))
def _(spark, d):
    return rounded(V.walk_forward(supervised(spark, d), "log_return", MAC), 6, r2=5)


@query("val7_walk_forward_summary", sql("""SELECT ticker, count(*) AS windows, round(avg(r2), 5) AS avg_r2, round(median(r2), 5) AS median_r2, round(avg(greatest(-2.0, least(1.0, r2))), 5) AS clipped_avg_r2, round(min(r2), 5) AS worst_r2,
    round(CASE WHEN count(*) >= 4 THEN quantile_cont(r2, 0.1) ELSE min(r2) END, 5) AS band_low, round(CASE WHEN count(*) >= 4 THEN quantile_cont(r2, 0.9) ELSE max(r2) END, 5) AS band_high FROM wf_score GROUP BY 1""", "wf_score"))
def _(spark, d):
    return rounded(V.walk_forward_summary(V.walk_forward(supervised(spark, d), "log_return", MAC)), 5)


cte("sup_one", "SELECT ticker, date, y, energy_index AS x FROM panel WHERE y IS NOT NULL AND energy_index IS NOT NULL", "panel")
cte("wf1", windows_sql("sup_one"), "sup_one")
cte("wf2", """SELECT t.ticker, t.win, regr_slope(a.y, a.x) AS b, regr_intercept(a.y, a.x) AS c, count(*) AS n_train FROM (SELECT DISTINCT ticker, win FROM wf1 WHERE win > 0) t
    JOIN wf1 a ON a.ticker = t.ticker AND a.win < t.win GROUP BY 1, 2""", "wf1")


@query("val7_walk_forward_one_factor", sql("""SELECT ticker, win AS "window", any_value(n_train) AS n_train, count(*) AS n_test, round(1 - sum((y - c - b * x) ** 2) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg((y - c - b * x) ** 2)), 6) AS rmse
    FROM wf1 JOIN wf2 USING (ticker, win) GROUP BY 1, 2""", "wf1", "wf2"))
def _(spark, d):
    w = V.walk_forward(supervised(spark, d, ["energy_index"]), "log_return", ["energy_index"])
    return rounded(w, 6, r2=5)


least_squares("wf_ridge", "wf_train", "ticker, win", MAC, "log_return", "wf_train", alpha="0.5")
cte("wf_pred", f"SELECT r.ticker, r.date, r.win, r.log_return AS actual, {fitted_sql(MAC)} AS predicted FROM wf_ridge f JOIN wf r ON r.ticker = f.ticker AND r.win = f.win", "wf_ridge", "wf")


def band_ctes(name, source, draws=200, seed=42):
    """Block bootstrap of R2 over predictions, by running sums; starts are the same hashes."""
    cte(f"{name}_s", f"SELECT *, actual - avg(actual) OVER (PARTITION BY ticker) AS y, (actual - predicted) ** 2 AS ee, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM {source} QUALIFY n >= 5", source)
    cte(f"{name}_u", f"SELECT ticker, i, n, {', '.join(f'sum({e}) OVER (PARTITION BY ticker ORDER BY i) AS {k}' for k, e in (('sy', 'y'), ('syy', 'y * y'), ('see', 'ee')))} FROM {name}_s UNION ALL SELECT DISTINCT ticker, 0, n, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM {name}_s", f"{name}_s")
    cte(f"{name}_b", f"""SELECT *, CASE WHEN f + l > n THEN f + l - n ELSE f + l END AS t, f + l > n AS wraps FROM (SELECT *, CAST(floor(('0x' || substr(md5('{seed}|' || ticker || '|' || draw || '|' || block), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n) AS BIGINT) AS f, least(b, n - block * b) AS l FROM (
      SELECT ticker, n, b, draw, unnest(generate_series(0, CAST(ceil(n / b) AS BIGINT) - 1)) AS block FROM (SELECT ticker, n, greatest(2, CAST(floor(sqrt(n)) AS BIGINT)) AS b, unnest(generate_series(1, {draws})) AS draw FROM (SELECT DISTINCT ticker, n FROM {name}_s))))""", f"{name}_s")
    part = lambda k: f"sum(z.{k} - a.{k} + CASE WHEN wraps THEN e.{k} ELSE 0 END)"
    cte(f"{name}_d", f"""SELECT ticker, draw, CASE WHEN v > 1e-12 THEN greatest(-10.0, least(1.0, 1 - ee / n / v)) END AS r2 FROM (SELECT ticker, draw, n, ee, yy / n - (y / n) ** 2 AS v FROM (
      SELECT b.ticker, b.draw, any_value(b.n) AS n, {part('sy')} AS y, {part('syy')} AS yy, {part('see')} AS ee FROM {name}_b b JOIN {name}_u a ON a.ticker = b.ticker AND a.i = b.f JOIN {name}_u z ON z.ticker = b.ticker AND z.i = b.t
      JOIN {name}_u e ON e.ticker = b.ticker AND e.i = b.n GROUP BY 1, 2))""", f"{name}_b", f"{name}_u")
    cte(name, f"""SELECT ticker, n, point, coalesce(low, point) AS low, coalesce(high, point) AS high, coalesce(mean, point) AS mean, coalesce(std, 0.0) AS std, draws FROM (SELECT ticker, count(*) AS n, 1 - sum(ee) / sum(y * y) AS point FROM {name}_s GROUP BY 1)
      JOIN (SELECT ticker, quantile_cont(r2, 0.05) AS low, quantile_cont(r2, 0.95) AS high, avg(r2) AS mean, stddev_pop(r2) AS std, count(r2) AS draws FROM {name}_d GROUP BY 1) USING (ticker)""", f"{name}_s", f"{name}_d")


band_ctes("wf_band", "wf_pred")

# rows with gaps: features are unknown until their first release
cte("gap_rows", f"SELECT ticker, date, y AS log_return, {', '.join(MAC)} FROM panel WHERE y IS NOT NULL", "panel")
cte("gap_wf", windows_sql("gap_rows"), "gap_rows")
cte("gap_med", f"SELECT t.ticker, t.win, {', '.join(f'coalesce(median(r.{x}), 0) AS m_{x}' for x in MAC)} FROM (SELECT DISTINCT ticker, win FROM gap_wf WHERE win > 0) t JOIN gap_wf r ON r.ticker = t.ticker AND r.win < t.win GROUP BY 1, 2", "gap_wf")
cte("gap_train", f"SELECT t.ticker, t.win, r.log_return, {', '.join(f'coalesce(r.{x}, t.m_{x}) AS {x}' for x in MAC)} FROM gap_med t JOIN gap_wf r ON r.ticker = t.ticker AND r.win < t.win", "gap_med", "gap_wf")
cte("gap_test", f"SELECT t.ticker, t.win, r.log_return, {', '.join(f'coalesce(r.{x}, t.m_{x}) AS {x}' for x in MAC)} FROM gap_med t JOIN gap_wf r ON r.ticker = t.ticker AND r.win = t.win", "gap_med", "gap_wf")
least_squares("gap_fit", "gap_train", "ticker, win", MAC, "log_return", "gap_train", used=[f"c[{i}][{i}] > 0" for i in range(1, len(MAC) + 1)])


def gap_windows(spark, d):
    return V.with_windows(T.supervised_frame(master(spark, d), "log_return", MAC, complete=False))


@query("val7_walk_forward_imputed", sql(f"""SELECT ticker, win AS "window", 'Linear' AS model, round(r2, 4) AS r2, round(rmse, 6) AS rmse, n_train, n_test FROM ({test_score('gap_fit', 'gap_test', ('ticker', 'win'), 'TRUE')})""", "gap_fit", "gap_test"))
def _(spark, d):
    w = M.walk_forward_chosen(gap_windows(spark, d), "log_return", MAC, 4, choose=False)
    return rounded(w.drop("params", "cv_r2"), 6, r2=4)


@query("val7_walk_forward_chosen")
def _(spark, d):
    return M.walk_forward_chosen(gap_windows(spark, d), "log_return", MAC, 4)


@query("val8_bootstrap_band", sql("SELECT ticker, n, draws, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("point", "low", "high", "mean", "std")) + " FROM wf_band", "wf_band"))
def _(spark, d):
    p, _ = V.walk_forward_predictions(supervised(spark, d), "log_return", MAC)
    return rounded(V.bootstrap_band(p), 5)


UNIT = ["close", "log_return", "inflation"]
EARLIER = ", ".join(f"lag(x, {k}) {WTF}) AS l{k}" for k in range(1, 10))


def unit_root_ctes(name, source, columns):
    """Both statistics of (ticker, feature) over columns of a table."""
    xs = ["l1", *[f"d{k}" for k in range(1, 9)]]
    cte(f"{name}_l", f"""SELECT *, x - m AS e, least(8, greatest(1, n // 50)) AS o FROM (SELECT *, row_number() {WTF}) AS i, count(*) OVER (PARTITION BY ticker, feature) AS n, avg(x) OVER (PARTITION BY ticker, feature) AS m, {EARLIER} FROM (
      {" UNION ALL ".join(f"SELECT ticker, date, '{c}' AS feature, {c} AS x FROM {source} WHERE {c} IS NOT NULL" for c in columns)}))""", source)
    cte(f"{name}_r", f"SELECT ticker, feature, o, x - l1 AS d, l1, {', '.join(f'CASE WHEN o >= {k} THEN l{k} - l{k + 1} ELSE 0.0 END AS d{k}' for k in range(1, 9))} FROM {name}_l WHERE i > o + 1", f"{name}_l")
    least_squares(f"{name}_f", f"{name}_r", "ticker, feature, o", xs, "d", f"{name}_r", used=["TRUE", *[f"o >= {k}" for k in range(1, 9)]])
    long_run = " + ".join(f"2 * coalesce(sum(e * (l{k} - m) * (1 - {k} / (o + 1.0))) FILTER (o >= {k}), 0)" for k in range(1, 9))
    cte(name, f"""SELECT ticker, feature, k.n, k.o AS lags, kpss, adf, CASE WHEN k.n >= 20 THEN coalesce(adf < {V.ADF_CRITICAL} AND kpss < {V.KPSS_CRITICAL}, FALSE) END AS is_stationary FROM (
      SELECT ticker, feature, max(n) AS n, max(o) AS o, (sum(s * s) / max(n) ** 2) / ((sum(e * e) + {long_run}) / max(n)) AS kpss FROM (SELECT *, sum(e) {WTF} ROWS UNBOUNDED PRECEDING) AS s FROM {name}_l) GROUP BY 1, 2) k
      LEFT JOIN (SELECT ticker, feature, b[1] / (sqrt(rss / (n - o - 2) * inv[1] / n) / sd[1]) AS adf FROM {name}_f) a USING (ticker, feature)""", f"{name}_l", f"{name}_f")


unit_root_ctes("unit", "master", UNIT)


@query("val9_stationarity", sql("SELECT ticker, feature, n, lags, round(kpss, 5) AS kpss, round(adf, 4) AS adf, is_stationary FROM unit", "unit"))
def _(spark, d):
    return rounded(V.stationarity(master(spark, d), UNIT), 5, adf=4)


def kpss_sql():
    e = "SELECT *, x - avg(x) OVER (PARTITION BY ticker) AS e, count(*) OVER (PARTITION BY ticker) AS n FROM (SELECT ticker, date, close AS x FROM px)"
    lags = ", ".join(f"e * lag(e, {k}) {WT}) AS p{k}" for k in range(1, 9))
    acc = " + ".join(f"2 * coalesce(sum(p{k} * (1 - {k} / (l + 1.0))) FILTER (l >= {k}), 0)" for k in range(1, 9))
    return f"SELECT ticker, max(n) AS n, round((sum(s * s) / max(n) ** 2) / ((sum(e * e) + {acc}) / max(n)), 5) AS kpss FROM (SELECT *, least(8, greatest(1, n // 50)) AS l, sum(e) {WT} ROWS UNBOUNDED PRECEDING) AS s, {lags} FROM ({e})) GROUP BY 1"


@query("val9_kpss", sql(kpss_sql(), "px"))
def _(spark, d):
    lv = B.bars(spark, d).select("ticker", "date", F.col("close").alias("x"))
    return rounded(V.unit_roots(lv, ("ticker",)).select("ticker", "n", "kpss"), 5)


LEAK = ["inflation", "energy_index", "echo"]
cte("leak_in", "SELECT ticker, date, log_return, inflation, energy_index, log_return * 2 AS echo, lag(log_return) " + WT + ") AS prophet FROM sup", "sup")
LEAK2 = [*LEAK, "prophet"]
cte("leak", " UNION ALL ".join(f"SELECT ticker, '{f}' AS factor, count(*) AS n, corr(log_return, {f}) AS corr, corr(log_return, ld) AS lead_corr, corr(log_return, lg) AS lag_corr FROM (SELECT *, lead({f}) {WT}) AS ld, lag({f}) {WT}) AS lg FROM leak_in) GROUP BY 1" for f in LEAK2), "leak_in")
FLAGS = "concat_ws(',', CASE WHEN abs(corr) > 0.995 THEN 'near_perfect_correlation' END, CASE WHEN abs(lead_corr) > abs(lag_corr) + 0.15 THEN 'possible_future_leakage' END)"


def leak_frame(spark, d):
    s = supervised(spark, d).withColumn("echo", F.col("log_return") * 2)
    return s.withColumn("prophet", F.lag("log_return").over(series("ticker")))


@query("val10_leakage_flags", sql(f"SELECT ticker, factor, n, round(corr, 5) AS corr, round(lead_corr, 5) AS lead_corr, round(lag_corr, 5) AS lag_corr, {FLAGS} AS flags FROM leak", "leak"))
def _(spark, d):
    lk = V.leakage(leak_frame(spark, d), "log_return", LEAK2)
    return rounded(lk.withColumn("flags", F.array_join("flags", ",")), 5)


X_ = "(abs(atanh(corr)) * sqrt(n - 3) / sqrt(2.0))"
T_ = f"(1.0 / (1.0 + {V.ERF_P} * {X_}))"
POLY = "0.0"
for a in reversed(V.ERF):
    POLY = f"({POLY} + {a}) * t"
cte("bh", f"""SELECT ticker, factor, n, corr, least(1.0, {POLY} * exp(-x * x)) AS p FROM (SELECT *, {X_} AS x, {T_} AS t FROM (
    SELECT ticker, factor, count(*) AS n, corr(log_return, v) AS corr FROM sup UNPIVOT (v FOR factor IN ({', '.join(MAC)})) GROUP BY 1, 2))""", "sup")
cte("bh2", "SELECT *, max(CASE WHEN p <= r / m * 0.05 THEN r END) OVER (PARTITION BY ticker) AS top FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY p, factor) AS r, count(*) OVER (PARTITION BY ticker) AS m FROM bh)", "bh")


@query("val11_false_discovery", sql("SELECT ticker, factor, n, round(corr, 5) AS corr, round(p, 6) AS p_value, coalesce(r <= top, false) AS significant, coalesce(r <= top, false) AND abs(corr) > 0.95 AS flagged FROM bh2", "bh2"))
def _(spark, d):
    lk = V.leakage(supervised(spark, d), "log_return", MAC).select("ticker", "factor", "n", "corr")
    return rounded(V.false_discovery(lk), 6, corr=5)


def roll(fn, c, n):
    return f"CASE WHEN count({c}) {WT} ROWS {n - 1} PRECEDING) >= {n} THEN {fn}({c}) {WT} ROWS {n - 1} PRECEDING) END"


@query("val12_rolling_extremes", sql(f"SELECT ticker, round(max(m), 6) AS max_mean, round(min(m), 6) AS min_mean, round(max(s), 6) AS max_std, round(min(s), 6) AS min_std FROM (SELECT ticker, {roll('avg', 'log_return', 24)} AS m, {roll('stddev_samp', 'log_return', 24)} AS s FROM sup) GROUP BY 1", "sup"))
def _(spark, d):
    return rounded(V.rolling_extremes(supervised(spark, d), "log_return"))


cte("shift", """SELECT ticker, em - tm AS mean_shift, es - ts AS std_shift, abs(em - tm) / greatest(abs(ts), 1e-9) AS normalized_shift FROM (SELECT ticker, avg(log_return) FILTER (is_train) AS tm, avg(log_return) FILTER (NOT is_train) AS em,
    stddev_samp(log_return) FILTER (is_train) AS ts, stddev_samp(log_return) FILTER (NOT is_train) AS es FROM split GROUP BY 1)""", "split")


@query("val13_target_shift", sql("SELECT ticker, round(mean_shift, 6) AS mean_shift, round(std_shift, 6) AS std_shift, round(normalized_shift, 5) AS normalized_shift FROM shift", "shift"))
def _(spark, d):
    return rounded(V.target_shift(V.with_split(supervised(spark, d)), "log_return"), 6, normalized_shift=5)


cte("imp", " UNION ALL ".join(f"SELECT ticker, '{f}' AS factor, regr_slope(log_return, {f}) * stddev_samp({f}) AS coef FROM sup GROUP BY 1" for f in MAC), "sup")
cte("conc", """SELECT ticker, max(factor) FILTER (r = 1) AS top_factor, max(w) AS top_share, sum(w) FILTER (r <= 3) AS top3_share, 1 / sum(w * w) AS effective_factors FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY w DESC, factor) AS r FROM (SELECT *, abs(coef) / sum(abs(coef)) OVER (PARTITION BY ticker) AS w FROM imp)) GROUP BY 1""", "imp")


def scaled_betas(s):
    items = [F.struct(F.lit(f).alias("factor"), (F.regr_slope("log_return", f) * F.stddev_samp(f)).alias("coef")) for f in MAC]
    return s.groupBy("ticker").agg(F.array(*items).alias("a")).select("ticker", F.inline("a"))


@query("val14_concentration", sql("SELECT ticker, top_factor, round(top_share, 5) AS top_share, round(top3_share, 5) AS top3_share, round(effective_factors, 4) AS effective_factors FROM conc", "conc"))
def _(spark, d):
    return rounded(V.concentration(scaled_betas(supervised(spark, d))), 5, effective_factors=4)


cte("tv", f"""SELECT ticker, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (ok IS NOT NULL) AS direction, 1 - sum((va - vp) ** 2) / (var_pop(va) * count(va)) AS volatility_r2, stddev_samp(predicted) / stddev_samp(actual) AS volatility_ratio FROM (
    SELECT *, sign(actual - lag(actual) {WT})) = sign(predicted - lag(predicted) {WT})) AS ok, {roll('stddev_samp', 'actual', 5)} AS va, {roll('stddev_samp', 'predicted', 5)} AS vp FROM pred_ok) GROUP BY 1""", "pred_ok")
# a governed run is one publication lag: all runs of all tickers go through the same operators under the key ticker|lag
cte("gsup", f"SELECT ticker || '|' || lag AS ticker, date, log_return, {', '.join(MAC)} FROM sup_lags", "sup_lags")
cte("gsplit", "SELECT *, i <= greatest(24, least(floor(n * 0.8), n - 5)) AS is_train FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM gsup)", "gsup")
cte("gclip", f"SELECT ticker, date, is_train, log_return, {', '.join(f'greatest(q_{f}[1], least(q_{f}[2], {f})) AS {f}' for f in MAC)} FROM (SELECT *, " + ", ".join(f"quantile_cont(CASE WHEN is_train THEN {f} END, [0.01, 0.99]) OVER (PARTITION BY ticker) AS q_{f}" for f in MAC) + " FROM gsplit)", "gsplit")
cte("gtrain", "SELECT * FROM gclip WHERE is_train", "gclip")
least_squares("gfit", "gtrain", "ticker", MAC, "log_return", "gtrain")
cte("gpred", f"SELECT r.ticker, r.date, r.log_return AS actual, {fitted_sql(MAC)} AS predicted FROM gfit f JOIN gclip r ON r.ticker = f.ticker AND NOT r.is_train", "gfit", "gclip")
cte("gmet", metric_sql("gpred", "ticker", "actual", "predicted"), "gpred")
band_ctes("gband", "gpred", 100)
cte("gtv", f"""SELECT ticker, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (ok IS NOT NULL) AS direction, 1 - sum((va - vp) ** 2) / (var_pop(va) * count(va)) AS volatility_r2, stddev_samp(predicted) / stddev_samp(actual) AS volatility_ratio FROM (
    SELECT *, sign(actual - lag(actual) {WT})) = sign(predicted - lag(predicted) {WT})) AS ok, {roll('stddev_samp', 'actual', 5)} AS va, {roll('stddev_samp', 'predicted', 5)} AS vp FROM gpred) GROUP BY 1""", "gpred")
cte("gshift", """SELECT ticker, abs(avg(log_return) FILTER (NOT is_train) - avg(log_return) FILTER (is_train)) / greatest(abs(stddev_samp(log_return) FILTER (is_train)), 1e-9) AS normalized_shift FROM gsplit GROUP BY 1""", "gsplit")
cte("gconc", "SELECT ticker, max(w) AS top_share FROM (SELECT ticker, abs(c) / sum(abs(c)) OVER (PARTITION BY ticker) AS w FROM (" + " UNION ALL ".join(f"SELECT ticker, b[{i}] * sd[{i}] AS c FROM gfit" for i in range(1, len(MAC) + 1)) + ")) GROUP BY 1", "gfit")
unit_root_ctes("gunit", "gsup", ["log_return", *MAC])
cte("gstat", "SELECT ticker, count(is_stationary) AS considered, count(*) FILTER (is_stationary) AS stationary FROM gunit GROUP BY 1", "gunit")
cte("gwf", windows_sql("gsup"), "gsup")
cte("gwf_train", f"SELECT t.ticker, t.win, r.log_return, {', '.join(f'r.{x}' for x in MAC)} FROM (SELECT DISTINCT ticker, win FROM gwf WHERE win > 0) t JOIN gwf r ON r.ticker = t.ticker AND r.win < t.win", "gwf")
least_squares("gwf_fit", "gwf_train", "ticker, win", MAC, "log_return", "gwf_train")
cte("gwfs", f"""SELECT ticker, count(*) AS windows, avg(r2) AS wf_avg_r2, avg(greatest(-2.0, least(1.0, r2))) AS perf_r2, CASE WHEN count(*) >= 4 THEN quantile_cont(r2, 0.9) ELSE max(r2) END AS wf_band_high
    FROM ({test_score('gwf_fit', 'gwf', ('ticker', 'win'), 'TRUE')}) GROUP BY 1""", "gwf_fit", "gwf")
cte("glink", f"SELECT ticker, factor, count(*) AS n, corr(log_return, v) AS corr, corr(log_return, ld) AS lead_corr, corr(log_return, lg) AS lag_corr FROM (SELECT *, lead(v) {WTF.replace('feature', 'factor')}) AS ld, lag(v) {WTF.replace('feature', 'factor')}) AS lg FROM gsup UNPIVOT (v FOR factor IN ({', '.join(MAC)}))) GROUP BY 1, 2", "gsup")
cte("gbh", f"SELECT *, max(CASE WHEN p <= r / m * 0.05 THEN r END) OVER (PARTITION BY ticker) AS top FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY p, factor) AS r, count(*) OVER (PARTITION BY ticker) AS m FROM (SELECT *, least(1.0, {POLY} * exp(-x * x)) AS p FROM (SELECT *, {X_} AS x, {T_} AS t FROM glink)))", "glink")
cte("gleak", """SELECT ticker, count(*) AS factors, sum(CAST(abs(corr) > 0.995 AS INT) + CAST(abs(lead_corr) > abs(lag_corr) + CASE WHEN n >= 60 THEN 0.15 ELSE 0.25 END AS INT) + CAST(coalesce(r <= top, false) AND abs(corr) > CASE WHEN n >= 60 THEN 0.95 ELSE 0.98 END AS INT))::BIGINT AS leakage_flags FROM gbh GROUP BY 1""", "gbh")
cte("risk", f"""SELECT *, least(1.0, greatest(0.0, 0.35 * least(1.0, leakage_flags / greatest(1, factors)) + 0.25 * greatest(0.0, 1 - stationary / considered) + 0.20 * least(1.0, greatest(0.0, normalized_shift / 5.0)) + 0.20 * {BAND.format(c='perf_r2')})) AS risk_score
    FROM gleak JOIN gstat USING (ticker) JOIN gshift USING (ticker) JOIN gwfs USING (ticker)""", "gleak", "gstat", "gshift", "gwfs")
RUN = "split_part(ticker, '|', 1) AS ticker, split_part(ticker, '|', 2)::BIGINT AS run_id"


def runs_of(t):
    """Results under ticker|lag with the two parts as columns."""
    parts = F.split("ticker", r"\|")
    return t.select(parts[0].alias("ticker"), parts[1].cast("long").alias("run_id"), *[c for c in t.columns if c != "ticker"])


def governed(spark, d):
    frames = [f.select(F.concat_ws("|", "ticker", F.lit(k)).alias("ticker"), "date", "log_return", *MAC) for k, f in lag_frames(spark, d).items()]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return stage(every)


def report(spark, d):
    """The gate's input of every ticker and run; the publication lag of a run is read from the panel's own description."""
    frame = governed(spark, d)
    lags = values_table(spark, ("run", "max_lag"), [(k, T.publication_lag(MAC, k)) for k in LAGS])
    keys = frame.select("ticker").distinct().join(F.broadcast(lags), F.split("ticker", r"\|")[1].cast("long") == F.col("run")).select("ticker", "max_lag")
    return stage(V.governance_report(frame, "log_return", MAC, keys))


@query("val15_model_risk", sql(f"SELECT {RUN}, leakage_flags, factors, round(stationary / considered, 5) AS stationary_ratio, round(normalized_shift, 5) AS normalized_shift, round(perf_r2, 5) AS perf_r2, round(risk_score, 5) AS risk_score FROM risk", "risk"))
def _(spark, d):
    return rounded(runs_of(report(spark, d)).select("ticker", "run_id", "leakage_flags", "factors", "stationary_ratio", "normalized_shift", "perf_r2", "risk_score"), 5)


@query("val16_trend_volatility", sql("SELECT ticker, round(direction, 5) AS direction, round(volatility_r2, 5) AS volatility_r2, round(volatility_ratio, 5) AS volatility_ratio FROM tv", "tv"))
def _(spark, d):
    return rounded(V.trend_volatility(naive_predictions(spark, d)), 5)


@query("val17_freshness", sql("SELECT lag AS run_id, lag AS max_lag, lag <= 60 AS aligned, count(*) AS n_rows FROM sup_lags GROUP BY 1", "sup_lags"))
def _(spark, d):
    """Largest publication lag of the panel behind each run, and the rows it leaves."""
    out = None
    for k, f in lag_frames(spark, d).items():
        one = V.freshness(T.panel_meta(f, ["log_return", *MAC], macro_lag=k)).select(F.lit(k).cast("long").alias("run_id"), F.col("max_lag").cast("long").alias("max_lag"), "aligned").withColumn("n_rows", f.select(F.count("*")).scalar())
        out = one if out is None else out.unionByName(one)
    return out


@query("val18_stationary_ratio", sql(f"SELECT {RUN}, considered, stationary, round(stationary / considered, 6) AS ratio, CASE WHEN considered < 4 THEN 0.25 ELSE 0.1 END::DOUBLE AS floor, stationary / considered >= CASE WHEN considered < 4 THEN 0.25 ELSE 0.1 END AS ok FROM gstat", "gstat"))
def _(spark, d):
    return rounded(runs_of(V.stationary_ratio(V.stationarity(governed(spark, d), ["log_return", *MAC]))))


cte("rep", """SELECT r.ticker, r2 AS oos_r2, high AS r2_band_high, direction, volatility_r2, volatility_ratio, normalized_shift, leakage_flags, stationary / considered AS stationary_ratio, considered, wf_avg_r2, wf_band_high, windows,
    top_share, split_part(r.ticker, '|', 2)::BIGINT AS max_lag, risk_score FROM risk r JOIN gmet USING (ticker) JOIN gtv USING (ticker) JOIN gconc USING (ticker) JOIN gband USING (ticker)""", "risk", "gmet", "gtv", "gconc", "gband")
WF_MIN = "CASE WHEN windows < 4 THEN -1.0 ELSE -0.25 END"
cte("gate", f"""SELECT {RUN}, concat_ws(',', CASE WHEN oos_r2 < -0.25 THEN CASE WHEN r2_band_high >= -0.25 THEN 'oos_r2_low_but_band_clears' WHEN direction >= 0.55 AND (volatility_r2 >= 0 OR volatility_ratio BETWEEN 0.5 AND 1.8) THEN 'oos_r2_low_but_trend_volatility_ok'
      WHEN oos_r2 >= -0.1 THEN 'oos_r2_mildly_negative' ELSE 'oos_r2_low' END END,
      CASE WHEN wf_avg_r2 < {WF_MIN} THEN CASE WHEN wf_band_high >= {WF_MIN} THEN 'walk_forward_low_but_band_clears' WHEN wf_avg_r2 < -5 AND oos_r2 >= -0.25 THEN 'walk_forward_unstable_but_oos_ok' ELSE 'walk_forward_low' END END,
      CASE WHEN top_share > 0.65 THEN 'factor_concentration' END, CASE WHEN max_lag > 60 THEN 'publication_lag_exceeds_policy' END, CASE WHEN risk_score > 0.6 THEN 'model_risk_above_limit' END) AS advisory,
    concat_ws(',', CASE WHEN normalized_shift > 2.5 THEN 'mean_shift_above_limit' END, CASE WHEN leakage_flags > 1 THEN 'leakage_flags_above_limit' END, CASE WHEN stationary_ratio < CASE WHEN considered < 4 THEN 0.25 ELSE 0.1 END THEN 'stationary_ratio_below_limit' END) AS blocking,
    risk_score, wf_avg_r2 FROM rep""", "rep")
cte("dec2", "SELECT *, CASE WHEN risk_score >= 0.6 THEN 'fail' WHEN risk_score >= 0.4 THEN 'warn' WHEN advisory <> '' THEN 'warn' WHEN blocking <> '' THEN 'fail' ELSE 'pass' END AS severity, blocking = '' AS passed FROM gate", "gate")


def decisions(spark, d):
    """(ticker, run_id, advisory, blocking, severity, passed, risk_score, wf_avg_r2) of the gate, one run per publication lag."""
    r = report(spark, d)
    return stage(runs_of(V.gate(r, V.policy_for(r), hard_fail=True)))


@query("val19_gate", sql("SELECT ticker, run_id, advisory, blocking, severity, passed, round(risk_score, 5) AS risk_score FROM dec2", "dec2"))
def _(spark, d):
    g = decisions(spark, d).drop("wf_avg_r2")
    return rounded(g.withColumn("advisory", F.array_join("advisory", ",")).withColumn("blocking", F.array_join("blocking", ",")), 5)


OVR = [("PROMO", 0.05, 0.3), ("SMALL", -0.5, 0.8)]


@query("val20_policy", sql(f"""SELECT ticker, round(coalesce(min_r2, -0.25) - 0.05, 6) AS min_r2, round(least(1.0, coalesce(max_model_risk_score, 0.6) + 0.1), 6) AS max_model_risk_score, round(2.5::DOUBLE * 1.4, 6) AS max_normalized_shift
    FROM (SELECT DISTINCT ticker FROM px) LEFT JOIN ({values_sql(("ticker", "min_r2", "max_model_risk_score"), OVR)}) USING (ticker)""", "px"))
def _(spark, d):
    o = values_table(spark, ("ticker", "min_r2", "max_model_risk_score"), OVR)
    p = V.policy_for(B.bars(spark, d).select("ticker").distinct(), o, "crisis")
    return rounded(p.select("ticker", "min_r2", "max_model_risk_score", "max_normalized_shift"))


@query("val21_decision_log", sql("SELECT run_id, count(*) AS n, count(*) FILTER (severity = 'fail') AS failed FROM (SELECT ticker, severity, r.run_id FROM dec2, (VALUES ('a'), ('b')) r(run_id)) GROUP BY 1", "dec2"))
def _(spark, d):
    g, path = decisions(spark, d).withColumnRenamed("run_id", "lag"), _sink_path(spark)
    V.append_decisions(g, path, "a")
    V.append_decisions(g, path, "b")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "fail").alias("failed"))


@query("val22_worst_decision", sql("""SELECT run_id, ticker, severity, round(risk_score, 5) AS risk_score, decisions FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS decisions, row_number() OVER (PARTITION BY run_id ORDER BY
    CASE severity WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END DESC, risk_score DESC, ticker DESC) AS r FROM dec2) WHERE r = 1""", "dec2"))
def _(spark, d):
    return rounded(V.worst_decision(decisions(spark, d)), 5)


@query("val23_decision_trend", sql("""SELECT ticker, count(*) AS decisions, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 5) AS pass_rate, count(*) FILTER (severity = 'pass') AS n_pass, count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'fail') AS n_fail,
    round(avg(risk_score), 5) AS mean_risk, round(min(wf_avg_r2), 5) AS worst_r2, CASE WHEN avg(risk_score) FILTER (p > k // 2) - avg(risk_score) FILTER (p <= k // 2) > 0.05 THEN 'deteriorating'
    WHEN avg(risk_score) FILTER (p > k // 2) - avg(risk_score) FILTER (p <= k // 2) < -0.05 THEN 'improving' ELSE 'stable' END AS direction FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY run_id) AS p, count(*) OVER (PARTITION BY ticker) AS k FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY run_id DESC) AS b FROM dec2) WHERE b <= 5) GROUP BY 1""", "dec2"))
def _(spark, d):
    return rounded(V.decision_trend(decisions(spark, d), 5), 5)


@query("val24_blocked_results", sql(f"""SELECT run_id, ticker, CASE WHEN severity = 'fail' OR NOT passed THEN 'blocked' ELSE 'allowed' END AS state, count(*) AS n FROM (SELECT {RUN}, date FROM gpred) JOIN dec2 USING (ticker, run_id) GROUP BY 1, 2, 3""", "gpred", "dec2"))
def _(spark, d):
    """Test predictions of every run, marked by the gate's decision on the run."""
    p = runs_of(V.split_model(governed(spark, d), "log_return", MAC)[0])
    ok, no = V.split_blocked(p, decisions(spark, d), ("run_id", "ticker"))
    both = ok.withColumn("state", F.lit("allowed")).unionByName(no.withColumn("state", F.lit("blocked")))
    return both.groupBy("run_id", "ticker", "state").agg(F.count("*").alias("n"))


# --- model-driven backtests -------------------------------------------------------------------------------
def scored(spark, d, xs=("inflation", "energy_index", "consumer_sentiment")):
    """(ticker, window, date, z, actual, uptrend): out-of-window ridge predictions against realised returns."""
    m = stage(master(spark, d))
    frame = T.supervised_frame(m, "log_return", list(xs))
    p, _ = V.walk_forward_predictions(frame, "log_return", list(xs), alpha=1.0, windows=3, min_train=120, min_test=30)
    real = m.select("ticker", "date", F.greatest(F.lit(-0.15), F.least(F.lit(0.15), F.coalesce("log_return", F.lit(0.0)))).alias("realised"))
    up = K.uptrend_of(m, window=50)
    j = p.drop("actual").join(real, ["ticker", "date"]).join(up, ["ticker", "date"])
    return j.withColumnRenamed("realised", "actual")


def holdout(spark, d, cutoff="2000-01-01"):
    """Ridge trained before the cutoff date, z-scored by the train predictions."""
    xs = list(MAC)
    from ..functions import sums as S
    m = stage(master(spark, d))
    f = stage(T.supervised_frame(m, "log_return", xs).withColumn("is_train", F.col("date") < F.lit(cutoff).cast("date")))
    model = S.block_sums(f.where("is_train"), ["ticker"], xs, "log_return").withColumn("_m", S.ridge_udf("sums", F.lit(1.0))).select("ticker", "_m.*")
    p = S.predict(f, model, ["ticker"], xs)
    real = m.select("ticker", "date", F.greatest(F.lit(-0.15), F.least(F.lit(0.15), F.coalesce("log_return", F.lit(0.0)))).alias("actual"))
    return p.select("ticker", "date", "is_train", "predicted", "z").join(real, ["ticker", "date"]).join(K.uptrend_of(m, window=50), ["ticker", "date"])


cte("before", "SELECT * FROM sup WHERE date < DATE '2000-01-01'", "sup")
least_squares("before_fit", "before", "ticker", MAC, "log_return", "before", alpha="1.0")
cte("before_pred", f"""SELECT r.ticker, r.date < DATE '2000-01-01' AS is_train, {fitted_sql(MAC)} AS p, greatest(-0.15, least(0.15, coalesce(m.log_return, 0))) AS a
    FROM sup r JOIN before_fit f ON f.ticker = r.ticker JOIN master m ON m.ticker = r.ticker AND m.date = r.date""", "before_fit", "sup", "master")


@query("bt13_holdout_predictions", sql("""SELECT ticker, is_train, count(*) AS n, round(1 - sum((a - p) ** 2) / (var_pop(a) * count(*)), 5) AS r2, round(avg(abs(a - p)), 6) AS mae, round(sqrt(avg((a - p) ** 2)), 6) AS rmse FROM before_pred GROUP BY 1, 2""", "before_pred"))
def _(spark, d):
    return rounded(V.regression_metrics(holdout(spark, d), ("ticker", "is_train")), 6, r2=5)


cte("folds_r", "SELECT ticker, year(date) AS y, count(*) AS n, corr(predicted, actual) AS r FROM pred_ok GROUP BY 1, 2", "pred_ok")
XP = "(abs(atanh(r)) * sqrt(n - 3) / sqrt(2.0))"
cte("rob", f"""SELECT ticker, r, positive_ratio, least(1.0, {POLY} * exp(-x * x)) AS p_value FROM (SELECT *, 1.0 / (1.0 + {V.ERF_P} * x) AS t FROM (SELECT *, {XP} AS x FROM (
    SELECT ticker, count(*) AS n, corr(predicted, actual) AS r FROM pred_ok GROUP BY 1) JOIN (SELECT ticker, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio FROM folds_r GROUP BY 1) USING (ticker)))""", "pred_ok", "folds_r")


@query("bt19_robustness", sql("SELECT ticker, round(r, 5) AS r, round(p_value, 6) AS p_value, round(positive_ratio, 6) AS positive_ratio, r > 0 AS pearson_positive, p_value < 0.05 AS significant, r > 0 AND (p_value < 0.05 OR positive_ratio >= 0.5) AS robust FROM rob", "rob"))
def _(spark, d):
    p = naive_predictions(spark, d).withColumn("y", F.year("date"))
    f = K.prediction_test(p, ("ticker", "y")).groupBy("ticker").agg(F.avg((F.col("r") > 0).cast("double")).alias("positive_ratio"))
    t = K.prediction_test(p).select("ticker", "r", V.two_sided_p(F.col("r"), F.col("n").cast("double")).alias("p_value"))
    return rounded(K.robustness(t.join(f, "ticker")), 6, r=5)
