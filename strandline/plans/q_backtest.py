"""Strategy evaluation (BT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded, series
from ..functions.scans import running_totals
from ..operators import backtest as K
from ..sources import bindings as B
from .ctes import cte, sql
from .registry import query

R = K.Rules()
WT = "OVER (PARTITION BY ticker ORDER BY date"
WK = "OVER (PARTITION BY ticker, win, thr ORDER BY date"
GRID = [(n, t) for n in (10, 20, 50, 100) for t in (1.0, 1.5, 2.0, 2.5)]


def roll(fn, c, n, w=WT):
    return f"CASE WHEN count({c}) {w} ROWS {n - 1} PRECEDING) >= {n} THEN {fn}({c}) {w} ROWS {n - 1} PRECEDING) END"


cte("b0", f"SELECT ticker, date, px, CASE WHEN l IS NOT NULL THEN greatest(-0.15, least(0.15, l)) END AS r FROM (SELECT ticker, date, close AS px, ln(close / lag(close) {WT})) AS l FROM px)", "px")
cte("b1", "SELECT *, " + ", ".join(f"(px - {roll('avg', 'px', n)}) / nullif({roll('stddev_samp', 'px', n)}, 0) AS z_{n}" for n in (10, 20, 50, 100))
    + f", {roll('stddev_samp', 'r', 14)} AS vol, {roll('avg', 'px', 200)} AS sma FROM b0", "b0")
cte("b2", f"SELECT *, {roll('avg', 'vol', 20)} AS vol_ma FROM b1", "b1")
cte("b3", " UNION ALL ".join(f"SELECT ticker, date, px, r, vol, coalesce(vol > vol_ma, false) AS active, coalesce(px > sma, false) AS uptrend, {n}::BIGINT AS win, {t}::DOUBLE AS thr, z_{n} AS z FROM b2" for n, t in GRID), "b2")
SIG = "CASE WHEN NOT active THEN 0.0 WHEN z < -thr AND uptrend THEN 1.0 WHEN z > thr AND NOT uptrend THEN -1.0 ELSE 0.0 END::DOUBLE"
cte("b4", f"SELECT *, {SIG} AS raw_signal FROM b3", "b3")
cte("b5", f"SELECT *, lag(raw_signal) {WK}) * coalesce(lag(CASE WHEN vol IS NOT NULL THEN least({R.vol_target} / nullif(vol * sqrt(252), 0), 1.0) END) {WK}), 1.0) AS signal FROM b4", "b4")


def returns_of(src):
    return f"""SELECT *, signal * r - CASE WHEN changed THEN {R.friction} ELSE 0 END AS ret FROM (
      SELECT *, coalesce(abs(sign(signal) - lag(sign(signal)) {WK})) > 0.5, false) AS changed FROM {src})"""


cte("b6", returns_of("b5"), "b5")
cte("b7a", f"SELECT *, CASE WHEN ret IS NOT NULL THEN sum(ret) {WK} ROWS UNBOUNDED PRECEDING) END AS cum FROM b6", "b6")
cte("b7b", f"SELECT *, cum - max(cum) {WK} ROWS UNBOUNDED PRECEDING) AS dd0 FROM b7a", "b7a")
cte("b7c", f"SELECT ticker, date, px, r, vol, win, thr, z, CASE WHEN coalesce(lag(dd0) {WK}), 0) < -{R.portfolio_stop} THEN 0.0 ELSE signal END AS signal FROM b7b", "b7b")
cte("b7", returns_of("b7c"), "b7c")


def island(src):
    return f"""SELECT *, count(*) FILTER (NOT inp) {WK} ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, coalesce(abs(signal) > 1e-10, false) AS inp FROM {src})"""


cte("b8a", island("b7"), "b7")
cte("b8b", "SELECT *, CASE WHEN inp THEN count(*) FILTER (inp) OVER (PARTITION BY ticker, win, thr, isl ORDER BY date ROWS UNBOUNDED PRECEDING) ELSE 0 END AS held FROM b8a", "b8a")
cte("b8c", f"SELECT ticker, date, px, r, vol, win, thr, z, CASE WHEN coalesce(lag(held) {WK}), 0) >= {R.max_hold} THEN 0.0 ELSE signal END AS signal FROM b8b", "b8b")
cte("b8", returns_of("b8c"), "b8c")
cte("b9a", island(f"(SELECT *, lag(vol) {WK}) AS pv FROM b8)"), "b8")
cte("b9b", """SELECT *, first_value(CASE WHEN inp THEN 1 END IGNORE NULLS) OVER w AS started, first_value(CASE WHEN inp THEN coalesce(pv, -1) END IGNORE NULLS) OVER w AS ev,
    sum(CASE WHEN inp THEN ret END) OVER w AS pnl FROM b9a WINDOW w AS (PARTITION BY ticker, win, thr, isl ORDER BY date ROWS UNBOUNDED PRECEDING)""", "b9a")
cte("b9c", f"""SELECT ticker, date, px, r, vol, win, thr, z, CASE WHEN coalesce(lag(hit) {WK}), false) THEN 0.0 ELSE signal END AS signal FROM (
    SELECT *, inp AND coalesce(pnl < -least({R.trade_stop_multiple} * CASE WHEN ev > 0 THEN ev ELSE 0.02 END, {R.trade_stop_cap}), false) AS hit FROM b9b)""", "b9b")
cte("b9", returns_of("b9c"), "b9c")
cte("bt", 'SELECT ticker, win AS "window", thr AS threshold, date, px, z, signal, changed, ret, r AS bench FROM b9 WHERE ret IS NOT NULL AND signal IS NOT NULL AND r IS NOT NULL AND z IS NOT NULL', "b9")
BK = 'ticker, "window", threshold'
cte("bt_c", f"SELECT *, exp(cum - max(cum) OVER (PARTITION BY {BK} ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM (SELECT *, sum(ret) OVER (PARTITION BY {BK} ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM bt)", "bt")
ANNUAL = "least(greatest(exp(s / greatest(n / 252.0, 1 / 252.0)) - 1, -0.99), 25.0)"
cte("bt_m", f"""SELECT {BK}, {ANNUAL} AS annualized_return, sd * sqrt(252) AS annualized_volatility, CASE WHEN sd > 1e-12 THEN m / sd * sqrt(252) END AS sharpe_ratio,
    CASE WHEN dsd > 1e-12 THEN m / dsd * sqrt(252) END AS sortino_ratio, mdd AS max_drawdown, CASE WHEN loss > 1e-12 THEN gain / loss END AS profit_factor,
    {ANNUAL} / greatest(abs(mdd), 0.01) AS calmar_ratio, total_trades, wins / n AS win_rate, n AS total_days, exp(s) AS final_equity FROM (
    SELECT {BK}, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, sum(ret) AS s, stddev_samp(ret) FILTER (ret < 0) AS dsd, min(dd) AS mdd, coalesce(sum(ret) FILTER (ret > 0), 0) AS gain,
    coalesce(abs(sum(ret) FILTER (ret < 0)), 0) AS loss, count(*) FILTER (ret > 0) AS wins, count(*) FILTER (changed) AS total_trades FROM bt_c GROUP BY ALL) WHERE n >= 10""", "bt_c")
MET = ["annualized_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "profit_factor", "calmar_ratio", "win_rate", "final_equity"]
RM = ", ".join(f"round({c}, 5) AS {c}" for c in MET)
ONE = ' "window" = 20 AND threshold = 1.5'


def steps(spark, d, upto):
    """Rows after the first `upto` rules, for window 20 and threshold 1.5."""
    keys = ["ticker", "window", "threshold"]
    x = K.with_parameters(K.with_indicators(K.clean_prices(B.bars(spark, d)), [20]), [20], [1.5])
    x = K.with_returns_of(K.with_signal(x, keys, R), series(keys), R)
    for rule in (K.with_portfolio_stop, K.with_time_exit, K.with_trade_stop)[:upto]:
        x = rule(x, keys, R)
    return x


@query("bt1_clean_prices", sql(f"""SELECT ticker, date, round(px, 4) AS px, round(CASE WHEN l IS NOT NULL THEN greatest(-0.15, least(0.15, l)) END, 6) AS r FROM (
    SELECT *, ln(px / lag(px) {WT})) AS l FROM (SELECT ticker, date, last_value(CASE WHEN day(date) <= 3 OR day(date) >= 29 THEN NULL ELSE close END IGNORE NULLS) {WT} ROWS UNBOUNDED PRECEDING) AS px FROM px)
    WHERE px IS NOT NULL)""", "px"))
def _(spark, d):
    dom = F.dayofmonth("date")
    px = B.bars(spark, d).withColumn("close", F.when(dom >= 29, -F.col("close")).when(dom > 3, F.col("close")))
    return rounded(K.clean_prices(px), 6, px=4)


@query("bt2_zscore_signal", sql("SELECT ticker, date, round(z, 5) AS z, CASE WHEN z < -thr THEN 1.0 WHEN z > thr THEN -1.0 ELSE 0.0 END::DOUBLE AS signal FROM b3 WHERE win = 20 AND thr = 1.5", "b3"))
def _(spark, d):
    x = K.with_parameters(K.with_indicators(K.clean_prices(B.bars(spark, d)), [20]), [20], [1.5])
    plain = K.Rules(volatility_filter=False, trend_filter=False, long_only_uptrend=False)
    return rounded(x.select("ticker", "date", "z", K.raw_signal(plain).alias("signal")), 5)


@query("bt3_activity_filter", sql("SELECT ticker, date, round(vol, 6) AS vol, round(vol_ma, 6) AS vol_ma, coalesce(vol > vol_ma, false) AS active FROM b2", "b2"))
def _(spark, d):
    return rounded(K.with_indicators(K.clean_prices(B.bars(spark, d)), []).select("ticker", "date", "vol", "vol_ma", "active"))


@query("bt4_trend_filter", sql("SELECT ticker, date, uptrend, raw_signal FROM b4 WHERE win = 20 AND thr = 1.5", "b4"))
def _(spark, d):
    x = K.with_parameters(K.with_indicators(K.clean_prices(B.bars(spark, d)), [20]), [20], [1.5])
    return x.select("ticker", "date", "uptrend", K.raw_signal(R).alias("raw_signal"))


@query("bt5_lag_and_size", sql("SELECT ticker, date, round(signal, 6) AS signal FROM b5 WHERE win = 20 AND thr = 1.5", "b5"))
def _(spark, d):
    return rounded(steps(spark, d, 0).select("ticker", "date", "signal"))


for name, src, n in (("bt6_return_and_cost", "b6", 0), ("bt7_portfolio_stop", "b7", 1), ("bt8_time_exit", "b8", 2), ("bt9_trade_stop", "b9", 3)):
    @query(name, sql(f"SELECT ticker, date, round(signal, 6) AS signal, changed, round(ret, 6) AS ret FROM {src} WHERE win = 20 AND thr = 1.5", src))
    def _(spark, d, n=n):
        return rounded(steps(spark, d, n).select("ticker", "date", "signal", "changed", "ret"))


@query("bt10_metrics", sql(f"SELECT ticker, total_trades, total_days, {RM} FROM bt_m WHERE {ONE}", "bt_m"))
def _(spark, d):
    x, keys = K.run(B.bars(spark, d))
    return rounded(K.metrics(x, keys).drop("window", "threshold"), 5)


@query("bt11_curves", sql(f"""SELECT ticker, date, round(exp(sum(ret) {WT} ROWS UNBOUNDED PRECEDING)), 6) AS equity, round(exp(sum(bench) {WT} ROWS UNBOUNDED PRECEDING)), 6) AS benchmark,
    round({roll('avg', 'ret', 30)} / nullif({roll('stddev_samp', 'ret', 30)}, 0) * sqrt(252), 4) AS rolling_sharpe FROM bt WHERE {ONE}""", "bt"))
def _(spark, d):
    x, keys = K.run(B.bars(spark, d))
    return rounded(K.curves(x, keys).drop("window", "threshold"), 6, rolling_sharpe=4)


@query("bt12_drawdown_annual", sql("SELECT ticker, min(dd) AS max_drawdown, least(greatest(exp(max(s) / greatest(max(n) / 252.0, 1 / 252.0)) - 1, -0.99), 25.0) AS annualized_return FROM ("
    + f"SELECT ticker, round(exp(cum - max(cum) {WT} ROWS UNBOUNDED PRECEDING)) - 1, 6) AS dd, sum(log_return) OVER (PARTITION BY ticker) AS s, count(log_return) OVER (PARTITION BY ticker) AS n FROM ("
    + f"SELECT *, sum(log_return) {WT} ROWS UNBOUNDED PRECEDING) AS cum FROM ret WHERE log_return IS NOT NULL)) GROUP BY 1", "ret").replace("least(greatest(", "round(least(greatest(").replace("25.0) AS", "25.0), 6) AS"))
def _(spark, d):
    from ..operators import gold as G
    r = G.with_returns(B.bars(spark, d)).where(F.col("log_return").isNotNull())
    c = K.with_curve(r, ["ticker"], "log_return").groupBy("ticker").agg(F.min("dd").alias("max_drawdown"), F.sum("log_return").alias("s"), F.count("*").alias("n"))
    return rounded(c.select("ticker", "max_drawdown", K.annualised(F.col("s"), F.col("n")).alias("annualized_return")))


def stat_sql(src, ret, bench, cond="true"):
    w = "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT ticker, n, wins / n * avg_win - losses / n * avg_loss AS expectancy, CASE WHEN loss > 1e-12 THEN gain / loss END AS profit_factor,
      CASE WHEN sd > 1e-12 THEN m / sd * sqrt(252) END AS sharpe, mdd AS max_drawdown, {ANNUAL} AS annualized_return, {ANNUAL} / greatest(abs(mdd), 0.01) AS calmar,
      CASE WHEN te > 1e-12 THEN am / te * sqrt(252) END AS information_ratio, te AS tracking_error FROM (
      SELECT ticker, count({ret}) AS n, count(*) FILTER ({ret} > 0) AS wins, count(*) FILTER ({ret} < 0) AS losses, coalesce(avg({ret}) FILTER ({ret} > 0), 0) AS avg_win,
        coalesce(abs(avg({ret}) FILTER ({ret} < 0)), 0) AS avg_loss, coalesce(sum({ret}) FILTER ({ret} > 0), 0) AS gain, coalesce(abs(sum({ret}) FILTER ({ret} < 0)), 0) AS loss,
        avg({ret}) AS m, stddev_samp({ret}) AS sd, sum({ret}) AS s, min(dd) AS mdd, avg({ret} - {bench}) AS am, stddev_samp({ret} - {bench}) AS te FROM (
        SELECT *, exp(cum - max(cum) {w}) - 1 AS dd FROM (SELECT *, sum({ret}) {w} AS cum FROM {src} WHERE {cond})) GROUP BY 1)"""


STATS = ["expectancy", "profit_factor", "sharpe", "max_drawdown", "annualized_return", "calmar", "information_ratio", "tracking_error"]
RS = ", ".join(f"round({c}, 5) AS {c}" for c in STATS)


@query("bt15_short_stats", sql(f"SELECT ticker, n, {RS} FROM ({stat_sql('bt', 'ret', 'bench', ONE)})", "bt"))
def _(spark, d):
    x, _ = K.run(B.bars(spark, d))
    return rounded(K.short_stats(x, ["ticker"]), 5)


@query("bt20_return_histogram", sql(f"""SELECT ticker, bins, least(coalesce(floor((ret - lo) / nullif(hi - lo, 0) * bins), 0), bins - 1)::BIGINT AS bin, count(*) AS n FROM (SELECT * FROM bt WHERE {ONE})
    JOIN (SELECT ticker, min(ret) AS lo, max(ret) AS hi, least(24, greatest(8, floor(sqrt(count(*)))))::BIGINT AS bins FROM bt WHERE {ONE} GROUP BY 1) USING (ticker) GROUP BY ALL""", "bt"))
def _(spark, d):
    x, _ = K.run(B.bars(spark, d))
    return K.histogram(x)


@query("bt22_parameter_grid", sql(f"""SELECT {BK}, place, total_trades, total_days, {RM} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sortino_ratio DESC NULLS LAST, "window", threshold) AS place FROM bt_m)
    WHERE place <= 5""", "bt_m"))
def _(spark, d):
    return rounded(K.grid_search(B.bars(spark, d)), 5)


@query("bt23_plausibility_gate", sql(f"""SELECT {BK}, coalesce(abs(sharpe_ratio) <= 5.5, true) AND max_drawdown >= -0.99 AND final_equity <= 1000 AND annualized_return <= 99 AS passed FROM bt_m""", "bt_m"))
def _(spark, d):
    x, keys = K.run(B.bars(spark, d), (10, 20, 50, 100), (1.0, 1.5, 2.0, 2.5))
    return K.plausibility(K.metrics(x, keys)).select(*keys, "passed")


# a naive forecast (the return of the row before) stands in for model predictions
cte("preds", f"SELECT ticker, date, lag(log_return) {WT}) AS predicted, log_return AS actual FROM ret", "ret")
cte("pred_ok", "SELECT * FROM preds WHERE predicted IS NOT NULL AND actual IS NOT NULL", "preds")


def naive_predictions(spark, d):
    from ..operators import gold as G
    r = G.with_returns(B.bars(spark, d))
    p = r.select("ticker", "date", F.lag("log_return").over(series("ticker")).alias("predicted"), F.col("log_return").alias("actual"))
    return p.where(F.col("predicted").isNotNull() & F.col("actual").isNotNull())


@query("bt24_sign_strategy", sql("""SELECT ticker, n, round(expectancy, 6) AS expectancy, round(profit_factor, 5) AS profit_factor, round(max_drawdown, 6) AS max_drawdown,
    round(ann, 5) AS annualized_return, round(CASE WHEN abs(max_drawdown) > 1e-12 THEN ann / abs(max_drawdown) END, 5) AS calmar, round(CASE WHEN sd > 1e-12 THEN m / sd * sqrt(252) END, 5) AS sharpe,
    round(CASE WHEN asd > 1e-12 THEN am / asd * sqrt(252) END, 5) AS information_ratio, round(r, 6) AS pearson_r FROM (SELECT *, exp(g / greatest(n / 252.0, 1 / 252.0)) - 1 AS ann FROM (
    SELECT ticker, count(*) AS n, count(*) FILTER (ret > 0) / count(*) * coalesce(avg(ret) FILTER (ret > 0), 0) - count(*) FILTER (ret < 0) / count(*) * coalesce(abs(avg(ret) FILTER (ret < 0)), 0) AS expectancy,
    CASE WHEN abs(sum(ret) FILTER (ret < 0)) > 1e-12 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / abs(sum(ret) FILTER (ret < 0)) END AS profit_factor, min(dd) AS max_drawdown, sum(ln(1 + ret)) AS g,
    avg(ret) AS m, stddev_samp(ret) AS sd, avg(ret - actual) AS am, stddev_samp(ret - actual) AS asd, corr(predicted, actual) AS r FROM (
    SELECT *, eq / max(eq) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS eq FROM (
    SELECT *, CASE WHEN predicted >= 0 THEN 1.0 ELSE -1.0 END * actual AS ret FROM pred_ok))) GROUP BY 1))""", "pred_ok"))
def _(spark, d):
    return rounded(K.sign_strategy(naive_predictions(spark, d)), 5, expectancy=6, max_drawdown=6, pearson_r=6)


cte("san", "SELECT ticker, date, greatest(-0.15, least(0.15, coalesce(CASE WHEN predicted >= 0 THEN 1.0 ELSE -1.0 END * actual, 0))) AS ret, greatest(-0.15, least(0.15, coalesce(actual, 0))) AS bench FROM preds WHERE predicted IS NOT NULL", "preds")
cte("san_stats", stat_sql("san", "ret", "bench"), "san")


def sanitised_stats(spark, d):
    p = naive_predictions(spark, d)
    p = p.select("ticker", "date", (F.when(F.col("predicted") >= 0, 1.0).otherwise(-1.0) * F.col("actual")).alias("ret"), F.col("actual").alias("bench"))
    return K.sanitised(p, ["ret", "bench"])


@query("bt25_sanitised_scorecard", sql(f"SELECT ticker, n, {RS} FROM san_stats", "san_stats"))
def _(spark, d):
    return rounded(K.short_stats(sanitised_stats(spark, d), ["ticker"]), 5)


def pts(c, full, p):
    return f"coalesce(least(greatest({c} / {full} * {p}, 0.0), {p}.0), 0.0)"


SCORE = f"least(100.0, CASE WHEN expectancy > 0 THEN 25.0 ELSE 0.0 END + {pts('(profit_factor - 1)', 0.2, 25)} + {pts('calmar', 0.6, 20)} + {pts('sharpe', 0.6, 20)} + {pts('information_ratio', 0.5, 10)})"


@query("bt26_edge_score", sql(f"SELECT ticker, round({SCORE}, 4) AS score FROM san_stats", "san_stats"))
def _(spark, d):
    return rounded(K.edge_score(K.short_stats(sanitised_stats(spark, d), ["ticker"])).select("ticker", "score"), 4)


cte("san_year", "SELECT ticker || '#' || year(date) AS ticker, date, ret, bench FROM san", "san")
cte("year_stats", stat_sql("san_year", "ret", "bench"), "san_year")
cte("scores", f"SELECT split_part(ticker, '#', 1) AS ticker, CAST(split_part(ticker, '#', 2) AS BIGINT) AS run, {SCORE} AS score FROM year_stats", "year_stats")


@query("bt27_score_alerts", sql("""SELECT ticker, run, round(score, 4) AS score, round(previous, 4) AS previous, coalesce(score < previous - 30, false) AS alert, round(ma, 4) AS score_ma FROM (
    SELECT *, lag(score) OVER w AS previous, avg(score) OVER (PARTITION BY ticker ORDER BY run ROWS 4 PRECEDING) AS ma FROM scores WINDOW w AS (PARTITION BY ticker ORDER BY run))""", "scores"))
def _(spark, d):
    s = sanitised_stats(spark, d).withColumn("run", F.year("date").cast("long"))
    return rounded(K.score_alerts(K.edge_score(K.short_stats(s, ["ticker", "run"])).select("ticker", "run", "score")), 4)


@query("bt28_final_values", sql(f"""SELECT ticker, round(exp(sum(ret)), 6) AS strategy, round(exp(sum(bench)), 6) AS benchmark, round((exp(sum(ret)) - exp(sum(bench))) / greatest(abs(exp(sum(bench))), 1e-6) * 100, 3) AS alpha_pct
    FROM bt WHERE {ONE} GROUP BY 1""", "bt"))
def _(spark, d):
    x, _ = K.run(B.bars(spark, d))
    return rounded(K.final_values(x, ["ticker"]), 6, alpha_pct=3)


@query("bt29_prediction_test", sql("SELECT ticker, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t FROM (SELECT ticker, count(*) AS n, corr(predicted, actual) AS r FROM pred_ok GROUP BY 1)", "pred_ok"))
def _(spark, d):
    return rounded(K.prediction_test(naive_predictions(spark, d)), 6, t=5)


@query("bt12_tick_drawdown", """SELECT event_type, count(*) AS n, round(max(total), 4) AS top, round(min(total - peak), 4) AS worst FROM (SELECT *, max(total) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS peak FROM (
    SELECT *, sum(value - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS total FROM events)) GROUP BY 1""".replace("round(", "ROUND("))
def _(spark, d):
    """Peak and worst fall of the running value of each event type, a series that is not bounded by the calendar."""
    e = B.table(spark, d, "events").select("event_type", "ts", "event_id", (F.col("value") - 50).alias("move"))
    t = running_totals(e, ["event_type"], ["ts", "event_id"], "move")
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("total"), 4).alias("top"), F.round(F.min("fall"), 4).alias("worst"))
