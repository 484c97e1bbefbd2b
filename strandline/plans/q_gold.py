"""Wide table (GLD) and mixed-frequency transforms (TRN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import rounded
from ..functions.scans import asof_backward
from ..operators import gold as G
from ..operators import transforms as T
from ..sources import bindings as B
from .ctes import cte, sql
from .registry import query

MAC, IND = list(B.MACRO_NAMES), list(B.INDICATOR_NAMES)
CLIP = repr(X.RETURN_CLIP)
W = "OVER (PARTITION BY ticker ORDER BY date"


def master(spark, d, **kw):
    return G.master_table(B.bars(spark, d), B.macro(spark, d), MAC, B.indicators(spark, d), IND, **kw)


cte("ret", f"""SELECT *, CASE WHEN raw_return IS NOT NULL THEN greatest(-{CLIP}, least({CLIP}, raw_return)) END AS log_return FROM (
    SELECT *, ln(adj_close / lag(adj_close) {W})) AS raw_return FROM px)""", "px")
cte("ret_day", f"""SELECT *, CASE WHEN raw_return IS NOT NULL THEN greatest(-{CLIP}, least({CLIP}, raw_return)) END AS log_return FROM (
    SELECT *, ln(adj_close / lag(adj_close) {W})) AS raw_return FROM px_day)""", "px_day")
PREV_BD = "CAST({d} - CAST(greatest(isodow({d}) - 5, 0) AS INT) AS DATE)"
cte("ind_agg", f"SELECT series, {PREV_BD.format(d='date')} AS date, v AS value FROM (SELECT series, date, avg(value) AS v FROM ind GROUP BY 1, 2)", "ind")


def asof(prev, name, src, tol, key):
    cond = f"m.date - s.date <= {tol}" if tol else "true"
    return f"""SELECT m.*, CASE WHEN {cond} THEN s.value END AS {name}, CASE WHEN {cond} THEN CAST(m.date - s.date AS INT) END AS age_days_{name}
      FROM {prev} m ASOF LEFT JOIN (SELECT date, value FROM {src} WHERE series = '{key}') s ON m.date >= s.date"""


prev = "ret"
for i, n in enumerate(MAC):
    cte(f"m{i}", asof(prev, n, "macro", X.MACRO_TOLERANCE_DAYS, n), prev, "macro")
    prev = f"m{i}"
for i, n in enumerate(IND):
    cte(f"s{i}", asof(prev, n, "ind_agg", X.INDICATOR_TOLERANCE_DAYS, n), prev, "ind_agg")
    prev = f"s{i}"
cte("master", f"SELECT * FROM {prev}", prev)
M4 = ", ".join(f"round({c}, 4) AS {c}" for c in MAC)
AGES = ", ".join(f"age_days_{c}" for c in MAC + IND)


@query("gld1_union_entities", sql("""SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM (
    SELECT ticker, date FROM px UNION ALL SELECT ticker, date FROM px_flag) GROUP BY 1""", "px", "px_flag"))
def _(spark, d):
    both = G.union_entities([B.bars(spark, d).withColumn("ticker", F.lower("ticker")), B.bars(spark, d, "l_returnflag", "day").drop("high", "low")])
    return both.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("gld2_valid_dates", """SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_rows FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def _(spark, d):
    o = B.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderdate").cast("string")).alias("date"))
    return G.valid_dates(o).groupBy("date").agg(F.count("*").alias("n_rows"))


@query("gld3_log_return", sql("SELECT ticker, date, round(raw_return, 6) AS raw_return FROM ret_day", "ret_day"))
def _(spark, d):
    return rounded(G.with_returns(B.bars(spark, d, "p_brand", "day")).select("ticker", "date", "raw_return"))


@query("gld4_clip_returns", sql(f"""SELECT ticker, count(raw_return) AS n_returns, count(*) FILTER (abs(raw_return) > {CLIP}) AS n_clipped FROM ret_day GROUP BY 1""", "ret_day"))
def _(spark, d):
    return G.clipped_returns(G.with_returns(B.bars(spark, d, "p_brand", "day")))


@query("gld5_asof_join", sql(f"""SELECT p.ticker, p.date, round(CASE WHEN p.date - s.date <= 20 THEN s.value END, 4) AS inflation
    FROM px_day p ASOF LEFT JOIN (SELECT date, value FROM macro WHERE series = 'inflation') s ON p.date >= s.date""", "px_day", "macro"))
def _(spark, d):
    wide = G.widen(G.asof_calendar(B.macro(spark, d), 20), ["inflation"], ages=False)
    return rounded(B.bars(spark, d, "p_brand", "day").join(F.broadcast(wide), "date", "left").select("ticker", "date", "inflation"), 4)


# ticks: the last other event of the user within an hour before each error
@query("gld5_asof_ticks", """SELECT e.event_id, CASE WHEN e.ts - o.ts <= INTERVAL 1 HOUR THEN o.event_type END AS seen_type, CASE WHEN e.ts - o.ts <= INTERVAL 1 HOUR THEN o.value END AS seen_value FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT user_id, ts, max_by(event_type, row(value, event_type)) AS event_type, max(value) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2) o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def _(spark, d):
    e = B.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    seen = e.where("event_type <> 'error'").select("ts", "user_id", F.col("value").alias("seen_value"), F.col("event_type").alias("seen_type"))
    return asof_backward(e.where("event_type = 'error'"), seen, "ts", ["seen_value", "seen_type"], ["user_id"], 3600).select("event_id", "seen_type", "seen_value")


@query("gld6_keep_last_duplicate", """SELECT event_type AS series, CAST(ts AS DATE) AS date, round(max_by(value, event_id), 4) AS value FROM events GROUP BY 1, 2""")
def _(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("date"), "value", "event_id")
    return rounded(G.keep_last(e, ["series", "date"], "event_id").drop("event_id"), 4)


@query("gld7_value_age", sql(f"SELECT ticker, date, {AGES} FROM master", "master"))
def _(spark, d):
    return master(spark, d).select("ticker", "date", *[f"age_days_{c}" for c in MAC + IND])


@query("gld8_missing_columns", sql("SELECT count(*) AS n_rows, 'vix_index' AS missing FROM master", "master"))
def _(spark, d):
    m = master(spark, d)
    try:
        G.require_columns(m, [*MAC, "vix_index"])
        missing = ""
    except ValueError as e:
        missing = str(e).split(": ")[1]
    return m.agg(F.count("*").alias("n_rows")).withColumn("missing", F.lit(missing))


@query("gld9_economy_aggregate", sql("""SELECT series, date, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(sum(value), 4) AS sum,
    round(max_by(value, economy), 4) AS last FROM ind GROUP BY 1, 2""", "ind"))
def _(spark, d):
    return rounded(G.aggregate_economies(B.indicators(spark, d), ("mean", "median", "sum", "last")), 4)


@query("gld10_business_days", sql("""SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM px_day)
    WHERE isodow(d) <= 5""", "px_day"))
def _(spark, d):
    return G.business_days(B.bars(spark, d, "p_brand", "day"))


cte("bd", """SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-02', DATE '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS date)
    WHERE isodow(date) <= 5""")
cte("anchor", "SELECT a.series, a.date, a.value, bd.i, lead(a.value) OVER w AS v1, lead(bd.i) OVER w AS i1 FROM ind_agg a JOIN bd USING (date) WINDOW w AS (PARTITION BY a.series ORDER BY a.date)", "ind_agg", "bd")


@query("gld11_linear_interpolation", sql("""SELECT a.series, bd.date, round(CASE WHEN v1 IS NULL THEN value ELSE value + (v1 - value) * (bd.i - a.i) / (a.i1 - a.i) END, 4) AS value
    FROM bd ASOF JOIN (SELECT * FROM anchor WHERE series = 'gdp_growth') a ON bd.date >= a.date WHERE bd.date - a.date <= 730
    UNION ALL SELECT a.series, bd.date, round(CASE WHEN v1 IS NULL THEN value ELSE value + (v1 - value) * (bd.i - a.i) / (a.i1 - a.i) END, 4) AS value
    FROM bd ASOF JOIN (SELECT * FROM anchor WHERE series = 'trade_openness') a ON bd.date >= a.date WHERE bd.date - a.date <= 730""", "anchor"))
def _(spark, d):
    cal = G.indicator_calendar(G.aggregate_economies(B.indicators(spark, d)), "linear")
    return rounded(cal.where(F.weekday("date") < 5).select("series", "date", "value"), 4)


@query("gld12_indicator_asof", sql("SELECT ticker, date, round(gdp_growth, 4) AS gdp_growth, age_days_gdp_growth, round(trade_openness, 4) AS trade_openness FROM master", "master"))
def _(spark, d):
    return rounded(master(spark, d).select("ticker", "date", "gdp_growth", "age_days_gdp_growth", "trade_openness"), 4)


@query("master_table", sql(f"""SELECT ticker, date, round(close, 4) AS close, round(log_return, 6) AS log_return, volume, {M4}, round(gdp_growth, 4) AS gdp_growth,
    round(trade_openness, 4) AS trade_openness, {AGES} FROM master""", "master"))
def _(spark, d):
    cols = ["ticker", "date", "close", "log_return", "volume", *MAC, *IND, *[f"age_days_{c}" for c in MAC + IND]]
    return rounded(master(spark, d).select(*cols), 4, log_return=6)


@query("macro_beta", sql("""SELECT ticker, count(log_return) FILTER (inflation IS NOT NULL) AS n, round(regr_slope(log_return, inflation) * 1e6, 4) AS beta_ppm, round(corr(log_return, inflation), 6) AS corr
    FROM master GROUP BY 1""", "master"))
def _(spark, d):
    """Flagship: prices to clipped returns, macro as of each day, one-factor beta per ticker."""
    m = G.master_table(B.bars(spark, d), B.macro(spark, d), MAC)
    a = m.groupBy("ticker").agg(F.count(F.when(F.col("inflation").isNotNull(), F.col("log_return"))).alias("n"), (F.regr_slope("log_return", "inflation") * 1e6).alias("beta_ppm"), F.corr("log_return", "inflation").alias("corr"))
    return rounded(a, 6, beta_ppm=4)


GROUPS = {"yfinance": ["close"], "fred": MAC, "worldbank": IND, "other": ["age_days_trade_openness"]}


def anyof(cs):
    return "coalesce(" + ", ".join(f"CAST({c} AS DOUBLE)" for c in cs) + ") IS NOT NULL"


@query("gld13_source_usage", sql(" UNION ALL ".join(
    f"SELECT '{s}' AS source, round(100.0 * count(*) FILTER ({anyof(cs)}) / count(*), 6) AS usage_pct FROM master" for s, cs in GROUPS.items()), "master"))
def _(spark, d):
    return rounded(G.source_usage(master(spark, d), GROUPS))


@query("gld14_staleness", sql("""SELECT source, CAST(max(age) AS BIGINT) AS max_age_days, CAST(median(age) AS DOUBLE) AS median_age_days FROM ("""
    + " UNION ALL ".join(f"SELECT '{s}' AS source, age_days_{c} AS age FROM master" for s, cs in (("fred", MAC), ("worldbank", IND)) for c in cs)
    + ") WHERE age IS NOT NULL GROUP BY 1", "master"))
def _(spark, d):
    return G.staleness(master(spark, d), {"fred": MAC, "worldbank": IND})


@query("gld15_unused_sources", sql("SELECT 'none' AS source, 0.0::DOUBLE AS usage_pct FROM master LIMIT 1", "master"))
def _(spark, d):
    m = master(spark, d).withColumn("never", F.lit(None).cast("double"))
    return G.unused_sources(G.source_usage(m, {"fred": MAC, "none": ["never"]}))


DENS = ["close", "log_return", *MAC, *IND]


@query("gld16_null_density", sql("SELECT *, null_pct > 20 AS alert FROM (" + " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", ROUND(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct FROM master' for c in DENS) + ")", "master"))
def _(spark, d):
    return G.null_density(master(spark, d), DENS)


@query("gld17_contract", sql(" UNION ALL ".join(f"SELECT '{src}' AS source, '{c}' AS column_name, count({c if known else 'NULL'}) > 0 AS observed, count({c if known else 'NULL'}) AS n_values, count(*) AS n_rows FROM master"
    for src, c, known in [("yfinance", "close", True), ("yfinance", "log_return", True), *[("fred", c, c in MAC) for c in sorted(X.MACRO_SERIES.values())]]), "master"))
def _(spark, d):
    return G.contract(master(spark, d), {"yfinance": ["close", "log_return"], "fred": list(X.MACRO_SERIES.values())})


@query("gld18_filter_ticker", sql("""SELECT 'PROMO' AS asked, ticker, count(*) AS n FROM px WHERE ticker = 'PROMO' GROUP BY 2
    UNION ALL SELECT 'absent', ticker, count(*) FROM px GROUP BY 2""", "px"))
def _(spark, d):
    px = B.bars(spark, d)
    one = lambda t: G.for_ticker(px, t).groupBy("ticker").agg(F.count("*").alias("n")).withColumn("asked", F.lit(t))
    return one("PROMO").unionByName(one("absent"))


CAND = ["inflation", "gdp_growth", "trade_openness", "close", "volume", "flat"]


@query("gld19_candidate_factors", sql("SELECT * FROM (" + " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", {i}::BIGINT AS position, count({c}) AS n FROM master HAVING count({c}) >= 30 AND count(DISTINCT {c}) > 1' for i, c in enumerate(CAND[:-1])) + ")", "master"))
def _(spark, d):
    return G.candidate_factors(master(spark, d).withColumn("flat", F.lit(1.0)), CAND)


@query("gld20_inverse_vol_weights", sql("""SELECT ticker, round(volatility, 6) AS volatility, round((1 / greatest(volatility, 1e-8)) / sum(1 / greatest(volatility, 1e-8)) OVER (), 6) AS weight
    FROM (SELECT ticker, stddev_samp(log_return) * sqrt(252) AS volatility FROM ret WHERE date >= (SELECT max(date) FROM ret) - 252 GROUP BY 1 HAVING count(log_return) >= 20)""", "ret"))
def _(spark, d):
    return rounded(G.inverse_volatility_weights(G.with_returns(B.bars(spark, d))))


cte("macro_gap", "SELECT series, date, CASE WHEN month(date) <= 7 THEN NULL ELSE value END AS value FROM macro", "macro")
cte("macro_bfill", "SELECT series, date, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS value FROM macro_gap", "macro_gap")


@query("gld21_bounded_fill_merge", sql("""SELECT p.ticker, p.date, round(p.close, 4) AS close, round(s.value, 4) AS inflation FROM px p
    ASOF LEFT JOIN (SELECT date, value FROM macro_bfill WHERE series = 'inflation') s ON p.date >= s.date""", "px", "macro_bfill"))
def _(spark, d):
    gap = B.macro(spark, d).withColumn("value", F.when(F.month("date") > 7, F.col("value")))
    return rounded(G.merged_frame(B.bars(spark, d).select("ticker", "date", "close"), gap, ["inflation"]), 4)


# --- transforms -----------------------------------------------------------------------------------
RATE = "|".join(X.RATE_WORDS)
CLS = ["close", "log_return", "inflation", "energy_index", "gdp_growth", "trade_openness", "consumer_sentiment"]


@query("trn1_classify_columns", sql(f"""SELECT "column", n, source, return_like, rate_like, CAST(CASE source WHEN 'yfinance' THEN 1 WHEN 'fred' THEN 21 ELSE 252 END AS BIGINT) AS native_horizon FROM (
    SELECT *, CASE WHEN "column" IN ('open','high','low','close','adj_close','volume','log_return','ticker') THEN 'yfinance' WHEN "column" IN ('gdp_growth','trade_openness') THEN 'worldbank' ELSE 'fred' END AS source,
    regexp_matches("column", 'return|pct_change|diff') AS return_like, regexp_matches("column", '{RATE}') AS rate_like FROM ("""
    + " UNION ALL ".join(f'SELECT \'{c}\' AS "column", count({c}) AS n FROM master' for c in CLS) + "))", "master"))
def _(spark, d):
    m = master(spark, d)
    names = m.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n")) for c in CLS]).alias("a")).select(F.inline("a"))
    return T.classify(names)


LAG = f"lag({{c}}) {W})"


def stat_sql(name, c, prev, pos):
    if T.is_return_like(name):
        return c
    if T.is_rate_like(name):
        return f"{c} - {prev}"
    return f"CASE WHEN {pos} THEN ln({c} / nullif({prev}, 0)) ELSE {c} / nullif({prev}, 0) - 1 END"


TRN2 = ["log_return", "inflation", "close", "raw_change"]
cte("trn2", f"SELECT *, inflation - 300000 AS raw_change FROM master", "master")


@query("trn2_stationary", sql("SELECT ticker, date, " + ", ".join(
    f"round({stat_sql(c, c, LAG.format(c=c), f'min({c}) OVER (PARTITION BY ticker) > 0')}, 4) AS t_{c}" for c in TRN2) + " FROM trn2", "trn2"))
def _(spark, d):
    m = master(spark, d).withColumn("raw_change", F.col("inflation") - 300000)
    for c in TRN2:
        m = T.with_stationary(m, c, f"t_{c}")
    return rounded(m.select("ticker", "date", *[f"t_{c}" for c in TRN2]), 4)


cte("gappy", "SELECT *, CASE WHEN day(date) BETWEEN 5 AND 20 THEN NULL ELSE close END AS g, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM px", "px")
cte("gappy2", """SELECT *, last_value(g IGNORE NULLS) OVER p AS v0, first_value(g IGNORE NULLS) OVER n AS v1, last_value(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0,
    first_value(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) OVER n AS i1 FROM gappy WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING),
    n AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "gappy")


@query("trn3_interpolate", sql("SELECT ticker, date, round(CASE WHEN g IS NOT NULL THEN g WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 4) AS filled FROM gappy2", "gappy2"))
def _(spark, d):
    g = B.bars(spark, d).withColumn("g", F.when(~F.dayofmonth("date").between(5, 20), F.col("close")))
    return rounded(T.with_interpolated(g, "g", "filled").select("ticker", "date", "filled"), 4)


cte("rvol", f"SELECT *, CASE WHEN count(log_return) {W} ROWS 29 PRECEDING) >= 15 THEN stddev_samp(log_return) {W} ROWS 29 PRECEDING) END AS rolling_vol FROM ret", "ret")
cte("regime", """SELECT *, coalesce(rolling_vol >= q, false) AS hi_vol FROM rvol JOIN (SELECT ticker, quantile_cont(rolling_vol, 0.75) AS q FROM rvol GROUP BY 1) USING (ticker)""", "rvol")


@query("trn4_volatility_regime", sql("""SELECT ticker, date, round(rolling_vol, 6) AS rolling_vol, CAST(hi_vol AS BIGINT) AS regime_high,
    CASE WHEN hi_vol THEN 'high_volatility' ELSE 'low_volatility' END AS regime FROM regime""", "regime"))
def _(spark, d):
    m = T.with_volatility_regime(G.with_returns(B.bars(spark, d)))
    return rounded(m.select("ticker", "date", "rolling_vol", "regime_high", "regime"))


def release_ctes(names, lag):
    """Release rows and transforms per macro column, as named expressions rel_<name>."""
    for n in names:
        cte(f"lg_{n}_{lag}", f"SELECT ticker, date, last_value(l IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS x FROM ("
            f"SELECT ticker, date, {f'lag({n}, {lag}) {W})' if lag else n} AS l FROM master)", "master")
        cte(f"rf_{n}_{lag}", f"SELECT *, x IS NOT NULL AND (b IS NULL OR NOT abs(x - b) <= 1e-8 + 1e-5 * abs(b)) AS rel FROM ("
            f"SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lg_{n}_{lag})", f"lg_{n}_{lag}")
        t = stat_sql(n, "x", f"lag(x) {W})", "min(x) OVER (PARTITION BY ticker) > 0")
        cte(f"rt_{n}_{lag}", f"SELECT ticker, date, {t} AS t FROM rf_{n}_{lag} WHERE rel", f"rf_{n}_{lag}")
        cte(f"rel_{n}_{lag}", f"SELECT a.ticker, a.date, last_value(t IGNORE NULLS) OVER (PARTITION BY a.ticker ORDER BY a.date ROWS UNBOUNDED PRECEDING) AS {n} "
            f"FROM lg_{n}_{lag} a LEFT JOIN rt_{n}_{lag} r ON a.ticker = r.ticker AND a.date = r.date", f"lg_{n}_{lag}", f"rt_{n}_{lag}")


release_ctes(["inflation", "energy_index"], 0)
for lag_ in (45, 60, 75, 90):
    release_ctes(MAC, lag_)


@query("trn5_release_mask", sql("SELECT ticker, date, rel AS is_release FROM rf_inflation_0", "rf_inflation_0"))
def _(spark, d):
    from ..functions.columns import series
    return master(spark, d).select("ticker", "date", T.is_release(F.col("inflation"), series("ticker")).alias("is_release"))


@query("trn6_release_transform", sql("SELECT ticker, date, round(inflation, 4) AS t_inflation, round(energy_index, 6) AS t_energy FROM rel_inflation_0 JOIN rel_energy_index_0 USING (ticker, date)", "rel_inflation_0", "rel_energy_index_0"))
def _(spark, d):
    m = T.with_release_transform(master(spark, d), "inflation", "inflation", "t_inflation")
    m = T.with_release_transform(m, "energy_index", "energy_index", "t_energy")
    return rounded(m.select("ticker", "date", "t_inflation", "t_energy"), 4, t_energy=6)


FWD = f"CASE WHEN count(log_return) {W} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) = 21 THEN sum(log_return) {W} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) END"


@query("trn7_forward_target", sql(f"SELECT ticker, date, round({FWD}, 6) AS y_return, round(ln(lead(close, 21) {W}) / close), 6) AS y_close, round(lead(d, 21) {W}) - d, 4) AS y_shift FROM (SELECT *, close - 3000 AS d FROM ret)", "ret"))
def _(spark, d):
    m = G.with_returns(B.bars(spark, d)).withColumn("shifted", F.col("close") - 3000)
    m = T.with_target(m, "log_return", 21, "y_return")
    m = T.with_target(T.with_target(m, "close", 21, "y_close"), "shifted", 21, "y_shift")
    return rounded(m.select("ticker", "date", "y_return", "y_close", "y_shift"), 6, y_shift=4)


cte("panel", "SELECT r.ticker, r.date, r.log_return, CASE WHEN min(r.close) OVER (PARTITION BY r.ticker) > 0 THEN ln(r.close / lag(r.close) OVER (PARTITION BY r.ticker ORDER BY r.date)) END AS close, "
    + ", ".join(f"m{i}.{n}" for i, n in enumerate(MAC)) + f", {FWD.replace('ticker', 'r.ticker').replace('date', 'r.date').replace('(log_return', '(r.log_return')} AS y FROM master r "
    + " ".join(f"JOIN rel_{n}_45 m{i} ON m{i}.ticker = r.ticker AND m{i}.date = r.date" for i, n in enumerate(MAC)), "master", *[f"rel_{n}_45" for n in MAC])
cte("panel_ok", "SELECT ticker, date, log_return, close, " + ", ".join(MAC) + " FROM panel WHERE log_return IS NOT NULL AND close IS NOT NULL AND " + " AND ".join(f"{n} IS NOT NULL" for n in MAC), "panel")
cte("sup", "SELECT ticker, date, y AS log_return, " + ", ".join(MAC) + " FROM panel WHERE y IS NOT NULL AND " + " AND ".join(f"{n} IS NOT NULL" for n in MAC), "panel")
for lag_ in (45, 60, 75, 90):  # the supervised frame at other publication lags
    cte(f"sup_{lag_}", f"SELECT ticker, date, CAST({lag_} AS BIGINT) AS lag, y AS log_return, " + ", ".join(MAC) + " FROM (SELECT r.ticker, r.date, " + ", ".join(f"m{i}.{n}" for i, n in enumerate(MAC))
        + f", {FWD.replace('ticker', 'r.ticker').replace('date', 'r.date').replace('(log_return', '(r.log_return')} AS y FROM master r "
        + " ".join(f"JOIN rel_{n}_{lag_} m{i} ON m{i}.ticker = r.ticker AND m{i}.date = r.date" for i, n in enumerate(MAC)) + ") WHERE y IS NOT NULL AND " + " AND ".join(f"{n} IS NOT NULL" for n in MAC),
        "master", *[f"rel_{n}_{lag_}" for n in MAC])
cte("sup_lags", " UNION ALL ".join(f"SELECT * FROM sup_{k}" for k in (45, 60, 75, 90)), *[f"sup_{k}" for k in (45, 60, 75, 90)])
PANEL = ["log_return", "close", *MAC]


def panel(spark, d):
    return T.stationary_panel(master(spark, d), PANEL)


def supervised(spark, d, features=tuple(MAC), **kw):
    return T.supervised_frame(master(spark, d), "log_return", list(features), **kw)


@query("trn9_stationary_panel", sql("SELECT ticker, date, round(log_return, 6) AS log_return, round(close, 6) AS close, " + ", ".join(f"round({n}, 4) AS {n}" for n in MAC) + " FROM panel_ok", "panel_ok"))
def _(spark, d):
    return rounded(panel(spark, d), 4, log_return=6, close=6)


@query("trn10_supervised_frame", sql("SELECT ticker, date, round(log_return, 6) AS log_return, " + ", ".join(f"round({n}, 4) AS {n}" for n in MAC) + " FROM sup", "sup"))
def _(spark, d):
    return rounded(supervised(spark, d), 4, log_return=6)


cte("betas1", " UNION ALL ".join(f"SELECT ticker, '{n}' AS feature, regr_slope(log_return, {n}) * stddev_samp({n}) AS importance FROM sup GROUP BY 1" for n in MAC)
    + " UNION ALL SELECT ticker, 'gdp_growth', stddev_samp(log_return) FROM sup GROUP BY 1", "sup")


@query("trn11_importance_by_source", sql("""SELECT ticker, source, round(v, 6) AS importance, round(v / sum(v) OVER (PARTITION BY ticker), 6) AS share FROM (
    SELECT ticker, CASE WHEN feature = 'gdp_growth' THEN 'worldbank' ELSE 'fred' END AS source, sum(abs(importance)) AS v FROM betas1 GROUP BY 1, 2)""", "betas1"))
def _(spark, d):
    s = supervised(spark, d)
    items = [F.struct(F.lit(n).alias("feature"), (F.regr_slope("log_return", n) * F.stddev_samp(n)).alias("importance")) for n in MAC]
    items.append(F.struct(F.lit("gdp_growth").alias("feature"), F.stddev_samp("log_return").alias("importance")))
    imp = s.groupBy("ticker").agg(F.array(*items).alias("a")).select("ticker", F.inline("a"))
    return rounded(T.importance_by_source(imp, keys=["ticker"]))
