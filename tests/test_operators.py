"""Operators against brute force and planted answers on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import sums as S
from strandline.operators import backtest, gold, regress, relate, risk, transforms, validate
from strandline.sources import ingest


def dates(n, start="2015-01-01"):
    return pd.bdate_range(start, periods=n).date


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(0)
    out = [pd.DataFrame({"ticker": t, "date": dates(420), "close": 100 * np.exp(np.cumsum(rng.normal(0.0003, s, 420)))}) for t, s in (("AAA", 0.01), ("BBB", 0.03))]
    pdf = pd.concat(out, ignore_index=True)
    return spark.createDataFrame(pdf), pdf


@pytest.fixture(scope="module")
def planted(spark):
    """y = 0.5 + 2 a - 3 b + noise, per ticker."""
    rng = np.random.default_rng(5)
    rows = []
    for t in ("AAA", "BBB"):
        a, b = rng.normal(size=300), rng.normal(size=300)
        rows.append(pd.DataFrame({"ticker": t, "date": dates(300), "a": a, "b": b, "c": rng.normal(size=300), "y": 0.5 + 2 * a - 3 * b + rng.normal(0, 0.1, 300)}))
    pdf = pd.concat(rows, ignore_index=True)
    return spark.createDataFrame(pdf), pdf


def test_asof_equals_merge_asof(spark):
    rng = np.random.default_rng(6)
    px = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=200), "ticker": "A"})
    mac = pd.DataFrame({"date": np.sort(rng.choice(pd.date_range("2019-12-01", periods=220), 9, replace=False)), "value": rng.normal(size=9)})
    want = pd.merge_asof(px, mac, on="date", tolerance=pd.Timedelta(days=15))["value"]
    cal = gold.asof_calendar(spark.createDataFrame(mac).select(F.to_date("date").alias("date"), "value", F.lit("s").alias("series")), 15)
    got = spark.createDataFrame(px).withColumn("date", F.to_date("date")).join(gold.widen(cal, ["s"], ages=False), "date", "left").orderBy("date").toPandas()["s"]
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_repeated_dates_keep_one_row(spark):
    s = spark.createDataFrame([("s", "2020-01-01", 1.0), ("s", "2020-01-01", 2.0), ("s", "2020-01-05", 3.0)], "series string, date string, value double").withColumn("date", F.to_date("date"))
    cal = gold.asof_calendar(s, 3)
    assert cal.groupBy("date").count().where("count > 1").count() == 0


def test_weekend_anchors_survive(spark):
    s = spark.createDataFrame([("g", "2016-12-31", 1.0), ("g", "2017-12-31", 3.0)], "series string, date string, value double").withColumn("date", F.to_date("date"))
    lin = gold.indicator_calendar(s, "linear").orderBy("date").toPandas()
    assert str(lin["date"].iloc[0]) == "2016-12-30" and lin["value"].is_monotonic_increasing and lin["value"].max() == 3.0
    assert set(gold.indicator_calendar(s, "carry").toPandas()["value"]) == {1.0, 3.0}


def test_ewm_volatility(prices):
    df, pdf = prices
    got = risk.ewm_volatility(risk.close_returns(df)).toPandas().set_index("ticker")["ewm_vol"]
    for t, g in pdf.groupby("ticker"):
        r = np.log(g["close"] / g["close"].shift(1)).dropna()
        assert got[t] == pytest.approx(r.ewm(span=30, min_periods=15).std().iloc[-1], rel=1e-9)


def test_value_without_tolerance_reaches_the_last_price(spark):
    px = spark.sql("SELECT 'A' AS ticker, explode(array(date'2000-01-03', date'2010-06-01', date'2015-01-01')) AS date, 1.0 AS close")
    slow = spark.sql("SELECT 's' AS series, date'2000-01-01' AS date, 7.0D AS value")
    assert [r["s"] for r in gold.merged_frame(px, slow, ["s"]).orderBy("date").collect()] == [7.0, 7.0, 7.0]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_later_ingested_row_of_a_date_stands(spark, parts):
    rows = [("s", "2020-01-02", 5.0, 2), ("s", "2020-01-02", 9.0, 1), ("s", "2020-01-04", 1.0, 3)]
    slow = spark.createDataFrame(rows, "series string, date string, value double, seq long").withColumn("date", F.to_date("date")).repartition(parts)
    got = {str(r["date"]): r["value"] for r in gold.asof_calendar(slow, 1, order="seq").collect()}
    assert got == {"2020-01-02": 5.0, "2020-01-03": 5.0, "2020-01-04": 1.0, "2020-01-05": 1.0}


def test_forward_target_counts_rows(prices):
    df, pdf = prices
    d = gold.with_returns(df, "close", 10.0)
    got = transforms.with_target(d, "log_return", 21, "y").orderBy("ticker", "date").toPandas()
    for _, g in got.groupby("ticker"):
        r = g["log_return"].to_numpy()
        assert g["y"].iloc[0] == pytest.approx(r[1:22].sum()) and g["y"].iloc[-21:].isna().all()


def test_panel_layers_equal_single_columns(spark, sf):
    from strandline.plans.q_gold import MAC, master
    m = master(spark, sf)
    both = transforms.with_panel_columns(m, ["close", "inflation", "energy_index"])
    w = transforms.series("ticker")
    for c in ("inflation", "energy_index"):
        both = both.withColumn("_l", F.last(c, ignorenulls=True).over(w.rowsBetween(transforms.Window.unboundedPreceding, -45)))
        both = transforms.with_release_transform(both, c, "_l", f"u_{c}").drop("_l")
    bad = both.where(~F.col("t_inflation").eqNullSafe(F.col("u_inflation")) | ~F.col("t_energy_index").eqNullSafe(F.col("u_energy_index")))
    assert bad.count() == 0 and set(MAC) <= set(m.columns)


def test_lag_scan_brute_force(planted):
    df, pdf = planted
    got = relate.lag_scan(df, "y", "a", 5).toPandas().set_index(["ticker", "lag"])["corr"]
    for t, g in pdf.groupby("ticker"):
        for k in range(6):
            assert got[t, k] == pytest.approx(g["y"].corr(g["a"].shift(k)), abs=1e-10)


def test_ols_recovers_plant(planted):
    rep = regress.ols_report(planted[0], "y", ["a", "b", "c"]).toPandas().set_index(["ticker", "factor"])
    for t in ("AAA", "BBB"):
        assert rep.loc[(t, "a"), "coef"] == pytest.approx(2, abs=0.05) and rep.loc[(t, "b"), "coef"] == pytest.approx(-3, abs=0.05)
        assert rep.loc[(t, "a"), "p_value"] < 1e-6 and abs(rep.loc[(t, "c"), "coef"]) < 0.05
        assert rep.loc[(t, "a"), "r2"] > 0.99 and rep.loc[(t, "a"), "adj_r2"] <= rep.loc[(t, "a"), "r2"]


def test_ridge_folds_brute_force(planted):
    df, pdf = planted
    got = regress.ridge_cv(df, "y", ["a", "b"], (0.5,)).toPandas().set_index(["ticker", "fold"])
    for t, g in pdf.groupby("ticker"):
        g = g.sort_values("date")
        n, k = len(g), 5
        size = n // (k + 1)
        for f in range(1, k + 1):
            end = n - k * size + (f - 1) * size
            tr, te = g.iloc[:end], g.iloc[end:end + size]
            mu, sd = tr[["a", "b"]].mean(), tr[["a", "b"]].std(ddof=0)
            x, y = ((tr[["a", "b"]] - mu) / sd).to_numpy(), tr["y"].to_numpy()
            b = np.linalg.solve(x.T @ x + 0.5 * np.eye(2), x.T @ (y - y.mean()))
            p = ((te[["a", "b"]] - mu) / sd).to_numpy() @ b + y.mean()
            r2 = 1 - ((te["y"] - p) ** 2).sum() / ((te["y"] - te["y"].mean()) ** 2).sum()
            assert got.loc[(t, f), "r2"] == pytest.approx(r2, abs=1e-8)
            assert got.loc[(t, f), "n_train"] == end


def test_subset_choice_drops_noise(planted):
    best = regress.choose_subset(planted[0], "y", ["a", "b", "c"]).where("place = 1").toPandas()
    assert all({"a", "b"} <= set(m.split("+")) for m in best["members"])


def test_vif_flags_copies(spark, planted):
    df = planted[0].withColumn("a2", F.col("a") * 1.001 + F.col("c") * 0.001)
    v = regress.inflation_factors(df, "y", ["a", "b", "a2"]).toPandas()
    assert (v["vif"] >= 0.999).all() and (v.groupby("ticker")["kept"].sum() == 2).all()


def test_ar_forecast_recovers_plant(spark):
    rng = np.random.default_rng(7)
    v = [0.0]
    for _ in range(3000):
        v.append(0.8 * v[-1] + rng.normal())
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": pd.date_range("2000-01-01", periods=len(v)).date, "v": v}))
    f = regress.ar_forecast(df, 1, 5).orderBy("step").toPandas()
    assert f["forecast"].iloc[0] == pytest.approx(0.8 * v[-1], abs=0.2)
    width = (f["upper"] - f["lower"]).to_numpy()
    assert (np.diff(width) > 0).all() and width[0] == pytest.approx(2 * 1.645, rel=0.05)


def test_stationarity_decision(spark):
    rng = np.random.default_rng(8)
    e = rng.normal(size=600)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": dates(600), "noise": e, "walk": np.cumsum(e)}))
    got = validate.stationarity(df, ["noise", "walk"]).toPandas().set_index("feature")
    assert bool(got.loc["noise", "is_stationary"]) and not bool(got.loc["walk", "is_stationary"])
    x = np.cumsum(e)
    dx = np.diff(x)
    k = 8  # min(8, max(1, 600 // 50))
    a = np.column_stack([np.ones(len(dx) - k), x[k:-1], *[dx[k - j:-j] for j in range(1, k + 1)]])
    b, *_ = np.linalg.lstsq(a, dx[k:], rcond=None)
    r = dx[k:] - a @ b
    se = math.sqrt((r @ r) / (len(r) - k - 2) * np.linalg.inv(a.T @ a)[1, 1])
    assert got.loc["walk", "adf"] == pytest.approx(b[1] / se, rel=1e-6)


def test_bootstrap_band_has_width(planted):
    p = planted[0].select("ticker", "date", F.col("y").alias("actual"), (F.col("a") * 2).alias("predicted"))
    for r in validate.bootstrap_band(p, 100).collect():
        assert r["low"] < r["point"] < r["high"] <= 1 and r["std"] > 0


def test_walk_forward_uses_only_the_past(planted):
    w = validate.with_windows(planted[0], 3, 120, 30).groupBy("ticker", "window").agg(F.min("date").alias("a"), F.max("date").alias("b")).toPandas()
    for _, g in w.groupby("ticker"):
        g = g.sort_values("window")
        assert (g["a"].iloc[1:].to_numpy() > g["b"].iloc[:-1].to_numpy()).all()
    s = validate.walk_forward(planted[0], "y", ["a", "b"], 3, 120, 30).toPandas()
    assert (s["r2"] > 0.99).all() and (s["n_train"] >= 120).all()


def brute_strategy(pdf, w=20, th=1.0, R=backtest.Rules()):
    """Row-by-row statement of the rules."""
    px = pdf["close"].to_numpy(float)
    n = len(px)
    r = np.clip(np.log(px[1:] / px[:-1]), -0.15, 0.15)
    r = np.concatenate([[np.nan], r])
    s = pd.Series
    z = ((s(px) - s(px).rolling(w).mean()) / s(px).rolling(w).std()).to_numpy()
    vol = s(r).rolling(14).std().to_numpy()
    vma = s(vol).rolling(20).mean().to_numpy()
    sma = s(px).rolling(200).mean().to_numpy()
    raw = np.zeros(n)
    for i in range(n):
        if not (vol[i] > vma[i]):
            continue
        up = bool(px[i] > sma[i])
        raw[i] = 1.0 if z[i] < -th and up else -1.0 if z[i] > th and not up else 0.0
    size = [1.0 if i == 0 or np.isnan(vol[i - 1]) else min(R.vol_target / (vol[i - 1] * math.sqrt(252)), 1.0) for i in range(n)]
    sig = np.array([np.nan] + [raw[i - 1] * size[i] for i in range(1, n)])

    def ret(sig):
        ch = np.concatenate([[False], np.abs(np.diff(np.sign(sig))) > 0.5])
        return sig * r - ch * R.friction

    x = ret(sig)
    cum = np.nancumsum(x)
    cum[np.isnan(x)] = np.nan
    dd = cum - s(cum).cummax().to_numpy()
    sig = np.array([0.0 if i and dd[i - 1] < -R.portfolio_stop else sig[i] for i in range(n)])
    held, h = np.zeros(n), 0
    for i in range(n):
        h = h + 1 if abs(sig[i]) > 1e-10 else 0
        held[i] = h
    sig = np.array([0.0 if i and held[i - 1] >= R.max_hold else sig[i] for i in range(n)])
    x = ret(sig)
    hit, pnl, lim, live = np.zeros(n, bool), 0.0, 0.0, False
    for i in range(n):
        if abs(sig[i]) > 1e-10:
            if not live:
                v = vol[i - 1]
                pnl, lim = 0.0, min(R.trade_stop_multiple * (v if v > 0 else 0.02), R.trade_stop_cap)
            live = True
            pnl += x[i]
            hit[i] = pnl < -lim
        else:
            live = False
    sig = np.array([0.0 if i and hit[i - 1] else sig[i] for i in range(n)])
    return pd.DataFrame({"date": pdf["date"].to_numpy(), "signal": sig, "ret": ret(sig), "ok": ~np.isnan(ret(sig)) & ~np.isnan(z)})


def test_strategy_equals_row_loop(spark):
    rng = np.random.default_rng(11)
    r = rng.normal(0.001, 0.02, 900)
    r[300:420] -= 0.02
    r[500:520] += 0.04
    pdf = pd.DataFrame({"ticker": "A", "date": dates(900), "close": 50 * np.exp(np.cumsum(r))})
    got, _ = backtest.run(spark.createDataFrame(pdf), (20,), (1.0,))
    got = got.orderBy("date").toPandas()
    want = brute_strategy(pdf)
    want = want[want["ok"]].reset_index(drop=True)
    assert len(got) == len(want) and (np.abs(want["signal"]) > 0).sum() > 20
    np.testing.assert_allclose(got["signal"], want["signal"], atol=1e-12)
    np.testing.assert_allclose(got["ret"], want["ret"], atol=1e-12)


def test_drawdown_starts_at_first_value(spark):
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": dates(3), "ret": [-0.5, 0.1, -0.2]}))
    dd = backtest.with_curve(df, ["ticker"]).orderBy("date").toPandas()["dd"]
    np.testing.assert_allclose(dd, [0, 0, math.exp(-0.2) - 1], atol=1e-12)


def test_cleaning_stream_retry_leaves_no_copies(spark, sf, tmp_path):
    from strandline.sources import bindings
    from strandline.streaming import cleaning
    ops = bindings.operations(spark, sf)
    for _ in range(2):
        cleaning.process_batch(ops, 0, str(tmp_path), cleaning.default_rules())
    assert spark.read.parquet(f"{tmp_path}/good").count() + spark.read.parquet(f"{tmp_path}/dead").count() == ops.count()


def test_stream_windows_agree_with_batch(spark, sf, tmp_path):
    from strandline.sources import bindings
    from strandline.streaming import levels
    levels.run_to_table(levels.rolling_levels(levels.event_stream(spark, f"{sf}/events*.parquet")), f"{tmp_path}/o", f"{tmp_path}/c")
    got = levels.current_levels(spark, f"{tmp_path}/o")
    batch = levels.rolling_levels(bindings.operations(spark, sf))
    key = ["from_ts", "to_ts", "operation", "events"]
    assert got.count() == batch.count() and got.select(key).exceptAll(batch.select(key)).count() == 0


def test_fingerprint_ignores_row_order(spark, prices):
    df = prices[0]
    a = ingest.fingerprint(df, ["ticker"]).orderBy("ticker").collect()
    b = ingest.fingerprint(df.orderBy(F.desc("close")).repartition(5), ["ticker"]).orderBy("ticker").collect()
    c = ingest.fingerprint(df.withColumn("close", F.col("close") + 1), ["ticker"]).orderBy("ticker").collect()
    assert a == b and a != c


def test_solver_matrix_round_trip():
    rng = np.random.default_rng(9)
    z = np.column_stack([np.ones(20), rng.normal(size=(20, 3))])
    g = z.T @ z
    np.testing.assert_allclose(S.matrix(g[np.triu_indices(4)]), g)
    assert S.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_worker_functions_travel_without_the_package(tmp_path):
    """Executors hold no copy of the package: a pickled worker function must load without it."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    blob = tmp_path / "f.pkl"
    blob.write_bytes(cloudpickle.dumps([relate._pair_block, S.ridge, S.ols]))
    code = f"import pickle, sys; fs = pickle.load(open({str(blob)!r}, 'rb')); assert len(fs) == 3 and 'strandline' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60, env={"PATH": "/usr/bin:/bin"})
