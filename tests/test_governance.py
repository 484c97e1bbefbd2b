"""Unit roots, bootstrap bands, imputed walk-forward windows and the gate against plain Python and planted tickers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from strandline.functions.columns import values_table
from strandline.operators import tournament as M
from strandline.operators import validate as V


def frame_of(spark, series, names):
    rows = [(t, str(np.datetime64("2000-01-01") + i), *[None if v is None or v != v else float(v) for v in r]) for t, m in series.items() for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "ticker string, date string, " + ", ".join(f"{n} double" for n in names)).withColumn("date", F.to_date("date"))


def roots_by_hand(x):
    n = len(x)
    k = min(8, max(1, n // 50))
    e = x - x.mean()
    s = np.cumsum(e)
    long_run = (e @ e + 2 * sum((1 - j / (k + 1)) * (e[j:] @ e[:-j]) for j in range(1, k + 1))) / n
    d = np.diff(x)
    rows = np.arange(k, len(d))
    z = np.column_stack([np.ones(len(rows)), x[rows], *[d[rows - j] for j in range(1, k + 1)]])
    b, *_ = np.linalg.lstsq(z, d[rows], rcond=None)
    r = d[rows] - z @ b
    se = np.sqrt(r @ r / (len(rows) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
    return k, s @ s / n ** 2 / long_run, b[1] / se


def test_unit_roots_match_a_direct_regression(spark):
    rng = np.random.default_rng(1)
    series = {n: np.cumsum(rng.standard_normal(n)) if n % 2 else rng.standard_normal(n) + 100 for n in (21, 60, 130, 333, 500)}
    rows = [(str(n), "x", i, float(v)) for n, x in series.items() for i, v in enumerate(x)] + [("flat", "x", i, 2.0) for i in range(40)] + [("short", "x", 0, 1.0), ("short", "x", 1, None)]
    levels = spark.createDataFrame(rows, "ticker string, feature string, date int, x double")
    got = {r.ticker: r for r in V.unit_roots(levels).collect()}
    for n, x in series.items():
        k, kpss, adf = roots_by_hand(x)
        r = got[str(n)]
        assert (r.n, r.lags) == (n, k) and math.isclose(r.kpss, kpss, rel_tol=1e-8) and math.isclose(r.adf, adf, rel_tol=1e-6)
    assert got["flat"].kpss is None and got["short"].adf is None
    wide = frame_of(spark, {"A": np.column_stack([series[500], np.cumsum(rng.standard_normal(500))])}, ["noise", "walk"])
    told = {r.feature: r.is_stationary for r in V.stationarity(wide, ["noise", "walk"]).collect()}
    assert told == {"noise": True, "walk": False}


def test_bootstrap_matches_resampled_rows(spark):
    rng = np.random.default_rng(2)
    series = {}
    for t, n in (("A", 57), ("B", 5), ("C", 4), ("D", 200)):
        y = rng.standard_normal(n)
        series[t] = np.column_stack([y, 0.6 * y + 0.3 * rng.standard_normal(n)])
    got = {r.ticker: r for r in V.bootstrap_band(frame_of(spark, series, ["actual", "predicted"]), 60, 0.9, 7).collect()}
    assert set(got) == {"A", "B", "D"}
    for t in got:
        y, p = series[t].T
        n = len(y)
        b = max(2, int(math.sqrt(n)))
        r2 = []
        for draw in range(1, 61):
            pick = []
            for block in range(-(-n // b)):
                u = int(hashlib.md5(f"7|{t}|{draw}|{block}".encode()).hexdigest()[:8], 16) / 2 ** 32
                pick += [(int(u * n) + i) % n for i in range(min(b, n - block * b))]
            k = np.array(pick)
            assert len(k) == n
            if np.var(y[k]) > 1e-12:
                r2.append(np.clip(1 - np.mean((y[k] - p[k]) ** 2) / np.var(y[k]), -10, 1))
        r = got[t]
        want = (1 - np.sum((y - p) ** 2) / (np.var(y) * n), *np.percentile(r2, [5, 95]), np.mean(r2), np.std(r2))
        assert r.draws == len(r2) and np.allclose((r.point, r.low, r.high, r.mean, r.std), want)


def test_windows_are_imputed_by_their_own_train_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((180, 2))
    y = x @ [1.0, -2.0] + 0.1 * rng.standard_normal(180)
    x[rng.random((180, 2)) < 0.3] = np.nan
    x[:40, 1] = np.nan  # not known at all in the first window
    frame = frame_of(spark, {"A": np.column_stack([x, y])}, ["a", "b", "y"])
    windowed = V.with_windows(frame, 3)
    rows = sorted((r.date, r.window, r.a, r.b, r.y) for r in windowed.collect())
    got = {r.window: r for r in M.walk_forward_chosen(windowed, "y", ["a", "b"], 3, choose=False).collect()}
    picked = {r.window: r for r in M.walk_forward_chosen(windowed, "y", ["a", "b"], 3).collect()}
    assert set(got) == set(picked) == {1, 2, 3}
    for w in got:
        train, test = ([np.array([math.nan if v is None else v for v in r[2:4]]) for r in rows if c(r[1])] for c in (lambda k: k < w, lambda k: k == w))
        yt, ye = (np.array([r[4] for r in rows if c(r[1])]) for c in (lambda k: k < w, lambda k: k == w))
        train, test = np.array(train), np.array(test)
        with np.errstate(all="ignore"):
            middle = np.array([np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else 0.0 for v in train.T])
        train, test = (np.where(np.isnan(m), middle, m) for m in (train, test))
        b, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(train)), train]), yt, rcond=None)
        e = ye - np.column_stack([np.ones(len(test)), test]) @ b
        assert got[w].n_train == len(yt) and math.isclose(got[w].r2, 1 - e @ e / (np.var(ye) * len(ye)), rel_tol=1e-6)
        assert (picked[w].cv_r2 is None) == (len(yt) < 50) and (picked[w].cv_r2 is not None or picked[w].model == "Linear")


def test_a_leaking_ticker_is_blocked_and_a_sound_one_passes(spark):
    rng = np.random.default_rng(4)
    n = 400
    series = {}
    y = rng.standard_normal(n)
    series["LEAK"] = np.column_stack([2 * y, np.r_[0.0, y[:-1]], y])  # the target itself, and a factor whose next value is the target
    a = rng.standard_normal((n, 2))
    series["SOUND"] = np.column_stack([a, a @ [0.8, 0.6] + 0.3 * rng.standard_normal(n)])
    series["SHIFT"] = np.column_stack([a, a @ [0.1, 0.1] + 0.1 * rng.standard_normal(n) + np.where(np.arange(n) > 330, 9.0, 0.0)])
    frame = frame_of(spark, series, ["a", "b", "y"])
    lags = values_table(spark, ("ticker", "max_lag"), [("LEAK", 45), ("SOUND", 45), ("SHIFT", 90)])
    report = V.governance_report(frame, "y", ["a", "b"], lags, draws=40)
    got = {r.ticker: r for r in V.gate(report, V.policy_for(report), hard_fail=True).collect()}
    assert "leakage_flags_above_limit" in got["LEAK"].blocking and not got["LEAK"].passed
    assert got["SOUND"].passed and got["SOUND"].severity == "pass" and got["SOUND"].blocking == []
    assert "mean_shift_above_limit" in got["SHIFT"].blocking and "publication_lag_exceeds_policy" in got["SHIFT"].advisory and not got["SHIFT"].passed
    assert got["LEAK"].risk_score > got["SOUND"].risk_score
