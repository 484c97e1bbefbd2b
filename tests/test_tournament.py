"""Forests, penalised fits and tournaments against brute force, closed forms and Spark ML."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from strandline.functions import forest
from strandline.functions.quantiles import expanding_quantiles
from strandline.operators import tournament as M


def best_by_hand(x, y, w, leaf):
    """(gain, feature, rows on the left) over all cuts of the rows in the bag."""
    here = np.flatnonzero(w > 0)
    loss = lambda k: (w[k] * (y[k] - np.average(y[k], weights=w[k])) ** 2).sum()
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for v in np.unique(x[here, j])[:-1]:
            a, b = here[x[here, j] <= v], here[x[here, j] > v]
            if min(len(a), len(b)) >= leaf and loss(here) - loss(a) - loss(b) > best[0] + 1e-9:
                best = (loss(here) - loss(a) - loss(b), j, set(np.flatnonzero(x[:, j] <= v)))
    return best


@pytest.mark.parametrize("leaf", [1, 3])
def test_cuts_match_brute_force(leaf):
    rng = np.random.default_rng(leaf)
    for _ in range(20):
        n = int(rng.integers(2, 25))
        x, y = rng.integers(0, 6, (n, 3)).astype(float), rng.standard_normal(n)
        w = rng.poisson(1, n).astype(float)
        if w.sum() == 0:
            continue
        bag = np.flatnonzero(w > 0)
        bins = forest.binned(x, w > 0)
        gain, feature, cut = forest.best_cuts(np.zeros(len(bag), int), bag, w[bag], y[bag], bins, 1, leaf)
        want = best_by_hand(x, y, w, leaf)
        assert np.isclose(gain[0], want[0])
        if want[1] is not None:
            assert set(np.flatnonzero(bins[:, feature[0]] <= cut[0])) & set(bag) == want[2] & set(bag)


def grow_by_hand(x, y, w, leaf, depth):
    """Values of all rows of one tree, by recursion."""
    out = np.empty(len(y))

    def go(rows, left):
        bag = rows[w[rows] > 0]
        out[rows] = np.average(y[bag], weights=w[bag])
        if not left:
            return
        at = np.zeros(len(y))
        at[bag] = w[bag]
        gain, j, _ = best_by_hand(x, y, at, leaf)
        if j is None:
            return
        values = np.unique(x[bag, j])
        losses = {}
        for v in values[:-1]:
            a, b = bag[x[bag, j] <= v], bag[x[bag, j] > v]
            if min(len(a), len(b)) >= leaf:
                losses[v] = sum((w[k] * (y[k] - np.average(y[k], weights=w[k])) ** 2).sum() for k in (a, b))
        v = min(losses, key=losses.get)
        go(rows[x[rows, j] <= v], left - 1)
        go(rows[x[rows, j] > v], left - 1)

    go(np.arange(len(y)), depth)
    return out


def test_shallow_trees_are_levels_of_deep_ones():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 30, (80, 3)).astype(float), rng.standard_normal(80)
    w = forest.bags(range(4), 80, 7)
    w[:, 70:] = 0  # rows to be predicted
    bins = forest.binned(x, np.ones(80, bool))
    values, shares = forest.grow(bins, y, w, 2, (1, 3, 64))
    for d, got in zip((1, 3, 64), values):
        assert np.allclose(got, sum(grow_by_hand(x, y, w[t], 2, d) for t in range(4)))
    assert np.allclose(shares.sum(axis=1), 4)
    one, _ = forest.grow(bins, y, w[2:3], 2, (64,))
    rest, _ = forest.grow(bins, y, w[[0, 1, 3]], 2, (64,))
    assert np.allclose(one + rest, values[2:])
    flat, none = forest.grow(bins, np.ones(80), w, 2, (3, 64))
    assert np.allclose(flat, 4) and not none.any()


def test_boosting_and_bins():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 2))
    y = np.where(x[:, 0] > 0.5, 3.0, 0.0) + x[:, 1]
    train = np.arange(3000) < 2000
    bins = forest.binned(x, train)
    assert bins.max() < forest.BINS and (np.argsort(bins[:, 0], kind="stable").shape == (3000,))
    value, shares = forest.boost(bins, y, train, 100, 0.1, 3)
    assert 1 - ((y - value)[~train] ** 2).sum() / (y[~train].var() * 1000) > 0.95 and np.isclose(shares.sum(), 1) and shares[0] > 0.3


def sums_of(x, y):
    z = np.column_stack([np.ones(len(y)), x, y])
    return z.T @ z


def test_descent_matches_closed_form_and_spark(spark):
    rng = np.random.default_rng(2)
    n = 400
    q = np.linalg.qr(rng.standard_normal((n, 4)) - 0)[0]
    x = q - q.mean(axis=0)
    x = np.linalg.qr(x)[0] * np.sqrt(n)  # orthogonal and centred: the solution is soft thresholding
    x -= x.mean(axis=0)
    y = x @ [0.5, -0.05, 0.2, 0.0] + 0.1 * rng.standard_normal(n)
    c = (x / x.std(axis=0)).T @ (y - y.mean()) / n
    fits = M.linear_fits(sums_of(x, y), [("Lasso", {"alpha": 0.1}), ("ElasticNet", {"alpha": 0.1, "l1_ratio": 0.5})])
    soft = lambda t: np.sign(c) * np.maximum(np.abs(c) - t, 0)
    assert np.allclose(fits[0][1] * x.std(axis=0), soft(0.1), atol=1e-8) and np.allclose(fits[1][1] * x.std(axis=0), soft(0.05) / 1.05, atol=1e-8)
    x[:, 3] += 0.9 * x[:, 0] + 5
    settings = M.linear_settings()
    fits = M.linear_fits(sums_of(x, y), settings)
    data = VectorAssembler(inputCols=list("abcd"), outputCol="f").transform(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double"))
    # Spark scales by the sample deviation and divides the quadratic penalty by that of the label
    for i in (0, 6, 8, 14):
        family, p = settings[i]
        a, share = p.get("alpha", 0.0), p.get("l1_ratio", 1.0)
        one, two = a * share, a * (1 - share) * y.std(ddof=1)
        reg = one + two
        model = LinearRegression(featuresCol="f", labelCol="y", regParam=reg, elasticNetParam=one / reg if reg else 0.0, maxIter=5000, tol=1e-12).fit(data)
        assert np.allclose(model.coefficients.toArray(), fits[i][1], rtol=2e-2, atol=2e-3), settings[i]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    ridge = np.linalg.solve(z.T @ z + 10 * np.eye(4), z.T @ (y - y.mean())) / x.std(axis=0)
    assert np.allclose(fits[4][1], ridge)
    flat = M.linear_fits(sums_of(np.column_stack([x[:, 0], np.full(n, 7.0)]), y), settings)
    assert all(f[1][1] == 0 for f in flat)


def series_frame(spark, n=200, tickers=("A", "B", "C")):
    rng = np.random.default_rng(6)
    rows = []
    for t in tickers:
        x = rng.standard_normal((n, 2))
        y = {"A": np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.05 * rng.standard_normal(n), "B": x @ [0.4, -0.7] + 0.01 * rng.standard_normal(n), "C": rng.standard_normal(n)}[t]
        rows += [(t, str(np.datetime64("2000-01-01") + i), float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "ticker string, date string, a double, b double, y double").withColumn("date", F.to_date("date"))


def test_tournament_finds_planted_models(spark):
    assert Counter(m for m, _ in M.linear_settings() + M.forest_settings()) == {"Linear": 1, "Ridge": 4, "Lasso": 4, "ElasticNet": 9, "RandomForest": 18}
    frame = series_frame(spark)
    scores, fits, values = M.tournament(frame, "y", ["a", "b"])
    got = scores.collect()
    assert len(got) == 3 * 36 * 3  # tickers, settings, folds of 200 rows
    best = {r.ticker: r.model for r in got if r.best}
    assert best["A"] == "RandomForest" and best["B"] in ("Linear", "Ridge", "Lasso", "ElasticNet")
    assert all(len({r.variant for r in got if r.ticker == t and r.model == m and r.winner}) == 1 for t in "ABC" for m in ("Linear", "Ridge", "Lasso", "ElasticNet", "RandomForest"))
    again = {(r.ticker, r.variant, r.fold): r.r2 for r in M.tournament(frame.repartition(3), "y", ["a", "b"])[0].collect()}
    assert all(np.isclose(again[r.ticker, r.variant, r.fold], r.r2) for r in got)
    lines = M.refit(scores, fits, values, frame, "y", ["a", "b"]).collect()
    a = {r.factor: r for r in lines if r.ticker == "A"}
    assert np.isclose(a["a"].importance + a["b"].importance, 1) and a["a"].importance > 0.9 and a["a"].r2 > 0.98 and a["a"].n_obs == 200
    b = {r.factor: r for r in lines if r.ticker == "B"}
    assert np.allclose([b["a"].coef, b["b"].coef], [0.4, -0.7], atol=0.05) and b["a"].r2 > 0.99 and b["a"].mae < 0.05


def test_holdout_models_see_train_rows_only(spark):
    frame = series_frame(spark)
    models, predictions = M.holdout_models(frame, "y", ["a", "b"])
    rows, told = models.collect(), predictions.collect()
    assert len(rows) == 3 * 4 * 2 and Counter(r.ticker for r in told) == {"A": 40, "B": 40, "C": 40}
    assert all(np.isclose(sum(r.importance for r in rows if (r.ticker, r.model) == k), 1) or k[1] == "ElasticNet" for k in {(r.ticker, r.model) for r in rows})
    best = {r.ticker: (r.model, r.holdout_r2) for r in rows if r.best}
    assert best["A"][0] in ("RandomForest", "GradientBoosting") and best["A"][1] > 0.9 and best["B"][0] in ("Ridge", "ElasticNet")
    # other values in the holdout change nothing that was fitted: the same predictions for the same factors
    w = F.row_number().over(M.Window.partitionBy("ticker").orderBy("date"))
    bent = frame.withColumn("y", F.when(w > 160, F.col("y") * 50 + 3).otherwise(F.col("y")))
    other = {(r.ticker, r.date): r.prediction for r in M.holdout_models(bent, "y", ["a", "b"])[1].collect()}
    assert all(np.isclose(other[r.ticker, r.date], r.prediction) for r in told)


def test_expanding_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(t, int(rng.integers(0, 5)), float(rng.integers(0, 9)) if rng.random() > 0.1 else None, float(rng.standard_normal())) for t in "AB" for _ in range(150)]
    rows += [("C", 2, 1.0, None)]
    got = {(r.ticker, r.b, r.feature): (r.n, r.q) for r in expanding_quantiles(spark.createDataFrame(rows, "ticker string, b int, x double, z double"), ["ticker"], "b", 5, ["x", "z"], (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for t in "ABC":
        for b in range(1, 6):
            for j, f in ((2, "x"), (3, "z")):
                v = [r[j] for r in rows if r[0] == t and r[1] < b and r[j] is not None]
                assert (t, b, f) in got if v else (t, b, f) not in got
                if v:
                    assert got[t, b, f][0] == len(v) and np.allclose(got[t, b, f][1], np.quantile(v, [0, 0.25, 0.5, 0.9, 1]))
