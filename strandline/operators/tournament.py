"""Model tournaments of every ticker at once (REG-11, REG-17).

Linear families cost one pass: sums of products by (ticker, fold) give every train and test side, penalised fits are coordinate descent
on those sums (covariance updates, warm starts along falling penalties), and scores are read from the sums of the test side.

Forests are dealt as (ticker, block of trees): each task grows its trees of every fold and leaf size on one series, and the values of
test rows are added up over blocks by Spark. A forest of 200 unlimited trees holds the shallower ones as its upper levels and the forest of 100 trees as half of its
blocks, so the 18 forest settings of a fold are three forests.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forest
from ..functions import sums as S
from ..functions.columns import finite, values_table
from ..functions.quantiles import by_feature, expanding_quantiles
from ..functions.stage import stage
from ..functions.sums import centred, matrix, score  # by name: workers get these functions, not the module with its session's objects
from .regress import RIDGE_GRID, with_folds

DEPTHS, LEAVES, TREES, BLOCK, SEED = (3, 5, 64), (2, 4, 8), 200, 25, 42  # no series is deep enough to reach 64 levels of halves
ALL = -1  # the fold that trains and scores on every row


def linear_settings() -> list[tuple[str, dict]]:
    """Families and grids of the tournament, in the order in which ties are settled."""
    return [("Linear", {}), *(("Ridge", {"alpha": a}) for a in RIDGE_GRID), *(("Lasso", {"alpha": a}) for a in (1e-3, 1e-2, 5e-2, 1e-1)),
            *(("ElasticNet", {"alpha": a, "l1_ratio": r}) for a in (1e-3, 1e-2, 1e-1) for r in (0.2, 0.5, 0.8))]


def forest_settings() -> list[tuple[str, dict]]:
    """18 forests; a depth of 64 stands for no limit."""
    return [("RandomForest", {"trees": t, "depth": d, "leaf": m}) for t in (100, TREES) for d in DEPTHS for m in LEAVES]


def described(p: dict) -> str:
    return ",".join(f"{k}={'none' if k == 'depth' and v == DEPTHS[-1] else v}" for k, v in p.items())


# --- linear families ---------------------------------------------------------------------------------
def descent(q: np.ndarray, c: np.ndarray, one: float, two: float, start: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Minimiser of w'Qw / 2 - c'w + one |w| + two |w|^2 / 2 by cyclic coordinate descent."""
    w = start.copy()
    live = np.flatnonzero(np.diag(q) > 0)
    scale = max(float(np.abs(c).max(initial=0)), 1e-300)
    for _ in range(20_000):
        moved = 0.0
        for j in live:
            r = c[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - one, 0.0) / (q[j, j] + two) + 0.0
            moved, w[j] = max(moved, abs(new - w[j]) * q[j, j]), new
        if moved <= tolerance * scale:
            break
    return w


def linear_fits(m: np.ndarray, settings: Sequence[tuple[str, dict]], spread: np.ndarray | None = None) -> list[tuple[float, np.ndarray]]:
    """(intercept, coefficients) of each setting from the sums of the train rows. Penalties act on factors divided by `spread`, by default
    their standard deviation: |y - xw|^2 + a |w|^2 for ridge, |y - xw|^2 / 2n + a l |w|_1 + a (1 - l) |w|^2 / 2 for the others."""
    n, mean, c = centred(m)
    sd = np.sqrt(np.maximum(np.diag(c)[:-1] / n, 0.0)) if spread is None else np.asarray(spread, float)
    sd = np.where(sd > 0, sd, 1.0)
    flat = np.diag(c)[:-1] <= 1e-12 * (np.diag(c)[:-1] + n * mean[:-1] ** 2)  # a constant factor takes no part
    q, cy = c[:-1, :-1] / np.outer(sd, sd) / n, c[:-1, -1] / sd / n
    q[flat], q[:, flat], cy[flat] = 0.0, 0.0, 0.0
    out: dict[int, np.ndarray] = {}
    warm: dict[float, np.ndarray] = {}
    for i, (family, p) in sorted(enumerate(settings), key=lambda s: -s[1][1].get("alpha", 0.0)):
        if family in ("Linear", "Ridge"):
            out[i] = np.linalg.lstsq(q + p.get("alpha", 0.0) / n * np.diag((~flat).astype(float)), cy, rcond=None)[0]
        else:
            share = p.get("l1_ratio", 1.0)
            out[i] = warm[share] = descent(q, cy, p["alpha"] * share, p["alpha"] * (1 - share), warm.get(share, np.zeros(len(cy))))
    b = [out[i] / sd for i in range(len(settings))]
    return [(float(mean[-1] - mean[:-1] @ w), w) for w in b]


def linear_udf(settings: Sequence[tuple[str, dict]], scaled: bool = False):
    """scaled: the third argument holds the unit of each factor in which penalties act."""
    fields = "array<struct<variant:int,r2:double,rmse:double,n_train:long,n_test:long,intercept:double,coef:array<double>>>"

    def fitted(train, test, units):
        out = []
        for a, b, u in zip(train, test, units):
            ma, mb = matrix(a), matrix(b)
            rows = []
            for i, (b0, w) in enumerate(linear_fits(ma, settings, u)):
                r2, rmse = score(mb, b0, w)
                rows.append({"variant": i, "r2": r2, "rmse": rmse, "n_train": int(ma[0, 0]), "n_test": int(mb[0, 0]), "intercept": b0, "coef": w.tolist()})
            out.append(rows)
        return pd.Series(out)

    if scaled:
        @F.pandas_udf(fields)
        def run(train: pd.Series, test: pd.Series, units: pd.Series) -> pd.Series:
            return fitted(train, test, units)
    else:
        @F.pandas_udf(fields)
        def run(train: pd.Series, test: pd.Series) -> pd.Series:
            return fitted(train, test, [None] * len(train))

    return run


def linear_scores(folded: DataFrame, y: str, xs: Sequence[str], settings: Sequence[tuple[str, dict]]) -> DataFrame:
    """(ticker, fold, variant, r2, rmse, n_train, n_test, intercept, coef); fold ALL is fitted to and scored on every row."""
    e = S.expanding_sums(folded, ["ticker"], "fold", xs, y).select("ticker", "fold", "train", "test")
    whole = S.block_sums(folded, ["ticker"], xs, y).select("ticker", F.lit(ALL).cast("long").alias("fold"), F.col("sums").alias("train"), F.col("sums").alias("test"))
    return e.unionByName(whole).select("ticker", "fold", F.inline(linear_udf(settings)("train", "test")))


# --- forests -----------------------------------------------------------------------------------------
def forest_values(folded: DataFrame, y: str, xs: Sequence[str], trees: int = TREES, leaves: Sequence[int] = LEAVES, depths: Sequence[int] = DEPTHS,
                  block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(ticker, block, fold, date, leaf, y, sums by depth, shares by depth and factor) for test rows of every fold and, in fold ALL, for every row.

    `shares` is set on the first row of a fold. A group is one series and one block of trees.
    """
    blocks = -(-trees // block)
    dealt = folded.select("ticker", "date", "fold", F.col(y).cast("double").alias("y"), F.array(*[F.col(x).cast("double") for x in xs]).alias("x"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    leaves, depths = tuple(leaves), tuple(depths)

    def run(key, d):
        d = d.sort_values("date")
        x, target, fold = np.array(d["x"].tolist(), float).reshape(len(d), -1), d["y"].to_numpy(float), d["fold"].to_numpy()
        mine = range(key[1] * block, min((key[1] + 1) * block, trees))
        parts = []
        for k in [ALL, *sorted(f for f in set(fold.tolist()) if f > 0)]:
            train, test = (np.ones(len(d), bool),) * 2 if k == ALL else (fold < k, fold == k)
            seen = train | test
            if not train.any():
                continue
            bins = forest.binned(x[seen], train[seen])
            weights = forest.bags(mine, int(seen.sum()), seed) * train[seen]
            weights[weights.sum(axis=1) == 0] = train[seen]
            for leaf in leaves:
                values, shares = forest.grow(bins, target[seen], weights, leaf, depths)
                at = test[seen]
                part = pd.DataFrame({"date": d["date"][test], "y": target[test], "sums": list(values[:, at].T)})
                part["shares"] = [shares.tolist()] + [None] * (len(part) - 1)
                parts.append(part.assign(fold=k, leaf=leaf))
        return pd.concat(parts).assign(ticker=key[0], block=key[1])[["ticker", "block", "fold", "date", "leaf", "y", "sums", "shares"]]

    return dealt.groupBy("ticker", "block").applyInPandas(run, "ticker string, block int, fold long, date date, leaf int, y double, sums array<double>, shares array<array<double>>")


def forest_predictions(values: DataFrame, trees: int, depth: int, block: int = BLOCK, depths: Sequence[int] = DEPTHS) -> DataFrame:
    """(ticker, fold, leaf, date, y, predicted) of the forest of the first `trees` trees."""
    used = values.where(F.col("block") < trees // block)
    return used.groupBy("ticker", "fold", "leaf", "date").agg(F.first("y").alias("y"), (F.sum(F.col("sums")[list(depths).index(depth)]) / trees).alias("predicted"))


def fit_quality(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, r2, mae, n_test)."""
    e = F.col("y") - F.col("predicted")
    return predicted.groupBy(*keys).agg(finite(1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("*"))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n_test"))


def forest_scores(values: DataFrame, first: int, settings: Sequence[tuple[str, dict]]) -> DataFrame:
    """(ticker, fold, variant, r2, n_test): all settings from one pass over the rows; variants are numbered from `first`."""
    pairs = sorted({(p["trees"], p["depth"]) for _, p in settings})
    sums = [F.sum(F.when(F.col("block") < t // BLOCK, F.col("sums")[DEPTHS.index(d)])) / t for t, d in pairs]
    rows = values.groupBy("ticker", "fold", "leaf", "date").agg(F.first("y").alias("y"), F.array(*sums).alias("p"))
    e = [F.col("y") - F.col("p")[i] for i in range(len(pairs))]
    r2 = [finite(1 - F.try_divide(F.sum(x * x), F.var_pop("y") * F.count("*"))) for x in e]
    got = rows.groupBy("ticker", "fold", "leaf").agg(F.count("*").alias("n_test"), F.array(*[F.struct(F.lit(t).alias("trees"), F.lit(d).alias("depth"), c.alias("r2")) for (t, d), c in zip(pairs, r2)]).alias("s"))
    numbered = values_table(values.sparkSession, ("trees", "depth", "leaf", "variant"), [(p["trees"], p["depth"], p["leaf"], first + i) for i, (_, p) in enumerate(settings)])
    return got.select("ticker", "fold", "leaf", "n_test", F.inline("s")).join(F.broadcast(numbered), ["trees", "depth", "leaf"]).select("ticker", "fold", F.col("variant").cast("int").alias("variant"), "r2", "n_test")


# --- REG-11 ------------------------------------------------------------------------------------------
def placed(scores: DataFrame, settings: Sequence[tuple[str, dict]]) -> DataFrame:
    """Scores of folds with model, params, mean_r2, winner (of its family) and best (of the ticker); earlier settings win ties."""
    named = values_table(scores.sparkSession, ("variant", "model", "params"), [(i, m, described(p)) for i, (m, p) in enumerate(settings)])
    t = scores.where(F.col("fold") > 0).join(F.broadcast(named.withColumn("variant", F.col("variant").cast("int"))), "variant")
    t = t.withColumn("mean_r2", F.avg(finite("r2")).over(Window.partitionBy("ticker", "variant")))
    order = F.struct(F.coalesce(F.round(-F.col("mean_r2"), 12), F.lit(float("inf"))).alias("r"), "variant")  # equal but for rounding is a tie
    return t.withColumn("winner", F.col("variant") == F.min_by("variant", order).over(Window.partitionBy("ticker", "model"))).withColumn(
        "best", F.col("variant") == F.min_by("variant", order).over(Window.partitionBy("ticker")))


def tournament(frame: DataFrame, y: str, xs: Sequence[str], forests: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(scores of every ticker, setting and fold; linear fits; forest values). Folds: k = clamp(n // 60, 2, 5), expanding in time."""
    folded = stage(with_folds(frame.select("ticker", "date", y, *xs)))
    linear = linear_settings()
    fits = stage(linear_scores(folded, y, xs, linear))
    scores = fits.select("ticker", "fold", "variant", finite("r2").alias("r2"), "n_test")
    values, settings = None, linear
    if forests:
        values, settings = stage(forest_values(folded, y, xs)), linear + forest_settings()
        scores = scores.unionByName(forest_scores(values, len(linear), forest_settings()))
    return placed(scores, settings), fits, values


def refit(scores: DataFrame, fits: DataFrame, values: DataFrame, frame: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """(ticker, model, params, cv_r2, r2, mae, n_obs, factor, coef, importance) of each ticker's best setting on all its rows.

    Coefficients are per unit of the factor, their importance is abs(coef) * std; a forest has coefficients 0 and its own importances, which sum to 1.
    """
    best = stage(scores.where("best").groupBy("ticker", "variant", "model", "params").agg(F.first("mean_r2").alias("cv_r2")))
    names = F.array(*[F.lit(x) for x in xs])
    chosen = fits.where(F.col("fold") == ALL).join(best, ["ticker", "variant"]).select("ticker", "intercept", "coef")
    p = F.col("intercept")
    for i, x in enumerate(xs):
        p = p + F.col("coef")[i] * F.col(x)
    flat = frame.select("ticker", F.col(y).alias("y"), *xs)
    quality = fit_quality(flat.join(chosen, "ticker").select("ticker", "y", p.alias("predicted")), ["ticker"])
    sd = flat.groupBy("ticker").agg(F.array(*[F.stddev_samp(x) for x in xs]).alias("sd"))
    lines = F.arrays_zip(names.alias("factor"), F.col("coef"), F.transform(F.arrays_zip("coef", "sd"), lambda z: F.abs(z.coef) * z.sd).alias("importance"))
    linear = chosen.join(quality, "ticker").join(sd, "ticker").select("ticker", "r2", "mae", F.col("n_test").alias("n_obs"), F.inline(lines)).select("ticker", "r2", "mae", "n_obs", "factor", "coef", "importance")
    parts = [linear]
    if values is not None:
        every, first = values.where(F.col("fold") == ALL), len(linear_settings())
        numbered = values_table(values.sparkSession, ("variant", "trees", "depth", "leaf", "at"), [(first + i, p["trees"], p["depth"], p["leaf"], DEPTHS.index(p["depth"])) for i, (_, p) in enumerate(forest_settings())])
        mine = best.join(F.broadcast(numbered.withColumn("variant", F.col("variant").cast("int"))), "variant").select("ticker", "trees", "leaf", "at")
        used = every.join(mine, ["ticker", "leaf"]).where(F.col("block") < F.col("trees") / BLOCK)
        at = F.col("at").cast("int")
        rows = used.groupBy("ticker", "date").agg(F.first("y").alias("y"), (F.sum(F.get("sums", at)) / F.first("trees")).alias("predicted"))
        shares = used.where("shares IS NOT NULL").select("ticker", "trees", F.posexplode(F.get("shares", at)).alias("i", "share"))
        shares = shares.groupBy("ticker", "i").agg((F.sum("share") / F.first("trees")).alias("share"))
        total = Window.partitionBy("ticker")
        shares = shares.select("ticker", F.element_at(names, F.col("i") + 1).alias("factor"), F.coalesce(F.try_divide("share", F.sum("share").over(total)), F.lit(0.0)).alias("importance"))
        parts.append(fit_quality(rows, ["ticker"]).join(shares, "ticker").select("ticker", "r2", "mae", F.col("n_test").alias("n_obs"), "factor", F.lit(0.0).alias("coef"), "importance"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return best.join(out, "ticker").select("ticker", "model", "params", "cv_r2", "r2", "mae", "n_obs", "factor", "coef", "importance")


# --- REG-17 ------------------------------------------------------------------------------------------
HOLDOUT = ("Ridge", "ElasticNet", "RandomForest", "GradientBoosting")
HOLDOUT_TREES, HOLDOUT_LEAF, ROUNDS, RATE, STEP_DEPTH = 150, 4, 100, 0.1, 3
HOLDOUT_LINEAR = [("Ridge", {"alpha": 0.5}), ("ElasticNet", {"alpha": 0.01, "l1_ratio": 0.3})]


def holdout_folds(frame: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Adds `fold`: the train part is cut as `with_folds` cuts a series; the holdout is the block after its last fold, numbered `last` + 1."""
    w = Window.partitionBy("ticker")
    marked = frame.withColumn("_train", F.row_number().over(w.orderBy("date")) <= F.floor(F.count("*").over(w) * train_share))
    folded = with_folds(marked, ("ticker", "_train")).withColumn("last", F.max(F.when(F.col("_train"), F.col("fold"))).over(w))
    return folded.withColumn("fold", F.when(F.col("_train"), F.col("fold")).otherwise(F.col("last") + 1)).drop("_train")


def boosted_values(folded: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """(ticker, fold, date, y, predicted, shares) of gradient boosting for every fold of every ticker; a group is one series."""

    def run(key, d):
        d = d.sort_values("date")
        x, target, fold = d[list(xs)].to_numpy(float), d[y].to_numpy(float), d["fold"].to_numpy()
        parts = []
        for k in sorted(f for f in set(fold.tolist()) if f > 0):
            train, seen = fold < k, fold <= k
            if not train.any():
                continue
            value, shares = forest.boost(forest.binned(x[seen], train[seen]), target[seen], train[seen], ROUNDS, RATE, STEP_DEPTH)
            part = pd.DataFrame({"date": d["date"][fold == k], "y": target[fold == k], "predicted": value[~train[seen]]})
            part["shares"] = [shares.tolist()] + [None] * (len(part) - 1)
            parts.append(part.assign(fold=k))
        if not parts:
            return pd.DataFrame(columns=["ticker", "fold", "date", "y", "predicted", "shares"])
        return pd.concat(parts).assign(ticker=key[0])[["ticker", "fold", "date", "y", "predicted", "shares"]]

    return folded.select("ticker", "date", "fold", F.col(y).cast("double").alias(y), *[F.col(x).cast("double").alias(x) for x in xs]).groupBy("ticker").applyInPandas(
        run, "ticker string, fold long, date date, y double, predicted double, shares array<double>")


def holdout_models(frame: DataFrame, y: str, xs: Sequence[str], train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(models, predictions) of every ticker's last rows.

    models: (ticker, model, cv_r2, best, holdout_r2, holdout_mae, factor, importance). Every fold and the holdout are fitted with units of their own train rows:
    quartile distances of factors (expanding quantiles), so nothing of a test side is seen. predictions: (ticker, date, actual, prediction) of the best model.
    """
    folded = stage(holdout_folds(frame.select("ticker", "date", y, *xs), train_share))
    last = stage(folded.groupBy("ticker").agg(F.max("fold").alias("last")))
    top = last.agg(F.max("last")).first()[0] or 1  # folds of the longest series, at most 6
    spread = expanding_quantiles(folded, ["ticker"], "fold", top, xs, (0.25, 0.75))
    units = by_feature(spread, ["ticker", "fold"], xs, F.col("q")[1] - F.col("q")[0]).select("ticker", "fold", F.transform("stats", lambda u: F.coalesce(u, F.lit(0.0))).alias("units"))
    e = S.expanding_sums(folded, ["ticker"], "fold", xs, y).join(units, ["ticker", "fold"])
    fits = stage(e.select("ticker", "fold", "units", F.inline(linear_udf(HOLDOUT_LINEAR, True)("train", "test", "units"))))
    named = values_table(frame.sparkSession, ("variant", "model"), [(i, m) for i, (m, _) in enumerate(HOLDOUT_LINEAR)])
    fits = fits.join(F.broadcast(named.withColumn("variant", F.col("variant").cast("int"))), "variant")
    p = F.col("intercept")
    for i, x in enumerate(xs):
        p = p + F.col("coef")[i] * F.col(x)
    linear = folded.where("fold > 0").join(fits.select("ticker", "fold", "model", "intercept", "coef"), ["ticker", "fold"]).select("ticker", "fold", "model", "date", F.col(y).alias("y"), p.alias("predicted"))
    trees = stage(forest_values(folded, y, xs, HOLDOUT_TREES, (HOLDOUT_LEAF,), DEPTHS))
    boosted = stage(boosted_values(folded, y, xs))
    grown = forest_predictions(trees.where("fold > 0"), HOLDOUT_TREES, DEPTHS[-1]).select("ticker", "fold", F.lit("RandomForest").alias("model"), "date", "y", "predicted")
    every = stage(linear.unionByName(grown).unionByName(boosted.select("ticker", "fold", F.lit("GradientBoosting").alias("model"), "date", "y", "predicted")))
    quality = fit_quality(every, ["ticker", "fold", "model"]).join(last, "ticker")
    held = F.col("fold") == F.col("last")
    per = quality.groupBy("ticker", "model").agg(F.avg(F.when(~held, F.col("r2"))).alias("cv_r2"), F.max(F.when(held, F.col("r2"))).alias("holdout_r2"), F.max(F.when(held, F.col("mae"))).alias("holdout_mae"))
    place = F.create_map(*[x for i, m in enumerate(HOLDOUT) for x in (F.lit(m), F.lit(i))])
    order = F.struct(F.coalesce(F.round(-F.col("cv_r2"), 12), F.lit(float("inf"))).alias("r"), F.element_at(place, F.col("model")).alias("i"))
    per = stage(per.withColumn("best", F.col("model") == F.min_by("model", order).over(Window.partitionBy("ticker"))))
    # importances of the fit that predicts the holdout; coefficients count in units of their factors
    names = F.array(*[F.lit(x) for x in xs])
    here = lambda t: t.join(last, "ticker").where(held)
    weights = here(fits).select("ticker", "model", F.zip_with("coef", "units", lambda b, u: F.abs(b * F.when(u > 0, u).otherwise(1.0))).alias("w"))
    weights = weights.unionByName(here(boosted.where("shares IS NOT NULL")).select("ticker", F.lit("GradientBoosting").alias("model"), F.col("shares").alias("w")))
    blocks = here(trees.where("shares IS NOT NULL")).select("ticker", F.posexplode(F.col("shares")[len(DEPTHS) - 1]).alias("i", "s")).groupBy("ticker", "i").agg(F.sum("s").alias("s"))
    weights = weights.unionByName(blocks.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda z: z.s).alias("w")).select("ticker", F.lit("RandomForest").alias("model"), "w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    shares = weights.select("ticker", "model", F.inline(F.arrays_zip(names.alias("factor"), F.transform("w", lambda v: v / F.when(total > 0, total).otherwise(1.0)).alias("importance"))))
    models = per.join(shares, ["ticker", "model"]).select("ticker", "model", "cv_r2", "best", "holdout_r2", "holdout_mae", "factor", "importance")
    predictions = every.join(last, "ticker").where(held).join(per.where("best").select("ticker", "model"), ["ticker", "model"]).select("ticker", "date", F.col("y").alias("actual"), F.col("predicted").alias("prediction"))
    return models, predictions


# --- VAL-7: gaps filled and models chosen inside each window --------------------------------------------
def window_sums(windowed: DataFrame, y: str, xs: Sequence[str], windows: int) -> DataFrame:
    """(ticker, window, train, test) sums with gaps of both sides filled by the medians of the window's train rows.

    Rows are read once: sums of values and gap marks are cumulated over windows, and medians come from one sort for all windows.
    """
    columns, names = S.with_gaps(xs)
    e = S.expanding_sums(windowed.withColumns(columns), ["ticker"], "window", names, y)
    return e.join(window_medians(windowed, xs, windows), ["ticker", "window"], "left").select("ticker", "window", S.filled_udf("train", "test", known(xs)).alias("s")).select("ticker", "window", "s.*")


def window_medians(windowed: DataFrame, xs: Sequence[str], windows: int) -> DataFrame:
    q = expanding_quantiles(windowed, ["ticker"], "window", windows, xs, (0.5,))
    return by_feature(q, ["ticker", "window"], xs, F.col("q")[0])


def known(xs: Sequence[str]) -> Column:
    """Medians, as NULLs where no factor has a value yet."""
    return F.coalesce("stats", F.array(*[F.lit(None).cast("double")] * len(xs)))


def walk_forward_chosen(windowed: DataFrame, y: str, xs: Sequence[str], windows: int, choose: bool = True, least: int = 50) -> DataFrame:
    """(ticker, window, model, params, cv_r2, r2, rmse, n_train, n_test) of walk-forward windows (`with_windows`) with gaps in factors.

    Each window picks its model by folds inside its own train rows, where it has `least` of them, and least squares otherwise or without `choose`.
    The choice covers the linear families; rows meet each later window once, so choosing costs `windows` times the rows, summed before they are shuffled.
    """
    windowed = stage(windowed.select("ticker", "date", "window", y, *xs))
    settings = linear_settings() if choose else linear_settings()[:1]
    outer = stage(window_sums(windowed, y, xs, windows).select("ticker", "window", F.inline(linear_udf(settings)("train", "test"))))
    named = F.broadcast(values_table(windowed.sparkSession, ("variant", "model", "params"), [(i, m, described(p)) for i, (m, p) in enumerate(settings)]).withColumn("variant", F.col("variant").cast("int")))
    if choose:
        later = windowed.where(F.col("window") < windows).withColumn("window", F.explode(F.sequence(F.col("window") + 1, F.lit(windows).cast("long"))))
        columns, names = S.with_gaps(xs)
        folded = with_folds(later, ("ticker", "window")).withColumns(columns)
        inner = S.expanding_sums(folded, ["ticker", "window"], "fold", names, y).join(window_medians(windowed, xs, windows), ["ticker", "window"], "left")
        inner = inner.select("ticker", "window", "fold", S.filled_udf("train", "test", known(xs)).alias("s")).select("ticker", "window", F.inline(linear_udf(settings)("s.train", "s.test")))
        mean = inner.groupBy("ticker", "window", "variant").agg(F.avg(finite("r2")).alias("m"))
        order = F.struct(F.coalesce(F.round(-F.col("m"), 12), F.lit(float("inf"))).alias("r"), "variant")
        best = mean.groupBy("ticker", "window").agg(F.min_by("variant", order).alias("best"), F.max("m").alias("cv_r2"))
        outer = outer.join(best, ["ticker", "window"], "left")
        outer = outer.withColumn("best", F.when(F.col("n_train") >= least, F.coalesce("best", F.lit(0))).otherwise(0)).withColumn("cv_r2", F.when(F.col("n_train") >= least, F.col("cv_r2")))
    else:
        outer = outer.withColumns({"best": F.lit(0), "cv_r2": F.lit(None).cast("double")})
    return outer.where(F.col("variant") == F.col("best")).join(named, "variant").select("ticker", "window", "model", "params", "cv_r2", finite("r2").alias("r2"), "rmse", "n_train", "n_test")
