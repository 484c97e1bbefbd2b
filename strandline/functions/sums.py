"""Cross-product sums per (keys, block), and the small solvers that read them.

One aggregate with map-side combine yields, per group and block of time, the sums of all products of
(1, x..., y). Adding blocks up gives every expanding training set, and any feature subset, lag or
penalty is solved from a sub-matrix, so data is read once however many models are scored. Solvers see
one row per group; their input is (p + 2)(p + 3) / 2 numbers, never data rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def products(xs: Sequence[str], y: str) -> list[Column]:
    z = [F.lit(1.0), *[F.col(c) for c in xs], F.col(y)]
    return [z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]


def block_sums(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """(keys, sums array)."""
    aggs = [F.sum(c) for c in products(xs, y)]
    return df.groupBy(*keys).agg(F.array(*aggs).alias("sums"))


def expanding_sums(df: DataFrame, keys: Sequence[str], block: str, xs: Sequence[str], y: str) -> DataFrame:
    """(keys, block, train, test): sums of all earlier blocks and of the block itself; block > 0."""
    n = len(products(xs, y))
    b = df.groupBy(*keys, block).agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(products(xs, y))])
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return b.select(*keys, block, F.array(*[F.sum(f"s{i}").over(w) for i in range(n)]).alias("train"),
                    F.array(*[F.col(f"s{i}") for i in range(n)]).alias("test")).where(F.col(block) > 0)


# --- solvers on one matrix -------------------------------------------------------------------------
def matrix(sums) -> np.ndarray:
    s = np.asarray(sums, float)
    k = int((math.isqrt(8 * len(s) + 1) - 1) // 2)
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = s
    return m + np.triu(m, 1).T


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    n = m[0, 0]
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] - n * np.outer(mean, mean)


def ridge(m: np.ndarray, alpha: float, scale: bool = True) -> tuple[float, np.ndarray]:
    """(intercept, coefficients); the penalty acts on standardised or on raw factors."""
    n, mean, c = centred(m)
    cx, cy = c[:-1, :-1], c[:-1, -1]
    sd = np.sqrt(np.maximum(np.diag(cx) / n, 0.0)) if scale else np.ones(len(cy))
    sd = np.where(sd > 0, sd, 1.0)
    a = cx / np.outer(sd, sd) + alpha * np.eye(len(cy))
    b = (np.linalg.lstsq(a, cy / sd, rcond=None)[0]) / sd
    return float(mean[-1] - mean[:-1] @ b), b


def score(m: np.ndarray, b0: float, b: np.ndarray) -> tuple[float, float]:
    """(R2, RMSE) of a linear model on the rows summed in m."""
    v = np.concatenate([[-b0], -b, [1.0]])
    sse = max(float(v @ m @ v), 0.0)
    sst = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    return (1.0 - sse / sst if sst > 1e-300 else float("nan")), math.sqrt(sse / m[0, 0])


def subset(m: np.ndarray, idx: Sequence[int]) -> np.ndarray:
    keep = [0, *[i + 1 for i in idx], m.shape[0] - 1]
    return m[np.ix_(keep, keep)]


def normal_tail(t: float) -> float:
    """Two-sided tail probability of a standard normal."""
    return math.erfc(abs(t) / math.sqrt(2.0))


def ols(m: np.ndarray) -> dict:
    n, mean, c = centred(m)
    p = len(mean) - 1
    inv = scaled_inverse(c[:-1, :-1])
    b = inv @ c[:-1, -1]
    b0 = float(mean[-1] - mean[:-1] @ b)
    r2, rmse = score(m, b0, b)
    dof = n - p - 1
    s2 = rmse**2 * n / dof if dof > 0 else float("nan")
    se = np.sqrt(np.maximum(s2 * np.diag(inv), 0.0))
    return {"intercept": b0, "coef": b, "se": se, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / dof if dof > 0 else float("nan"), "n": int(n)}


def scaled_inverse(s: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of sums of products whose factors have different units: it is taken of the matrix with a unit diagonal."""
    d = np.sqrt(np.maximum(np.diag(s), 0.0))
    d = np.where(d > 0, d, 1.0)
    return np.linalg.pinv(s / np.outer(d, d), rcond=1e-12, hermitian=True) / np.outer(d, d)


def vif(m: np.ndarray) -> np.ndarray:
    """Uncentred variance inflation: S_jj * (S^-1)_jj over the factors."""
    s = m[1:-1, 1:-1]
    return np.diag(s) * np.diag(scaled_inverse(s))


def reduce_vif(m: np.ndarray, names: Sequence[str], limit: float = 12.0, least: int = 2) -> tuple[list[str], np.ndarray]:
    idx = list(range(len(names)))
    while len(idx) > least:
        v = vif(subset(m, idx))
        worst = int(np.argmax(v))
        if not v[worst] > limit:
            break
        idx.pop(worst)
    return [names[i] for i in idx], vif(subset(m, idx))


def subsets(p: int) -> list[tuple[int, ...]]:
    return [c for k in range(1, p + 1) for c in combinations(range(p), k)]


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


DBL, LNG, STR, FLAG = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


def with_gaps(xs: Sequence[str]) -> tuple[dict[str, Column], list[str]]:
    """Columns for sums from which any filling of gaps can be derived later: each factor with 0 for a gap, and a mark for the gap."""
    known = {f"_x_{x}": F.when(F.col(x).isNotNull() & ~F.isnan(x), F.col(x)).otherwise(0.0) for x in xs}
    marks = {f"_g_{x}": (F.col(x).isNull() | F.isnan(x)).cast("double") for x in xs}
    return known | marks, [*known, *marks]


def filled(m: np.ndarray, values: Sequence[float]) -> np.ndarray:
    """Sums over (1, x, y) with gaps filled by `values`, from sums over (1, x with 0, marks, y): x + value * mark is linear in both."""
    p = len(values)
    a = np.zeros((p + 2, 2 * p + 2))
    a[0, 0] = a[-1, -1] = 1.0
    a[np.arange(1, p + 1), np.arange(1, p + 1)] = 1.0
    a[np.arange(1, p + 1), np.arange(p + 1, 2 * p + 1)] = values
    return a @ m @ a.T


# --- Arrow-batched wrappers: one input row per group -------------------------------------------------
@F.pandas_udf(fields(intercept=DBL, coef=T.ArrayType(DBL), pred_mean=DBL, pred_sd=DBL))
def ridge_udf(train: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """Model, and mean and sample std of its predictions on the rows it was trained on."""
    rows = []
    for s, a in zip(train, alpha):
        m = matrix(s)
        b0, b = ridge(m, a)
        n, mean, c = centred(m)
        sd = math.sqrt(max(float(b @ c[:-1, :-1] @ b), 0.0) / max(n - 1, 1))
        rows.append((b0, b.tolist(), float(b0 + mean[:-1] @ b), sd))
    return pd.DataFrame(rows, columns=["intercept", "coef", "pred_mean", "pred_sd"])


@F.pandas_udf(fields(r2=DBL, rmse=DBL, n_train=LNG, n_test=LNG))
def ridge_score_udf(train: pd.Series, test: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, al in zip(train, test, alpha):
        ma, mb = matrix(a), matrix(b)
        rows.append((*score(mb, *ridge(ma, al)), int(ma[0, 0]), int(mb[0, 0])))
    return pd.DataFrame(rows, columns=["r2", "rmse", "n_train", "n_test"])


@F.pandas_udf(fields(members=STR, size=LNG, r2=DBL))
def subset_score_udf(folds: pd.Series, names: pd.Series, mask: pd.Series) -> pd.DataFrame:
    """Mean fold R² of the factors whose bits the mask holds."""
    out = []
    for fs, ns, m in zip(folds, names, mask):
        idx = tuple(i for i in range(len(ns)) if m >> i & 1)
        r2 = [score(subset(matrix(f["test"]), idx), *ridge(subset(matrix(f["train"]), idx), 0.5))[0] for f in fs]
        out.append(("+".join(ns[i] for i in idx), len(idx), float(np.mean(r2))))
    return pd.DataFrame(out, columns=["members", "size", "r2"])


@F.pandas_udf(T.ArrayType(fields(factor=STR, coef=DBL, se=DBL, p_value=DBL, r2=DBL, adj_r2=DBL, intercept=DBL, n=LNG)))
def ols_udf(sums: pd.Series, names: pd.Series) -> pd.Series:
    out = []
    for s, ns in zip(sums, names):
        o = ols(matrix(s))
        t = np.divide(o["coef"], o["se"], out=np.zeros_like(o["coef"]), where=o["se"] > 0)
        out.append([{"factor": f, "coef": float(b), "se": float(e), "p_value": normal_tail(float(x)), "r2": o["r2"], "adj_r2": o["adj_r2"],
                     "intercept": o["intercept"], "n": o["n"]} for f, b, e, x in zip(ns, o["coef"], o["se"], t)])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(fields(factor=STR, vif=DBL, kept=FLAG)))
def vif_udf(sums: pd.Series, names: pd.Series) -> pd.Series:
    out = []
    for s, ns in zip(sums, names):
        m = matrix(s)
        kept, after = reduce_vif(m, list(ns))
        final = dict(zip(kept, after))
        out.append([{"factor": f, "vif": float(final.get(f, v)), "kept": f in final} for f, v in zip(ns, vif(m))])
    return pd.Series(out)


@F.pandas_udf(DBL)
def first_t_udf(sums: pd.Series, count: pd.Series) -> pd.Series:
    """t statistic of the first factor in a regression with intercept on the first `count` factors."""
    def one(s, k):
        m = matrix(s)  # no rows: NULLs, which are NaN here
        if not m[0, 0] > k + 1:
            return float("nan")
        o = ols(subset(m, range(int(k))))
        return float(o["coef"][0] / o["se"][0]) if o["se"][0] > 0 else float("nan")
    return pd.Series([one(s, k) for s, k in zip(sums, count)], dtype=float)


@F.pandas_udf(T.ArrayType(fields(step=LNG, forecast=DBL, lower=DBL, upper=DBL)))
def ar_forecast_udf(sums: pd.Series, last: pd.Series, steps: pd.Series) -> pd.Series:
    out = []
    for s, tail, h in zip(sums, last, steps):
        m = matrix(s)
        b0, b = ridge(m, 0.0, scale=False)
        sigma = score(m, b0, b)[1]
        hist, psi, res, var = list(tail), [1.0], [], 0.0  # tail: newest first
        for k in range(int(h)):
            f = b0 + float(np.dot(b, hist[: len(b)]))
            var += psi[k] ** 2
            half = 1.6448536269514722 * sigma * math.sqrt(var)
            res.append({"step": k + 1, "forecast": f, "lower": f - half, "upper": f + half})
            hist.insert(0, f)
            psi.append(float(sum(b[j] * psi[k - j] for j in range(min(len(b), k + 1)))))
        out.append(res)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(fields(step=LNG, forecast=DBL, lower=DBL, upper=DBL)))
def arma_forecast_udf(sums: pd.Series, values: pd.Series, errors: pd.Series, steps: pd.Series) -> pd.Series:
    """Forecasts from the sums of (1, lagged values, lagged errors, value); values and errors: the last ones, newest first."""
    out = []
    for s, v, e, h in zip(sums, values, errors, steps):
        m, p, q = matrix(s), len(v), len(e)
        b0, b = ridge(m, 0.0)
        phi, theta = b[:p], b[p:]
        sigma = score(m, b0, b)[1]
        past, shocks, psi, var, res = list(v), list(e), [1.0], 0.0, []
        for k in range(int(h)):
            f = b0 + float(np.dot(phi, past[:p])) + float(np.dot(theta, shocks[:q]))
            var += psi[k] ** 2
            half = 1.6448536269514722 * sigma * math.sqrt(var)
            res.append({"step": k + 1, "forecast": f, "lower": f - half, "upper": f + half})
            past, shocks = [f, *past], [0.0, *shocks]
            psi.append(float(sum(phi[j] * psi[k - j] for j in range(min(p, k + 1))) + (theta[k] if k < q else 0.0)))
        out.append(res)
    return pd.Series(out)


@F.pandas_udf(fields(train=T.ArrayType(DBL), test=T.ArrayType(DBL)))
def filled_udf(train: pd.Series, test: pd.Series, values: pd.Series) -> pd.DataFrame:
    """Both sums with gaps filled by the values, which are NULL for a factor that is not known yet (it then counts as 0)."""
    def one(s, v):
        m = filled(matrix(s), [0.0 if x is None or x != x else float(x) for x in v])
        return m[np.triu_indices(len(m))].tolist()
    return pd.DataFrame({"train": [one(s, v) for s, v in zip(train, values)], "test": [one(s, v) for s, v in zip(test, values)]})


def predict(df: DataFrame, models: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Adds `predicted`, and z against the model's own train predictions; arithmetic stays in the JVM."""
    j = df.join(models.select(*keys, "intercept", "coef", "pred_mean", "pred_sd"), list(keys))
    p = F.col("intercept")
    for i, c in enumerate(xs):
        p = p + F.col("coef")[i] * F.col(c)
    z = (F.col("predicted") - F.col("pred_mean")) / F.when(F.col("pred_sd") > 1e-8, F.col("pred_sd")).otherwise(1.0)
    return j.withColumn("predicted", p).withColumn("z", z).drop("intercept", "coef", "pred_mean", "pred_sd")
