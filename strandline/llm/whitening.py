"""Whitening of vectors along the leading eigenvectors of their covariance, found by spectrum slicing.

Entries become whole numbers, x = floor(64 * c) + 1000000. One pass adds up x, a second one the products of x less the
nearest whole number to its mean; both sums are exact whole numbers, so the covariance is rounded once, is the same
in every run, and loses nothing to cancellation. What a task sends is one number per pair of dimensions.

The eigenvalues of the covariance V are located by counting: V - s * I = P L D L' P' with pivots of size one and two, and by
Sylvester's law the number of positive pivots of D is the number of eigenvalues above s. Bisection on that
count separates each leading eigenvalue from the others; Rayleigh quotient iteration from inside the interval converges
cubically, and the counts just above and below the value it reaches prove that it is the j-th one. Where no interval separates
values (equal ones, or closer than rounding), any orthonormal basis of their space is used, built by inverse iteration
against the vectors already found. V has one entry per pair of dimensions and is worked on by the driver: d * d numbers, whatever
the number of rows.

A third pass measures the covariance of the whitened rows, a fourth returns them; no row is shuffled or written.

Defined cases: a vector that is null or holds null or non-finite entries is dropped, as is one with an entry of 2**56 or more, which has
no exact x. Vectors of other lengths than the most frequent one (the shorter of two equally frequent ones) have no place in the
covariance and are dropped. Components are those with more than 1e-11 of the trace, `components` at the most; vectors
without spread, a single vector and an empty table give an empty result. Repeated rows count as often as they come; a deviation beyond the
range of a long is null; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .dense import lengths, matrix, wide

COMPONENTS, SCALE, SHIFT, LARGEST, FLOOR = 32, 64.0, 1_000_000, 2.0 ** 56, 1e-11
EXACT = 2.0 ** 53
LONG = 2 ** 63 - 1
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# the spectrum of a symmetric matrix


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above the shift: positive pivots of V - shift * I = P L D L' P', completely pivoted (Bunch and Parlett)."""
    a = v - shift * np.eye(len(v))
    limit, positive = (1 + math.sqrt(17)) / 8, 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal().copy()
        np.fill_diagonal(size, -1.0)
        p, (r, c) = int(diagonal.argmax()), np.unravel_index(size.argmax(), size.shape)
        if diagonal[p] >= limit * size[r, c]:
            if diagonal[p] == 0:  # what is left is zero: eigenvalues that equal the shift
                return positive
            positive += int(a[p, p] > 0)
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[p, p])
        else:  # a block of two whose determinant is negative
            positive += 1
            rest = np.delete(np.arange(len(a)), [r, c])
            pair = a[np.ix_(rest, [r, c])]
            a = a[np.ix_(rest, rest)] - pair @ np.linalg.solve(a[np.ix_([r, c], [r, c])], pair.T)
        a = (a + a.T) / 2
    return positive


class Slices:
    """Counts of eigenvalues above shifts; every count narrows the interval of all eigenvalues."""

    def __init__(self, v: np.ndarray):
        self.v, self.scale = v, float(np.abs(v).sum(axis=1).max(initial=0.0))
        self.known: dict[float, int] = {-self.scale: len(v), 2 * self.scale: 0}

    def count(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = above(self.v, shift)
        return self.known[shift]

    def interval(self, j: int) -> tuple[float, float]:
        """Shifts between which the j-th largest eigenvalue lies, as far as counted."""
        return max(s for s, n in self.known.items() if n >= j), min(s for s, n in self.known.items() if n < j)

    def isolate(self, j: int, width: float) -> tuple[float, float]:
        """An interval that holds the j-th eigenvalue alone, or is narrower than `width`."""
        while True:
            low, high = self.interval(j)
            if (self.count(low) == j and self.count(high) == j - 1) or high - low <= width:
                return low, high
            self.count((low + high) / 2)


def leading(v: np.ndarray, wanted: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above `floor`, falling, at most `wanted`, and their unit eigenvectors as columns."""
    d = len(v)
    cut = Slices(v)
    m = min(wanted, d, cut.count(floor) if d else 0)
    eps = np.finfo(float).eps
    tight = 8 * eps * cut.scale * max(d, 1) ** 0.5
    values, vectors = np.zeros(m), np.zeros((d, m))
    draw = np.random.default_rng(11)

    def solve(shift, b):
        try:
            return np.linalg.solve(v - shift * np.eye(d), b)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            return np.linalg.solve(v - (shift + eps * cut.scale) * np.eye(d), b)

    for j in range(m):
        found = vectors[:, :j]

        def unit(y):
            y = y / np.abs(y).max()
            for _ in range(2):
                y = y - found @ (found.T @ y)
            return y / np.linalg.norm(y)

        low, high = cut.isolate(j + 1, tight)
        start = unit(draw.standard_normal(d))
        while True:
            middle = (low + high) / 2
            x = unit(solve(middle, unit(solve(middle, start))))
            best, value, left = x, float(x @ v @ x), math.inf
            while low <= (rho := float(x @ v @ x)) <= high:
                miss = float(np.linalg.norm(v @ x - rho * x))
                if miss >= left / 2:
                    break
                best, value, left = x, rho, miss
                x = unit(solve(rho, x))
            slack = tight + 2 * left if left < math.inf else math.inf
            # counts on both sides of the value certify that it is the j-th one
            if left <= 64 * tight and cut.count(value + slack) <= j < cut.count(value - slack):
                break
            if high - low <= tight:  # values that no count separates
                break
            cut.count(middle)
            low, high = cut.interval(j + 1)
        values[j], vectors[:, j] = value, best
    return values, vectors


# exact sums over rows


def whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose scaled entries are exact, and x as longs."""
    y = np.floor(SCALE * np.clip(x, -LARGEST, LARGEST))
    fine = (np.abs(x) < LARGEST).all(axis=1)
    return np.flatnonzero(fine), y[fine].astype(np.int64) + SHIFT


def products(a: np.ndarray) -> np.ndarray:
    """a'a as exact whole numbers, in Python integers."""
    total = np.zeros((a.shape[1], a.shape[1]), object)
    top = np.abs(a).max(axis=1, initial=0).astype(float)
    small = top < 2.0 ** 20
    b = a[small].astype(np.float64)
    step = max(1, int(EXACT / max(float(top[small].max(initial=1)) ** 2, 1)))
    for i in range(0, len(b), step):  # no partial sum of a block leaves the exact range of a double
        total += (b[i:i + step].T @ b[i:i + step]).astype(np.int64).astype(object)
    if not small.all():
        c = a[~small].astype(object)
        total += c.T @ c
    return total


def column_sums(vectors: DataFrame) -> DataFrame:
    """length, dim, total: exact sums of x by length and dimension; dim -1 holds the number of vectors."""

    def sums(batches):
        for batch in batches:
            lists = batch.column("v")
            for length in np.unique(lengths(lists)):
                if length < 0:
                    continue
                x = whole(matrix(lists, int(length))[1])[1]
                if len(x):
                    totals = [len(x), *(x - SHIFT).astype(object).sum(axis=0)] if np.abs(x).max(initial=0) > 2 ** 40 else [len(x), *(x - SHIFT).sum(axis=0)]
                    totals[1:] = [int(t) + SHIFT * len(x) for t in totals[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()), wide(totals)], ["length", "dim", "total"])

    return vectors.mapInArrow(sums, "length int, dim int, total decimal(38,0)").groupBy("length", "dim").agg(F.sum("total").alias("total"))


def covariance(vectors: DataFrame, d: int, n: int, total: list[int]) -> np.ndarray:
    """Covariance of x, divisor n, rounded once from exact whole numbers."""
    centre = [round(t / n) if abs(t) < 2 ** 50 else (2 * t + n) // (2 * n) for t in total]
    i, j = np.triu_indices(d)
    near = np.array(centre, np.int64)

    def gram(batches):
        held = None
        for batch in batches:
            x = whole(matrix(batch.column("v"), d)[1])[1]
            if len(x):
                more = products(x - near)
                held = more if held is None else held + more
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), wide(held[i, j])], ["i", "j", "total"])

    sums = vectors.mapInArrow(gram, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    left = [t - n * c for t, c in zip(total, centre)]  # what the whole number misses of the mean, times n
    v = np.zeros((d, d))
    for r in sums:
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.total) - left[r.i] * left[r.j]) / (n * n)
    return v


class Whitener:
    """What rows need to be whitened: n, sums of x, eigenvectors (d, m) divided by the roots of their values, shares of the trace."""

    def __init__(self, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.d, self.m, self.values, self.vectors = n, len(total), len(values), values, vectors
        self.centre = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)
        self.left = np.array([t - n * int(c) for t, c in zip(total, self.centre)], object)
        self.project, self.explained = vectors / np.sqrt(values), values / trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        near = x - self.centre
        if float(np.abs(near).max(initial=0)) * self.n < 2.0 ** 61 and self.n < 2 ** 61:
            return near * self.n - self.left.astype(np.int64)
        return near.astype(object) * self.n - self.left

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Whitened rows, and each row's deviation (None beyond a long)."""
        y = self.centred(x)
        f = y.astype(np.float64)
        large = (f * f).sum(axis=1) > 2.0 ** 62
        deviation = (np.where(large[:, None], 0, y) ** 2).sum(axis=1).tolist()
        for k in np.flatnonzero(large):
            exact = sum(int(e) ** 2 for e in y[k])
            deviation[k] = exact if exact <= LONG else None
        return (f / self.n) @ self.project, deviation


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of a table (vec_id, v array<double>); None where nothing can be whitened."""
    sums = stage(column_sums(vectors))
    top = sums.where("dim = -1").orderBy(F.desc("total"), "length").select("length", "total").first()
    if top is None or not top.length:
        return None
    d, n = top.length, int(top.total)
    total = [int(r.total) for r in sums.where((F.col("length") == d) & (F.col("dim") >= 0)).orderBy("dim").collect()]
    v = covariance(vectors, d, n, total)
    trace = float(v.trace())
    values, found = leading(v, components, FLOOR * trace) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    return Whitener(n, total, values, found, trace) if len(values) else None


def identity_error(vectors: DataFrame, shared) -> float:
    """Largest entry, in size, of the covariance of the whitened rows less the identity."""
    m = shared.value.m
    i, j = np.triu_indices(m)

    def measure(batches):
        w = shared.value
        first, second = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            x = whole(matrix(batch.column("v"), w.d)[1])[1]
            if len(x):
                y, _ = w.whiten(x)
                first += y.sum(axis=0)
                second += y.T @ y
        at = [np.full(m, -1), i], [np.arange(m), j], [first, second[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(at, (pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "total"])

    rows = vectors.mapInArrow(measure, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    n = shared.value.n
    mean = {r.j: r.total / n for r in rows if r.i < 0}  # zero but for rounding: rows are centred before they are projected
    return max(abs(r.total / n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in rows if r.i >= 0)


def whiten(table: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    spark = table.sparkSession
    fitted = fit(vectors, components)
    if fitted is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(fitted)  # d * components doubles
    error = identity_error(vectors, shared)

    def apply(batches):
        w = shared.value
        for batch in batches:
            rows, x = matrix(batch.column("v"), w.d)
            fine, x = whole(x)
            if not len(x):
                continue
            y, deviation = w.whiten(x)
            k = len(x) * w.m
            ids = batch.column("vec_id").take(pa.array(np.repeat(rows[fine], w.m)))
            deviation = pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), w.m)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, w.m + 1), len(x)), pa.int32()), pa.array(np.full(k, w.n), pa.int64()), deviation,
                 pa.array(y.ravel()), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(apply, SCHEMA)
