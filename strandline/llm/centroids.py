"""k-means over whole-number vectors; nearest centroids are found in a vantage-point tree.

A component x becomes floor(1024 * x). Every round builds a tree over the centroids and broadcasts it: a node's vantage point is the
centroid whose distances to the others vary most; the others are halved by their distance to it, and each half is kept with its least and
greatest one. A vector searches best first: the open node with the least lower bound is next, and a node is left out only
if its bound exceeds the best distance so far, so a centroid at exactly that distance is still met and ties go to the smaller number. Bounds
are rounded outwards; distances that decide are exact whole numbers. All vectors of a batch take a step at a time, each at its
own node.

A task sends one sum per cluster and component and one count per cluster, whatever its number of rows, so a cluster that holds most rows costs no more
than another. Sums are exact, so every run and partitioning gives the same centroids. Broadcast and collected are k * dimension
numbers. Vectors are read anew each round, never shuffled; only (id, cluster, distance) of the last assignment is written.

The first centroids are the k vectors with the smallest hashes. Hashes are spread evenly, so those below a cut that a few
more than k pass are sorted; the cut widens until k are found.

Defined cases: vectors that are null, of another length or hold null or non-finite components are left out; repeated rows count as often as they
come, also among the first centroids, where equal hashes are ordered by components; fewer vectors than k give as many clusters; an empty
table gives an empty result; a null id has no hash and is chosen last; a distance or sum of distances beyond a long is null, while clusters stay exact
(components too large for 64-bit arithmetic are handled as Python integers); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .dense import matrix, wide

K, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
LEAF = 2  # centroids of a leaf
SAFE = 2 ** 27  # components below it keep sums of 64 squares of differences in a long
OUT = 1e-12  # rounding bounds outwards
LONG = 2 ** 63 - 1
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(x: np.ndarray, small: bool) -> np.ndarray:
    """floor(1024 * x): longs, or Python integers where some component may be large."""
    if small:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.ravel().tolist()]
    return out


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    d = x - c
    return (d * d).sum(axis=1)


def roots(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of square roots from below and above."""
    if square.dtype == object:
        low = np.array([math.isqrt(int(s)) for s in square] + [None], object)[:-1]
        return low, low + 1
    r = np.sqrt(square.astype(np.float64))
    return r * (1 - OUT), r * (1 + OUT)


@dataclass
class Node:
    centroids: list[int]  # of a leaf, or the vantage point alone
    children: list[int] = field(default_factory=list)
    nearest: list = field(default_factory=list)  # per child, least distance to the vantage point, rounded down
    farthest: list = field(default_factory=list)  # greatest, rounded up


class Tree:
    """Vantage-point tree over centroids (k, dimension)."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids, self.leaf, self.nodes = centroids, leaf, []
        self.build(list(range(len(centroids))))

    def build(self, among: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(Node(among))
        if len(among) <= self.leaf:
            return at
        c = self.centroids[among]
        away = np.stack([roots(squares(c, v))[0] for v in c])
        if away.dtype == object:  # as shares of the greatest distance, since they may exceed a double
            away = (away * 2 ** 52 // max(1, away.max())).astype(np.float64)
        point = among[int(away.var(axis=1).argmax())]
        others = [i for i in among if i != point]
        square = squares(self.centroids[others], self.centroids[point])
        order = sorted(range(len(others)), key=lambda k: (square[k], others[k]))
        node = self.nodes[at] = Node([point])
        half = (len(order) + 1) // 2
        for part in (order[:half], order[half:]):
            if part:
                low, high = roots(square[[part[0], part[-1]]])
                node.nearest.append(low[0])
                node.farthest.append(high[1])
                node.children.append(self.build(sorted(others[k] for k in part)))
        return at

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row (the smaller number of equally near ones) and its squared distance."""
        n, exact = len(x), x.dtype == object
        cluster = np.zeros(n, np.int64)
        best = squares(x, self.centroids[0])  # any centroid bounds the search
        reach = roots(best)[1]
        bound = np.full((n, len(self.nodes)), math.inf, dtype=object if exact else np.float64)  # of open nodes
        bound[:, 0] = 0
        rows = np.arange(n)
        while len(rows):
            at = np.argmin(bound[rows], axis=1)
            inside = bound[rows, at] <= reach[rows]  # inclusive: a tie with a smaller number may lie there
            rows, at = rows[inside], at[inside].astype(np.int64)
            for a in np.unique(at):
                here, node = rows[at == a], self.nodes[a]
                floor = bound[here, a]
                bound[here, a] = math.inf
                for c in node.centroids:
                    square = squares(x[here], self.centroids[c])
                    closer = (square < best[here]) | ((square == best[here]) & (c < cluster[here]))
                    best[here[closer]], cluster[here[closer]] = square[closer], c
                reach[here] = roots(best[here])[1]
                if node.children:
                    low, high = roots(square)
                    for child, near, far in zip(node.children, node.nearest, node.farthest):
                        bound[here, child] = np.maximum(floor, np.maximum(low - far, near - high))
        return cluster, best


def first_centroids(vectors: DataFrame, n: int, k: int, dimension: int, small: bool, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes, in their order."""
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))

    def kept(batches):
        for batch in batches:
            rows, _ = matrix(batch.column("v"), dimension)
            if len(rows):
                yield batch.take(pa.array(rows))

    share = (k + 8 * math.sqrt(k) + 32) / n
    while True:
        cut = f"{int(share * 16 ** 12):012x}" if share < 1 else None
        chosen = hashed.where(F.col("hash") < cut) if cut else hashed
        rows = chosen.mapInArrow(kept, chosen.schema).orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
        if len(rows) == k or not cut:
            return whole(np.array([r.v for r in rows], np.float64).reshape(len(rows), dimension), small)
        share *= 16


def cluster_vectors(table: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, seed: int = SEED, embedding: str = "embedding",
                    vec_id: str = "vec_id") -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = table.sparkSession
    vectors = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))

    def measure(batches):
        for batch in batches:
            _, x = matrix(batch.column("v"), dimension)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([float(np.abs(x).max(initial=0.0))])], ["n", "top"])

    n, top = vectors.mapInArrow(measure, "n long, top double").agg(F.sum("n"), F.max("top")).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    small = top * SCALE < SAFE / math.sqrt(max(dimension / 64, 1))
    centroids = first_centroids(vectors, n, min(k, n), dimension, small, seed)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, dimension, small)
    return last_assignment(vectors, centroids, dimension, small)


def moved(vectors: DataFrame, centroids: np.ndarray, dimension: int, small: bool) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors; empty ones stay."""
    spark, k = vectors.sparkSession, len(centroids)
    tree = spark.sparkContext.broadcast(Tree(centroids))

    def sums(batches):
        total, count = np.zeros((k, dimension), object), np.zeros(k, np.int64)
        for batch in batches:
            _, x = matrix(batch.column("v"), dimension)
            if not len(x):
                continue
            x = whole(x, small)
            cluster, _ = tree.value.search(x)
            order = np.argsort(cluster, kind="stable")
            found, begin = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(x[order], begin, axis=0)
            count += np.bincount(cluster, minlength=k)
        has = np.flatnonzero(count)
        if len(has):
            c = np.repeat(has, dimension + 1)
            i = np.tile(np.arange(-1, dimension), len(has))
            values = np.concatenate([count[has, None].astype(object), total[has]], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), wide(values) if small else pa.array([str(v) for v in values])], ["cluster", "i", "total"])

    kind = "decimal(38,0)" if small else "string"
    rows = vectors.mapInArrow(sums, f"cluster int, i int, total {kind}")
    out = centroids.copy()
    if small:
        found = {(r.cluster, r.i): int(r.total) for r in rows.groupBy("cluster", "i").agg(F.sum("total").alias("total")).collect()}
    else:
        found = exact_totals(rows)
    tree.unpersist()
    for (c, i), total in found.items():
        if i >= 0:
            out[c, i] = total // found[c, -1]
    return out


def exact_totals(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of whole numbers of any size: digits in groups of 15 are summed, at most 22 groups a number, and put together."""
    size, digits = 15, F.regexp_replace("total", "-", "")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(digits) - 1) / size).cast("int")),
                        lambda g: F.struct(g.alias("g"), F.reverse(F.substring(F.reverse(digits), g * size + 1, F.lit(size))).cast("long").alias("v")))
    sign = F.when(F.col("total").startswith("-"), -1).otherwise(1)
    each = rows.select("cluster", "i", sign.alias("s"), F.explode(parts).alias("p")).groupBy("cluster", "i", "p.g").agg(F.sum((F.col("s") * F.col("p.v")).cast("decimal(38,0)")).alias("v"))
    out: dict[tuple[int, int], int] = {}
    for r in each.collect():
        out[r.cluster, r.i] = out.get((r.cluster, r.i), 0) + int(r.v) * 10 ** (size * r.g)
    return out


def last_assignment(vectors: DataFrame, centroids: np.ndarray, dimension: int, small: bool) -> DataFrame:
    tree = vectors.sparkSession.sparkContext.broadcast(Tree(centroids))

    def assign(batches):
        for batch in batches:
            rows, x = matrix(batch.column("v"), dimension)
            if len(rows):
                cluster, square = tree.value.search(whole(x, small))
                fits = [int(s) if s <= LONG else None for s in square]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    near = stage(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    sums = {r.cluster: r for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("over")).collect()}
    part = {c: None if r.over or int(r.d) > LONG else int(r.d) for c, r in sums.items()}
    whole_sum = None if any(v is None for v in part.values()) or sum(part.values()) > LONG else sum(part.values())
    digest = {c: hashlib.sha256(",".join(str(int(v)) for v in centroids[c]).encode()).hexdigest() for c in part}
    table = near.sparkSession.createDataFrame([(c, part[c], whole_sum, digest[c]) for c in part], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
