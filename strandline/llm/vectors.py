"""Near duplicates among vectors: binary codes under random rotations, with stored correction factors.

A vector's unit form is turned by fixed random rotations; the signs are its code, and the factor kept with a code is
the inner product of the turned vector with its own code. Dividing by it makes <code(x), turned y> / factor(x) an
unbiased estimate of the cosine, with an error below `WIDTH` * sqrt((1 - f * f) / f / f / (turns * (dimension - 1))) but
for rare pairs. A pair whose bound stays under the threshold is dropped; every other pair is recomputed
exactly in double precision, and only exact values make links.

Candidates come from tables of code bits: a table's bucket is `bits` signs taken from the rotations, each sign
used once. Two vectors at the threshold agree in a sign with probability 1 - acos(threshold) / pi, so
`tables` is chosen for the wanted recall at the threshold itself; closer pairs are found more surely. bits grow with
the logarithm of the number of vectors, so a bucket of unrelated vectors keeps its size.

Equal vectors are one class with a number of copies, combined before any shuffle. A bucket with more than `BLOCK` vectors is
split, and pairs of blocks are compared, each vector being sent once per block; no task holds more than two blocks.
A link is counted only in the first table in which its two vectors meet, so counts are whole numbers
of different vectors. No pair leaves a task: it sends, per vector, the number of links and the
smallest vector reached inside the block, and components are joined from those.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors of
different lengths never link; repeated rows are copies of each other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .graph import components, local_components, whole_runs

THRESHOLD, RECALL, WIDTH, BLOCK, PER_BUCKET, TURNS = 0.95, 0.999, 3.0, 1024, 12, 2


def rotations(dimension: int, count: int) -> np.ndarray:
    """Fixed random orthogonal matrices, side by side: (dimension, count * dimension)."""
    draw = np.random.default_rng(20_240_517)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(draw.standard_normal((dimension, dimension)))
        out.append(q * np.sign(np.diag(r)))
    return np.hstack(out)


def layout(n: int, dimension: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """bits of a bucket, tables, rotations."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2) / PER_BUCKET))))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - same ** bits)))
    return bits, tables, max(TURNS, math.ceil(bits * tables / dimension))


def usable(v):
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(table, column: str, dimension: int) -> np.ndarray:
    x = table.column(column).to_numpy() if isinstance(table, pa.Table) else table.column(column).to_numpy(zero_copy_only=False)
    x = np.array([np.frombuffer(b, np.float64) for b in x]).reshape(-1, dimension)
    return x


def compare(x, y, same: bool, table: int, codes: tuple, threshold: float, width: float, turns: int, dimension: int, rotation: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Links between two blocks that are counted in this table."""
    (cx, fx), (cy, _) = codes
    turned = (y.astype(np.float32) @ rotation[:, :turns * dimension].astype(np.float32))
    signs = (cx[:, :turns * dimension].astype(np.float32) * 2 - 1) / math.sqrt(dimension)
    estimate, slack = np.zeros((len(x), len(y)), np.float32), np.zeros(len(x))
    for t in range(turns):
        s = slice(t * dimension, (t + 1) * dimension)
        estimate += (signs[:, s] / fx[:, t:t + 1].astype(np.float32)) @ turned[:, s].T
        slack += (1 - fx[:, t] ** 2) / fx[:, t] ** 2
    estimate /= turns
    slack = width * np.sqrt(np.maximum(slack, 0) / turns / (turns * max(dimension - 1, 1)))
    maybe = estimate + slack[:, None] >= threshold
    if same:
        maybe = np.triu(maybe | maybe.T, 1)
    linked = np.zeros(maybe.shape, bool)
    i, j = np.nonzero(maybe)
    if len(i) * 8 > maybe.size:
        linked = maybe & (x @ y.T >= threshold)
    elif len(i):
        for a in range(0, len(i), 65536):
            p, q = i[a:a + 65536], j[a:a + 65536]
            linked[p, q] = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
    if linked.any():
        for t in range(table):  # they met in an earlier table
            kx, ky = key(cx, chosen[t]), key(cy, chosen[t])
            linked &= kx[:, None] != ky[None, :]
    return linked


def key(code: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return code[:, columns] @ (1 << np.arange(len(columns), dtype=np.int64))


def near_vectors(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD,
                 recall: float = RECALL, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = rows.where(usable(F.col("v")))
    classes = stage(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    links = []
    for (d, n) in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():
        links.append(class_links(classes.where(F.size("v") == d), d, n, threshold, recall, width, block))
    found = None
    for part in links:
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    info = stage(classes.join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.withColumn("v", F.when(usable(F.col("v")), F.col("v"))).join(info, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def class_links(classes: DataFrame, dimension: int, n: int, threshold: float, recall: float, width: float, block: int) -> DataFrame:
    """rep, links, label: per block, how many vectors a class newly links with and the smallest class it reaches there."""
    bits, tables, count = layout(n, dimension, threshold, recall)
    rotation = rotations(dimension, count)
    chosen = np.random.default_rng(7).permutation(count * dimension)[:bits * tables].reshape(tables, bits)
    shared = classes.sparkSession.sparkContext.broadcast((rotation, chosen))
    every = TURNS * dimension

    def code(batches):
        turn, columns = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("v")
            x = lists.flatten().to_numpy().reshape(-1, dimension)
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            z = x @ turn
            signs = z > 0
            factor = np.abs(z[:, :every]).reshape(len(x), TURNS, dimension).sum(axis=2) / math.sqrt(dimension)
            packed = np.packbits(signs, axis=1)
            body = [a.tobytes() + b.tobytes() + c.tobytes() for a, b, c in zip(x, factor, packed)]
            buckets = np.stack([key(signs, c) for c in columns], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), pa.array(body, pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(buckets.ravel()))],
                                             ["rep", "copies", "body", "buckets"])

    coded = stage(classes.select("v", "rep", "copies").mapInArrow(code, "rep long, copies long, body binary, buckets array<long>"))
    place = coded.select("rep", F.posexplode("buckets").alias("t", "bucket"))
    sizes = place.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / block).cast("int")
    dealt = place.join(sizes, ["t", "bucket"]).select("rep", "t", "bucket", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("own"))
    cells = dealt.select("rep", "t", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "rep", "t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    # two rows of a block in its own cell coincide; vectors join in last, so that only ids were shuffled so far
    full = cells.join(coded.select("rep", "copies", "body"), "rep")
    groups = ["t", "bucket", "i", "j"]
    size = dimension * 8

    def inside(batches):
        turn, columns = shared.value
        for table, begin in whole_runs(batches, groups):
            rep, copies, t = (table.column(c).to_numpy() for c in ("rep", "copies", "t"))
            second, diagonal = table.column("second").to_numpy(), table.column("i").to_numpy() == table.column("j").to_numpy()
            body = table.column("body").to_pylist()
            out_rep, out_links, out_label = [], [], []
            for a, b in zip(begin[:-1], begin[1:]):
                if b - a < 2:
                    continue
                raw = np.frombuffer(b"".join(body[a:b]), np.uint8).reshape(b - a, -1)
                x = raw[:, :size].copy().view(np.float64)
                f = raw[:, size:size + 8 * TURNS].copy().view(np.float64)
                c = np.unpackbits(raw[:, size + 8 * TURNS:], axis=1)[:, :turn.shape[1]].astype(np.int64)
                if diagonal[a]:
                    linked = compare(x, x, True, int(t[a]), ((c, f), (c, f)), threshold, width, TURNS, dimension, turn, columns)
                    linked = linked | linked.T
                else:
                    s = second[a:b].astype(bool)
                    p, q = np.flatnonzero(~s), np.flatnonzero(s)
                    linked = np.zeros((b - a, b - a), bool)
                    if len(p) and len(q):
                        cross = compare(x[p], x[q], False, int(t[a]), ((c[p], f[p]), (c[q], f[q])), threshold, width, TURNS, dimension, turn, columns)
                        linked[np.ix_(p, q)] = cross
                        linked |= linked.T
                has = np.flatnonzero(linked.any(axis=1))
                if len(has):
                    sub = linked[np.ix_(has, has)]
                    ids = rep[a:b][has]
                    order = np.argsort(ids)
                    label = np.empty(len(has), np.int64)
                    label[order] = ids[order][local_components(sub[np.ix_(order, order)])]
                    out_rep.append(ids)
                    out_links.append(sub @ copies[a:b][has])
                    out_label.append(label)
            if out_rep:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in (out_rep, out_links, out_label)], ["rep", "links", "label"])

    return full.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(inside, "rep long, links long, label long")
