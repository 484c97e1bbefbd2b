"""Connected components of a link table, as Spark joins, and helpers for sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). One row per id that has a link: id, component (the smallest id it reaches).

    Large-star and small-star steps alternate: every id tells its larger, then its smaller neighbours about the
    smallest id it knows, until only stars are left. The number of rounds grows with the logarithm of the longest
    path; a hub is a skewed join key, which the planner splits, and minima are combined before they are shuffled.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if tuple(now) == mark or not now.n:
            break
        mark = tuple(now)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    # only stars: every id points to its component
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def whole_runs(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables that hold whole runs of equal keys, and where the runs begin (one more entry).

    Only a run that crosses batches is copied.
    """
    held: list[pa.RecordBatch] = []

    def key(batch):
        return [batch.column(k)[0].as_py() for k in keys]

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        return table, np.array([0, table.num_rows])

    for batch in batches:
        if not batch.num_rows:
            continue
        begin = run_starts(batch, keys)
        first = 0
        if held and key(batch) == key(held[0]):
            first = 1 if len(begin) > 1 else len(begin)
            held.append(batch.slice(0, int(begin[1]) if len(begin) > 1 else batch.num_rows))
            if len(begin) == 1:
                continue
        if held:
            yield joined()
        a, b = int(begin[first]), int(begin[-1])
        if b > a:
            yield pa.Table.from_batches([batch.slice(a, b - a)]), begin[first:] - a
        held = [batch.slice(b)]
    if held:
        yield joined()


def run_starts(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k)
        v = v.to_numpy() if isinstance(table, pa.Table) else v.to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each row of a symmetric matrix of links."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label, len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new
