"""Exact quantiles of groups that may be arbitrarily large.

`percentile` keeps a group's distinct values in one task's memory. That is right for a calendar-bound
series and wrong for raw rows. Here every pass is an aggregate with map-side combine: the range of a
group is cut into equal cells, cell counts locate the wanted rank, and only the cell that holds it is
cut again. The last pass ranks the few distinct values left. Nothing but counts is shuffled, a hot key
or a block of copies collapses before the shuffle, and the answer is exact for any distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import broadcast_counted, stage

CELLS = 1024
SMALL_GROUP = 1_000_000  # up to this many rows a group's values fit one task's aggregation buffer


def rank_values(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, n_ranks: int, rounds: int = 2) -> DataFrame:
    """Value at zero-based `rank` for each row of `ranks` (keys, rank, _lo, _hi); nulls are not ranked.

    _lo and _hi are the least and greatest value of the group. `ranks` has one row per group and wanted
    rank; every pass keeps that number of rows, so its measured count decides on broadcasting.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    want = ranks.select(*keys, "rank", F.col("rank").alias("_rest"), "_lo", "_hi").distinct()
    cell = F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * CELLS), F.lit(CELLS - 1))
    cell = F.coalesce(cell, F.lit(0)).cast("long")
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    w_rank = Window.partitionBy(*keys, "rank")

    def containing(counts: DataFrame, order: str) -> DataFrame:
        upto = F.sum("_n").over(w_rank.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn("_upto", upto).where(
            (F.col("_rest") >= F.col("_upto") - F.col("_n")) & (F.col("_rest") < F.col("_upto")))

    for _ in range(rounds):
        # each cell reports the least and greatest value it holds, so the next pass cuts real data range
        counts = (
            data.join(broadcast_counted(want, n_ranks), keys).where(inside).groupBy(*keys, "rank", "_rest", cell.alias("_cell"))
            .agg(F.count("*").alias("_n"), F.min("_v").alias("_clo"), F.max("_v").alias("_chi"))
        )
        want = containing(counts, "_cell").select(
            *keys, "rank", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest"),
            F.col("_clo").alias("_lo"), F.col("_chi").alias("_hi"))
    left = data.join(broadcast_counted(want, n_ranks), keys).where(inside).groupBy(*keys, "rank", "_rest", "_v").agg(F.count("*").alias("_n"))
    return containing(left, "_v").select(*keys, "rank", F.col("_v").alias("value"))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    interpolate: bool = True) -> DataFrame:
    """One row per group with a column per named probability.

    interpolate=True is linear interpolation between neighbours; False takes the element at
    floor(p * (n - 1)).
    """
    keys = list(keys)
    totals = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min(F.col(value).cast("double")).alias("_lo"), F.max(F.col(value).cast("double")).alias("_hi"))
    plist = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in probs.items()])
    pos = totals.select(*keys, F.explode(plist).alias("_q"), "_n", "_lo", "_hi").select(
        *keys, F.col("_q.name").alias("_name"), (F.col("_q.p") * (F.col("_n") - 1)).alias("_pos"), "_n", "_lo", "_hi")
    lo = F.floor("_pos").cast("long")
    hi = F.least(lo + 1, F.col("_n") - 1) if interpolate else lo
    spots = stage(pos.select(*keys, "_name", (F.col("_pos") - lo).alias("_f"),
                       F.explode(F.array_distinct(F.array(lo, hi))).alias("rank"), lo.alias("_lo_rank"), "_lo", "_hi"))
    found = rank_values(df, keys, value, spots, spots.count())
    both = spots.drop("_lo", "_hi").join(found, [*keys, "rank"])
    is_lo = F.col("rank") == F.col("_lo_rank")
    v_lo, v_hi = F.max(F.when(is_lo, F.col("value"))), F.max(F.when(~is_lo, F.col("value")))
    per = both.groupBy(*keys, "_name").agg(v_lo.alias("_a"), v_hi.alias("_b"), F.first("_f").alias("_f"))
    val = F.when(F.col("_b").isNull() | F.lit(not interpolate), F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    per = per.withColumn("_val", val)
    aggs = [F.max(F.when(F.col("_name") == k, F.col("_val"))).alias(k) for k in probs]
    return per.groupBy(*keys).agg(*aggs)


def sized_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], biggest_group: int) -> DataFrame:
    """`percentile` when the largest group is known to be small, the counting passes otherwise."""
    if biggest_group > SMALL_GROUP:
        return group_quantiles(df, keys, value, probs)
    both = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
    return df.groupBy(*keys).agg(both.alias("_q")).select(*keys, *[F.col("_q")[i].alias(k) for i, k in enumerate(probs)])


def expanding_quantiles(df: DataFrame, keys: Sequence[str], block: str, blocks: int, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, block, feature, n, q): interpolated quantiles of all rows in earlier blocks, for every block from 1 to `blocks`.

    Values are counted per block, so repeated values are one row. One sort by value serves all blocks: running counts of the rows before each block tell
    which value holds a wanted rank. Nothing is sorted or read again for a further block. keys name series, whose number of values the calendar bounds.
    """
    keys = [*keys, "feature"]
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_v")) for c in columns])
    long = df.select(*keys[:-1], F.col(block).alias("_b"), F.inline(items)).where("_v IS NOT NULL AND NOT isnan(_v)")
    before = [F.count_if(F.col("_b") < b).alias(f"_c{b}") for b in range(1, blocks + 1)]
    counts = long.groupBy(*keys, "_v").agg(*before)
    w = Window.partitionBy(*keys)
    upto = w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    each = [F.struct(F.lit(b).cast("long").alias("block"), F.col(f"_c{b}").alias("_c"), F.sum(f"_c{b}").over(upto).alias("_upto"), F.sum(f"_c{b}").over(w).alias("_n")) for b in range(1, blocks + 1)]
    rows = counts.select(*keys, "_v", F.array(*each).alias("_e")).select(*keys, "_v", F.inline("_e")).where("_c > 0")
    aggs, out = [], []
    for i, p in enumerate(probs):
        at = (F.col("_n") - 1) * float(p)
        for j, rank in enumerate((F.floor(at), F.ceil(at))):
            aggs.append(F.max(F.when((rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_v"))).alias(f"_q{i}{j}"))
        share = (F.col("n") - 1) * float(p) - F.floor((F.col("n") - 1) * float(p))
        out.append(F.col(f"_q{i}0") + (F.col(f"_q{i}1") - F.col(f"_q{i}0")) * share)
    found = rows.groupBy(*keys, "block").agg(F.max("_n").alias("n"), *aggs)
    return found.select(*keys[:-1], F.col("block").alias(block), "feature", "n", F.array(*out).alias("q"))


def by_feature(quantiles: DataFrame, keys: Sequence[str], columns: Sequence[str], value) -> DataFrame:
    """(keys, stats): one array per key, in the order of `columns`, NULL where a feature has no value yet."""
    parts = [F.max(F.when(F.col("feature") == c, value)) for c in columns]
    return quantiles.groupBy(*keys).agg(F.array(*parts).alias("stats"))
