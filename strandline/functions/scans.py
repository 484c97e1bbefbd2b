"""As-of joins and running values over series of any length.

A daily series fits one task; ticks of one key may not. Here rows are dealt to tasks by ranges of (key, time), so a key that holds a third of all rows
takes a third of the tasks. Inside a range a window does the work; what a range inherits from earlier ranges of its key is a
summary of a row per (key, range), scanned over ranges. Only keys that span ranges have a summary to inherit, at most two per range, so that side is
bounded by the number of ranges. No calendar is expanded and nothing that grows with the data is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import stage


def ranged(rows: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Rows written with `_range`, the number of their range in `order`; ranges are numbered in order."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def inherited(parts: DataFrame, keys: Sequence[str], carry: dict[str, Column]) -> DataFrame:
    """(keys, _range, carried columns) of keys that span ranges. parts: one row per (keys, _range); `carry` maps an exclusive running window to values."""
    parts = parts.withColumn("_spans", F.count("*").over(Window.partitionBy(*keys))).where("_spans > 1")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_range", *[c.over(earlier).alias(name) for name, c in carry.items()])


def met(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    carried = carried.select(*[F.col(k).alias(f"{k}_c") for k in keys], F.col("_range").alias("_range_c"), *[c for c in carried.columns if c not in (*keys, "_range")])
    same = F.col("_range") == F.col("_range_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_c"))
    return rows.join(F.broadcast(carried), same, "left").drop("_range_c", *[f"{k}_c" for k in keys])  # at most two rows per range


def number(c: str, kind: str) -> Column:
    """Times as numbers: micros of timestamps, days of dates."""
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp"))
    return F.unix_date(c).cast("long") if kind == "date" else F.col(c)


def asof_backward(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (), tolerance: float | None = None, ranges: int | None = None) -> DataFrame:
    """`left` with `values` of the last row of `right` at or before it, per `by`; NULL beyond `tolerance` (seconds, days or units of `on`).

    Of several right rows at one time the one with the greatest values counts. Rows of `right` without a time or key match nothing, as do
    such rows of `left`, which stay.
    """
    kind = dict(left.dtypes)[on]
    unit = 1_000_000 if kind.startswith("timestamp") else 1
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(b).alias(k) for b, k in zip(by, keys)]
    kept = right.where(F.col(on).isNotNull()).na.drop(subset=list(by)) if by else right.where(F.col(on).isNotNull())
    points = kept.select(*named, number(on, dict(right.dtypes)[on]).alias("_t"), F.lit(0).alias("_side"), F.struct(number(on, dict(right.dtypes)[on]).alias("_at"), *values).alias("_point"))
    asked = left.select(*named, number(on, kind).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    rows = ranged(asked.unionByName(points, allowMissingColumns=True), [*keys, "_t", "_side"], ranges)
    w = Window.partitionBy("_range", *keys).orderBy("_t", "_side", "_point").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.last("_point", ignorenulls=True).over(w)).where("_side = 1")
    parts = rows.groupBy("_range", *keys).agg(F.max("_point").alias("_last"))
    keys_ = keys or ["_all"]
    if not keys:
        parts, here = parts.withColumn("_all", F.lit(0)), here.withColumn("_all", F.lit(0))
    carried = inherited(parts, keys_, {"_before": F.last("_last", ignorenulls=True)})
    found = met(here, carried, keys_).withColumn("_found", F.coalesce("_here", "_before"))
    near = F.col("_found._at").isNotNull() & F.col("_t").isNotNull()
    if tolerance is not None:
        near = near & (F.col("_t") - F.col("_found._at") <= tolerance * unit)
    return found.select("_row.*", *[F.when(near, F.col(f"_found.{v}")).alias(v) for v in values])


def running_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """`rows` with `total` (running sum of value), `peak` (running maximum of total) and `fall` (total below peak), per keys in `order`."""
    placed = ranged(rows, [*keys, *order], ranges)
    w = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("_s", F.sum(value).over(w)).withColumn("_m", F.max("_s").over(w))
    parts = inside.groupBy("_range", *keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_sum"), F.max("_m").alias("_top"))
    # a range's peak counts from the total it starts with
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_from", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0))).withColumn("_peak", F.col("_from") + F.col("_top"))
    carried = inherited(parts, keys, {"_before": F.sum("_sum"), "_high": F.max("_peak")})
    start = F.coalesce("_before", F.lit(0.0))
    out = met(inside, carried, keys).withColumn("total", start + F.col("_s")).withColumn("peak", F.greatest(start + F.col("_m"), F.col("_high")))
    return out.withColumn("fall", F.col("total") - F.col("peak")).drop("_range", "_s", "_m", "_before", "_high")
