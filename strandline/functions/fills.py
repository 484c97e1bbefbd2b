"""Forward and backward fill for raw entities, whose row count the calendar does not bound.

Copies of one day may be a third of a table, so a plain window over an entity could land in one task.
Rows are cut into runs of (day, block of ingest order). Each run reports its last and first known value
(an aggregate with map-side combine), the runs of an entity are filled by one window (at most days plus
rows/BLOCK of them), and the result is joined back to fill inside each run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import SMALL_GROUP

BLOCK = 100_000


def fill_both_ways(df: DataFrame, keys: Sequence[str], value: str, day: str = "date", seq: str = "seq",
                   out: str = "filled", biggest_group: int | None = None) -> DataFrame:
    """Last known value carried forward in (day, seq) order, then the first known one carried back.

    When the largest group is known to fit a task, one window does; otherwise rows are filled by runs.
    """
    keys = list(keys)
    if biggest_group is not None and biggest_group <= SMALL_GROUP:
        w = Window.partitionBy(*keys).orderBy(day, seq)
        return df.withColumn(out, F.coalesce(
            F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    run = [*keys, day, "_run"]
    data = df.withColumn("_run", F.floor(F.col(seq) / BLOCK).cast("long"))
    known = F.col(value).isNotNull()
    ends = data.groupBy(*run).agg(
        F.max_by(value, F.when(known, F.col(seq))).alias("_last"),
        F.min_by(value, F.when(known, F.col(seq))).alias("_first"),
    )
    w = Window.partitionBy(*keys).orderBy(day, "_run")
    ends = ends.select(
        *run,
        F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inner = Window.partitionBy(*run).orderBy(seq)
    fwd = F.last(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(value, ignorenulls=True).over(inner.rowsBetween(0, Window.unboundedFollowing))
    return (
        data.join(ends, run)
        .withColumn(out, F.coalesce(fwd, F.col("_before"), back, F.col("_after")))
        .drop("_run", "_before", "_after")
    )
