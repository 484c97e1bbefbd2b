"""Trailing service levels at every event of a stream (OPS-7), with the state kept by Spark.

For each event the stream tells events, success rate and P95 of its operation over the last `spans` seconds up to it, as the batch form with range windows does.
Events may arrive in any order within the lateness: a late one corrects the rows of events up to the longest span after it, so a result row
has a version (its batch) and the latest counts. A group is a stretch of `STRETCH` longest spans of an operation, and also holds the events of the longest
span before it, so what a task holds at a time depends on how dense events are, not on how many there are. State is one list per group: events younger
than the longest span before the watermark. A timer at the end of a group's last event empties the state of groups that fall silent; a time to live is
not used, because it goes by the clock and would make replays of old data differ. Events without a time belong to no window and have no row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

SPANS = (300, 3600)
STRETCH = 4  # longest spans in a group; one in STRETCH events is held twice
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = T.StructType([T.StructField("at", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("success", T.BooleanType()), T.StructField("duration", T.DoubleType())])
OUT = "operation string, event_id long, ts timestamp, span long, events long, success_rate double, p95_seconds double"


def smallest(values: np.ndarray, first: np.ndarray, last: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of values[first:last], for all ranges at once: bit by bit of the rank, with values of a clear bit moved to the front."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    found = np.zeros(len(k), np.int64)
    for bit in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
        up = (rank >> bit & 1).astype(bool)
        clear = np.concatenate(([0], np.cumsum(~up)))
        a, b = clear[first], clear[last]
        above = k >= b - a
        found |= above.astype(np.int64) << bit
        k = np.where(above, k - (b - a), k)
        first, last = np.where(above, clear[-1] + first - a, a), np.where(above, clear[-1] + last - b, b)
        rank = np.concatenate((rank[~up], rank[up]))
    return values[order[found]]


def levels_at(at: np.ndarray, success: np.ndarray, duration: np.ndarray, asked: np.ndarray, micros: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """events, success rate and P95 (the value at rank ceil(0.95 n), NaN if there is none) of rows in [t - span, t] for the asked rows; `at` is sorted."""
    first = np.searchsorted(at, at[asked] - micros, side="left")
    last = np.searchsorted(at, at[asked], side="right")
    good = np.concatenate(([0], np.cumsum(success)))
    timed = ~np.isnan(duration)
    before = np.concatenate(([0], np.cumsum(timed)))
    a, b = before[first], before[last]
    top, some = np.full(len(asked), np.nan), b > a
    top[some] = smallest(duration[timed], a[some], b[some], np.ceil(0.95 * (b - a)[some]).astype(np.int64) - 1)
    return last - first, (good[last] - good[first]) / (last - first), top


class Trailing(StatefulProcessor):
    def __init__(self, spans: Sequence[int] = SPANS):
        self.spans = tuple(spans)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", STATE)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([pd.DataFrame({"at": r["at"], "event_id": r["event_id"], "success": r["success"], "duration": r["duration_seconds"]}) for r in rows])
        old = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=["at", "event_id", "success", "duration"])
        both = pd.concat([old, new]) if len(old) else new
        both = both.sort_values(["at", "event_id"], kind="stable").reset_index(drop=True)
        at, longest = both["at"].to_numpy(np.int64), max(self.spans) * 1_000_000
        since = int(new["at"].min())
        asked = np.flatnonzero((at >= since) & (at <= int(new["at"].max()) + longest) & (at // (STRETCH * longest) == key[1]))
        success, duration = both["success"].to_numpy(bool), both["duration"].to_numpy(float)
        for span in self.spans:
            events, rate, top = levels_at(at, success, duration, asked, span * 1_000_000)
            yield pd.DataFrame({"operation": key[0], "event_id": both["event_id"].to_numpy(np.int64)[asked], "ts": pd.to_datetime(at[asked], unit="us"),
                                "span": span, "events": events, "success_rate": rate, "p95_seconds": top})
        # a later event may still arrive at the watermark, and looks back the longest span from there
        keep = both[at >= timerValues.getCurrentWatermarkInMs() * 1000 - longest]
        if len(keep):
            self.held.put([tuple(r) for r in keep[["at", "event_id", "success", "duration"]].astype(object).itertuples(index=False)])
        else:
            self.held.clear()  # a list in the state is never empty
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(int(at[-1] // 1000) + max(self.spans) * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def dealt(timed: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Rows by stretch: an event goes to each in which a window may hold it, its own and, near the end, the next."""
    longest = max(spans) * 1_000_000
    size = F.lit(STRETCH * longest)
    own, reach = (((at - F.pmod(at, size)) / size).cast("long") for at in (F.col("at"), F.col("at") + F.lit(longest)))
    return timed.withColumn("stretch", F.explode(F.sequence(own, reach)))


def trailing_stream(ops: DataFrame, spans: Sequence[int] = SPANS, late: str = "2 hours") -> DataFrame:
    """Versions of (operation, event_id, ts, span, events, success_rate, p95_seconds); rows later than the watermark are dropped."""
    timed = ops.withWatermark("ts", late).select("operation", "ts", F.unix_micros("ts").alias("at"), "event_id", "success", "duration_seconds")
    return dealt(timed, spans).groupBy("operation", "stretch").transformWithStateInPandas(Trailing(spans), OUT, "Update", "EventTime")


def run_trailing(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available; each batch overwrites its own folder."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last version of each event and span."""
    rows = spark.read.parquet(path)
    keys = ["operation", "event_id", "ts", "span"]
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def trailing_batch(ops: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """The same levels over a table, by range windows."""
    d = ops.withColumn("at", F.unix_micros("ts"))
    out = None
    for span in spans:
        w = Window.partitionBy("operation").orderBy("at").rangeBetween(-span * 1_000_000, 0)
        held = F.array_sort(F.collect_list("duration_seconds").over(w))
        p95 = F.get(held, (F.ceil(F.size(held) * 0.95) - 1).cast("int"))
        one = d.select("operation", "event_id", "ts", F.lit(span).cast("long").alias("span"), F.count("*").over(w).alias("events"), F.avg(F.col("success").cast("double")).over(w).alias("success_rate"), p95.alias("p95_seconds"))
        out = one if out is None else out.unionByName(one)
    return out
