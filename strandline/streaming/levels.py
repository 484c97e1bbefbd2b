"""Rolling service levels on a stream of operation events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"), F.col("user_id").alias("component"),
                                  F.col("value").alias("duration_seconds"), (F.col("event_type") != "error").alias("success"), "event_id")


def rolling_levels(ops: DataFrame, span: str = "1 hour", slide: str = "5 minutes", late: str = "2 hours") -> DataFrame:
    """Events, success and error rate and P95 per (window, operation); batch input gives the same windows.

    P95 is the mergeable sketch at an accuracy of 1 in 10,000: a stream keeps bounded state per window.
    Rows later than the watermark are dropped.
    """
    if ops.isStreaming:
        ops = ops.withWatermark("ts", late)
    a = ops.groupBy(F.window("ts", span, slide).alias("w"), "operation").agg(
        F.count("*").alias("events"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.percentile_approx("duration_seconds", 0.95, 10000).alias("p95_seconds"))
    return a.select(F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "operation", "events", "success_rate", (1 - F.col("success_rate")).alias("error_rate"), "p95_seconds")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available. Every batch writes the windows it changed to its own folder, which a retry overwrites,
    so windows still open at the watermark are there as well; `current_levels` reads the latest state of each."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def current_levels(spark: SparkSession, path: str) -> DataFrame:
    """One row per (window, operation): the one of the last batch that changed it."""
    rows = spark.read.parquet(path)
    keys = ["from_ts", "to_ts", "operation"]
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
