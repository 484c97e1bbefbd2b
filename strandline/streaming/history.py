"""Incremental validation with history (STR-2): a stream is judged by entity and day, and limits adapt to the days before.

A batch lands its rows, then judges every day from its earliest one on, from what has landed up to it and from the verdicts of earlier
days. Verdicts, good rows and dead letters are written under the batch that judged them, and the latest verdict of an (entity, day) counts, so days
that arrive in several batches, late rows and replays end as one run over all rows would. A batch reads folders of batches before it and overwrites its own:
a retry changes nothing.

What is read again grows with the lateness of the data, not with its history: a batch in order judges its own days only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import messages
from ..operators.silver import null_severity, quality_score

DAY = ["entity", "day"]


def judged_days(days: DataFrame, base: float, last: int, buffer: float) -> DataFrame:
    """days: entity, day, n_rows, nulls, bad. Adds null_pct, null_limit (base, or mean + 2 deviations of the last days, at most the ceiling), severity and score."""
    d = days.withColumn("null_pct", F.col("nulls") * 100.0 / F.col("n_rows"))
    w = Window.partitionBy("entity").orderBy("day").rowsBetween(-last, -1)
    usual = F.avg("null_pct").over(w) + 2 * F.stddev_pop("null_pct").over(w)
    d = d.withColumn("null_limit", F.greatest(F.lit(base), F.least(F.lit(float(X.NULL_LIMIT_CEILING)), F.coalesce(usual, F.lit(0.0)))))
    d = d.withColumns({"severity": null_severity("n_rows", "null_pct", "null_limit", buffer), "_none": F.lit(0), "_one": F.lit(1)})
    return d.withColumn("score", quality_score("nulls", "_none", "bad", "n_rows", "_one")).drop("_none", "_one")


def process_batch(batch: DataFrame, batch_id: int, root: str, rules: list[tuple[Column, str]], base: float = 15.0, last: int = 5, buffer: float = float(X.WARN_TO_FAIL_BUFFER)) -> None:
    """batch: entity, ts, event_id, value and whatever `rules` read."""
    spark = batch.sparkSession
    batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").parquet(f"{root}/landed/batch={batch_id}")
    landed = spark.read.parquet(f"{root}/landed").where(F.col("batch") <= batch_id)
    own = landed.where(F.col("batch") == batch_id)
    own.where("day IS NULL").withColumn("failed_rules", F.array(F.lit("date_missing"))).drop("batch").write.mode("overwrite").parquet(f"{root}/undated/batch={batch_id}")
    since = own.agg(F.min("day")).first()[0]
    if since is None:
        return
    rows = landed.where(F.col("day") >= F.lit(since)).drop("batch")
    repeated = F.row_number().over(Window.partitionBy(*DAY, "event_id").orderBy("ts", F.xxhash64("value"))) > 1
    rows = rows.withColumn("failed_rules", messages(*rules, (repeated, "repeated_event")))
    days = rows.groupBy(*DAY).agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(F.size("failed_rules") > 0).alias("bad"))
    before = latest_verdicts(spark, root, batch_id - 1)
    if before is not None:
        days = days.unionByName(before.where(F.col("day") < F.lit(since)).select(days.columns))
    judged = judged_days(days, base, last, buffer).where(F.col("day") >= F.lit(since))
    judged.write.mode("overwrite").parquet(f"{root}/verdicts/batch={batch_id}")
    verdicts = spark.read.parquet(f"{root}/verdicts/batch={batch_id}").select(*DAY, "severity")
    told = rows.join(verdicts, DAY).withColumn("failed_rules", F.when(F.col("severity") == "fail", F.array_append("failed_rules", "null_share_above_limit")).otherwise(F.col("failed_rules"))).drop("severity")
    told.where(F.size("failed_rules") == 0).drop("failed_rules").write.mode("overwrite").parquet(f"{root}/good/batch={batch_id}")
    told.where(F.size("failed_rules") > 0).write.mode("overwrite").parquet(f"{root}/dead/batch={batch_id}")


def latest_verdicts(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame | None:
    """One row per (entity, day) with the batch that judged it last; None before the first batch."""
    if upto is not None and upto < 0:
        return None
    rows = spark.read.parquet(f"{root}/verdicts")
    rows = rows if upto is None else rows.where(F.col("batch") <= upto)
    rest = [c for c in rows.columns if c not in (*DAY, "batch")]
    return rows.groupBy(*DAY).agg(F.max("batch").alias("batch"), F.max_by(F.struct(*rest), "batch").alias("_r")).select(*DAY, "batch", "_r.*")


def current(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Rows of `good` or `dead` as the latest verdicts have them; dead letters without a date included."""
    rows = spark.read.parquet(f"{root}/{kind}").join(latest_verdicts(spark, root).select(*DAY, "batch"), [*DAY, "batch"]).drop("batch")
    return rows if kind == "good" else rows.unionByName(spark.read.parquet(f"{root}/undated").drop("batch"), allowMissingColumns=True)


def run(stream: DataFrame, root: str, checkpoint: str, rules: list[tuple[Column, str]], **limits) -> None:
    stream.writeStream.foreachBatch(lambda b, i: process_batch(b, i, root, rules, **limits)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
