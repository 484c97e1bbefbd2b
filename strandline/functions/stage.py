"""Cut a plan by writing an intermediate table to the shared folder.

Written as Parquet rather than checkpointed rows, so later reads still prune columns and push filters
down. The table survives the loss of any executor, and a step that needs its input several times reads
it from here instead of repeating the work above it.

All tables of an application lie under one folder, `strandline-<application id>`, of the shared folder. Results are
lazy and may read them, so they stay until the job that owns the results calls `drop_staged`, after which its
DataFrames can no longer be read. A folder whose application has ended can be deleted as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def staged_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/strandline-{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Delete every table staged by this application, through the file system that holds the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{staged_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 500_000  # narrow per-group rows; about 50 MB at the most


def broadcast_counted(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a narrow table whose row count was measured; beyond the limit the planner shuffles it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_side(df: DataFrame) -> DataFrame:
    """A per-group aggregate made ready to meet its own raw rows: written once, counted, broadcast if small.

    Without this the planner cannot know that the aggregate is small and would shuffle the raw rows.
    """
    written = stage(df)
    return broadcast_counted(written, written.count())
