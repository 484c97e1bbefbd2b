"""A corpus pipeline: toxic documents go, then exact copies, near duplicates and repeated passages; what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. A
stage's result is written to the shared folder and read again as the next one's documents. Rows without an id pass the
duplicate stages untouched.

The duplicate stages decide by row. Where ids are unique, a row's key is its id; where some repeat, rows are written once
more with a key in the order of ids, so one row of each text stays and rows of other texts under one id are untouched.

Defined cases: a null text is an empty one to every stage; empty texts pass toxicity, are copies of each other, are never near
duplicates and lose no words; empty tables give empty tables; extra columns are kept, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.stage import stage
from strandline.llm import toxicity
from strandline.llm.exact_dedup import exact_duplicates
from strandline.llm.near_dedup import near_duplicates
from strandline.llm.packing import pack
from strandline.llm.rowkeys import fresh, keyed
from strandline.llm.substrings import remove_repeats


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.without_toxic(docs, model)


def keep(rows: DataFrame, key: str, judged: DataFrame) -> DataFrame:
    """Rows that are kept in `judged`, whose doc_id is the key. What goes is fewer rows than what stays, so that side is matched."""
    gone = judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key, _ = keyed(docs)
    return keep(rows, key, exact_duplicates(rows, doc_id=key)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key, _ = keyed(docs)
    return keep(rows, key, near_duplicates(rows, doc_id=key, unique=True)).select(docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key, _ = keyed(docs)
    new = fresh(rows.columns, "new_text")
    cut = remove_repeats(rows, doc_id=key, unique=True).where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("kept_text").alias(new))
    rows = rows.join(cut, key, "left")
    changed = F.col(new).isNotNull()
    columns = {"text": F.when(changed, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumns(columns).select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("substring dedup", drop_passages), ("packing", pack_documents)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
