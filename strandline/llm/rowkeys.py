"""A key of its own for every row, in the order of ids, for operators that decide by document where ids repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage


def fresh(names: Sequence[str], name: str) -> str:
    """`name`, with underscores in front until no column is called so."""
    while name.lower() in {n.lower() for n in names}:
        name = "_" + name
    return name


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", nulls: bool = False) -> tuple[DataFrame, str, bool]:
    """Rows with a long key, the key's name, and whether it differs from the id.

    Where ids are unique the key is the id. Otherwise rows are written once with keys in the order of ids, then of text
    hashes. Rows without an id have no key, or with `nulls` keys after all others.
    """
    key = fresh(docs.columns, "row_key")
    count = docs.groupBy(F.col(doc_id).alias("id")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max(F.when(F.col("id").isNotNull(), F.col("n"))).alias("most"), F.max(F.when(F.col("id").isNull(), F.col("n"))).alias("none")).first()
    if (count.most or 1) == 1 and not (nulls and count.none):
        return docs.withColumn(key, F.col(doc_id).cast("long")), key, False
    # ranges are numbered in their order; the last column spreads the rows of one text
    first = F.col(doc_id).asc_nulls_last()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.repartitionByRange(n, first, F.xxhash64(text), F.rand(7)).sortWithinPartitions(first, F.xxhash64(text))
    number = F.monotonically_increasing_id()
    return stage(placed.withColumn(key, number if nulls else F.when(F.col(doc_id).isNotNull(), number))), key, True


def ids_of(judged: DataFrame, rows: DataFrame, key: str, doc_id: str, columns: Sequence[str]) -> DataFrame:
    """`judged` with the keys in `columns` replaced by the ids they stand for."""
    names = judged.columns
    ids = stage(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("its_key"), F.col(doc_id).cast("long").alias("its_id")))
    for c in columns:
        judged = judged.join(ids, F.col(c) == F.col("its_key"), "left").drop("its_key").withColumn(c, F.col("its_id")).drop("its_id")
    return judged.select(names)
