"""Mix sources to target weights by repeating whole documents.

Words are summed per source. A source's target is its share, by weight, of all words; a target above `repeat` times the source's
words stops there and the excess goes to the others by weight, until none is above. Sorted by words per weight, the sources that
stop are the first ones, and each is known from running sums of words and weights before it, so the reshare needs no rounds.

A source's rate is its target divided by its words. Each document is emitted floor(rate) times, plus once more with a probability
equal to the fraction: its draw is a hash of seed, id and text, so reruns, retried tasks and other partitionings agree, and rows that share
an id draw apart unless they are the same document. The words taken of a source differ from its target by the spread of those draws, which is wide where
few long documents make up a source. So every document has `tries` draws, and each source uses the one whose words come nearest to its target;
one aggregate adds up all of them.

Sources are numbered, and summed in order, over ranges of a sorted table, so their number may grow; the table of sources meets the
documents by a broadcast only where its measured size allows. Elsewhere a source that holds many rows is split by the planner, which
can do so because both sides are plain scans of written tables. Documents are read once for sizes and draws, which are written (no text).

Defined cases: null and empty texts have no words: size 0, taken 0, and copies like other documents of their source. A null source is a
source of its own, last in order. A source without words has target 0 and rate 0. Repeated rows are documents of their own with equal draws. An
empty table gives an empty result. Very long texts are counted whole. Extra columns are kept by `emit` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import small_side, stage
from .rowkeys import fresh

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, REPEAT, SEED, TRIES = (5, 2, 1), 3, 13, 16


def draw(doc_id: str, text: str, seed: int) -> Column:
    """Two numbers in [0, 1) that depend on the seed, the id and the whole text: twice 48 bits of their MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    part = lambda a: F.conv(F.substring(F.md5(key), a, 12), 16, 10).cast("double") / float(1 << 48)
    return F.array(part(1), part(13))


def tried(draws: Column, k: Column | int) -> Column:
    """The k-th draw: steps of the second number from the first, modulo 1; exact for 48 bits and k below 16."""
    u = draws[0] + draws[1] * k
    return u - F.floor(u)


def copies_of(rate: Column, draws: Column, k: Column | int) -> Column:
    return F.floor(rate) + (tried(draws, k) < rate - F.floor(rate)).cast("long")


def running_before(rows: DataFrame, order: Sequence[Column], **values: Column) -> DataFrame:
    """`rows` with sums of `values` over all rows that come before in `order`, over ranges of rows that tasks hold one each."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(rows.withColumns(values).repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range, at most n
    ranges = placed.groupBy("range").agg(*(F.sum(v).alias(v) for v in values))
    ends = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("range", *(F.coalesce(F.sum(v).over(ends), F.lit(0)).alias(f"{v}_offset") for v in values))
    joined = placed.join(F.broadcast(offsets), "range")
    sums = {v: F.coalesce(F.sum(v).over(before), F.lit(0)) + F.col(f"{v}_offset") for v in values}
    return joined.select(*rows.columns, *(c.alias(v) for v, c in sums.items()))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, target, rate: one row per source of `sizes` (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_before(sources, [F.col("source").asc_nulls_last()], rank=F.lit(1).cast("long"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * repeat)
    weighed = stage(weighed.drop("rank"))
    all_words, all_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    ordered = running_before(weighed, [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()], most_before=F.col("most"), weight_before=F.col("weight"))
    words, weight = F.lit(all_words or 0) - F.col("most_before"), F.lit(all_weight or 0.0) - F.col("weight_before")
    stops = F.col("most") * weight < F.col("weight") * words
    ordered = stage(ordered.withColumn("stops", stops))
    stopped = ordered.where("stops").agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rest, among = (all_words or 0) - stopped[0], (all_weight or 0.0) - stopped[1]
    share = F.col("weight") * float(rest) / F.lit(float(among or 1))
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(share)
    out = ordered.select("source", "source_size", target.alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(repeat)))).otherwise(F.lit(0.0)))


def sizes_and_draws(docs: DataFrame, seed: int, text: str, doc_id: str, source: str) -> DataFrame:
    return stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                             F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), draw(doc_id, text, seed).alias("draws")))


def met(rows: DataFrame, table: DataFrame, source: Column, its: str) -> DataFrame:
    """Rows next to their source's line; the table is one row per source."""
    return rows.join(table, source.eqNullSafe(F.col(its)))


def planned(sized: DataFrame, weights: Sequence[float], repeat: int, tries: int) -> DataFrame:
    """its, source_size, target, rate, try: what each source takes, and which of its documents' draws."""
    table = small_side(targets(sized, weights, repeat).withColumnRenamed("source", "its"))
    rate = F.col("rate")
    extra = [F.sum(F.when(tried(F.col("draws"), k) < rate - F.floor(rate), F.col("size")).otherwise(0)).alias(f"extra_{k}") for k in range(tries)]
    sums = met(sized.select("source", "size", "draws"), table, F.col("source"), "its").groupBy("its", "source_size", "target", "rate").agg(*extra)
    miss = F.array(*[F.struct(F.abs(F.floor(rate) * F.col("source_size") + F.col(f"extra_{k}") - F.col("target")).alias("miss"), F.lit(k).alias("k")) for k in range(tries)])
    return small_side(sums.select("its", "source_size", "target", "rate", F.array_min(miss)["k"].alias("try")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeat: int = REPEAT, seed: int = SEED, text: str = "text", doc_id: str = "doc_id",
        source: str = "source", tries: int = TRIES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies. tries: at most 16."""
    sized = sizes_and_draws(docs, seed, text, doc_id, source)
    rows = met(sized, planned(sized, weights, repeat, tries), F.col("source"), "its")
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", copies_of(F.col("rate"), F.col("draws"), F.col("try")).alias("copies"))


def emit(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeat: int = REPEAT, seed: int = SEED, text: str = "text", doc_id: str = "doc_id",
         source: str = "source", copy: str = "copy", tries: int = TRIES) -> DataFrame:
    """The mixed corpus: rows of `docs` as often as the mix takes them, numbered from 1 in column `copy`.

    Only the lines of sources meet the documents, so no text is shuffled where they can be broadcast.
    """
    names = docs.columns
    its, rate, k = (fresh(names, n) for n in ("its_source", "its_rate", "its_try"))
    table = planned(sizes_and_draws(docs, seed, text, doc_id, source), weights, repeat, tries)
    table = table.select(F.col("its").alias(its), F.col("rate").alias(rate), F.col("try").alias(k))
    copies = copies_of(F.col(rate), draw(doc_id, text, seed), F.col(k))
    rows = met(docs, small_side(table), F.col(source).cast("string"), its)
    return rows.where(copies > 0).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copy))
