"""Exact duplicates by an extendible-hash index over whole texts on shared files.

A text's key is a 64-bit hash of its normalised form. The index has a directory, addressed by the leading bits of a key, and buckets,
each a range of keys. Directory doubling: as long as a bucket holds more than `capacity` keys, one more leading bit tells its halves
apart; only overfull buckets split, so several directory slots may name one bucket.

Every text goes through the directory to its bucket and is shuffled there. The task that owns a bucket walks its keys in order and keeps a chain of
the different texts under each key; a text is compared with the chain byte by byte, and joins the entry it equals or extends the chain. What an
entry gathers (smallest id, number of rows) decides the result. Copies are combined before the shuffle: within a batch by the text
itself, and texts that repeat within a batch are carried on to the end of the task, so a text that holds a third of all rows reaches its
owner as about one row per task. Buckets and directory are tables in the shared folder, so a later batch can be looked up in an index built before.

A document then finds its entry by (key, SHA-256), written once for all documents; a document of a hot text is an ordinary row of a join that the
planner splits.

Defined cases: a null text counts as empty; equal empty texts are copies of each other; the smallest id
stays, also among repeated rows of one id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import broadcast_counted, stage

CAPACITY = 4096  # entries of a bucket
KEY_BITS = 64
CARRIED, CARRIED_BYTES = 4096, 32 << 20  # repeated texts a task carries on, and their size
STEP_BITS = 4  # bits added to the histogram when a bucket is still overfull at its finest cell


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def slot(key: Column, bits: Column | int) -> Column:
    """The leading bits of a key as a number; none for no bits."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", key, (F.lit(KEY_BITS) - bits).cast("int")))


@dataclass
class Index:
    buckets: DataFrame  # bucket, local_depth, key, chain, text_sha256, keep_id, group_size
    directory: DataFrame  # slot, bucket, local_depth: the slots of a directory of `depth` bits
    depth: int


def combined(batches):
    """Rows (key, text, keep_id, n) with the copies inside a task combined; see the limits of what is carried."""
    held: dict[tuple[int, str], list] = {}
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table({"key": batch.column("key"), "text": batch.column("text").cast(pa.large_string()), "keep_id": batch.column("doc_id"), "n": pa.array([1] * batch.num_rows, pa.int64())})
        table = table.group_by(["key", "text"]).aggregate([("keep_id", "min"), ("n", "sum")])
        rows = []
        for key, text, keep, n in zip(*(table.column(c).to_pylist() for c in ("key", "text", "keep_id_min", "n_sum"))):
            known = held.get((key, text))
            if known is None and n > 1 and len(held) < CARRIED and size + len(text) <= CARRIED_BYTES:
                held[key, text], size = [keep, n], size + len(text)
            elif known is None:
                rows.append((key, text, keep, n))
            else:
                known[0] = min((x for x in (known[0], keep) if x is not None), default=None)
                known[1] += n
        yield entry_rows(rows)
    yield entry_rows([(key, text, keep, n) for (key, text), (keep, n) in held.items()])


def entry_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "text", "keep_id", "n"])


CHAIN = "bucket string, local_depth int, key long, chain int, text_sha256 string, keep_id long, group_size long"


def chained(batches):
    """Entries of the buckets of one owner. Rows come sorted by bucket and key; the chain of a key ends where the next key begins."""
    at, chain = None, []

    def entries():
        bucket, depth, key = at
        return [(bucket, depth, key, i, hashlib.sha256(text).hexdigest(), keep, n) for i, (text, keep, n) in enumerate(chain, 1)]

    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    names = ["bucket", "local_depth", "key", "chain", "text_sha256", "keep_id", "group_size"]

    def out(rows):
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    for batch in batches:
        done = []
        texts = batch.column("text").cast(pa.large_binary())
        for i, (bucket, depth, key, keep, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "local_depth", "key", "keep_id", "n")))):
            if at != (bucket, depth, key):
                done += entries() if at else []
                at, chain = (bucket, depth, key), []
            text = texts[i].as_py()
            for entry in chain:
                if entry[0] == text:  # the bytes decide
                    entry[1] = min((x for x in (entry[1], keep) if x is not None), default=None)
                    entry[2] += n
                    break
            else:
                chain.append([text, keep, n])
        yield out(done)
    if at:
        yield out(entries())


def directory(found: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Slots of the smallest directory in which no bucket of the different keys in `found` is overfull, if keys can be told apart."""
    fine = max(1, (max(found.count(), 1) // capacity).bit_length() + STEP_BITS)
    while True:
        cells = stage(found.groupBy(slot(F.col("key"), fine).alias("cell")).agg(F.count(F.lit(1)).alias("n")))
        # every level of the directory at once: a cell's prefix of d bits, and how many entries lie under it
        levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(fine))).alias("d")).select(
            "cell", "n", "d", F.call_function("shiftrightunsigned", "cell", (F.lit(fine) - F.col("d")).cast("int")).alias("prefix"))
        fits = levels.groupBy("d", "prefix").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("d") == fine))
        placed = stage(levels.select("cell", "d", "prefix").join(fits.select("d", "prefix", F.col("n").alias("held")), ["d", "prefix"])
                       .groupBy("cell").agg(F.min_by(F.struct("d", "prefix", "held"), "d").alias("b"))
                       .select("cell", F.col("b.d").alias("local_depth"), F.col("b.prefix").alias("prefix"), F.col("b.held").alias("held")))
        top = placed.agg(F.max("local_depth").alias("depth"), F.max("held").alias("held")).first()
        if (top.held or 0) <= capacity or fine + STEP_BITS > 48:
            break
        fine += STEP_BITS
    depth = top.depth or 0
    slots = placed.select(
        "local_depth", F.concat_ws("/", "local_depth", "prefix").alias("bucket"),
        F.call_function("shiftrightunsigned", "cell", F.lit(fine - depth)).alias("slot")).distinct()
    return slots, depth


def with_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key, text: the normalised text and its key."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("key"), "text")


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, keys: DataFrame | None = None) -> Index:
    """keys: column key of all documents, where it has been written already."""
    rows = with_keys(docs, text, doc_id)
    found = stage((rows if keys is None else keys).select("key").distinct())
    slots, depth = directory(found, capacity)
    slots = stage(slots)
    dealt = rows.select("key", "text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(combined, "key long, text string, keep_id long, n long")
    owned = dealt.withColumn("slot", slot(F.col("key"), depth)).join(broadcast_counted(slots, slots.count()), "slot")
    buckets = owned.select("bucket", F.col("local_depth").cast("int").alias("local_depth"), "key", "text", "keep_id", "n").repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(chained, CHAIN)
    return Index(stage(buckets), slots, depth)


def look_up(index: Index, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, key, text_sha256 and, if the index knows the text, keep_id, group_size, bucket, chain."""
    return found_in(index, fingerprints(docs, text, doc_id))


def fingerprints(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return with_keys(docs, text, doc_id).select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"))


def found_in(index: Index, prints: DataFrame) -> DataFrame:
    return prints.join(index.buckets.drop("local_depth"), ["key", "text_sha256"], "left")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    prints = stage(fingerprints(docs, text, doc_id))
    return found_in(build(docs, text, doc_id, capacity, prints), prints).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain")
