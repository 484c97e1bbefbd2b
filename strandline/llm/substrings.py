"""Repeated word spans by grouping word windows over the corpus; no de Bruijn graph is built.

A window (an edge of that graph) is a run of `WINDOW` words. Nodes, degrees and branches are not formed. A
window that starts earlier somewhere (in a smaller id, or before in the same text) is a repeat, and all
its words go. Windows are judged on the input.

Only windows that can repeat are shuffled. Each window has a minimizer, the smallest hash among its runs of `KMER`
words; equal windows have equal minimizers. Minimizers are about a seventh of the words; those that occur once in the
corpus rule out all their windows without comparing any. The remaining windows are edges: grouped by two
independent hashes (96 bits) with map-side combination they give each repeated edge its source, the earliest coordinates.
A join brings sources back to later occurrences, and windows that follow one another in a text and in one source are
merged, text by text with arrays, to one path: a span with the coordinates of its source. Texts of which every word repeats as a whole
copy are settled before by a digest of their words, so groups of copies add one text to the graph.

Where a window is very frequent, its occurrences are rows of a join that the planner splits; its edge is one row per
task before the shuffle. What is collected per text is bounded by the text.

Verification: the pass that cuts paths out of texts also takes digests of the words of each path and, through the source
coordinates, of its source; a path whose digests differ is taken out again.

Defined cases: null and empty texts have no words and the digest of the empty string; texts shorter than a window lose
nothing; rows that share an id are documents of their own in the order of text hashes, rows without an id come after all
others (both get keys of their own, and results name ids); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .rowkeys import ids_of, keyed
from .words import Words, hashed, inside, mix, runs, slices, words

WINDOW, KMER = 20, 8


def minimizers(w: Words, h: np.ndarray, window: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (index of the first word), the place of each one's minimizer, and k-mer hashes by place."""
    values = np.full(len(w.codes), np.uint64(2 ** 64 - 1))
    found, at = runs(h[w.codes], w.starts, kmer)
    values[at] = found
    place = np.arange(len(values))
    low, low_at, span, need = values, place, 1, window - kmer + 1
    while span < need:  # smallest of the next `span` places, the first of equal ones
        step = min(span, need - span)
        other = low[step:] < low[:-step]
        low = np.where(other, low[step:], low[:-step])
        low_at = np.where(other, low_at[step:], low_at[:-step])
        span += step
    start = inside(w.starts, window)
    return start, low_at[start], values


def joined(text: str) -> str:
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " "))


def repeated_windows(docs: DataFrame, base: DataFrame, window: int, kmer: int) -> DataFrame:
    """doc_id, windows: array of (pos, source, at) of a text's windows that start earlier elsewhere.

    docs: doc_id, text. base: doc_id, minimizers; the texts to look at.
    """
    # one row per text and minimizer, with all its places; written counts, so that rows of a frequent minimizer can be split
    places = base.select("doc_id", F.explode("minimizers").alias("m")).select("doc_id", "m.h", "m.places")
    common = stage(places.groupBy("h").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("h"))
    hits = stage(places.join(common.hint("merge"), "h").groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("places")))

    def edges(batches):
        for batch in slices(batches):
            w = words(batch.column("text"))
            h = hashed(w.vocabulary)
            start, low, _ = minimizers(w, h, window, kmer)
            lists = batch.column("places")
            marked = np.zeros(len(w.codes) + 1, bool)
            spot = lists.flatten().to_numpy() + np.repeat(w.starts[:-1], np.diff(lists.offsets.to_numpy()))
            marked[np.minimum(spot, len(w.codes))] = True
            keep = start[marked[low]]
            one, at = runs(h[w.codes], w.starts, window)
            two, _ = runs(mix(h ^ np.uint64(0x5851F42D4C957F2D))[w.codes], w.starts, window)
            which = np.searchsorted(at, keep)
            text = np.searchsorted(w.starts, keep, side="right") - 1
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(one[which].view(np.int64)), pa.array((two[which] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                                              pa.array(ids[text]), pa.array((keep - w.starts[text]).astype(np.int32))], ["w", "c", "doc_id", "pos"])

    found = stage(docs.join(hits, "doc_id").mapInArrow(edges, "w long, c int, doc_id long, pos int"))
    # written, so that the join below has two shuffles of its own and a frequent window's rows can be split
    sources = stage(found.groupBy("w", "c").agg(F.min(F.struct("doc_id", "pos")).alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "c", "source"))
    later = found.join(sources, ["w", "c"]).where(
        (F.col("doc_id") > F.col("source.doc_id")) | (F.col("pos") > F.col("source.pos")))
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("pos", F.col("source.doc_id").alias("source"), F.col("source.pos").alias("at"))).alias("windows"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, kmer: int = KMER, unique: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, paths (begin, words, source, source_begin; the source of a
    whole copy is the text it copies) and kept_text (the kept words joined by one space; null where nothing is removed).
    unique: ids are known to differ; rows without one are left out."""
    if not unique:
        rows, key, repeated = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), nulls=True)
        if repeated:
            out = remove_repeats(rows, "text", key, window, kmer, True)
            each = out.select("doc_id", F.explode("paths").alias("p")).select("doc_id", F.col("p.source").alias("source"), "p")
            each = ids_of(each, rows, key, "doc_id", ["source"]).select("doc_id", F.struct("p.begin", "p.words", "source", "p.source_begin").alias("p"))
            named = each.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("named"))
            out = out.join(named, "doc_id", "left").withColumn("paths", F.coalesce("named", "paths")).drop("named")
            return ids_of(out, rows, key, "doc_id", ["doc_id"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")

    def survey(batches):
        for batch in slices(batches):
            w = words(batch.column("text"))
            start, low, values = minimizers(w, hashed(w.vocabulary), window, kmer)
            first = np.flatnonzero(np.diff(low, prepend=-1))
            chosen = low[first]
            owner = np.searchsorted(w.starts, chosen, side="right") - 1
            value = values[chosen].view(np.int64)
            order = np.lexsort((chosen, value, owner))
            chosen, owner, value = chosen[order], owner[order], value[order]
            new = np.flatnonzero(np.concatenate((np.ones(min(len(chosen), 1), bool), (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))))
            spots = pa.ListArray.from_arrays(pa.array(np.append(new, len(chosen)), pa.int32()), pa.array((chosen - w.starts[owner]).astype(np.int32)))
            count = np.bincount(owner[new], minlength=len(w))
            items = pa.StructArray.from_arrays([pa.array(value[new]), spots], ["h", "places"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), pa.array(np.diff(w.starts)), lists], ["doc_id", "sha", "n_words", "minimizers"])

    base = stage(rows.select("doc_id", "text", F.sha2(joined("text"), 256).alias("sha")).mapInArrow(
        survey, "doc_id long, sha string, n_words long, minimizers array<struct<h:long,places:array<int>>>"))
    slim = base.select("doc_id", "sha", "n_words")
    # written, and merged at every size, so that the rows of a large group of copies can be split
    first = stage(slim.groupBy("sha").agg(F.min("doc_id").alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "source"))
    copies = stage(slim.where(F.col("n_words") >= window).join(first.hint("merge"), "sha").where("doc_id > source").select("doc_id", "source").distinct())
    single = base.where(F.size("minimizers") > 0).select("doc_id", "minimizers").join(copies.select("doc_id"), "doc_id", "left_anti")
    paths = stage(repeated_windows(rows, single, window, kmer).mapInArrow(compacted(window), PATHS))
    changed = stage(cut(rows, paths))
    wrong = stage(unverified(changed))
    if not wrong.isEmpty():  # two different windows with equal hashes: their paths are taken out again
        again = paths.join(wrong.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("paths").alias("path"))
        bad = wrong.select("doc_id", F.col("path.begin").alias("begin"))
        good = again.withColumn("begin", F.col("path.begin")).join(bad, ["doc_id", "begin"], "left_anti").groupBy("doc_id").agg(F.collect_list("path").alias("paths"))
        changed = changed.join(wrong.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(cut(rows, good))
    changed = changed.where("n_removed > 0").select("doc_id", "n_removed", "kept_sha256", "paths", "kept_text").dropDuplicates(["doc_id"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("words"), F.col("source").alias("source"), F.lit(0).cast("long").alias("source_begin")))
    out = slim.join(changed, "doc_id", "left").join(copies, "doc_id", "left")
    copied = F.col("source").isNotNull()
    return out.select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copied, whole).otherwise(F.coalesce("paths", F.array().cast("array<struct<begin:long,words:long,source:long,source_begin:long>>"))).alias("paths"),
        F.when(copied, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


PATH = "struct<begin:long,words:long,source:long,source_begin:long>"
PATHS = f"doc_id long, paths array<{PATH}>"
PATH_ARROW = pa.struct([(c, pa.int64()) for c in ("begin", "words", "source", "source_begin")])


def compacted(window: int):
    """From windows to paths, row by row: windows that follow one another in the text and in one source are one path."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("windows")
            text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            rows = lists.flatten()
            pos, source, at = (rows.field(c).to_numpy().astype(np.int64) for c in ("pos", "source", "at"))
            order = np.lexsort((pos, text))
            text, pos, source, at = text[order], pos[order], source[order], at[order]
            same = (text[1:] == text[:-1]) & (source[1:] == source[:-1]) & (pos[1:] == pos[:-1] + 1) & (at[1:] == at[:-1] + 1)
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            count = np.diff(np.append(first, len(pos)))
            paths = pa.StructArray.from_arrays([pa.array(c) for c in (pos[first], count - 1 + window, source[first], at[first])], ["begin", "words", "source", "source_begin"])
            begin = np.searchsorted(text[first], np.arange(len(lists) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), paths)], ["doc_id", "paths"])
    return run


def cut(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Texts without the words of their paths, and digests of paths and of the ranges that are sources of others' paths."""
    asked = paths.select(F.explode("paths").alias("p")).select(F.col("p.source").alias("doc_id"), F.col("p.source_begin").alias("begin"), F.col("p.words").alias("words")).distinct()
    work = paths.join(asked.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "words")).alias("ranges")), "doc_id", "full_outer")
    item = pa.struct([("begin", pa.int64()), ("words", pa.int64()), ("digest", pa.int64())])

    def run(batches):
        space = str.maketrans("\t\n\x0b\x0c\r", "     ")

        def digest(part):
            return int.from_bytes(hashlib.blake2b(" ".join(part).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

        for batch in slices(batches):
            out = []
            for doc, t, found, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "paths", "ranges"))):
                own = [x for x in (t or "").translate(space).split(" ") if x]
                gone = np.zeros(len(own) + 1, np.int64)
                for p in found or ():
                    gone[p["begin"]] += 1
                    gone[min(p["begin"] + p["words"], len(own))] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                rest = " ".join(x for x, k in zip(own, keep.tolist()) if k) if found else None
                out.append((doc, int((~keep).sum()), hashlib.sha256((rest or "").encode("utf-8", "surrogatepass")).hexdigest(), found or [],
                            [digest(own[p["begin"]:p["begin"] + p["words"]]) for p in found or ()],
                            [{"begin": r["begin"], "words": r["words"], "digest": digest(own[r["begin"]:r["begin"] + r["words"]])} for r in ranges or ()], rest))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(PATH_ARROW), pa.list_(pa.int64()), pa.list_(item), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_removed", "kept_sha256", "paths", "digests", "ranges", "kept_text"])

    return rows.join(work, "doc_id").mapInArrow(run, f"doc_id long, n_removed long, kept_sha256 string, paths array<{PATH}>, digests array<long>, "
                                                     "ranges array<struct<begin:long,words:long,digest:long>>, kept_text string")


def unverified(changed: DataFrame) -> DataFrame:
    """Paths whose words differ from their source's: doc_id, path."""
    own = changed.select("doc_id", F.explode(F.arrays_zip("paths", "digests")).alias("z")).select(
        "doc_id", F.col("z.paths").alias("path"), F.col("z.digests").alias("digest"))
    asked = changed.select(F.col("doc_id").alias("source"), F.explode("ranges").alias("r")).select(
        "source", F.col("r.begin").alias("source_begin"), F.col("r.words").alias("words"), F.col("r.digest").alias("held")).distinct()
    return own.withColumns({"source": F.col("path.source"), "source_begin": F.col("path.source_begin"), "words": F.col("path.words")}).join(
        asked, ["source", "source_begin", "words"], "left").where(~F.col("digest").eqNullSafe(F.col("held"))).select("doc_id", "path")
