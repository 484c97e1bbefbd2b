"""Near duplicates of texts by ProbMinHash over weighted word shingles.

A text is its runs of five words (a shorter text is one run of all its words), each weighted by 1 + log2 of how
often it occurs. Similarity is the probability Jaccard index of the weights; it is the plain Jaccard index where no run
repeats. Texts with equal weighted runs are one class, found by fingerprints that are combined before the shuffle.

Signatures: every run sends a Poisson process of arrivals whose rate is its weight; each arrival falls on one of
`REGISTERS` registers, which keep the run that arrives first. Two texts agree in a register with the probability Jaccard
index. A text stops drawing at the time by which all its registers are filled: first a time that suffices for almost
all texts, doubled for the rest, so the result is exact and most runs draw once or twice.

Candidates share a band of `ROWS` registers. Pairs within a bucket are not listed. First every member meets the
bucket's hub, the member whose buckets hold the most texts; partners are sent to parts of at most `PART` beside one copy of
their hub. Where members are left outside the largest component of their bucket, they meet the bucket's other members
block by block (at most `BLOCK` against `BLOCK`): pairs that lie in different components, and whose estimate
from `LONG` further registers is not `SLACK` standard deviations below the threshold, are compared from the most similar
down. A task sends only links that join components, so it never sends more rows than it has members; a pair is
compared only in the first band that it shares. A link between members of one component changes nothing, so no link that
matters is lost. Every link is verified exactly on the weighted runs.

Defined cases: rows without an id are not compared by themselves; null texts and texts without words are alone, each its own class and component; repeated rows and equal
texts share a class and the row with the smallest id stays, one of them where ids repeat (rows then get keys of their own, so texts under one id are judged apart); an empty table gives an empty result; extra columns are ignored; very
long texts count with all their runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .graph import components, whole_runs
from .rowkeys import ids_of, keyed
from .words import Words, hashed, mix, runs, slices, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
LONG, SLACK, PART, BLOCK = 256, 3.5, 128, 512
SLICE = 2 << 20  # bytes of text at a time; signatures take many arrays of its size


def weighted(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different runs of each text: text, hash and times; sorted by text and hash."""
    h = hashed(w.vocabulary)[w.codes]
    size = np.diff(w.starts)
    hashes, owner = [], []
    for n in range(1, SHINGLE + 1):
        found, at = runs(h, w.starts, n)
        text = np.searchsorted(w.starts, at, side="right") - 1
        keep = size[text] == n if n < SHINGLE else slice(None)
        hashes.append(found[keep])
        owner.append(text[keep])
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], hashes[first], np.diff(np.append(first, len(hashes)))


def weight(times: np.ndarray) -> np.ndarray:
    return 1 + np.log2(times)


def draws(h: np.ndarray, k: int, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th waiting time (rate 1) and register of each run; they depend on the run alone."""
    x = mix(h + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (2 ** 64 - 1)))
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
    return -np.log(u), (mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(registers)).astype(np.int64)


def signatures(owner: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers of n texts (n, registers); a text without runs has zeros."""
    out = np.zeros((n, registers), np.uint64)
    total = np.bincount(owner, w, n)
    open_ = total > 0
    limit = np.where(open_, registers * (np.log(registers) + 4) / np.where(open_, total, 1), 0)
    while open_.any():
        best, who = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
        rows = np.flatnonzero(open_[owner])
        at, k = np.zeros(len(rows)), 0
        places, times, ids = [], [], []
        while len(rows):
            wait, register = draws(h[rows], k, registers)
            at = at + wait / w[rows]
            on = at <= limit[owner[rows]]
            rows, at = rows[on], at[on]
            places.append(owner[rows] * registers + register[on])
            times.append(at)
            ids.append(h[rows])
            k += 1
        place, time, run = np.concatenate(places), np.concatenate(times), np.concatenate(ids)
        order = np.argsort(-time, kind="stable")  # the earliest arrival is written last
        best[place[order]] = time[order]
        who[place[order]] = run[order]
        full = open_ & np.isfinite(best.reshape(n, registers)).all(axis=1)
        out[full] = who.reshape(n, registers)[full]
        open_ &= ~full
        limit *= 2
    return out


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact index of two weighted sets; hashes are sorted."""
    keys = np.union1d(ha, hb)
    a, b = np.zeros(len(keys)), np.zeros(len(keys))
    a[np.searchsorted(keys, ha)] = wa
    b[np.searchsorted(keys, hb)] = wb
    with np.errstate(divide="ignore"):
        ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    above = np.concatenate((np.cumsum(a[::-1])[::-1], [0.0]))  # weights in A of runs with at least this ratio
    below = np.concatenate(([0.0], np.cumsum(b)))
    both = np.flatnonzero((a > 0) & (b > 0))
    return float((1 / (above[both] / a[both] + below[both] / b[both])).sum())


def bands_of(sig: np.ndarray) -> np.ndarray:
    """Bucket keys of each band (n, BANDS)."""
    bands = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands + sig[:, r::ROWS] * np.uint64(2 * r + 3))
    return bands.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, f1, f2 (fingerprints of the weighted runs), runs, bands; nulls where a text has no words."""

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            w = words(batch.column("text"))
            n = len(w)
            owner, h, times = weighted(w)
            count = np.bincount(owner, minlength=n)
            none = count == 0
            f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            if len(owner):
                begin = np.flatnonzero(np.diff(owner, prepend=-1))
                t = times.astype(np.uint64)
                f1[owner[begin]] = np.add.reduceat(mix(h) * t, begin)
                f2[owner[begin]] = np.add.reduceat(mix(h ^ np.uint64(0x1234567)) * mix(t), begin)
            bands = bands_of(signatures(owner, h, weight(times), n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel()), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f1.view(np.int64), mask=none), pa.array(f2.view(np.int64), mask=none), pa.array(count), lists],
                                             ["doc_id", "f1", "f2", "runs", "bands"])

    return docs.mapInArrow(run, "doc_id long, f1 long, f2 long, runs long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs: rep, text. rep, hashes (sorted), times, long (registers of a longer signature), bands."""

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            w = words(batch.column("text"))
            n = len(w)
            owner, h, times = weighted(w)
            offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
            long = (mix(signatures(owner, h, weight(times), n, LONG)) >> np.uint64(48)).astype(np.uint16)
            bands = bands_of(signatures(owner, h, weight(times), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                 pa.array([x.tobytes() for x in long], pa.binary()), pa.array([x.tobytes() for x in bands], pa.binary())], ["rep", "hashes", "times", "long", "bands"])

    return docs.mapInArrow(run, "rep long, hashes array<long>, times array<int>, long binary, bands binary")


def sets_of(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's runs begin, their hashes and weights."""
    columns = [table.column(c) for c in ("hashes", "times")]
    hashes, times = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns)
    at = hashes.offsets.to_numpy()
    return at - at[0], hashes.flatten().to_numpy().view(np.uint64), weight(times.flatten().to_numpy())


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs: hub, other (distinct). a, b of the pairs whose exact similarity reaches the threshold."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = stage(pairs.join(parts, "hub").select("hub", "other", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part")))
    heads = dealt.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("rep"), F.lit(0).alias("role"))
    rows = heads.unionByName(dealt.select("hub", "part", F.col("other").alias("rep"), F.lit(1).alias("role"))).join(sets.select("rep", "hashes", "times"), "rep")

    def run(batches):
        hub, mine = None, None  # the hub comes before its partners, in this batch or one before
        for batch in batches:
            if not batch.num_rows:
                continue
            at, h, t = sets_of(batch)
            a, b = [], []
            for i, (rep, role) in enumerate(zip(batch.column("rep").to_pylist(), batch.column("role").to_pylist())):
                x = slice(at[i], at[i + 1])
                if role == 0:
                    hub, mine = rep, (h[x].copy(), t[x].copy())
                elif probability_jaccard(*mine, h[x], t[x]) >= threshold - 1e-12:
                    a.append(hub)
                    b.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = ["hub", "part", "role", "rep"]
    return rows.select(*keys, "hashes", "times").repartition("hub", "part").sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def outsiders(members: DataFrame, info: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join components within a bucket. members: band, key, rep. info: rep, component."""
    rows = members.join(info, "rep")
    inside = rows.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = inside.groupBy("band", "key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    rows = rows.join(main.select("band", "key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("p"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("q")), ["band", "key"])
    deal = lambda parts: F.pmod(F.xxhash64("rep"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    out = F.col("component") != F.col("main")
    them = rows.select("band", "key", "rep", "component", out.alias("out"), F.lit(1).alias("role"), deal(F.col("p")).alias("i"), every("q").alias("j"))
    ours = rows.where(out).select("band", "key", "rep", "component", out.alias("out"), F.lit(0).alias("role"), every("p").alias("i"), deal(F.col("q")).alias("j"))
    cells = ["band", "key", "i", "j"]
    least = threshold - SLACK * (threshold * (1 - threshold) / LONG) ** 0.5

    def run(batches):
        for table, begin in whole_runs(batches, cells):
            rep, comp, role, band, open_ = (table.column(c).to_numpy() for c in ("rep", "component", "role", "band", "out"))
            keys = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
            long = np.frombuffer(b"".join(table.column("long").to_pylist()), np.uint16).reshape(-1, LONG)
            at, h, t = sets_of(table)
            a, b = [], []
            for lo, hi in zip(begin[:-1], begin[1:]):
                label = comp[lo:hi].copy()  # components as they are joined here
                one, two = np.flatnonzero(role[lo:hi] == 0), np.flatnonzero(role[lo:hi] == 1)
                for i in one:
                    x = lo + i
                    y = two[label[two] != label[i]]
                    y = y[~open_[lo + y] | (rep[lo + y] < rep[x])]  # of two outsiders the greater asks
                    y = y[(keys[lo + y] == keys[x]).argmax(axis=1) == band[lo]]
                    if not len(y):
                        continue
                    estimate = (long[lo + y] == long[x]).mean(axis=1)
                    for k in y[np.argsort(-estimate, kind="stable")][:np.count_nonzero(estimate >= least)]:
                        z = lo + k
                        if label[k] != label[i] and probability_jaccard(h[at[x]:at[x + 1]], t[at[x]:at[x + 1]], h[at[z]:at[z + 1]], t[at[z]:at[z + 1]]) >= threshold - 1e-12:
                            a.append(rep[x])
                            b.append(rep[z])
                            label[label == label[k]] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    full = them.unionByName(ours).join(sets, "rep")
    return full.repartition(*cells).sortWithinPartitions(*cells, "role", "rep").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, unique: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id with equal weighted runs), component_id (smallest id of its group of
    near duplicates), kept, runs. unique: ids are known to differ."""
    if not unique:
        rows, key, repeated = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
        if repeated:  # rows that share an id are judged by their own texts
            return ids_of(near_duplicates(rows, "text", key, threshold, True), rows, key, "doc_id", ["doc_id", "class_id", "component_id"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = stage(sketches(rows))
    made = ["f1", "f2", "runs"]
    with_runs = sketch.where("runs > 0")
    classes = stage(with_runs.groupBy(*made).agg(F.min("doc_id").alias("rep")))
    own = stage(with_runs.join(classes, made).where("doc_id = rep").select("rep", "bands").dropDuplicates(["rep"]))
    places = own.select("rep", F.posexplode("bands").alias("band", "key"))
    # aggregates are written before they meet their own rows, so the planner can split a hot bucket; merged at every size, since
    # they grow with the corpus and soon exceed what may be broadcast
    sizes = stage(places.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = stage(places.join(sizes.hint("merge"), ["band", "key"]).select("band", "key", "rep", "n"))
    degree = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    hubs = stage(members.join(degree, "rep").groupBy("band", "key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("hub")))
    pairs = stage(members.join(hubs.hint("merge"), ["band", "key"]).where("rep <> hub").select("hub", F.col("rep").alias("other")).distinct())
    involved = degree.select("rep")
    sets = stage(shingle_sets(rows.withColumnRenamed("doc_id", "rep").join(involved, "rep", "left_semi").dropDuplicates(["rep"]).select("rep", "text")))
    links = stage(verified(pairs, sets, threshold))
    found = stage(components(links))
    info = involved.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
    more = stage(outsiders(members.select("band", "key", "rep"), stage(info), sets, threshold))
    if not more.isEmpty():
        found = stage(components(links.unionByName(more)))
    groups = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*made, "rep", F.coalesce("component", "rep").alias("component"))
    return sketch.select("doc_id", *made).join(groups, made, "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"), "runs")
