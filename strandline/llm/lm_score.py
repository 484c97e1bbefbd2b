"""Log-probabilities of texts under a hashed maximum-entropy model with a class-factored softmax.

P(text) is the product over its tokens, an end token included, of P(class | history) * P(token | class). Words are
lower-cased; history reaches back to the start of the text.

Classes: one for the end, one for each of the `OWN` most frequent words, and the rest by a hash of a word's last
two bytes, which keeps endings, and so languages, together. P(class | history) is a maximum-entropy model:
features are a bias, the word before, the word before that (a skip feature), both together, and the class before;
each is hashed to one of `ROWS` rows of weights over classes. P(token | class) is the relative frequency among the
training tokens of the class; a class by ending gives unseen words, as one outcome, the share of its tokens
that were seen once (Good-Turing). So probabilities sum to one over known words, the end and one unseen outcome per
ending class.

Counts cover every training token: tasks combine words per slice, and the counts are a distributed table that is joined,
never collected. The most frequent `HEAD` words are broadcast (a fixed number), so only rarer words take part in the
join. Training covers every training token too: in each of `ROUNDS` rounds, tasks take gradient steps
on their part of the texts, starting from the common weights, and the weights are averaged by tokens, block by block of
rows in groups of at most `FAN` tasks. The model's size is fixed by its parameters, not by the corpus.

Defined cases: null and empty texts consist of the end alone; repeated rows are counted and scored as often as
they come; without training texts the counts are 0 and every class is equally likely; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .words import Words, buffers, hashed, mix, slices, words

CLASSES, OWN, ROW_BITS = 64, 24, 15
ROWS = 1 << ROW_BITS
HEAD = 65_536
ROUNDS, BATCH, RATE, FAN, BLOCKS = 2, 4096, 0.4, 64, 16
TASK_TOKENS = 1 << 21  # of a round, for a task to train on
SLICE = 2 << 20  # bytes of text at a time
CACHED, FEW = 512, 8  # rows of probabilities worked on at a time; rows of a feature added place by place
END = ""  # words are never empty


@dataclass
class Head:
    """The end and the most frequent training words, with counts, and the words that are classes of their own."""

    words: list[str]
    counts: np.ndarray

    def own(self) -> dict[str, int]:
        return {w: i + 1 for i, w in enumerate([w for w in self.words if w != END][:OWN])}


def classes(vocabulary: pa.Array, own: dict[str, int]) -> np.ndarray:
    """Class of each word; 0 is the end."""
    data, starts = buffers(vocabulary)
    size = np.diff(starts)
    last = np.where(size > 0, data[np.maximum(starts[1:] - 1, 0)] if len(data) else 0, 0).astype(np.uint64)
    before = np.where(size > 1, data[np.maximum(starts[1:] - 2, 0)] if len(data) else 0, 0).astype(np.uint64)
    out = (OWN + 1 + (mix(last * np.uint64(256) + before) % np.uint64(CLASSES - OWN - 1)).astype(np.int64))
    if own and len(vocabulary):
        place = pc.index_in(vocabulary, pa.array(list(own), vocabulary.type))
        found = place.is_valid().to_numpy(zero_copy_only=False)
        out[found] = np.array(list(own.values()))[place.drop_null().to_numpy()]
    return out


def tokens(w: Words, own: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """With the end after each text: class and feature rows (token, feature) of every token, and where each text begins."""
    n = len(w)
    begin = w.starts + np.arange(n + 1)
    total = int(begin[-1])
    is_end = np.zeros(total, bool)
    is_end[begin[1:] - 1] = True
    kind, h = np.zeros(total, np.int64), np.zeros(total, np.uint64)
    kind[~is_end] = classes(w.vocabulary, own)[w.codes]
    h[~is_end] = hashed(w.vocabulary)[w.codes]
    place = np.arange(total) - np.repeat(begin[:-1], np.diff(begin))
    one, two, last = np.full(total, np.uint64(1)), np.full(total, np.uint64(2)), np.full(total, np.uint64(CLASSES))
    one[1:], two[2:], last[1:] = h[:-1], h[:-2], kind[:-1].astype(np.uint64)
    one[place < 1], two[place < 2], last[place < 1] = 1, 2, CLASSES
    shift = np.uint64(64 - ROW_BITS)
    rows = np.empty((total, 5), np.uint16)  # numbers below ROWS
    rows[:, 0] = 0
    rows[:, 1] = mix(one * np.uint64(3) + np.uint64(0x51)) >> shift
    rows[:, 2] = mix(two * np.uint64(5) + np.uint64(0x52)) >> shift
    rows[:, 3] = mix(one * np.uint64(7) + mix(two) + np.uint64(0x53)) >> shift
    rows[:, 4] = mix(last * np.uint64(11) + np.uint64(0x54)) >> shift
    return kind, rows, begin


def softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-probabilities of classes for sparse rows of features."""
    out = np.empty((len(rows), weights.shape[1]), weights.dtype)
    for a in range(0, len(rows), CACHED):
        r, z = rows[a:a + CACHED], out[a:a + CACHED]
        z[:] = weights.take(r[:, 0], axis=0)
        for j in range(1, rows.shape[1]):
            z += weights.take(r[:, j], axis=0)
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def summed(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of `at`, and for each the sum of its rows of g.

    Most have few rows: those are added place by place, which spares a sorted copy of g. The first row is added last,
    as `reduceat` does, so that both ways round alike.
    """
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    count = np.diff(np.append(first, len(at)))
    total = g.take(order[first], axis=0)
    few = np.flatnonzero((count > 1) & (count <= FEW))
    rest = g.take(order[first[few] + 1], axis=0)
    for i in range(2, FEW):
        more = np.flatnonzero(count[few] > i)
        if not len(more):
            break
        rest[more] += g.take(order[first[few[more]] + i], axis=0)
    total[few] += rest
    many = count > FEW
    if many.any():
        size = count[many]
        total[many] = np.add.reduceat(g.take(order[np.repeat(many, count)], axis=0), np.cumsum(size) - size, axis=0)
    return at[first], total


def descend(weights: np.ndarray, squares: np.ndarray, kind: np.ndarray, rows: np.ndarray, rate: float = RATE) -> None:
    """One pass of gradient steps with AdaGrad's step sizes, in place."""
    for a in range(0, len(kind), BATCH):
        k, r = kind[a:a + BATCH], rows[a:a + BATCH]
        g = softmax(weights, r)
        np.negative(np.exp(g, out=g), out=g)
        g[np.arange(len(k)), k] += 1
        step = g.sum(axis=0)  # the bias is one row
        squares[0] += step * step
        weights[0] += rate * step / np.sqrt(squares[0] + 1.0)
        for j in range(1, r.shape[1]):
            at, step = summed(g, r[:, j])
            s = squares.take(at, axis=0)
            s += step * step
            squares[at] = s
            s += 1
            step *= rate
            step /= np.sqrt(s, out=s)
            step += weights.take(at, axis=0)
            weights[at] = step


def averaged(rows: DataFrame) -> DataFrame:
    """Sums of equal blocks (weights already multiplied by tokens); groups of FAN tasks, level by level."""

    def add(key, table):
        parts = [np.frombuffer(x, np.float32) for x in table.column("weights").to_pylist()]
        total = np.sum(parts, axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"block": [key[0].as_py()], "task": [key[1].as_py()], "n": [sum(table.column("n").to_pylist())], "weights": pa.array([total.tobytes()], pa.binary())})

    return rows.withColumn("task", F.floor(F.col("task") / FAN).cast("long")).groupBy("block", "task").applyInArrow(add, "block long, task long, n double, weights binary")


def train(texts: DataFrame, own: dict[str, int], rounds: int = ROUNDS, total: int | None = None) -> np.ndarray:
    """Weights (row, class). texts: column text, and draw, a whole number that deals texts to rounds; total: their tokens.

    A task takes about `TASK_TOKENS` tokens of a round, however the files are cut, so what tasks write is a fixed share of what they read.
    """
    weights = np.zeros((ROWS, CLASSES), np.float32)
    if total is not None:
        texts = texts.coalesce(max(1, math.ceil(total / rounds / TASK_TOKENS)))
    for r in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(weights)

        def step(batches):
            w, squares, n = shared.value.copy(), np.zeros((ROWS, CLASSES), np.float32), 0
            for batch in slices(batches, limit=SLICE):
                kind, rows, _ = tokens(words(batch.column("text"), lower=True), own)
                descend(w, squares, kind, rows)
                n += len(kind)
            if n:
                w *= np.float32(n)
                blocks = np.split(w, BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int64()),
                                                  pa.array([float(n)] * BLOCKS), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "task", "n", "weights"])

        part = stage(texts.where(F.col("draw") % rounds == r).select("text").mapInArrow(step, "block long, task long, n double, weights binary"))
        tasks = part.agg(F.max("task")).first()[0]
        if tasks is None:
            continue
        while tasks >= FAN:
            part, tasks = stage(averaged(part)), tasks // FAN
        got = averaged(part).collect()
        for row in got:
            weights[row["block"] * (ROWS // BLOCKS):(row["block"] + 1) * (ROWS // BLOCKS)] = np.frombuffer(row["weights"], np.float32).reshape(-1, CLASSES) / row["n"]
        shared.unpersist()
    return weights


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all texts, ends included."""

    def count(batches):
        for batch in slices(batches):
            w = words(batch.column("text"), lower=True)
            n = np.bincount(w.codes, minlength=len(w.vocabulary))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([w.vocabulary.take(pa.array(used)).cast(pa.string()), pa.array([END])]), pa.array(np.append(n[used], len(w)))], ["word", "n"])

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int) -> Head:
    """The end and at most `size` of the most frequent words: those above a count that a histogram of counts gives.

    Only the histogram (counts up to 1024 apart, larger ones in steps of a 32nd of a power of two) and the chosen words reach the driver.
    """
    words_ = counts.where(F.col("word") != END).select("word", "n")
    step = F.when(F.col("n") <= 1024, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 32) + 10_000)
    steps = words_.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    taken, least = 0, None
    for r in steps:
        if taken + r["words"] > size:
            break
        taken, least = taken + r["words"], r["least"]
    frequent = words_.where(F.col("n") >= least).collect() if least is not None else []
    classes_ = words_.orderBy(F.desc("n"), "word").limit(OWN).collect()  # words that are classes of their own, whatever the size
    top = sorted({*map(tuple, frequent), *map(tuple, classes_)}, key=lambda r: (-r[1], r[0]))
    end = counts.where(F.col("word") == END).select("word", "n").first()
    chosen = [*([tuple(end)] if end else []), *top]
    return Head([r[0] for r in chosen], np.array([r[1] for r in chosen], np.int64))


def score(docs: DataFrame, learn, text: str = "text", doc_id: str = "doc_id", head_size: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score. learn: a condition on doc_id
    that tells which rows are learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = rows.where(learn).select("text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("draw"))
    counts = stage(count_words(seen.select("text")))
    head = frequent_words(counts, head_size)
    own = head.own()
    trained = counts.agg(F.sum("n")).first()[0] or 0
    weights = spark.sparkContext.broadcast(train(seen, own, rounds, trained))
    known = spark.sparkContext.broadcast(head)

    def classed(batches):
        for batch in batches:
            k = classes(batch.column("word").cast(pa.large_string()), own)
            k[pc.equal(batch.column("word"), END).to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column("n")], ["class", "n"])

    got = counts.mapInArrow(classed, "class long, n long").groupBy("class").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
    size, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in got:
        size[r["class"]], once[r["class"]] = r["n"], r["once"]
    total, distinct = int(size.sum()), sum(r["words"] for r in got)
    open_class = np.arange(CLASSES) > OWN
    unseen = np.where(open_class, (once + 0.5) / (size + 1.0), 0.0)
    unseen_log = np.log10(np.maximum(unseen, 1e-300))
    known_log = np.log10(np.maximum(1 - unseen, 1e-300)) - np.log10(np.maximum(size, 1))  # + log10(count)
    base = float(np.log10(total + distinct + 1.0))

    def walk(batches):
        """Per document: sums over classes and frequent words, and its rarer words with how often it has them."""
        table = pa.array(known.value.words, pa.large_string())
        for batch in slices(batches, limit=SLICE):
            w = words(batch.column("text"), lower=True)
            kind, feats, begin = tokens(w, own)
            logp = np.empty(len(kind))
            for a in range(0, len(kind), BATCH):
                p = softmax(weights.value, feats[a:a + BATCH])
                logp[a:a + BATCH] = p[np.arange(len(p)), kind[a:a + BATCH]]
            logp /= np.log(10)
            place = pc.index_in(w.vocabulary, table).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            kinds = classes(w.vocabulary, own)
            c = np.where(place >= 0, known.value.counts[place] if len(table) else 0, 0)
            add_base = np.log10(c + 1.0) - base
            add = np.log10(np.maximum(c, 1)) + known_log[kinds]
            frequent = place >= 0
            text_of = w.text_of()
            f = frequent[w.codes]
            n = len(w)
            end_n = known.value.counts[0] if len(table) else 0  # the end comes first
            ends = 0.0 if end_n else float(unseen_log[0])
            s_base = np.bincount(text_of[f], add_base[w.codes[f]], n) + np.log10(end_n + 1.0) - base
            s_model = np.bincount(np.repeat(np.arange(n), np.diff(begin)), logp, n) + np.bincount(text_of[f], add[w.codes[f]], n) + ends
            n_known = np.bincount(text_of[f], minlength=n) + (end_n > 0)
            pairs, times = np.unique(text_of[~f] * max(len(frequent), 1) + w.codes[~f], return_counts=True)
            doc, code = np.divmod(pairs, max(len(frequent), 1))
            size_ = np.bincount(doc, minlength=n)
            lists = np.concatenate(([0], np.cumsum(size_)))
            rare = pa.StructArray.from_arrays([w.vocabulary.take(pa.array(code)).cast(pa.string()), pa.array(kinds[code].astype(np.int32)), pa.array(times.astype(np.int32))], ["word", "class", "times"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(begin)), pa.array(n_known.astype(np.int64)), pa.array(s_base), pa.array(s_model),
                                              pa.ListArray.from_arrays(pa.array(lists, pa.int32()), rare)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,class:int,times:int>>"
    walked = stage(rows.mapInArrow(walk, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = walked.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.class", "r.times").join(counts, "word", "left")
    tables = [F.array(*[F.lit(float(x)) for x in t]) for t in (known_log, unseen_log)]
    known_at, unseen_at = (F.element_at(t, F.col("class") + 1) for t in tables)
    c = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).cast("long").alias("k"),
        F.sum(F.col("times") * (F.log10(c + 1) - F.lit(base))).alias("b"),
        F.sum(F.col("times") * F.when(c > 0, F.log10(c) + known_at).otherwise(unseen_at)).alias("m"))
    out = walked.drop("rare").join(sums, "row", "left")
    more = lambda name, part: (F.col(name) + F.coalesce(part, F.lit(0))).alias(name)
    return out.select("doc_id", "n_tokens", more("n_known", "k"), F.lit(total).cast("long").alias("train_tokens"), more("base_score", "b"), more("score", "m"))
