"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; a token's features are its lower-cased form without outer punctuation and the form's
beginnings of 4, 5 and 6 letters. Labels mark documents only, so token labels come from counts over
distinct labelled texts: a feature that at least `MIN_DOCS` toxic texts have, and that is `LIFT` times as frequent
among toxic texts as among clean ones, is evidence; evidence tokens of toxic texts are labelled toxic,
all other tokens are not. The field has weights for evidence, a bias, start and transition weights, and is fit by
gradient steps on the exact log-likelihood.

Scoring runs forward and backward over the whole text. Tokens without evidence share one transfer matrix, so a run of
them is a power of a 2 x 2 matrix in closed form: the result is that of the full recursion and the cost follows the
evidence. Marginals above one half give the offending offsets; the largest marginal, their sum and their density go
into a logistic function fit on labelled texts that the field has not seen.

Fitting uses a bounded sample: about `sample` documents of each label by a hash of the id, equal texts once. Scoring is a map
without shuffle; the broadcast model holds evidence features of that sample only.

Defined cases: null and empty texts have no tokens and get the score of a text without evidence; without labels of
both kinds every score is 0; repeated labels of a document count as toxic if one does; repeated rows are scored
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .words import Words, buffers, plain_spaces, slices, words

SAMPLE, MIN_DOCS, LIFT, THRESHOLD = 4000, 3, 6.0, 0.3
STARTS = (4, 5, 6)
SEGMENT, STEPS, NEAR = 64, 80, 2  # training tokens per sequence, gradient steps, explicit tokens around evidence
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—"


def forms(vocabulary: pa.Array) -> list[str]:
    return pc.utf8_lower(pc.utf8_trim(vocabulary, PUNCTUATION)).to_pylist()


def features(form: str) -> list[str]:
    return ["=" + form, *(form[:n] + "*" for n in STARTS if len(form) > n)] if form else []


@dataclass
class Field:
    index: dict[str, int] = field(default_factory=dict)  # evidence feature -> weight
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # from, to
    scale: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -np.inf]))  # of the logistic function

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """Score of each row of summaries; 0 where the model has learned from labels of one kind only."""
        z = evidence @ self.scale[:3] + self.scale[3]
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def emissions(self, vocabulary: pa.Array) -> np.ndarray:
        """Weight of each word's evidence; NaN where it has none."""
        out, get, w = np.full(len(vocabulary), np.nan), self.index.get, self.weights
        for i, form in enumerate(forms(vocabulary)):
            found = [j for j in map(get, features(form)) if j is not None]
            if found:
                out[i] = w[found].sum()
        return out


def power(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """m ** n for a positive 2 x 2 matrix scaled to a largest eigenvalue of 1, for many n: (len(n), 2, 2)."""
    a, b, c, d = m[0, 0], m[0, 1], m[1, 0], m[1, 1]
    root = np.sqrt((a - d) ** 2 / 4 + b * c)
    high, low = (a + d) / 2 + root, (a + d) / 2 - root
    one = (m - low * np.eye(2)) / (high - low)  # the projector on the first eigenvector
    return one + (low / high) ** n[:, None, None] * (np.eye(2) - one)


def marginals(model: Field, length: int, at: np.ndarray, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens around evidence (positions `at` with weights) of a text of `length` tokens, and each one's probability of being toxic."""
    near = np.unique(np.clip(at[:, None] + np.arange(-NEAR, NEAR + 1), 0, length - 1))
    weight = np.full(len(near), model.bias)
    weight[np.searchsorted(near, at)] += evidence
    lift = np.exp(np.clip(weight, -60, 60))
    trans = np.exp(model.step)
    plain = trans * np.array([1.0, np.exp(model.bias)])
    gap = np.diff(near) - 1
    between = power(plain, gap.astype(float)) @ trans
    first = np.exp(model.start)
    if near[0] > 0:  # the first token and the rest of the leading run carry no evidence
        lead = first * np.array([1.0, np.exp(model.bias)])
        first = lead @ power(plain, np.array([near[0] - 1.0]))[0] @ trans
    tail = power(plain, np.array([float(length - 1 - near[-1])]))[0] @ np.ones(2)
    n = len(near)
    forward, backward = np.empty((n, 2)), np.empty((n, 2))
    v = first
    for i in range(n):
        v = (v if i == 0 else v @ between[i - 1]) * (1.0, lift[i])
        v = forward[i] = v / v.sum()
    v = backward[n - 1] = tail
    for i in range(n - 2, -1, -1):
        v = between[i] @ (v * (1.0, lift[i + 1]))
        v = backward[i] = v / v.sum()
    both = forward * backward
    return near, both[:, 1] / both.sum(axis=1)


def summaries(length: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """Largest marginal as log-odds, sum of marginals and their density, for each text."""
    out = np.zeros((len(length), 3))
    for i, p in enumerate(found):
        top = min(max(p.max(), 1e-9), 1 - 1e-9) if len(p) else 1e-9
        out[i] = np.log(top / (1 - top)) / 4, np.log1p(p.sum()), min(1.0, 20 * p.sum() / max(length[i], 1))
    return out


def tagged(model: Field, w: Words) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text: positions of tokens around evidence and their marginals."""
    e = model.emissions(w.vocabulary)[w.codes]
    hits = np.flatnonzero(~np.isnan(e))
    bounds = np.searchsorted(hits, w.starts)
    places, probs = [], []
    for i in range(len(w)):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            places.append(np.zeros(0, np.int64))
            probs.append(np.zeros(0))
            continue
        own = hits[a:b]
        near, p = marginals(model, int(w.starts[i + 1] - w.starts[i]), own - w.starts[i], e[own])
        places.append(near)
        probs.append(p)
    return places, probs


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (y - p) - 0.1 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return w


def train(model: Field, segments: list[tuple[int, np.ndarray, list[list[int]], np.ndarray, float]], steps: int = STEPS) -> None:
    """Fit weights. A segment: length, positions of evidence, their features, their labels, weight of the segment."""
    n, width = len(segments), max((s[0] for s in segments), default=0)
    if not n:
        return
    length, weight = np.array([s[0] for s in segments]), np.array([s[4] for s in segments])
    row = np.repeat(np.arange(n), [len(s[1]) for s in segments])
    col = np.concatenate([s[1] for s in segments]).astype(int)
    lists = [f for s in segments for f in s[2]]
    token, feat = np.repeat(np.arange(len(lists)), [len(f) for f in lists]), np.array([j for f in lists for j in f], int)
    y = np.zeros((n, width))
    y[row, col] = np.concatenate([s[3] for s in segments])
    inside = np.arange(width) < length[:, None]
    w = np.concatenate([model.weights, [model.bias], model.start, model.step.ravel()])
    k, moment, square = len(model.weights), np.zeros(len(w)), np.zeros(len(w))
    onehot = np.stack([(1 - y) * inside, y * inside], -1)
    seen_step = np.einsum("n,nti,ntj->ij", weight, onehot[:, :-1], onehot[:, 1:])
    total = (weight * length).sum()
    for it in range(1, steps + 1):
        e = np.full((n, width), w[k])
        np.add.at(e, (row[token], col[token]), w[feat])
        lift = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], -1)
        start, trans = np.exp(w[k + 1:k + 3]), np.exp(w[k + 3:].reshape(2, 2))
        f, b = np.empty((width, n, 2)), np.ones((width, n, 2))
        v = start * lift[:, 0]
        f[0] = v / v.sum(1, keepdims=True)
        for t in range(1, width):
            v = (f[t - 1] @ trans) * lift[:, t]
            f[t] = np.where(inside[:, t, None], v / v.sum(1, keepdims=True), f[t - 1])
        for t in range(width - 2, -1, -1):
            v = (b[t + 1] * lift[:, t + 1]) @ trans.T
            b[t] = np.where(inside[:, t + 1, None], v / v.sum(1, keepdims=True), 1.0)
        p = f * b
        p /= p.sum(2, keepdims=True)
        miss = (y - p[:, :, 1].T) * inside * weight[:, None]
        pair = np.zeros((2, 2))
        for t in range(width - 1):
            x = f[t][:, :, None] * trans * (b[t + 1] * lift[:, t + 1])[:, None, :]
            pair += ((weight * inside[:, t + 1])[:, None, None] * x / x.sum((1, 2), keepdims=True)).sum(0)
        g = np.concatenate([np.bincount(feat, miss[row[token], col[token]], k), [miss.sum()],
                            (weight[:, None] * (onehot[:, 0] - p[0])).sum(0), (seen_step - pair).ravel()])
        g = g / total - 1e-7 * w
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w + 0.25 * (moment / (1 - 0.9 ** it)) / (np.sqrt(square / (1 - 0.99 ** it)) + 1e-9)
    model.weights, model.bias, model.start, model.step = w[:k], float(w[k]), w[k + 1:k + 3], w[k + 3:].reshape(2, 2)


def fit(docs: DataFrame, marks: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Field:
    """marks: doc_id and 0/1 toxic of the documents to learn from."""
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Field()
    if not counts.get(0) or not counts.get(1):
        return model
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, sample / counts[1]).otherwise(sample / counts[0])
    part = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(4))
    # the sampled ids are about 2 * sample rows whatever the corpus, so they are broadcast and no text is shuffled for them;
    # copies of a text meet in the grouping, over the sample alone
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marks.where(draw < share)), "doc_id")
    chosen = stage(rows.where("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("part", part))

    def count(batches):
        for batch in slices(batches):
            w = words(batch.column("text"))
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            names: dict[str, int] = {}
            lists = [[names.setdefault(f, len(names)) for f in features(form)] for form in forms(w.vocabulary)]
            size = np.array([len(x) for x in lists], np.int64)
            flat, begin = np.array([j for x in lists for j in x], np.int64), np.concatenate(([0], np.cumsum(size))).astype(np.int64)
            n = size[w.codes]
            feat = flat[np.arange(n.sum()) + np.repeat(begin[w.codes] - np.concatenate(([0], np.cumsum(n)[:-1])), n)]
            pairs = np.unique(np.repeat(w.text_of(), n) * max(len(names), 1) + feat)
            doc, feat = np.divmod(pairs, max(len(names), 1))
            bad = np.bincount(feat, label[doc], len(names)).astype(np.int64)
            fine = np.bincount(feat, 1 - label[doc], len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(bad), pa.array(fine)], ["feature", "bad", "fine"])

    fit_rows = chosen.where("part > 0")
    n = {r["toxic"]: r["n"] for r in fit_rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return model
    odds = (F.col("bad") / float(n[1])) / ((F.col("fine") + 1) / float(n[0]))
    evidence = (fit_rows.select("text", "toxic").mapInArrow(count, "feature string, bad long, fine long").groupBy("feature")
                .agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine")).where((F.col("bad") >= MIN_DOCS) & (odds >= LIFT)).toArrow())
    model.index = {f: i for i, f in enumerate(sorted(evidence["feature"].to_pylist()))}
    model.weights = np.zeros(len(model.index))
    index = model.index

    def sequences(batches):
        """Evidence tokens of each segment: (length, positions, features, labels)."""
        for batch in slices(batches):
            w = words(batch.column("text"))
            own = [[j for j in map(index.get, features(form)) if j is not None] for form in forms(w.vocabulary)]
            has = np.array([bool(x) for x in own], bool)
            out, label = {"length": [], "at": [], "features": [], "toxic": []}, batch.column("toxic").to_pylist()
            for i in range(len(w)):
                codes = w.codes[w.starts[i]:w.starts[i + 1]]
                hits = np.flatnonzero(has[codes])
                for s in range(0, len(codes), SEGMENT):
                    at = hits[(hits >= s) & (hits < s + SEGMENT)]
                    out["length"].append(min(SEGMENT, len(codes) - s))
                    out["at"].append((at - s).tolist())
                    out["features"].append([own[codes[a]] for a in at])
                    out["toxic"].append(label[i])
            yield pa.RecordBatch.from_arrays([pa.array(out["length"], pa.int64()), pa.array(out["at"], pa.list_(pa.int64())),
                                              pa.array(out["features"], pa.list_(pa.list_(pa.int64()))), pa.array(out["toxic"], pa.int64())], list(out))

    # segments that look alike are one row with their number
    got = (fit_rows.select("text", "toxic").mapInArrow(sequences, "length long, at array<long>, features array<array<long>>, toxic long")
           .groupBy("length", "at", "features", "toxic").agg(F.count(F.lit(1)).alias("n")).collect())
    segments = [(r["length"], np.array(r["at"], int), r["features"], np.full(len(r["at"]), float(r["toxic"])), float(r["n"]))
                for r in sorted(got, key=lambda r: (r["length"], r["at"], r["features"], r["toxic"]))]
    train(model, segments)

    def measure(batches):
        for batch in slices(batches):
            w = words(batch.column("text"))
            s = summaries(np.diff(w.starts), tagged(model, w)[1])
            yield pa.RecordBatch.from_arrays([pa.array(s[:, j]) for j in range(3)] + [batch.column("toxic")], ["a", "b", "c", "toxic"])

    held = chosen.where("part = 0").select("text", "toxic").mapInArrow(measure, "a double, b double, c double, toxic int").toArrow().sort_by([(c, "ascending") for c in "abc"])
    y = held["toxic"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        x = np.column_stack([held[c].to_numpy() for c in "abc"])
        # the sample has more toxic texts than the corpus; shift the intercept back
        model.scale = logistic(x, y)
        rate, base = y.mean(), counts[1] / (counts[0] + counts[1])
        model.scale[-1] += np.log(base / (1 - base)) - np.log(rate / (1 - rate))
    return model


def score(docs: DataFrame, model: Field, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, spans (begin and end in characters, end excluded, and probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def tag(batches):
        m = shared.value
        for batch in slices(batches):
            texts = batch.column("text")
            w = words(texts)
            places, probs = tagged(m, w)
            result = m.probability(summaries(np.diff(w.starts), probs))
            spans: list[list[dict]] = [[] for _ in probs]
            if any((p >= 0.5).any() for p in probs):
                data, starts = buffers(plain_spaces(texts))
                word = data != 32
                head, tail = word.copy(), word.copy()
                head[1:] &= ~word[:-1]
                tail[:-1] &= ~word[1:]
                edge = np.unique(starts[1:-1])
                edge = edge[(edge > 0) & (edge < len(data))]
                head[edge] |= word[edge]
                tail[edge - 1] |= word[edge - 1]
                begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
                char = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                for i, (near, p) in enumerate(zip(places, probs)):
                    for a, q in zip(near[p >= 0.5], p[p >= 0.5]):
                        k, first = w.starts[i] + a, char[starts[i]]
                        spans[i].append({"begin": int(char[begin[k]] - first), "end": int(char[end[k]] - first), "probability": float(q)})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(result), pa.array((result >= threshold).astype(np.int32)), pa.array(spans, span)],
                                             ["doc_id", "score", "predicted", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tag, "doc_id long, score double, predicted int, spans array<struct<begin:long,end:long,probability:double>>")


def without_toxic(docs: DataFrame, model: Field, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold; no row is moved for it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches):
        m = shared.value
        for batch in slices(batches, text):
            w = words(batch.column(text))
            yield batch.filter(pa.array(m.probability(summaries(np.diff(w.starts), tagged(m, w)[1])) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels of documents that may be learned from, one row per document."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2):
    """True where crc32 of the id as text leaves the remainder that is kept for testing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))
