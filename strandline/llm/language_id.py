"""Language of whole texts by a string kernel.

Kernel: blended spectrum with presence. A text is the set of its character n-grams of 1 to `GRAMS` characters
(lower case, hashed to `BUCKETS`); k(x, y) counts the n-grams that both have, divided by the root of the
product of their own counts. Nystroem landmarks stand for the kernel, and one ridge regression per language
(one against the rest) is solved in the landmarks' coordinates: (K'K + ridge * n * Kmm) b = K'Y.

Fitting uses bounded samples of labelled rows: about `sample` texts of each language, chosen by a hash of
the id, and of them `landmarks` texts in all. Tasks multiply their texts with the landmark matrix and send
sums of the size of the landmarks alone. Scoring needs no landmark at all: the kernel is linear in presence,
so landmarks and coefficients fold into one matrix (bucket, language), and a batch of texts is a sparse matrix of
presence times that matrix. Scoring is a map without shuffle; the matrix has a fixed size for each language.

Defined cases: a null text or one without a letter is `und` with score 0; a null label is never learned;
without any label every text is `und`; ties go to the language first by name; repeated rows count as often as
they come; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix, slices

GRAMS, BUCKET_BITS = 4, 17
BUCKETS = 1 << BUCKET_BITS
SAMPLE, LANDMARKS, RIDGE = 1500, 192, 1e-3
UNKNOWN = "und"


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, each once, one text after the other; and where each text begins."""
    out, begin = [], [0]
    seen = np.zeros(BUCKETS, bool)
    for text in texts:
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = np.zeros(len(c) + 1, np.uint64)
        for n in range(1, GRAMS + 1):
            if len(c) < n:
                break
            h = h[:len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:] + np.uint64(1)
            seen[mix(h) >> np.uint64(64 - BUCKET_BITS)] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        out.append(found)
        begin.append(begin[-1] + len(found))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array(begin)


def product(found: np.ndarray, begin: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sparse presence matrix times a dense matrix (bucket, column)."""
    out = np.zeros((len(begin) - 1, matrix.shape[1]))
    for i, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
        if b > a:
            out[i] = matrix[found[a:b]].sum(axis=0, dtype=np.float64)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (bucket, language)
    bias: np.ndarray


def letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE,
        landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """labelled: rows to learn from."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & letters(F.col("text")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(sample / counts[k]))])
    chosen = rows.where(draw < share[F.col("lang")])
    each = max(1, landmarks // len(languages))
    marks = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(3 * each / counts[k]))])
    # about three times as many as wanted are drawn, so that the first of them by the draw are there
    near = chosen.where(draw < marks[F.col("lang")]).withColumn("draw", draw)

    def sets(batches):
        for batch in slices(batches):
            found, begin = presence(batch.column("text").to_pylist())
            lists = pa.LargeListArray.from_arrays(pa.array(begin, pa.int64()), pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), lists.cast(pa.list_(pa.int64()))], ["lang", "draw", "buckets"])

    drawn = near.select("lang", "draw", "text").mapInArrow(sets, "lang string, draw double, buckets array<long>").toArrow().sort_by("draw")
    kept: dict[str, int] = {}
    chosen_sets = []
    for k, b in zip(drawn["lang"].to_pylist(), drawn["buckets"]):
        kept[k] = kept.get(k, 0) + 1
        if kept[k] <= each:
            chosen_sets.append(np.array(b.values.to_numpy(zero_copy_only=False)))
    m = len(chosen_sets)
    if not m:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    has = np.zeros((BUCKETS, m), np.uint8)
    for j, b in enumerate(chosen_sets):
        has[b, j] = 1
    own = np.sqrt([len(b) for b in chosen_sets])
    c = len(languages)

    def sums(batches):
        total = np.zeros((m + 1, m + 1 + c))
        index = {k: i for i, k in enumerate(languages)}
        for batch in slices(batches):
            found, begin = presence(batch.column("text").to_pylist())
            k = product(found, begin, has) / own / np.sqrt(np.maximum(np.diff(begin), 1))[:, None]
            y = np.zeros((len(k), c))
            y[np.arange(len(k)), [index[x] for x in batch.column("lang").to_pylist()]] = 1
            k = np.hstack([k, np.ones((len(k), 1))])
            total += k.T @ np.hstack([k, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    summed = (chosen.select("lang", "text").repartition(16).mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
              .toArrow())
    total = np.zeros((m + 1) * (m + 1 + c))
    total[summed["at"].to_numpy()] = summed["value"].to_numpy()
    total = total.reshape(m + 1, m + 1 + c)
    n = max(total[m, m], 1.0)
    kmm = (has.T.astype(np.float32) @ has.astype(np.float32)) / np.outer(own, own)
    left = total[:, :m + 1].copy()
    left[:m, :m] += ridge * n * (kmm + 1e-6 * np.eye(m))
    left += 1e-9 * n * np.eye(m + 1)
    beta = np.linalg.solve(left, total[:, m + 1:])
    return Model(languages, (has.astype(np.float32) @ (beta[:m] / own[:, None]).astype(np.float32)), beta[m])


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score: the regression of the best language, cut to 0..1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if m.languages:
                found, begin = presence(texts)
                r = product(found, begin, m.weights) / np.sqrt(np.maximum(np.diff(begin), 1))[:, None] + m.bias
                best = r.argmax(axis=1)
                names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                score = np.where(known, np.clip(r[np.arange(len(r)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), letters(F.col(text)).alias("known"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")
