"""URL verdicts: rules first, then the ratio of two character language models.

Urls on which a rule decides are the labelled rows. For each verdict a variable-order Markov model of
characters is counted: contexts of 0 to `ORDER` characters, interpolated from short to long by Witten-Bell
weights (a context that was followed by few different characters is trusted more), ending in a uniform
distribution over bytes. A url's value is the difference of its log-likelihoods under the two models, divided by its
length. Platt's logistic fit on labelled urls held out from counting turns that into a probability
of being rejected; above one half the verdict is `block`.

Counting and calibration use a bounded sample of the labelled urls: about `sample` of each verdict by a
hash of the url, so the models have at most 2 * sample * (length + 1) * (ORDER + 1) entries; they are
broadcast as sorted arrays. The sample's urls are distinct, so a url that fills the table counts once. Judging is a
map without shuffle.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is judged by the method;
without labelled urls of both verdicts everything unruled is allowed; repeated rows are judged alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import buffers, mix

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
ORDER, SAMPLE, HELD = 5, 10_000, 4  # one labelled url in HELD calibrates
ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Markov:
    """Counts by hash of (context, character) and of contexts, for every order."""

    grams: np.ndarray
    gram_n: np.ndarray
    contexts: np.ndarray
    context_n: np.ndarray
    followers: np.ndarray


def context_hashes(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character: whether it has `order` characters before it in its url, the context's hash, and with the character."""
    place = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    h = np.full(len(data), np.uint64(order + 1))
    for j in range(order, 0, -1):
        before = np.zeros(len(data), np.uint64)
        before[j:] = data[:-j] if j else data
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(1))
    return place >= order, h, mix(h * np.uint64(0x9E3779B97F4A7C15) + data.astype(np.uint64) + np.uint64(0xABCDEF))


def at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0)


def log_likelihood(model: Markov, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    p = np.full(len(data), 1 / 256)
    for k in range(ORDER + 1):
        there, context, gram = context_hashes(data, starts, k)
        n, u = at(model.contexts, model.context_n, context), at(model.contexts, model.followers, context)
        use = there & (n > 0)
        p = np.where(use, (at(model.grams, model.gram_n, gram) + u * p) / np.maximum(n + u, 1), p)
    total = np.concatenate(([0], np.cumsum(np.log(p))))
    return total[starts[1:]] - total[starts[:-1]]


def counted(urls: DataFrame) -> Markov:
    """urls: one column `target`."""

    def grams(batches):
        for batch in batches:
            data, starts = buffers(batch.column("target"))
            for k in range(ORDER + 1):
                there, context, gram = context_hashes(data, starts, k)
                yield pa.RecordBatch.from_arrays([pa.array(context[there].view(np.int64)), pa.array(gram[there].view(np.int64))], ["context", "gram"])

    got = urls.mapInArrow(grams, "context long, gram long").groupBy("context", "gram").agg(F.count(F.lit(1)).alias("n")).toArrow()
    context, gram, n = (got[c].to_numpy() for c in ("context", "gram", "n"))
    context, gram = context.view(np.uint64), gram.view(np.uint64)
    order = np.argsort(gram)
    keys, inverse = np.unique(context, return_inverse=True)
    return Markov(gram[order], n[order].astype(float), keys, np.bincount(inverse, n, len(keys)), np.bincount(inverse, minlength=len(keys)).astype(float))


@dataclass
class Judge:
    allow: Markov
    block: Markov
    scale: float  # of Platt's logistic
    shift: float

    def probability(self, targets: pa.Array) -> np.ndarray:
        """Of being rejected."""
        z = self.scale * self.value(targets) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def value(self, targets: pa.Array) -> np.ndarray:
        data, starts = buffers(targets)
        size = np.maximum(np.diff(starts), 1)
        return (log_likelihood(self.block, data, starts) - log_likelihood(self.allow, data, starts)) / size


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit by Newton steps; targets are drawn in by one row, so the fit stays finite when classes don't overlap."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    spread = x.std() or 1.0
    z, w = np.column_stack([x / spread, np.ones_like(x)]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (t - p) - 1e-6 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Judge | None:
    """labelled: target (host and path), verdict. None if a verdict has no rows."""
    rows = labelled.where("target <> ''").groupBy("target", "verdict").agg(F.count(F.lit(1)).alias("copies"))
    counts = {r["verdict"]: r["n"] for r in rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(ALLOW) or not counts.get(BLOCK):
        return None
    draw = F.pmod(F.xxhash64("target", F.lit("url")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("verdict") == BLOCK, sample / counts[BLOCK]).otherwise(sample / counts[ALLOW])
    chosen = rows.where(draw < share).withColumn("part", F.pmod(F.xxhash64("target", F.lit("part")), F.lit(HELD)))
    allow, block = (counted(chosen.where((F.col("part") > 0) & (F.col("verdict") == v)).select("target")) for v in (ALLOW, BLOCK))
    held = chosen.where("part = 0").select("target", "verdict").toArrow().sort_by("target")
    judge = Judge(allow, block, 1.0, 0.0)
    y = np.array([v == BLOCK for v in held["verdict"].to_pylist()], float)
    if 0 < y.sum() < len(y):
        judge.scale, judge.shift = platt(judge.value(held["target"].combine_chunks()), y)
    return judge


def judge_urls(pages: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability (null where a rule decides)."""
    split = pages.select(F.col(page_id).cast("long").alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    ruled = split.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r")).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), F.concat("host", "path").alias("target"))
    model = fit(ruled.where("verdict is not null").select("target", "verdict"), sample)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def decide(batches):
        for batch in batches:
            verdict = batch.column("verdict").to_pylist()
            open_ = np.array([v is None for v in verdict], bool)
            p = np.full(len(verdict), np.nan)
            if shared.value is not None and open_.any():
                p[open_] = shared.value.probability(batch.column("target").filter(pa.array(open_)))
            elif open_.any():
                p[open_] = 0.0
            verdict = [v or (BLOCK if q > 0.5 else ALLOW) for v, q in zip(verdict, p)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(p, mask=~open_)],
                                             ["page_id", "host", "path", "rule", "verdict", "block_probability"])

    return ruled.mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string, block_probability double")
