"""Operators of the llm folder against brute force, round trips and held-out accuracy, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import exact_dedup, language_id, lm_score, near_dedup, packing, pieces, queries, substrings, toxicity, url_filter, vectors
from strandline.llm import words as W
from strandline.llm.chunks import Chunks

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 61}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "one  two\tthree four five six"),
       (7, LONG), (8, LONG + " end"), (9, "É\x85né <|endoftext|> 中文 😀 a  b"), (10, "ab\x00c"), (None, "a row without an id"), (11, "one"), (12, None)]
CLASHING = "key long, row long, rep long, component long, bucket string, cell long, words long, h long, n long, text_sha256 string"


def odd(spark, rows=ODD):
    """Documents with nulls, empty, long and repeated texts, and columns named like those the operators make."""
    extra = tuple(None if c % 2 else ("x" if t == "string" else c) for c, t in enumerate(x.split()[1] for x in CLASHING.split(", ")))
    return spark.createDataFrame([(*r, "en", "s", 0, *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def empty(spark):
    return odd(spark, [])


def split(text):
    return [w for w in SPACE.split(text or "") if w]


# words


def test_words_of_a_batch():
    texts = [None, "", "a b  a\t\nc ", "É b", "  "]
    w = W.words(pa.array(texts))
    v = w.vocabulary.to_pylist()
    assert [[v[c] for c in w.codes[a:b]] for a, b in zip(w.starts, w.starts[1:])] == [split(t) for t in texts]
    assert len(set(W.hashed(w.vocabulary).tolist())) == len(v)
    assert (W.hashed(pa.array(["xy", "b"])) == W.hashed(pa.array(["q", "xy", "b"]))[1:]).all()


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 30, 1, 1, 0)]})
    got = [b.column("text").to_pylist() for b in W.slices([batch, batch.slice(0, 0)], limit=10)]
    assert sum(got, []) == batch.column("text").to_pylist() and len(got) == 2


# 1


def brute_links(rows, threshold=0.95):
    good = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows
            if v and None not in v and np.isfinite(v).all() and any(v)}
    return {(a, b) for a, b in itertools.combinations(sorted(good), 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold}


def reach(ids, links):
    top = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(top[a], top[b])
            changed |= top[a] != m or top[b] != m
            top[a] = top[b] = m
    return top


def test_near_vectors_match_brute_force(spark, block=6):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 24))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.18 * r.standard_normal(24)]) for i in range(100)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]
    rows += [(200, None), (201, [0.0] * 24), (202, [float("nan")] + [1.0] * 23), (203, [None] + [1.0] * 23), (204, [float("inf")] + [1.0] * 23), (205, []), (206, [1.0, 2.0]), (207, [2.0, 4.0])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, label int, rep long")
    got = {x.vec_id: x for x in vectors.near_vectors(df, block=block, recall=0.9999999).collect()}
    links = brute_links(rows)
    degree, top = Counter(x for p in links for x in p), reach([i for i, _ in rows], links)
    assert len(got) == len(rows) and links
    assert {i: (x.n_links, x.component_id, x.kept) for i, x in got.items()} == {i: (degree[i], top[i], top[i] == i) for i, _ in rows}
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_estimates_are_unbiased_within_their_bounds():
    d, r = 64, np.random.default_rng(1)
    x, y = r.standard_normal((400, d)), r.standard_normal((400, d))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, 0.7 * x + 0.3 * y))
    error, bound = [], []
    for seed in range(20):
        q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
        zx, zy = x @ q, y @ q
        f = np.abs(zx).sum(1) / math.sqrt(d)
        error.append((np.sign(zx) / math.sqrt(d) * zy).sum(1) / f - (x * y).sum(1))
        bound.append(vectors.WIDTH * np.sqrt((1 - f * f) / f / f / (d - 1)))
    assert abs(np.mean(error)) < 0.003 and np.mean(np.abs(error) > np.array(bound)) < 0.01


# 2


def test_marginals_match_enumeration():
    r = np.random.default_rng(5)
    model = toxicity.Field(bias=-0.7, start=r.standard_normal(2), step=r.standard_normal((2, 2)))
    for n, at in ((9, [4]), (12, [0, 7]), (10, [2, 3, 9]), (1, [0])):
        extra = r.standard_normal(len(at)) * 2
        e = np.full(n, model.bias)
        e[at] += extra
        total, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            s = model.start[y[0]] + sum(e[i] for i in range(n) if y[i]) + sum(model.step[a, b] for a, b in zip(y, y[1:]))
            total += math.exp(s)
            on += math.exp(s) * np.array(y)
        near, p = toxicity.marginals(model, n, np.array(at), extra)
        assert np.allclose(p, on[near] / total)


def test_training_raises_weights_of_evidence():
    model = toxicity.Field({"=bad": 0, "=odd": 1}, np.zeros(2))
    segments = [(5, np.array([2]), [[0]], np.ones(1), 30.0), (5, np.array([1]), [[1]], np.zeros(1), 30.0), (5, np.array([], int), [], np.zeros(0), 50.0)]
    toxicity.train(model, segments)
    assert model.weights[0] > 3 > model.weights[1]


def test_toxicity_on_held_out_labels_and_odd_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, toxicity.learnable(labels))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    hit = sum(truth[i] and got[i].predicted for i in truth)
    assert len(got) == docs.count()
    assert hit >= 0.9 * sum(truth.values()) and hit >= 0.9 * sum(got[i].predicted for i in truth)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got.values():
        for s in r.spans:
            assert re.fullmatch(r"[^\x20\x09-\x0D]+", text[r.doc_id][s.begin:s.end])
    rows = odd(spark)
    scores = toxicity.score(rows, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    kept = toxicity.without_toxic(rows, model)
    assert kept.columns == rows.columns and kept.count() == sum(not r.predicted for r in scores)
    assert toxicity.score(empty(spark), model).count() == 0
    assert {r.score for r in toxicity.score(rows, toxicity.fit(docs, toxicity.learnable(labels.where("toxic = 0")))).collect()} == {0.0}


# 3


def test_exact_duplicates(spark):
    got = exact_dedup.exact_duplicates(odd(spark)).collect()
    norm = [(i, SPACE.sub(" ", t or "")) for i, t in ODD]
    size, first = Counter(t for _, t in norm), {}
    for i, t in norm:
        first[t] = min((x for x in (first.get(t), i) if x is not None), default=None)
    want = sorted((str(i), str(first[t]), size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('text ', id % 200) as text")
    index = exact_dedup.build(docs, capacity=16)
    sizes = [r["count"] for r in index.buckets.groupBy("bucket").count().collect()]
    assert sum(sizes) == 200 and max(sizes) <= 16 and index.depth >= 4
    slots = index.directory.collect()
    assert {r.slot for r in slots} <= set(range(2 ** index.depth)) and min(r.local_depth for r in slots) <= index.depth
    later = spark.createDataFrame([(900, "text  7"), (901, "unknown")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.look_up(index, later).collect()} == {900: 7, 901: None}


def test_chains_compare_bytes_and_tasks_combine_copies(monkeypatch):
    """Different texts under one key are entries of one chain; a task sends a repeated text once, as far as it may carry."""
    schema = pa.schema([("key", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64())])
    rows = [(7, "a", 5), (7, "b", 4), (7, "a", 3), (8, "c", 1)]
    batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    sent = lambda: Counter((r["key"], r["text"], r["keep_id"], r["n"]) for b in exact_dedup.combined([batch, batch]) for r in b.to_pylist())
    assert sent() == Counter({(7, "a", 3, 4): 1, (7, "b", 4, 1): 2, (8, "c", 1, 1): 2})
    monkeypatch.setattr(exact_dedup, "CARRIED", 0)
    assert sent()[7, "a", 3, 2] == 2
    owned = [("0/0", 0, 7, "b", 4, 1), ("0/0", 0, 7, "a", 3, 4), ("0/0", 0, 7, "b", None, 1), ("0/0", 0, 8, "c", 1, 2)]
    names = ["bucket", "local_depth", "key", "text", "keep_id", "n"]
    parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*owned[a:b])], names) for a, b in ((0, 2), (2, 4))]
    got = [tuple(r.values()) for b in exact_dedup.chained(parts) for r in b.to_pylist()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [("0/0", 0, 7, 1, sha("b"), 4, 2), ("0/0", 0, 7, 2, sha("a"), 3, 4), ("0/0", 0, 8, 1, sha("c"), 1, 2)]


# 4


def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/en/2", "x://notexample.org/es/", "http://b.com/fr/#f", "http://com/de/9",
            "http://a.com?x://c.org/", "http://org", "no url", None, "", "://", "http://x.net/a?b/c://d"]

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        h = re.match(r"[^/?#]*", rest)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h), re.match(r"[^?#]*", rest[len(h):])[0]

    def rule(h, p):
        fit = [(len(r), r, v) for r, v in url_filter.RULES for name, _, rest in [r.partition("/")] if (h == name or h.endswith("." + name)) and p.startswith("/" + rest)]
        return max(fit)[1:] if fit else (None, None)

    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, target string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    for i, u in enumerate(urls):
        h, p = parts(u)
        want, verdict = rule(h, p)
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, want), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_markov_model_is_a_distribution_and_the_ratio_separates(spark):
    rng = random.Random(1)
    good = ["".join(rng.choice("abcd") for _ in range(12)) for _ in range(400)]
    bad = ["".join(rng.choice("wxyza") for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t, "allow") for t in good] + [(t, "block") for t in bad], "target string, verdict string")
    judge = url_filter.fit(df)
    for prefix in ("", "ab", "abcab", "zz"):
        rows = [prefix + chr(c) for c in range(1, 128)]
        data, starts = W.buffers(pa.array(rows))
        base = url_filter.log_likelihood(judge.allow, *W.buffers(pa.array([prefix])))[0] if prefix else 0.0
        mass = np.exp(url_filter.log_likelihood(judge.allow, data, starts) - base).sum()
        assert 0.5 < mass <= 1 + 1e-9
    p = judge.probability(pa.array(["abcdabcd", "wxyzwxyz"]))
    assert p[0] < 0.2 and p[1] > 0.8
    assert url_filter.fit(df.where("verdict = 'allow'")) is None


# 5


def test_language_model(spark):
    texts = [(i, random.Random(i).choice(["The cat sat on the mat", "Der Hund lag auf der Matte"]) + f" x{i % 40} rare{i}") for i in range(120)] + [(500, None), (501, ""), (502, "the THE unseen")]
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, row long, word string")
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    toks = {i: [w.translate(low) for w in split(t)] + [""] for i, t in texts}
    c = Counter(w for i in toks if learn(i) for w in toks[i])
    n, v = sum(c.values()), len(c)
    for head in (5, 65536):
        got = {r.doc_id: r for r in lm_score.score(docs, ~toxicity.held_out("doc_id", 7, 2), head_size=head, rounds=1).collect()}
        for i, ws in toks.items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
            assert r.score <= 0
        held = [i for i in toks if not learn(i)]
        assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
        scores = {i: r.score for i, r in got.items()}
        assert head == 5 or all(math.isclose(scores[i], last[i], rel_tol=0.2, abs_tol=1.0) for i in scores)
        last = scores
    assert lm_score.score(empty(spark), ~toxicity.held_out("doc_id", 7, 2), rounds=1).count() == 0
    assert lm_score.score(odd(spark), ~toxicity.held_out("doc_id", 7, 2), rounds=1).count() == len(ODD)


def test_model_is_not_coarser_than_stated(monkeypatch):
    """24 own words, 39 classes by ending, and a gradient step for every 4,096 tokens."""
    head = lm_score.Head([lm_score.END, *[f"w{i}" for i in range(40)]], np.arange(41, 0, -1))
    assert len(head.own()) == 24
    endings = pa.array([f"{a}{b}" for a, b in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2)], pa.large_string())
    assert len(set(lm_score.classes(endings, {}).tolist())) == 39
    steps, real = [], lm_score.softmax
    monkeypatch.setattr(lm_score, "softmax", lambda w, r: steps.append(len(r)) or real(w, r))
    w = np.zeros((lm_score.ROWS, lm_score.CLASSES), np.float32)
    lm_score.descend(w, w.copy(), np.zeros(16_384, np.int64), np.zeros((16_384, 5), np.uint16))
    assert steps == [4096] * 4


def test_class_softmax_and_gradient():
    r = np.random.default_rng(0)
    w = r.standard_normal((lm_score.ROWS, lm_score.CLASSES)).astype(np.float32)
    rows = r.integers(0, lm_score.ROWS, (50, 5))
    assert np.allclose(np.exp(lm_score.softmax(w, rows)).sum(1), 1, atol=1e-5)
    kind = r.integers(0, 4, 4000)
    rows = np.column_stack([np.zeros(4000, int), 10 + kind, *(r.integers(100, 200, 4000) for _ in range(3))])
    w, s = np.zeros((lm_score.ROWS, lm_score.CLASSES), np.float32), np.zeros((lm_score.ROWS, lm_score.CLASSES), np.float32)
    before = lm_score.softmax(w, rows)[np.arange(4000), kind].mean()
    for _ in range(20):
        lm_score.descend(w, s, kind, rows)
    assert lm_score.softmax(w, rows)[np.arange(4000), kind].mean() > before + 2


@pytest.mark.parametrize("spread", [1, 60, 3000, 30_000])
def test_gradient_steps_equal_the_plain_form(spread):
    """Sums of few and of many rows, written as one sort and one reduceat, give the same weights."""
    r = np.random.default_rng(spread)
    n = 9000
    kind = r.integers(0, lm_score.CLASSES, n)
    rows = np.column_stack([np.zeros(n, int), *(np.minimum(r.geometric(1 / spread, n), lm_score.ROWS - 1) for _ in range(4))]).astype(np.uint16)
    g = r.standard_normal((n, lm_score.CLASSES)).astype(np.float32)
    at, total = lm_score.summed(g, rows[:, 1])
    assert at.tolist() == sorted(set(rows[:, 1].tolist()))
    want = np.zeros((lm_score.ROWS, lm_score.CLASSES))
    np.add.at(want, rows[:, 1], g)
    assert np.allclose(total, want[at], atol=1e-2)
    w, s = np.zeros((lm_score.ROWS, lm_score.CLASSES), np.float32), np.zeros((lm_score.ROWS, lm_score.CLASSES), np.float32)
    w2, s2 = w.copy(), s.copy()
    lm_score.descend(w, s, kind, rows)
    for a in range(0, n, lm_score.BATCH):
        k, f = kind[a:a + lm_score.BATCH], rows[a:a + lm_score.BATCH]
        z = sum(w2[f[:, j]] for j in range(5))
        z = z - z.max(axis=1, keepdims=True)
        step = np.eye(lm_score.CLASSES)[k] - np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        for j in range(5):
            total = np.zeros(w.shape)
            np.add.at(total, f[:, j], step)
            s2 += total * total
            w2 += lm_score.RATE * total / np.sqrt(s2 + 1)
    assert np.allclose(w, w2, atol=1e-4) and np.allclose(s, s2, rtol=1e-3, atol=1e-3)


# 6


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6(spark, sf).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang]
    assert len(got) == docs.count() and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    model = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd(spark), model).collect()} == {"und"}
    model = language_id.fit(docs.where("doc_id < 200"))
    rows = language_id.predict(odd(spark), model).collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 12}
    assert all(0 <= r.score <= 1 for r in rows) and language_id.predict(empty(spark), model).count() == 0


def test_presence_kernel_matches_sets():
    def grams(t):
        return {t.lower()[i:i + n] for n in range(1, language_id.GRAMS + 1) for i in range(len(t) - n + 1)}
    texts = ["Straße und Weg", "the way", "the Way home"]
    found, begin = language_id.presence(texts)
    sets = [set(found[a:b].tolist()) for a, b in zip(begin, begin[1:])]
    for i, j in itertools.product(range(3), repeat=2):
        assert abs(len(sets[i] & sets[j]) - len(grams(texts[i]) & grams(texts[j]))) <= 1


# 7


def test_pieces_equal_the_encoder_and_decode_back(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    signs = list("abthe  \n\t'.,1é😀  ñ|#①ﬁＡ▁") + ["the", " s", "ing", "    ", "aaaa"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [t for _, t in ODD] + ["the" * 400, " " * 90]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = pieces.encode(docs)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    rows = pieces.round_trip(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r.restored for r in rows) and pieces.round_trip(empty(spark)).count() == 0


# 8


def runs_of(text):
    w = split(text)
    return {k: 1 + math.log2(n) for k, n in Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))).items()} if w else {}


def index_of(a, b):
    """Sum over common runs d of 1 / sum over all runs e of max(a[e] / a[d], b[e] / b[d]); runs of one ratio a / b are added up first."""
    sums: dict[float, list[float]] = {}
    for e in a.keys() | b.keys():
        part = sums.setdefault(a.get(e, 0) / b[e] if e in b else math.inf, [0.0, 0.0])
        part[0] += a.get(e, 0)
        part[1] += b.get(e, 0)
    out = 0.0
    for d in a.keys() & b.keys():
        r = a[d] / b[d]
        out += 1 / sum(x / a[d] if q >= r else y / b[d] for q, (x, y) in sums.items())
    return out


def test_probability_jaccard_and_its_estimate():
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base + base[:20])] + [" ".join(w if rng.random() > p else "other" for w in base) for p in (0.005, 0.02, 0.05)]
    w = W.words(pa.array(texts))
    owner, h, times = near_dedup.weighted(w)
    sig = near_dedup.signatures(owner, h, near_dedup.weight(times), len(texts))
    for i, j in itertools.combinations(range(4), 2):
        exact = index_of(runs_of(texts[i]), runs_of(texts[j]))
        mine = near_dedup.probability_jaccard(*(x[owner == k] if x is h else near_dedup.weight(x[owner == k]) for k in (i, j) for x in (h, times)))
        assert math.isclose(mine, exact, rel_tol=1e-9)
        assert abs((sig[i] == sig[j]).mean() - exact) < 5 * math.sqrt(max(exact * (1 - exact), 0.01) / near_dedup.REGISTERS)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    rows = list(ODD)
    for g in range(6):
        base = [f"g{g}n{rng.randrange(300)}" for _ in range(120)]
        for k in range(14):  # copies of copies, so that components reach further than links
            rows.append((100 + 20 * g + k, " ".join(base)))
            if k % 3:
                base = list(base)
                base[rng.randrange(120)] = f"new{rng.randrange(9999)}"
    found = near_dedup.near_duplicates(odd(spark, rows)).collect()
    got, kept = {r.doc_id: r for r in found}, Counter(r.doc_id for r in found if r.kept)
    sets = {i: runs_of(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and abs(len(sets[a]) - len(sets[b])) < 200 and len(sets[a].keys() & sets[b].keys()) > 0.5 * len(sets[a])
             and (sets[a] == sets[b] or index_of(sets[a], sets[b]) >= 0.8)]
    top = reach(sets, links)
    assert {i: got[i].component_id for i in sets} == top and all(kept[i] == (top[i] == i) for i in sets)  # one row where an id repeats
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


# 9


def test_packing_round_trip(spark, sf, windows=2):
    rows = ODD + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    docs = odd(spark, rows).repartition(5)
    got = packing.pack(docs, windows=windows).collect()
    tok = Chunks().tokenizer
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    once = {i for i, n in Counter(i for i, _ in rows).items() if n == 1}
    for i in once:
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            part = np.array(ids[i][r.start:r.start + r.length], "<u4")
            assert r.start == at and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[i])
            at += r.length
        assert at == len(ids[i])
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 1024 and sum(v < 1024 for v in by.values()) <= 1
    assert sum(by.values()) == sum(len(ids[i]) for i, _ in rows)
    assert packing.pack(empty(spark)).count() == 0


def test_chunks_equal_whole_texts():
    rng = random.Random(1)
    signs = list("ab  \n\t'.,1é😀  ñ|#") + ["the", " s", "'ll"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [t for _, t in ODD]
    c = Chunks()
    ids, at = c.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [c.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


# 10


def cut_by_hand(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            if k in seen:
                gone[p:p + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,kmer,letters", [(5, 2, 3), (20, 8, 2)])
def test_repeats_match_brute_force(spark, window, kmer, letters):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abcdef"[:letters]) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(200, None), (201, ""), (202, LONG), (203, "start " + LONG)]
    got = substrings.remove_repeats(odd(spark, rows), window=window, kmer=kmer).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == cut_by_hand(rows, window)
    text = dict(rows)
    for r in got:
        for p in r.paths:
            assert split(text[r.doc_id])[p.begin:p.begin + p.words] == split(text[p.source])[p.source_begin:p.source_begin + p.words]
    assert substrings.remove_repeats(empty(spark)).count() == 0 and substrings.remove_repeats(odd(spark)).count() == len(ODD)


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    model = toxicity.fit(docs, toxicity.learnable(spark.read.parquet(f"{sf}/labels.parquet")))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    one = C.drop_toxic(spark, docs, sf).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, _ in rows) and one.columns == docs.columns
    first = {}
    for i, t in sorted(rows):
        first.setdefault(SPACE.sub(" ", t or ""), i)
    two = C.drop_copies(spark, one, sf).cache()
    assert {r.doc_id for r in two.collect()} == set(first.values())
    three = C.drop_near_copies(spark, two, sf).cache()
    kept = {r.doc_id for r in three.collect()}
    sets = {r.doc_id: runs_of(r.text) for r in two.collect()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a].keys() & sets[b].keys()) > 0.5 * max(len(sets[a]), len(sets[b]), 1) and index_of(sets[a], sets[b]) >= 0.8]
    top = reach(sets, links)
    assert kept == {i for i in sets if top[i] == i}
    four = C.drop_passages(spark, three, sf).cache()
    want = cut_by_hand([(r.doc_id, r.text) for r in three.collect()], 20)
    assert four.columns == docs.columns and four.count() == len(kept)
    assert {r.doc_id: hashlib.sha256(" ".join(split(r.text)).encode()).hexdigest() for r in four.collect()} == {i: v[2] for i, v in want.items()}
    assert C.pack_documents(spark, four, sf).select("doc_id").distinct().count() == len(kept)
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact dedup", "near dedup", "substring dedup", "packing"]


def test_duplicate_stages_decide_by_row(spark):
    import corpus_pipeline as C

    rng = np.random.default_rng(5)
    a, b, c, e = (" ".join("w" + str(x) for x in rng.integers(0, 100_000, 80)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, a), (9, e), (9, f"{b} {e}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bag = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    want = Counter({(3, a): 1, (5, b): 1, (7, c): 1, (None, a): 1, (9, e): 1, (9, f"{b} {e}"): 1})
    assert bag(C.drop_copies(spark, docs, "")) == want
    near = spark.createDataFrame(rows[:6], "doc_id long, text string")
    assert bag(C.drop_near_copies(spark, near, "")) == Counter({(3, a): 1, (5, b): 1, (7, c): 1, (None, a): 1})
    got = Counter((r.doc_id, len(r.text.split())) for r in C.drop_passages(spark, docs, "").collect())
    # one row of each text stays whole; the joined text loses both halves, or the later of two rows its own
    assert got[(3, 80)] == 1 and got[(5, 80)] == 1 and got[(5, 0)] == 1 and got[(7, 80)] == 1 and got[(7, 0)] == 1 and got[(None, 80)] == 1
    assert sum(n for (i, _), n in got.items() if i == 9) == 2 and sum(k * n for (i, k), n in got.items() if i == 9) == 80


def test_stages_on_odd_tables(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    own = "row_key long, _row long, _kept_text string, kept_text string, its_key string, copy int"
    for rows in (ODD, []):
        docs = spark.createDataFrame([(*r, "en", "s", 5, 1, 2, "a", "b", None, 7) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {own}")
        for name, step in C.STAGES:
            out = step(spark, docs, sf)
            assert name == "packing" or out.columns == docs.columns, name
            got = [r.doc_id for r in out.collect()]
            assert (len(got) > 0) == bool(rows), name
            if name in ("toxicity", "substring dedup"):
                assert len(got) == len(rows)
            assert None in got or not rows
    # a text that repeats another one's id is judged by itself
    rows = [(1, " ".join(f"x{i}" for i in range(30))), (2, " ".join(f"x{i}" for i in range(30))), (2, " ".join(f"y{i}" for i in range(40))), (None, " ".join(f"y{i}" for i in range(40)))]
    docs = odd(spark, rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == Counter({(1, 30, 0): 1, (2, 30, 30): 1, (2, 40, 0): 1, (None, 40, 40): 1})
    near = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert near == Counter({(1, 1, True): 1, (2, 1, False): 1, (2, 2, True): 1, (None, 2, False): 1})
