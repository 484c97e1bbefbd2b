"""Whitening, centroid clustering and mixing against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from compare import difference, duck
from strandline.llm import centroids, dense, mixing, queries, whitening

NAN, INF = float("nan"), float("inf")
CLASHING = "v array<double>, hash string, cluster int, range int, rank long, rate double, its_rate int, IT_S int"


def vectors(spark, rows):
    extra = ([1.0], "x", 1, 2, 3, 0.5, None, 4)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"vec_id long, embedding array<double>, {CLASHING}")


def odd_vectors(d, n, seed=1, scale=0.2):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.standard_normal(d) * scale).tolist()) for i in range(n)]
    bad = [NAN, INF, -INF, None]
    return rows + [(900, None), (901, []), *((910 + k, [b] + [0.1] * (d - 1)) for k, b in enumerate(bad)), (920, [0.1] * (d + 1)), (0, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (930, [0.0] * d)]


def fine(rows, d):
    return [(i, v) for i, v in rows if v is not None and len(v) == d and None not in v and np.isfinite(v).all()]


def test_lists_as_matrices():
    lists = pa.array([[1.0, 2.0], None, [], [None, 1.0], [3.0, INF], [5.0, 6.0]], pa.list_(pa.float64()))
    assert dense.lengths(lists).tolist() == [2, -1, 0, 2, 2, 2]
    for a in (lists, pa.concat_arrays([lists, lists]).slice(6)):
        rows, x = dense.matrix(a, 2)
        assert rows.tolist() == [0, 5] and x.tolist() == [[1, 2], [5, 6]]


# 11


@pytest.mark.parametrize("shape", ["random", "equal", "close", "low rank", "zero", "one", "negative"])
def test_slices_of_a_spectrum(shape):
    rng = np.random.default_rng(4)
    d = 1 if shape == "one" else 24
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"random": rng.random(d) * 100, "equal": np.repeat([5.0, 5.0, 2.0, 1.0], 6), "close": 1 + np.arange(d) * 1e-9, "low rank": np.r_[9.0, np.zeros(d - 1)],
         "zero": np.zeros(d), "one": np.array([3.0]), "negative": rng.standard_normal(d)}[shape]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    for s in (-0.5, 0.3, 1.7, 50.0):
        assert whitening.above(v, s) == (e > s).sum()
    e = np.sort(e)[::-1]
    values, x = whitening.leading(v, 10, 1e-9)
    want = e[:10][e[:10] > 1e-9]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-12)
    assert np.allclose(x.T @ x, np.eye(len(want)), atol=1e-12) and np.allclose(v @ x, x * values, atol=1e-11 * max(abs(e).max(), 1))


def whitened_by_hand(rows, d, components=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s).astype(float) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    m = min(components, (e > 1e-11 * v.trace()).sum())
    return n, [sum(t * t for t in r) for r in n * x - s], y @ q[:, :m] / np.sqrt(e[:m]), e[:m] / v.trace()


@pytest.mark.parametrize("d,n,scale", [(40, 300, 0.2), (6, 50, 3.0), (5, 40, 1e9), (8, 5, 1.0)])
def test_whitening_matches_dense_eigenvectors(spark, d, n, scale):
    rows = odd_vectors(d, n, scale=scale)
    got = whitening.whiten(vectors(spark, rows).repartition(5)).collect()
    kept = fine(rows, d)
    count, deviation, white, explained = whitened_by_hand(kept, d)
    m = len(explained)
    assert len(got) == len(kept) * m and {r.n for r in got} == {count} and all(r.identity_error < 1e-6 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    table = np.array([[by[i][c + 1][0].whitened for c in range(m)] for i, _ in kept])
    sign = np.sign((table * white).sum(axis=0))
    assert np.allclose(table * sign, white, atol=1e-6)
    limit = 2 ** 63 - 1
    assert all({x.deviation for rs in by[i].values() for x in rs} == {w if w <= limit else None} for (i, _), w in zip(kept, deviation))
    assert np.allclose([by[None][c + 1][0].explained for c in range(m)], explained, rtol=1e-8)
    assert len(by[0][1]) == 3


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None), (2, [])], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [NAN])], [(1, [1e300])]):
        assert whitening.whiten(vectors(spark, rows)).count() == 0
    # equally frequent lengths: the shorter one
    got = whitening.whiten(vectors(spark, [(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [5.0, 2.0])])).collect()
    assert {r.vec_id for r in got} == {1, 2}


def test_exact_products_of_large_entries():
    a = np.array([[2 ** 45, -3], [5, 2 ** 19], [7, 11]], np.int64)
    assert (whitening.products(a) == (a.astype(object).T @ a.astype(object))).all()


# 12


def clusters_by_hand(rows, k, rounds, d, seed=3):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in fine(rows, d)]
    key = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "z"
    cent = [v for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cent))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(cent)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cent[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    inertia = Counter()
    for s, j in last:
        inertia[j] += s
    return Counter((i, j, s, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()) for (i, _), (s, j) in zip(kept, last))


@pytest.mark.parametrize("k,d,n,scale,leaf", [(8, 64, 150, 0.2, 2), (13, 4, 120, 0.003, 2), (3, 5, 40, 1e5, 2), (5, 3, 4, 1.0, 2)])
def test_clusters_match_brute_force(spark, k, d, n, scale, leaf):
    rows = odd_vectors(d, n, scale=scale) + [(500 + i, [0.25] * d) for i in range(30)]
    got = centroids.cluster_vectors(vectors(spark, rows).repartition(4), k, 4, d).collect()
    limit = 2 ** 63 - 1
    want = Counter()
    for (i, j, s, a, b, h), c in clusters_by_hand(rows, k, 4, d).items():
        want[i, j, *(v if v <= limit else None for v in (s, a, b)), h] += c
    assert Counter(tuple(r) for r in got) == want


def test_components_beyond_a_long(spark):
    rows = [(i, [(-1) ** i * 10.0 ** (i % 9 * 30), float(i % 5)]) for i in range(40)] + [(50, [1e308, -1e308])]
    got = centroids.cluster_vectors(vectors(spark, rows), 4, 3, 2).collect()
    want = clusters_by_hand(rows, 4, 3, 2)
    assert Counter((r.vec_id, r.cluster, r.centroid_sha256) for r in got) == Counter({(i, j, h): c for (i, j, _, _, _, h), c in want.items()})
    assert {r.vec_id: r.distance for r in got} == {i: s if s < 2 ** 63 else None for i, _, s, *_ in want}


@pytest.mark.parametrize("exact", [False, True])
def test_tree_meets_ties_and_prunes(exact):
    rng = np.random.default_rng(8)
    c = rng.integers(-4, 5, (60, 3))
    c[40:50] = c[:10]  # equal centroids
    x = rng.integers(-5, 6, (400, 3))
    if exact:
        c, x = c.astype(object), x.astype(object)
    square = ((x[:, None] - c[None]) ** 2).sum(axis=2).astype(np.int64)
    for leaf in (1, 2, 7, 60):
        own, best = centroids.Tree(c, leaf).search(x)
        assert (own == square.argmin(axis=1)).all() and (best.astype(np.int64) == square.min(axis=1)).all()


def test_few_and_no_vectors(spark):
    assert centroids.cluster_vectors(vectors(spark, [])).count() == 0
    assert centroids.cluster_vectors(vectors(spark, [(1, None), (2, [1.0])]), dimension=2).count() == 0
    got = centroids.cluster_vectors(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]), dimension=2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in got] == [(0, 0, 0)] * 2


# 13


def mixed_by_hand(docs, weights=(5, 2, 1), repeat=3):
    size = Counter()
    for _, t, s in docs:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped: set = set()
    while True:  # round by round, as the reshare is told
        rest = sum(size.values()) - sum(repeat * size[s] for s in stopped)
        among = sum(w[s] for s in order if s not in stopped)
        target = {s: repeat * size[s] if s in stopped else w[s] * rest / among for s in order}
        more = {s for s in order if s not in stopped and target[s] > repeat * size[s] * (1 + 1e-12)}
        if not more:
            return size, target
        stopped |= more


ROWS = [(i, "w " * (i % 13 + 1) + ("\x0b\x1cx" if i % 7 else "é\x85"), ["a", "b", "B", "é", None, "tiny", "\U0001F600", "！"][i % 8]) for i in range(900)]
ROWS += [(i, "w " * 400, "hot") for i in range(2000, 2600)] + [(3, None, "a"), (3, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "x y z", None), (9000, None, "void"), (9001, "word " * 20_000, "b")]


def mixed_table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4.0) for r in rows], "doc_id long, text string, source string, its_rate int, size int, copy int, rank double")


def test_mix_matches_targets_by_hand(spark):
    docs = mixed_table(spark, ROWS).repartition(6)
    got = mixing.mix(docs).collect()
    size, target = mixed_by_hand(ROWS)
    assert len(got) == len(ROWS) and math.isclose(sum(target.values()), sum(size.values()))
    assert any(target[s] == 3 * size[s] > 0 for s in target) and target["void"] == 0
    taken, spread = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-12) and 0 <= r.copies <= 3
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
        taken[r.source] += r.copies * r.size
        f = r.rate - math.floor(r.rate)
        spread[r.source] += r.size ** 2 * f * (1 - f)
    for s in target:
        assert abs(taken[s] - target[s]) <= 4 * math.sqrt(spread[s]) + 1e-6
    # with several draws to choose from, sources come nearer than with one
    one = Counter()
    for r in mixing.mix(docs, tries=1).collect():
        one[r.source] += r.copies * r.size
    missed = lambda t: sum(abs(t[s] - target[s]) for s in target)
    assert missed(taken) < 0.5 * missed(one) and missed(taken) < 0.02 * sum(target.values())
    again = mixing.mix(docs.repartition(3, "size")).collect()
    bag = lambda rows: Counter((r.doc_id, r.source, r.size, r.copies) for r in rows)
    assert bag(again) == bag(got)
    emitted = mixing.emit(docs, copy="number")
    assert emitted.columns == [*docs.columns, "number"]
    want = Counter()
    for r in got:
        for c in range(r.copies):
            want[r.doc_id, r.source, c + 1] += 1
    assert Counter((r.doc_id, r.source, r.number) for r in emitted.collect()) == want


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(mixed_table(spark, [])).count() == 0 and mixing.emit(mixed_table(spark, []), copy="number").count() == 0
    got = mixing.mix(mixed_table(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.copies) for r in got] == [(0, 0.0, 0)] * 2


def test_many_sources(spark):
    rows = [(i, "w " * (i % 31), f"s{i % 700:03d}") for i in range(5000)]
    got = {r.source: r.target for r in mixing.mix(mixed_table(spark, rows)).collect()}
    _, target = mixed_by_hand(rows)
    assert all(math.isclose(got[s], target[s], rel_tol=1e-12, abs_tol=1e-9) for s in target)


@pytest.mark.parametrize("name", ["op12_centroid_clusters", "op13_source_mix"])
def test_new_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert difference(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name]) is None
