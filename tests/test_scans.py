"""As-of joins and running values over ranges against plain loops, at any number of ranges."""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.scans import asof_backward, running_totals


def planted(n=1500, keys=40):
    rng = np.random.default_rng(5)
    who = np.where(rng.random(n) < 0.4, "hot", np.char.add("k", rng.integers(0, keys, n).astype(str)))
    return who.tolist(), rng.integers(0, 4000, n).tolist(), rng.random(n).round(3).tolist()


@pytest.mark.parametrize("ranges", [1, 3, 17])
@pytest.mark.parametrize("tolerance", [None, 25])
def test_asof_matches_a_search(spark, ranges, tolerance):
    who, at, value = planted()
    right = list(zip(who[:900], at[:900], value[:900])) + [(None, 5, 0.1), ("hot", None, 0.2)]
    left = [(i, w, t) for i, (w, t) in enumerate(zip(who[900:], at[900:]))] + [(9001, None, 100), (9002, "hot", None), (9003, "never", 10)]
    sides = defaultdict(list)
    for w, t, v in right:
        if w is not None and t is not None:
            sides[w].append((t, v))
    want = {}
    for i, w, t in left:
        rows = sorted(sides[w])
        k = bisect.bisect_right(rows, (t, float("inf"))) if t is not None else 0
        hit = rows[k - 1] if k and (tolerance is None or t - rows[k - 1][0] <= tolerance) else None
        want[i] = hit[1] if hit else None
    a = spark.createDataFrame(left, "id long, who string, t long")
    b = spark.createDataFrame(right, "who string, t long, v double")
    got = asof_backward(a, b, "t", ["v"], ["who"], tolerance, ranges)
    assert got.columns == ["id", "who", "t", "v"] and {r.id: r.v for r in got.collect()} == want
    assert asof_backward(a.where("false"), b, "t", ["v"], ["who"], tolerance, ranges).count() == 0
    assert {r.v for r in asof_backward(a, b.where("false"), "t", ["v"], ["who"], tolerance, ranges).collect()} == {None}


def test_asof_on_timestamps_and_dates_without_keys(spark):
    a = spark.createDataFrame([(1, "2020-01-01 00:00:30"), (2, "2020-01-01 00:02:00"), (3, "2019-01-01 00:00:00")], "id int, t string").withColumn("t", F.to_timestamp("t"))
    b = spark.createDataFrame([("2020-01-01 00:00:10", "x"), ("2020-01-01 00:00:30", "y")], "t string, v string").withColumn("t", F.to_timestamp("t"))
    assert {r.id: r.v for r in asof_backward(a, b, "t", ["v"], tolerance=60, ranges=3).collect()} == {1: "y", 2: None, 3: None}
    days = lambda d: d.withColumn("t", F.to_date("t"))
    assert {r.id: r.v for r in asof_backward(days(a), days(b), "t", ["v"], tolerance=3).collect()} == {1: "y", 2: "y", 3: None}


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_running_totals_match_a_loop(spark, ranges):
    who, at, value = planted(700, 12)
    rows = [(w, t, i, v - 0.5) for i, (w, t, v) in enumerate(zip(who, at, value))]
    got = {r.i: r for r in running_totals(spark.createDataFrame(rows, "who string, t long, i long, v double"), ["who"], ["t", "i"], "v", ranges).collect()}
    state = defaultdict(lambda: (0.0, -np.inf))
    for w, t, i, v in sorted(rows):
        total = state[w][0] + v
        peak = max(state[w][1], total)
        state[w] = total, peak
        assert np.isclose(got[i].total, total) and np.isclose(got[i].peak, peak) and np.isclose(got[i].fall, total - peak)
    assert len(got) == len(rows)
