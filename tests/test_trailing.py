"""Trailing levels of a stream equal the batch form, whatever the order and the cuts of arrival."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.sources import bindings as B
from strandline.streaming import levels, trailing


@pytest.mark.parametrize("files,seed", [(1, 1), (5, 2)])
def test_shuffled_arrival_equals_the_batch(spark, sf, tmp_path, files, seed):
    events = spark.read.parquet(f"{sf}/events.parquet").where("ts < timestamp'2024-01-02 00:00:00'").toPandas()
    assert len(events) > 200
    # arrival out of order by up to an hour, and files cut anywhere
    rng = np.random.default_rng(seed)
    events = events.iloc[np.argsort(events["ts"].astype("int64").to_numpy() + rng.integers(0, 3_600_000_000_000 if events["ts"].dtype.str.endswith("[ns]") else 3_600_000_000, len(events)))]
    for i, part in enumerate(np.array_split(np.arange(len(events)), files)):
        spark.createDataFrame(events.iloc[part], levels.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    stream = levels.event_stream(spark, f"{tmp_path}/in/*", 1)
    trailing.run_trailing(trailing.trailing_stream(stream), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    got = {(r.operation, r.event_id, r.span): r for r in trailing.latest(spark, f"{tmp_path}/out").collect()}
    ops = B.operations(spark, sf).where("ts < timestamp'2024-01-02 00:00:00'")
    want = trailing.trailing_batch(ops).collect()
    assert len(got) == len(want) == 2 * len(events)
    for r in want:
        g = got[r.operation, r.event_id, r.span]
        assert g.events == r.events and np.isclose(g.success_rate, r.success_rate) and np.isclose(g.p95_seconds, r.p95_seconds)


def events_at(spark, seconds, path, kind="view", first=0):
    start = np.datetime64("2024-01-01T00:00:00", "us")
    rows = [(first + i, None if t is None else (start + np.timedelta64(int(t * 1_000_000), "us")).item(), 1, kind, None if i % 7 == 3 else float(i * 37 % 101), None) for i, t in enumerate(seconds)]
    spark.createDataFrame(rows, levels.EVENT_SCHEMA).coalesce(1).write.parquet(path)


def told(rows):
    return {(r.operation, r.event_id, r.span): (r.events, round(r.success_rate, 9), r.p95_seconds) for r in rows.collect()}


def test_a_group_holds_a_few_hours_however_long_the_stream(spark, tmp_path):
    # ten days at one event a minute, with events on the edges of stretches and, to the second, a span later; undated ones are in no window
    events_at(spark, sorted([*range(7, 864_000, 60), *range(0, 864_000, 14_400), *range(3600, 864_000, 14_400)]) + [None] * 50, f"{tmp_path}/in/f0")
    stream = trailing.trailing_stream(levels.event_stream(spark, f"{tmp_path}/in/*"))
    grouped = stream._jdf.queryExecution().analyzed().toString()
    assert "stretch" in grouped
    ops = spark.read.parquet(f"{tmp_path}/in/f0").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"), F.col("value").alias("duration_seconds"), (F.col("event_type") != "error").alias("success"), "event_id")
    held = trailing.dealt(ops.withColumn("at", F.unix_micros("ts"))).groupBy("operation", "stretch").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("width")).collect()
    assert len(held) > 50 and max(r.n for r in held) < 350 and max(r.width for r in held) <= 5 * 3_600_000_000
    trailing.run_trailing(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert told(trailing.latest(spark, f"{tmp_path}/out")) == told(trailing.trailing_batch(ops).where("ts is not null"))


def test_stragglers_that_no_later_event_can_need(spark, tmp_path):
    # the second file moves the watermark by days; the third brings events of another operation that the first one's still let in
    events_at(spark, range(0, 7200, 600), f"{tmp_path}/in0")
    events_at(spark, range(864_000, 867_600, 600), f"{tmp_path}/in1", first=100)
    events_at(spark, range(3600, 7200, 900), f"{tmp_path}/in2", kind="error", first=200)
    for i in range(3):
        spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
        time.sleep(1.1)  # files are taken by age
    trailing.run_trailing(trailing.trailing_stream(levels.event_stream(spark, f"{tmp_path}/in/*", 1)), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    got = trailing.latest(spark, f"{tmp_path}/out")
    assert {(r.operation, r["count"]) for r in got.groupBy("operation").count().collect()} == {("view", 2 * 18), ("error", 2 * 4)}


@pytest.mark.parametrize("seed", range(3))
def test_smallest_of_many_ranges(seed):
    r = np.random.default_rng(seed)
    values = r.integers(0, 30, [1, 40, 500][seed]).astype(float)
    first = r.integers(0, len(values), 200)
    last = np.array([r.integers(a + 1, len(values) + 1) for a in first])
    k = np.array([r.integers(0, b - a) for a, b in zip(first, last)])
    want = [np.sort(values[a:b])[i] for a, b, i in zip(first, last, k)]
    assert trailing.smallest(values, first, last, k).tolist() == want
    assert len(trailing.smallest(values[:0], *(np.zeros(0, np.int64),) * 3)) == 0
    at, gaps = np.arange(6) * 10, np.array([np.nan, np.nan, 5, 1, np.nan, 3])
    n, rate, top = trailing.levels_at(at, np.array([1, 0, 1, 1, 0, 1], bool), gaps, np.arange(6), 10)
    assert n.tolist() == [1, 2, 2, 2, 2, 2] and np.array_equal(top, [np.nan, np.nan, 5, 5, 1, 3], equal_nan=True)


def test_any_split_into_batches_ends_as_one_run(spark, sf, tmp_path):
    from strandline.plans import catalog  # noqa: F401  first: the plans name each other's tables
    from strandline.plans.q_audit import shards, value_rules
    from strandline.streaming import history

    ops = shards(B.operations(spark, sf).where("ts < timestamp'2024-01-09 00:00:00'")).cache()
    odd = spark.createDataFrame([("c0", None, 1, 5.0), ("c1", None, 2, None)], ops.schema)
    rows = ops.unionByName(odd).unionByName(ops.where("event_id % 97 = 0"))  # undated and repeated rows

    def told(root):
        v = {(r.entity, r.day): (r.n_rows, r.nulls, r.bad, round(r.null_limit, 9), r.severity) for r in history.latest_verdicts(spark, root).collect()}
        return v, *(sorted((r.entity, str(r.ts), r.event_id) for r in history.current(spark, root, k).collect()) for k in ("good", "dead"))

    history.process_batch(rows, 0, f"{tmp_path}/one", value_rules(), 12.0)
    want = told(f"{tmp_path}/one")
    assert {s for *_, s in want[0].values()} == {"ok", "warn", "fail"} or len({s for *_, s in want[0].values()}) > 1
    # days cut in the middle, one part late, and one batch replayed
    cut = F.when(F.col("ts").isNull(), 1).otherwise(F.least(F.lit(3), F.floor((F.unix_timestamp("ts") - 1704067200) / 187_000)))
    part = F.when(F.xxhash64("event_id") % 11 == 0, 3).otherwise(cut)
    dealt = rows.withColumn("part", part).cache()
    for k in (0, 1, 2, 3):
        history.process_batch(dealt.where(F.col("part") == k).drop("part"), k, f"{tmp_path}/many", value_rules(), 12.0)
        if k == 1:
            history.process_batch(dealt.where(F.col("part") == k).drop("part"), k, f"{tmp_path}/many", value_rules(), 12.0)
    assert told(f"{tmp_path}/many") == want
    assert len(want[1]) + len(want[2]) == rows.count()
