"""The ways taken for hot groups give the same answers as a direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import fills, quantiles
from strandline.operators import relate, silver


@pytest.fixture(scope="module")
def hot():
    rng = np.random.default_rng(1)
    frames = [
        pd.DataFrame({"k": "hot", "v": np.repeat([1.5, 2.5, 7.0], 4000)}),       # copies: most of the table
        pd.DataFrame({"k": "hot", "v": rng.lognormal(0, 3, 3000)}),              # heavy tail
        pd.DataFrame({"k": "flat", "v": np.full(50, 3.0)}),
        pd.DataFrame({"k": "one", "v": [4.25]}),
        pd.DataFrame({"k": "small", "v": [np.nan, -1e9, 0.0, 1e-9, 1e9]}),
    ]
    return pd.concat(frames, ignore_index=True)


def test_group_quantiles_exact(spark, hot):
    df = spark.createDataFrame(hot).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    probs = {"a": 0.01, "b": 0.37, "c": 0.5, "d": 0.99}
    got = quantiles.group_quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    small = quantiles.sized_quantiles(df, ["k"], "v", probs, 10).toPandas().set_index("k")
    for k, g in hot.groupby("k"):
        for n, p in probs.items():
            want = np.percentile(g["v"].dropna(), p * 100)
            assert got.loc[k, n] == pytest.approx(want, rel=1e-12, abs=1e-12)
            assert small.loc[k, n] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_group_quantiles_lower_element(spark, hot):
    got = quantiles.group_quantiles(spark.createDataFrame(hot).where(~F.isnan("v")), ["k"], "v", {"p": 0.95}, interpolate=False).toPandas().set_index("k")
    for k, g in hot.groupby("k"):
        v = np.sort(g["v"].dropna())
        assert got.loc[k, "p"] == v[int(0.95 * (len(v) - 1))]


def test_fill_by_runs_equals_window(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"k": rng.choice(["a", "b"], 600), "date": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 12, 600), "D"), "v": rng.normal(size=600)})
    rows["seq"] = np.arange(600)
    rows.loc[rng.random(600) < 0.7, "v"] = np.nan
    rows.loc[rows["k"].eq("a") & (rows["date"] < "2020-01-04"), "v"] = np.nan
    monkeypatch.setattr(fills, "BLOCK", 50)
    df = spark.createDataFrame(rows).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("date", F.to_date("date"))
    runs = fills.fill_both_ways(df, ["k"], "v").select("seq", "filled").toPandas().set_index("seq")["filled"]
    plain = fills.fill_both_ways(df, ["k"], "v", biggest_group=600).select("seq", "filled").toPandas().set_index("seq")["filled"]
    want = rows.sort_values(["k", "date", "seq"]).groupby("k")["v"].transform(lambda s: s.ffill().bfill())
    pd.testing.assert_series_equal(runs.sort_index(), want.sort_index(), check_names=False)
    pd.testing.assert_series_equal(plain.sort_index(), want.sort_index(), check_names=False)


def test_clean_takes_both_ways(spark, sf, monkeypatch):
    from strandline.plans.q_silver import _clean
    cols = ["entity", "status", "imputed_count", "outliers", "quality_score"]
    a = _clean(spark, sf)[1].select(*cols).toPandas().sort_values("entity").reset_index(drop=True)
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 0)
    monkeypatch.setattr(fills, "SMALL_GROUP", 0)
    b = _clean(spark, sf)[1].select(*cols).toPandas().sort_values("entity").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("block", [2, 5, 100])
def test_cross_ticker_blocks(spark, block):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(rng.normal(size=(60, 7)), index=pd.date_range("2021-01-01", periods=60), columns=list("ABCDEFG"))
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    long = wide.stack().rename_axis(["date", "ticker"]).rename("log_return").reset_index()
    got = relate.cross_ticker_matrix(spark.createDataFrame(long), block=block).toPandas()
    c = wide.corr()
    assert len(got) == 21 and (got["one"] < got["two"]).all()
    for r in got.itertuples():
        assert r.corr == pytest.approx(c.loc[r.one, r.two], abs=1e-12)
        assert r.n == wide[[r.one, r.two]].dropna().shape[0]


def test_order_violations_across_blocks(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y"], 500), "i": np.arange(500), "t": rng.integers(0, 300, 500)})
    got = silver.order_violations(spark.createDataFrame(pdf), "k", "i", "t", block=7).toPandas().set_index("k")["violations"]
    want = pdf.groupby("k")["t"].apply(lambda s: int((s.diff() < 0).sum()))
    assert got.to_dict() == want.to_dict()


def test_staged_tables_share_a_folder_and_can_be_dropped(tmp_path):
    """In a process of its own: dropping takes away the tables of a whole application."""
    import subprocess
    import sys

    code = f"""
import glob
from pyspark.sql import SparkSession
from strandline.functions.stage import drop_staged, stage
s = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
assert stage(s.range(5)).count() == 5 and len(glob.glob({str(tmp_path)!r} + "/*/*")) == 1
drop_staged(s)
assert not glob.glob({str(tmp_path)!r} + "/strandline-*")
"""
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
