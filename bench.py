"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandline.functions.stage import stage  # noqa: E402
from strandline.operators import backtest, risk, silver  # noqa: E402
from strandline.plans.catalog import QUERIES  # noqa: E402
from strandline.plans.q_gold import master  # noqa: E402
from strandline.plans.q_relate import returns  # noqa: E402
from strandline.session import build_session  # noqa: E402
from strandline.sources import bindings, ingest  # noqa: E402

HEADLINES = [
    "macro_beta", "master_table", "gld5_asof_join", "trn10_supervised_frame", "rel1_correlation_matrix", "rel3_cross_ticker",
    "rel7_lag_scan", "reg3_scenario_impacts", "reg10_ridge_cv", "reg13_choose_subset", "val7_walk_forward_summary", "val9_stationarity",
    "bt22_parameter_grid", "aud4_density", "aud6_continuity", "dia13_ks_statistic", "ops6_service_level", "str1_rolling_levels_batch",
]


LANDED = {}


def bronze_landing(spark, d):
    LANDED[d] = stage(bindings.raw_entities(spark, d))
    return ingest.catalog(LANDED[d])


def silver_stage(spark, d):
    """Landed rows to cleaned rows: verdicts, clipping, filling, quality scores."""
    raw = LANDED[d]
    return silver.clean(raw, ingest.catalog(raw.where("measure in ('close', 'value')")))[0]


def drawdown(spark, d):
    from strandline.operators import gold
    r = gold.with_returns(bindings.bars(spark, d, "p_brand", "day")).na.drop(subset=["log_return"])
    return backtest.with_curve(r, ["ticker"], "log_return").groupBy("ticker").agg({"dd": "min"})


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), "12g")
    spark.sparkContext.setLogLevel("ERROR")
    runs = {n: QUERIES[n] for n in HEADLINES} | {"bronze_landing": bronze_landing, "silver_stage": silver_stage, "max_drawdown": drawdown}
    master(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up cost of the JVM is not a query
    took = {}
    for name, fn in runs.items():
        t = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
