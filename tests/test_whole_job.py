"""Queries that once did part of their job."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.columns import values_table
from strandline.operators import diagnose as D
from strandline.plans.catalog import QUERIES  # first: the plans name each other's tables
from strandline.plans import q_validate
from strandline.plans.q_gold import MAC, supervised

real = q_validate.T.supervised_frame


def test_findings_count_once_and_penalties_grow(spark):
    found = values_table(spark, ("ticker", "finding", "penalty"), [("A", "RESIDUAL_HETERO", None), ("A", "RESIDUAL_HETERO", None), ("A", "LOOKAHEAD_BIAS", 16.0), ("B", "STALE_DATA", None)])
    keys = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    got = {r.ticker: r.score for r in D.diagnose(found, keys).collect()}
    assert got == {"A": 80.0, "B": 96.0, "C": 100.0}
    report = spark.createDataFrame([("failed",), ("failed",), ("success",)], "status string")
    gaps = D.data_gap_penalty(report, spark.createDataFrame([(True,), (False,)], "missing boolean"))
    assert gaps.first()[0] == 10.0
    assert D.outlier_penalty(spark.createDataFrame([(0.08,)], "outlier_ratio double")).first()[0] == 8.0


def test_diagnosis_has_the_codes_of_every_check(spark, sf):
    got = {r.ticker: set(r.findings.split(",")) for r in QUERIES["dia23_diagnose"](spark, sf).collect()}
    for name, flag, code in (("dia2_worst_shock", "exceeds", "EXCESS_DRAWDOWN"), ("dia3_high_vif", "size(offenders) > 0", "MULTICOLLINEARITY"), ("dia4_regime_stability", "NOT stable", "REGIME_INSTABILITY"),
                             ("dia5_staleness", "stale", "STALE_DATA"), ("dia9_sign_flips", "unstable", "SIGN_INSTABILITY"), ("dia12_explainability", "problem", "EXPLAINABILITY_RISK"),
                             ("dia15_ljung_box", "flagged", "RESIDUAL_HETERO"), ("dia18_importance_drift", "problem", "SHAP_STABILITY"), ("dia20_backtest_realism", "reason IS NOT NULL", "BACKTEST_REALISM")):
        flagged = {r.ticker for r in QUERIES[name](spark, sf).where(flag).select("ticker").collect()}
        assert flagged & set(got) <= {t for t, codes in got.items() if code in codes}, name
    assert len(set().union(*got.values())) > 4


def test_importance_and_holdout_read_every_series(spark, sf):
    got = QUERIES["reg15_importance"](spark, sf).collect()
    frame = supervised(spark, sf).toPandas()
    assert {(r.ticker, r.factor) for r in got} == {(t, f) for t in frame.ticker.unique() for f in MAC}
    for t, d in frame.groupby("ticker"):
        x = d[MAC].to_numpy(float)
        z = (x - x.mean(0)) / x.std(0, ddof=1)
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), d.log_return.to_numpy(float), rcond=None)[0][1:]
        assert np.allclose([{r.factor: r.importance for r in got if r.ticker == t}[f] for f in MAC], np.abs(beta), rtol=1e-3, atol=1e-7)
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(q_validate.T, "supervised_frame", lambda f, y, xs, *a, **k: seen.append(list(xs)) or real(f, y, xs, *a, **k))
        QUERIES["bt13_holdout_predictions"](spark, sf)
    assert MAC in seen
