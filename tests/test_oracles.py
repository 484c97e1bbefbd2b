"""Registered queries against their SQL. ALL_QUERIES=1 runs every one; the default takes some of each group."""

import os

import pytest

import __spark_entry__ as E
from compare import difference

SOME = [
    "src3_canonical_columns", "src7_year_end_dates", "src12_market_proxy", "slv3_percentage_scaling", "slv10_winsorise", "slv15_ordered_dates",
    "slv20_dead_letters", "macro_beta", "gld5_asof_join", "gld11_linear_interpolation", "gld20_inverse_vol_weights", "trn6_release_transform",
    "trn10_supervised_frame", "rel3_cross_ticker", "rel7_best_lag", "reg3_scenario_impacts", "reg9_time_folds", "rsk1_ewm_volatility",
    "bt9_trade_stop", "bt27_score_alerts", "val5_regression_metrics", "val23_decision_trend", "aud7_survivorship", "aud15_expansion",
    "dia6_residual_shift", "dia14_stability_index", "ops6_service_level", "ops7_trailing_levels", "str2_incremental_validation",
    "reg2_scenarios", "reg8_inflation_factors", "reg11_linear_two_factors", "reg12_choose_lag", "reg13_choose_subset", "reg14_ols_report", "reg17_train_quantiles", "reg18_arma_forecast",
    "reg20_lagged_grid", "val7_walk_forward_imputed", "val8_bootstrap_band", "val9_stationarity", "val15_model_risk", "val19_gate", "bt12_tick_drawdown", "bt13_holdout_predictions",
    "gld5_asof_ticks", "gld17_contract", "dia4_regime_stability", "ops7_trailing_stream",
]
QUERIES, ORACLES = E.queries(), E.oracle_sql()
NAMES = list(ORACLES) if os.environ.get("ALL_QUERIES") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(name, spark, con, sf):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_entry_and_registry(spark):
    assert set(ORACLES) <= set(QUERIES)
    df = E.entry(spark)
    assert df.columns == ["ticker", "n", "beta_ppm", "corr"] and df.count() == 6
