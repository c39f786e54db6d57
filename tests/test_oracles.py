"""A cross-section of the registered queries against their oracle SQL on the smallest tables.

``python tests/check_oracles.py`` runs all of them on a larger scale factor.
"""

import pytest
from check_oracles import compare, connect
from conftest import SF

import __spark_entry__ as entry

KEYS = [
    "bars_resample", "bars_by_supplier", "price_features", "features_by_supplier", "features_intraday", "macro_features", "asof_ffill",
    "join_left_ffill", "targets_all", "walk_forward", "fold_range_join", "embargo_cv", "store_save", "dq_report", "dq_monotonic",
    "leak_first_valid", "tgt_alignment", "fit_normalizer", "disagreement", "meta_features", "weights_clear", "backtest", "perf_summary",
    "strategy_table", "corr_matrix", "regime_labels", "regime_runs", "drawdown_eval", "stream_bars", "garch_walk", "garch_horizons", "trading_day_shift", "trading_bounds",
    "regime_filter_given", "regime_filtered_labels", "split_overlap", "dq_macro_coverage", "disagreement_frozen", "bars_buckets", "metrics_models",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    assert compare(entry.queries()[key](spark, SF).toPandas(), con.execute(entry.oracle_sql()[key]).fetchdf()) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 9


def test_oracles_name_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
