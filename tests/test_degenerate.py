"""Columns without spread, labels without rows, sums in another order: query and SQL state one rule there too."""

import shutil
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry
from tidemark.operators import diagnostics as dg
from tidemark.operators import trees as tr
from tidemark.sources import tables

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def calm(tmp_path_factory):
    """The tables with a VIX of 25 on all days but one: one label, a second one on a single row, the third never."""
    out = tmp_path_factory.mktemp("calm")
    for f in Path(SF01).iterdir():
        if f.name != "orders.parquet":
            shutil.copy(f, out / f.name)
    orders = pd.read_parquet(f"{SF01}/orders.parquet")
    days = pd.date_range("1995-01-01", "2001-12-31").astype(orders["o_orderdate"].dtype)
    low = orders.iloc[[0] * len(days)].assign(o_orderdate=days, o_orderpriority="5-LOW", o_totalprice=250000.0)
    low.loc[low["o_orderdate"] == "1997-06-10", "o_totalprice"] = 100000.0
    table = pd.concat([orders[orders["o_orderpriority"] != "5-LOW"], low])
    table.to_parquet(out / "orders.parquet", index=False, coerce_timestamps="us")
    return str(out)


def both(spark, sf, name):
    """Rows of a query, and how its SQL's rows differ."""
    got = entry.queries()[name](spark, sf).toPandas()
    return got, compare(got, connect(sf).execute(entry.oracle_sql()[name]).fetchdf())


def test_regime_labels_of_states_without_rows(spark, calm):
    got, note = both(spark, calm, "regime_labels")
    assert note is None and len(got) == 9 and got["median_vix"].isna().sum() == 3


def test_corr_matrix_without_spread(spark, calm):
    got, note = both(spark, calm, "corr_matrix")
    assert note is None and len(got) == 45
    assert got[(got["a"] == "rolling_pnl_return") & (got["b"] == "rolling_disagreement")]["corr"].notna().all()
    flat = spark.createDataFrame([("A", 1.0, 0.5), ("A", 2.0, 0.5), ("A", 4.0, 0.5)], "symbol string, p double, q double")
    assert dg.corr_matrix(flat, ["p", "q"]).first()["corr"] is None


def test_persistence_gate_of_a_label_that_never_stays(spark, calm):
    got, note = both(spark, calm, "persistence_gate")
    assert note is None
    once = got[got["label"] == 0]
    assert len(once) == 3 and (once["p_stay"] == 0).all() and (once["stay_verdict"] == "FAIL").all()


def test_warmup_of_a_feature_that_is_never_known(spark, calm):
    got, note = both(spark, calm, "warmup_nulls")
    assert note is None and len(got) == 18
    assert got[got["feature"] == "rolling_regime_accuracy"]["first_pos"].isna().all()


def test_variation_of_a_feature_of_zeros(spark, calm):
    got, note = both(spark, calm, "feature_variation")
    assert note is None and len(got) == 15
    zeros = got[got["feature"] == "rolling_pnl_regime"]
    assert zeros["zero_variance"].all() and zeros["cv"].isna().all() and zeros["low_signal"].isna().all()


@pytest.mark.parametrize("name", ["ridge_cv", "ridge_io", "saturation_report"])
def test_ridge_with_a_feature_without_spread(spark, calm, name):
    got, note = both(spark, calm, name)
    assert note is None and len(got) == 12 and got["alpha"].notna().all()


@pytest.mark.parametrize("name", ["learned_weights", "learned_lift"])
def test_learned_weights_with_a_feature_without_spread(spark, calm, name):
    got, note = both(spark, calm, name)
    assert note is None and len(got) and got.notna().all(axis=None)


def test_perf_summary_whose_first_day_loses(spark):
    """The log's drawdown starts at its first known day: on sf0.1 one symbol never regains it."""
    assert both(spark, "/root/testdata/sf0.1", "perf_summary")[1] is None


def test_regime_stats_of_a_label_with_one_return(spark, calm):
    got, note = both(spark, calm, "regime_stats")
    assert note is None
    once = got[got["label"] == 0]
    assert (once["n"] == 1).all() and once[["mean_daily", "std_daily", "sharpe_ann"]].isna().all(axis=None)


def test_macro_means_in_any_order(spark, tmp_path):
    """What ``determinism`` reads: the same prices in another order give the same bits, which a sum of doubles doesn't."""
    prices = [100000.1 + 0.37 * i for i in range(200)]
    means = {False: set(), True: set()}
    for k in range(6):
        order = [prices[(j * (2 * k + 1) * 3 + k) % 200] for j in range(200)] if k % 2 else prices[k * 17 :] + prices[: k * 17]
        order = order if sorted(order) == prices else prices[::-1]
        rows = pd.DataFrame({"o_orderpriority": "5-LOW", "o_orderdate": pd.Timestamp("1997-06-10"), "o_totalprice": order})
        spark.createDataFrame(rows).coalesce(1).write.parquet(f"{tmp_path}/{k}/orders.parquet")
        for exact, seen in means.items():
            seen.add(tables.order_macro(spark, f"{tmp_path}/{k}", exact).first()["value"])
    assert len(means[False]) > 1 and len(means[True]) == 1


@pytest.fixture(scope="session")
def turned(tmp_path_factory):
    """One price a day: a return follows the one of two days before, from the validation year on with the other sign."""
    out = tmp_path_factory.mktemp("turned")
    for f in Path(SF01).iterdir():
        if f.name != "lineitem.parquet":
            shutil.copy(f, out / f.name)
    items = pd.read_parquet(f"{SF01}/lineitem.parquet")
    days, rng, parts = pd.bdate_range("1995-01-02", "2001-10-31"), np.random.default_rng(5), []
    for symbol in "ANR":
        r = rng.normal(0, 0.01, len(days))
        for t in range(2, len(days)):
            r[t] += (0.6 if days[t] < pd.Timestamp("2000-01-01") else -0.6) * r[t - 2]
        parts.append(items.iloc[[0] * len(days)].assign(l_returnflag=symbol, l_shipdate=days.astype(items["l_shipdate"].dtype), l_quantity=1.0, l_extendedprice=1000 * np.exp(np.cumsum(r))))
    pd.concat(parts).to_parquet(out / "lineitem.parquet", index=False, coerce_timestamps="us")
    return str(out)


def test_return_fit_that_validates_best_after_one_round(spark, turned, monkeypatch):
    kept, count = [], tr.rounds_kept
    monkeypatch.setattr(tr, "rounds_kept", lambda model: kept.append(count(model)) or kept[-1])
    got, note = both(spark, turned, "return_fit")
    assert kept == [1] and note is None and len(got) == 3


def test_best_round_report_sees_a_wrong_round():
    from tidemark.plans.queries_models import QUERY_TREES, _best_kept

    errors = [3.0, 2.0, 2.5, 2.0] + [2.5] * (QUERY_TREES - 4)
    assert _best_kept(errors, 2, 2.0) and _best_kept([1.0] + errors[1:], 1, 1.0) and _best_kept([], QUERY_TREES, None)
    assert not any([_best_kept(errors, 1, 3.0), _best_kept(errors, 4, 2.0), _best_kept(errors, 2, 2.1), _best_kept([], 1, None)])
