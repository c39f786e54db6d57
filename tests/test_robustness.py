"""Short histories, injected faults and repeated writes: nothing may vanish or pass silently."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF, price_frame
from pyspark.sql import functions as F

from tidemark.functions.scalars import MODELS
from tidemark.operators import meta as mt
from tidemark.operators import price_features as pf
from tidemark.operators import quality as dq
from tidemark.operators import regime as rg
from tidemark.operators import ridge as rr
from tidemark.operators import targets as tg
from tidemark.operators import trees as tr
from tidemark.plans import catalog
from tidemark.plans import inputs as src
from tidemark.session import scratch_dir
from tidemark.sources import store, tables
from tidemark.streaming import scoring as sc


def rows_of(symbol, n, rng, part):
    d = pd.DataFrame(rng.normal(size=(n, 9)), columns=[*mt.META_FEATURES, *rr.TARGET_COLS])
    return d.assign(symbol=symbol, date=pd.bdate_range("2018-01-01", periods=n).date, part=part)


def test_symbols_with_short_history_keep_their_rows(spark):
    rng = np.random.default_rng(0)
    parts = [rows_of("LONG", 400, rng, "train"), rows_of("SHORT", 42, rng, "train"), *[rows_of(s, 18, rng, "eval") for s in ("LONG", "SHORT", "NEW")]]
    rows = spark.createDataFrame(pd.concat(parts))
    fit = rr.fit_ridge(rows.where("part = 'train'"))
    assert {r.symbol: r.fitted for r in fit.collect()} == {"LONG": True, "SHORT": False}
    out = mt.predict_weights_by_symbol(rows.where("part = 'eval'"), fit).toPandas()
    assert out.groupby("symbol").size().to_dict() == {"LONG": 18, "SHORT": 18, "NEW": 18}
    assert not out[out.symbol != "LONG"].fitted.any() and out[out.symbol == "LONG"].fitted.all()
    assert np.allclose(out.loc[out.symbol != "LONG", [f"w_{m}" for m in MODELS]], 0.25)


def test_regime_states_keep_short_symbols(spark):
    rng = np.random.default_rng(1)
    frames = []
    for s, n in (("LONG", 120), ("SHORT", 25)):
        d = pd.DataFrame(rng.normal(size=(n, 4)), columns=list(rg.INPUTS)).assign(symbol=s, date=pd.bdate_range("2018-01-01", periods=n).date)
        frames.append(d)
    x = spark.createDataFrame(pd.concat(frames))
    got = rg.decode(x, rg.hmm_fit(x, "2018-12-31")).toPandas()
    assert got.groupby("symbol").size().to_dict() == {"LONG": 120, "SHORT": 25}
    assert got[got.symbol == "SHORT"].state.isna().all() and got[got.symbol == "LONG"].state.notna().all()


def test_labels_are_mapped_on_train_rows(spark):
    days = pd.bdate_range("2018-01-01", periods=40).date
    states = spark.createDataFrame([("A", d, i % 2) for i, d in enumerate(days)], "symbol string, date date, state int")
    vix = spark.createDataFrame([(d, float(i % 2 if i < 20 else 50 - 40 * (i % 2))) for i, d in enumerate(days)], "date date, vix double")
    early = {r.state: r.median_vix for r in rg.label_map(states, vix, 2, train_end=str(days[19])).collect()}
    assert early == {0: 0.0, 1: 1.0}


def test_drop_nulls_reports_a_symbol_that_loses_all(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", None), ("B", None)], "symbol string, x double")
    assert sorted(map(tuple, tr.null_drops(df, ["x"], ["symbol"]).collect())) == [("A", 1, 1), ("B", 0, 1)]


def wilder(closes, n=14):
    move = pd.Series(closes).shift(1).diff()
    up = move.clip(lower=0).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    down = (-move.clip(upper=0)).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    return (100 - 100 / (1 + up / down)).to_numpy()


@pytest.mark.parametrize("rows", [7, 50, 4096])
def test_rsi_honours_order_and_keys_over_blocks(spark, rows):
    p = price_frame(n=200).reset_index(drop=True)
    p["hour"], p["desk"] = p.groupby("symbol").cumcount(), np.where(p.index % 2, "x", "y")
    df = spark.createDataFrame(p[["symbol", "desk", "hour", "close"]])
    got = pf.add_rsi(df, ("symbol", "desk"), "hour", rows=rows)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.toPandas().sort_values("hour")
    for (s, d), g in p.groupby(["symbol", "desk"]):
        mine = got[(got.symbol == s) & (got.desk == d)].rsi_14.to_numpy()
        np.testing.assert_allclose(mine, wilder(g.sort_values("hour").close.to_numpy()), rtol=1e-9)


def test_price_features_by_another_order(spark):
    p = price_frame(n=60).reset_index(drop=True)
    p["hour"] = p.groupby("symbol").cumcount()
    out = pf.price_features(spark.createDataFrame(p.drop(columns="date")), order="hour").toPandas()
    assert out.rsi_14.notna().sum() == 2 * (60 - 15)


def test_wide_features_hold_every_symbol(spark, bars):
    wide = pf.wide_features(pf.price_features(bars))
    assert set(wide.columns) == {"date", *[f"{s}_{c}" for s in ("AAA", "BBB") for c in pf.PRICE_FEATURES]}


def test_ticks_are_read_once(spark, monkeypatch):
    read = []
    real = tables.lineitem_bars
    monkeypatch.setattr(tables, "lineitem_bars", lambda *a: read.append(a) or real(*a))
    for key in ("panel", "predictions", "backtest"):
        read.clear()
        plan = catalog.REGISTRY[key].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert len(read) == 1 and "lineitem" not in plan
    src.bars(spark, SF)
    assert len(read) == 1


def test_order_keys_beyond_their_bits_are_refused(spark):
    schema = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long"
    fine = spark.createDataFrame([(2, 1, 1, 1), ((1 << 40) - 1, 7, 1, 1)], schema).select(tables.line_ordinal().alias("seq"))
    assert fine.orderBy("seq").count() == 2 and fine.agg(F.count("seq")).first()[0] == 2
    with pytest.raises(Exception, match="beyond the bits"):
        spark.createDataFrame([(1 << 41, 1, 1, 1)], schema).select(tables.line_ordinal()).collect()


def test_price_guard_runs_and_refuses(spark, prices):
    bad = prices.copy()
    bad.loc[5, "close"] = -1.0
    kept = lambda p: tg.forward_targets(tg.guarded_prices(spark.createDataFrame(p)).withColumn("guarded", F.col("close")), trim=False, carry=("guarded",)).select("guarded")
    assert kept(prices).count() == len(kept(prices).collect()) == len(prices)
    with pytest.raises(Exception, match="non-positive close"):
        kept(bad).collect()


def test_checks_find_injected_faults(spark, bars):
    cut = bars.where("date <= '2018-12-31'").withColumn("x", F.when(F.col("date") > "2018-01-31", 1.0)).withColumn("y", F.lit(1.0))
    fine = {r.symbol: (r.future_rows, r.early_columns, r.ok) for r in dq.future_rows(cut, "2018-12-31", ["x"], 3).collect()}
    assert set(fine.values()) == {(0, "", True)}
    late = dq.future_rows(cut, "2018-12-28", ["x", "y"], 3).where("symbol = 'AAA'").first()
    assert late.future_rows == 1 and late.early_columns == "y" and not late.ok
    d = lambda *days: spark.createDataFrame([(x,) for x in days], "date string").select(F.to_date("date").alias("date"))
    parts = {"train": d("2020-01-01", "2020-01-02"), "val": d("2020-01-02", "2020-01-03"), "test": d("2020-01-04")}
    assert [tuple(map(str, r)) for r in dq.split_overlap(**parts).collect()] == [("train", "val", "2020-01-02")]
    a = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None)], "k int, v double")
    assert dq.table_difference(a, a).first().ok
    assert dq.table_difference(a, a.withColumn("v", F.col("v") + 1e-12)).first().unmatched == 4


def test_patience():
    falling = [1.0, 0.9, 0.8, 0.85, 0.7] + [0.75] * 60 + [0.1]
    assert tr.best_round(falling, 50) == 5 and tr.best_round(falling, 80) == len(falling) and tr.best_round([1.0], 50) == 1


def test_repeated_append_leaves_rows_once(spark):
    w = spark.createDataFrame([("A", i, 0.1, 0.2, 0.3, 0.4) for i in range(5)], "symbol string, i int, w_return double, w_vol double, w_regime double, w_drawdown double")
    w = w.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i"))).drop("i")
    audit = store.WeightAudit(spark, scratch_dir(spark, "audit"))
    for part in (w.where("date < '2020-01-03'"), w, w):
        audit.append(part, "r")
    audit.append(w, "other")
    assert audit.load("r").count() == audit.load("other").count() == 5


def test_late_and_repeated_rows_are_counted_and_settled():
    base = {"return_pred": 0.1, "vol_pred": 0.1, "regime_pred": 0.1, "drawdown_risk_prob": 0.1, "regime_label": 0, "disagreement": 0.1, "ret_bwd": 0.01}
    rows = pd.DataFrame([{"symbol": "A", "date": d, **base} for d in pd.bdate_range("2020-01-01", periods=30).date])
    out, state = sc.score_block(rows, {**sc.FRESH, "late": 3}, src.WEIGHT_MODEL)
    assert set(out.late) == {3} and state["late"] == 3 and len(state["x_ret"]) == out.buffered.iloc[-1] == 21


def test_native_filter_equals_the_array_recursion(spark):
    from tidemark.plans.queries_models import GIVEN

    rng = np.random.default_rng(7)
    x = pd.DataFrame(rng.normal(size=(150, 4)).cumsum(axis=0) / 6, columns=list(rg.INPUTS))
    x = x.assign(symbol=np.where(x.index % 3, "A", "B"), date=pd.bdate_range("2018-01-01", periods=150).date)
    got = {(r.symbol, r.date): r.state for r in rg.filter_given(spark.createDataFrame(x.sample(frac=1, random_state=1)), GIVEN).collect()}
    assert len(got) == 150
    for s, g in x.groupby("symbol"):
        dens = rg.log_density(g[list(rg.INPUTS)].to_numpy(), np.array(GIVEN.mean), np.array([np.diag(v) for v in GIVEN.var]))
        post, _ = rg.forward(np.array(GIVEN.start), np.array(GIVEN.trans), dens)
        assert [got[s, d] for d in g.date] == post.argmax(axis=1).tolist()
