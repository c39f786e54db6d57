"""Causality of the backtest and equality of the batch and streaming paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.plans.inputs import WEIGHT_MODEL
from tidemark.session import scratch_dir
from tidemark.streaming import scoring as sc
from tidemark.streaming import sink


def run_frame(n=120, seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for s in ("A", "B"):
        parts.append(
            pd.DataFrame(
                {
                    "symbol": s,
                    "date": pd.bdate_range("2020-01-01", periods=n).date,
                    "return_pred": rng.normal(size=n),
                    "vol_pred": rng.normal(size=n),
                    "regime_pred": rng.normal(size=n),
                    "drawdown_risk_prob": rng.normal(size=n),
                    "regime_label": rng.integers(0, 3, n),
                    "disagreement": rng.uniform(0.5, 1.5, n),
                    "ret_bwd": rng.normal(0, 0.01, n),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def run(spark):
    return spark.createDataFrame(run_frame()).cache()


def frame(df):
    return df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)


def test_signal_does_not_see_its_own_return(spark, run):
    base = frame(bt.backtest(run, WEIGHT_MODEL))
    cut = pd.Timestamp("2020-04-01").date()
    shocked = run.withColumn("ret_bwd", F.when(F.col("date") >= F.lit(cut), F.col("ret_bwd") + 5).otherwise(F.col("ret_bwd")))
    moved = frame(bt.backtest(shocked, WEIGHT_MODEL))
    upto = base.date <= cut
    np.testing.assert_array_equal(base.signal[upto], moved.signal[upto])
    assert not np.allclose(base.signal[~upto], moved.signal[~upto])


def test_pnl_pairs_previous_signal_with_todays_return(run):
    df = frame(bt.backtest(run, WEIGHT_MODEL))
    for _, g in df.groupby("symbol"):
        np.testing.assert_allclose(g.pnl_mag.iloc[1:], g.signal.shift(1).iloc[1:] * g.ret_bwd.iloc[1:])
        assert np.isnan(g.pnl_mag.iloc[0])
        assert (g.filter(like="w_").iloc[:22] == 0.25).all().all()


def test_max_drawdown_matches_numpy(run):
    df = bt.backtest(run, WEIGHT_MODEL)
    got = bt.performance(df, "pnl_mag").toPandas().set_index("symbol").max_dd
    for s, g in frame(df).groupby("symbol"):
        cum = g.pnl_mag.fillna(0).cumsum()
        assert got[s] == pytest.approx((cum - cum.cummax()).min())


def test_causality_check_finds_an_injected_row(spark, run):
    from tidemark.operators import quality as dq

    log = bt.performance_log(bt.backtest(run, WEIGHT_MODEL))
    assert dq.causality_violations(log).isEmpty()
    bad = log.limit(1).withColumns({"prediction_date": F.col("feedback_date")})
    assert dq.causality_violations(log.unionByName(bad)).count() == 1


def test_stream_equals_batch_over_restarts_and_ignores_old_rows(spark, run):
    root = scratch_dir(spark, "stream")
    days = sorted(r.date for r in run.select("date").distinct().collect())
    for lo, hi in ((0, 30), (25, 31), (31, 120)):  # the second delivery repeats old rows
        part = run.where(F.col("date").between(F.lit(days[lo]), F.lit(days[hi - 1])))
        part.repartition(3).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(run.schema).parquet(f"{root}/in")
        sink.run_available(sink.write_batches(sc.stream_score(stream, WEIGHT_MODEL), f"{root}/out", f"{root}/cp"))
    got = frame(spark.read.parquet(f"{root}/out"))
    want = frame(bt.backtest(run, WEIGHT_MODEL))
    assert len(got) == len(want) == 240
    for c in ("signal", *bt.WEIGHTS):
        np.testing.assert_allclose(got[c], want[c], atol=1e-10, err_msg=c)


def test_late_ticks_are_dropped_and_counted(spark):
    from tidemark.streaming import bars as sb

    root = scratch_dir(spark, "late")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def deliver(rows):
        frame = spark.createDataFrame(
            [(i, pd.Timestamp(t).to_pydatetime(), 1, "click", v, "") for i, t, v in rows], schema
        )
        frame.coalesce(1).write.mode("append").parquet(f"{root}/in")
        ticks = sb.read_ticks(spark, f"{root}/in", "*.parquet")
        return sink.run_available(sink.write_batches(sb.stream_bars(ticks), f"{root}/out", f"{root}/cp"))

    deliver([(1, "2024-01-01 00:10", 5.0), (2, "2024-01-01 00:50", 7.0), (3, "2024-01-01 09:00", 6.0)])
    query = deliver([(4, "2024-01-01 00:30", 99.0), (5, "2024-01-01 09:30", 8.0), (6, "2024-01-01 09:40", 0.0)])
    assert sink.late_rows(query) == 1
    got = {r.start.hour: (r.open, r.high, r.low, r.close) for r in sink.latest(spark, f"{root}/out", ["symbol", "start"]).collect()}
    assert got == {0: (5.0, 7.0, 5.0, 7.0), 9: (6.0, 8.0, 6.0, 8.0)}
