"""Features and targets against pandas / NumPy, and the look-ahead property."""

import numpy as np
import pandas as pd
import pytest
from conftest import by_symbol
from pyspark.sql import functions as F

from tidemark.functions.windows import ordered
from tidemark.operators import price_features as pf
from tidemark.operators import targets as tg

FIRST_ROW = {"logret": 2, "vol_21d": 22, "vol_63d": 64, "mom_21d": 22, "mom_63d": 64, "mom_126d": 127, "rsi_14": 15, "bb_width": 20, "atr_14": 14}


@pytest.fixture(scope="module")
def features(bars):
    return by_symbol(pf.price_features(bars), "AAA")


def series(prices):
    return prices[prices.symbol == "AAA"].reset_index(drop=True)


@pytest.mark.parametrize("name", FIRST_ROW)
def test_first_valid_row(features, name):
    assert features[name].first_valid_index() == FIRST_ROW[name]


def test_features_match_pandas(features, prices):
    p = series(prices)
    r = np.log(p.close).diff().shift(1)
    c1 = p.close.shift(1)
    move = c1.diff()
    up = move.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    down = (-move.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    prev = p.close.shift(1)
    tr = pd.concat([p.high - p.low, (p.high - prev).abs(), (p.low - prev).abs()], axis=1).max(axis=1)
    want = {
        "logret": r,
        "vol_63d": r.rolling(63).std() * np.sqrt(252),
        "mom_126d": r.rolling(126).sum(),
        "bb_width": 4 * c1.rolling(20).std() / c1.rolling(20).mean(),
        "rsi_14": 100 - 100 / (1 + up / down),
        "atr_14": tr.rolling(14).mean().shift(1),
    }
    for name, w in want.items():
        np.testing.assert_allclose(features[name], w, rtol=1e-9, atol=1e-12, err_msg=name)


def test_rsi_of_flat_and_rising_prices(spark):
    rows = [("FLAT", d.date(), 5.0) for d in pd.bdate_range("2020-01-01", periods=20)]
    rows += [("UP", d.date(), 5.0 + i) for i, d in enumerate(pd.bdate_range("2020-01-01", periods=20))]
    out = pf.add_rsi(spark.createDataFrame(rows, "symbol string, date date, close double"))
    assert by_symbol(out, "FLAT").rsi_14.iloc[-1] == 50.0
    assert by_symbol(out, "UP").rsi_14.isna().all()


def test_nothing_before_a_changed_date_moves(spark, bars, prices):
    """Changing every bar after a date leaves all feature rows up to it unchanged; targets must move."""
    cut = pd.Timestamp("2018-10-01").date()
    changed = bars.withColumns({c: F.when(F.col("date") > F.lit(cut), F.col(c) * 3).otherwise(F.col(c)) for c in ("high", "low", "close")})
    a, b = (by_symbol(pf.price_features(x).where(F.col("date") <= F.lit(cut)), "AAA") for x in (bars, changed))
    pd.testing.assert_frame_equal(a, b)
    a, b = (by_symbol(tg.forward_targets(x).where(F.col("date") <= F.lit(cut)), "AAA") for x in (bars, changed))
    assert not np.allclose(a.tgt_ret_1d, b.tgt_ret_1d)


def test_lookback_filter_keeps_features(bars):
    since = "2018-12-03"
    full = pf.price_features(bars, rsi=False).where(F.col("date") >= since)
    part = pf.price_features(pf.lookback_filter(bars, since), rsi=False).where(F.col("date") >= since)
    pd.testing.assert_frame_equal(by_symbol(full, "BBB"), by_symbol(part, "BBB"))


def test_targets_match_numpy(bars, prices):
    t = by_symbol(tg.forward_targets(bars, trim=False), "AAA")
    c = series(prices).close.to_numpy()
    r = np.diff(np.log(c))
    for i in (0, 17, 100, 250):
        assert t.tgt_ret_5d[i] == pytest.approx(np.log(c[i + 5] / c[i]), abs=1e-12)
        assert t.tgt_vol_5d[i] == pytest.approx(np.std(r[i : i + 5], ddof=1), abs=1e-12)
        win = c[i + 1 : i + 22]
        peak = np.maximum.accumulate(win)
        assert t.tgt_mdd_21d[i] == pytest.approx(((win - peak) / peak).min(), abs=1e-12)
    assert t.tgt_mdd_21d.isna().sum() == 21 and t.tgt_ret_1d.isna().sum() == 1
    assert len(by_symbol(tg.forward_targets(bars), "AAA")) == len(c) - 21


def test_targets_refuse_bad_prices(spark, bars):
    bad = bars.withColumn("close", F.when(F.col("symbol") == "BBB", 0.0).otherwise(F.col("close")))
    with pytest.raises(Exception, match="non-positive close"):
        tg.forward_targets(bad, guard_prices=True).agg(F.max("tgt_ret_1d")).collect()


def test_causal_target_needs_a_registered_horizon():
    with pytest.raises(KeyError):
        tg.causal_target("tgt_ret_9d", ordered("symbol"))


@pytest.mark.parametrize("rows", [130, 4096])
def test_blocks_equal_whole_history_windows(spark, bars, rows):
    from tidemark.operators import blocks as bl

    monthly = bars.withColumn("month", F.trunc("date", "month"))

    def windows(df, **kw):
        return pf.price_features(df, rsi=False, **kw)

    got = by_symbol(bl.over_blocks(monthly, windows, "date", "month", back=128, rows=rows), "BBB")
    want = by_symbol(pf.price_features(bars, rsi=False), "BBB")
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-9, atol=1e-12)
    got = by_symbol(bl.over_blocks(monthly, tg.forward_targets, "date", "month", back=1, ahead=21, rows=rows), "BBB")
    want = by_symbol(tg.forward_targets(bars), "BBB")
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-9, atol=1e-12)
    got = by_symbol(bl.rsi_over_blocks(monthly, "date", "month", rows=min(rows, 50)), "BBB")
    want = by_symbol(pf.add_rsi(bars.select("symbol", "date", "close")), "BBB")
    np.testing.assert_allclose(got.rsi_14, want.rsi_14, rtol=1e-9)
