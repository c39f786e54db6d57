"""Splits, folds, feature store, audit log and as-of alignment."""

from datetime import date

import pandas as pd
import pytest
from conftest import by_symbol
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import calendar as cal
from tidemark.operators import quality as dq
from tidemark.operators import splits as sp
from tidemark.session import scratch_dir
from tidemark.sources import store


def test_business_day_steps_match_pandas():
    for d in pd.date_range("2020-01-01", periods=20):
        assert dates.next_bday(d.date()) == (d + pd.offsets.BDay(1)).date()
        assert dates.prev_bday(d.date()) == (d - pd.offsets.BDay(1)).date()
        assert dates.plus_months(d.date(), 13) == (d + pd.DateOffset(months=13)).date()


def test_fold_ranges_match_the_expanding_rule():
    folds = sp.fold_ranges(date(2015, 1, 30), "2017-06-30", 12, 1)
    end = pd.Timestamp("2015-01-30") + pd.DateOffset(months=12) - pd.offsets.BDay(1)
    for k, (fold, first, train_end, test_start, test_end) in enumerate(folds):
        start = end + pd.offsets.BDay(1)
        stop = start + pd.DateOffset(months=1) - pd.offsets.BDay(1)
        assert (fold, first, train_end, test_start, test_end) == (k, date(2015, 1, 30), end.date(), start.date(), stop.date())
        end += pd.DateOffset(months=1)
    assert folds[-1][4] <= date(2017, 6, 30)


def test_splits_cover_every_weekday_once(spark):
    days = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2015-01-01", "2024-12-31")], "date date")
    out = sp.with_split(days, "2021-12-31", "2023-06-30")
    assert out.where("split is null").isEmpty()
    assert not dq.split_report(out).where("overlap").count()


def test_embargo_folds_keep_the_gap(spark):
    rows = spark.createDataFrame([("A", d.date()) for d in pd.bdate_range("2020-01-01", periods=157)], "symbol string, date date")
    out = sp.embargo_folds(rows).toPandas()
    pos = {d: i for i, d in enumerate(sorted(out.date.unique()))}
    out["pos"] = [(x - date(2020, 1, 1)).days for x in out.date]
    for k, grp in out.groupby("fold"):
        test = grp[grp.role == "test"]
        assert len(test) == 157 // 6
        train = grp[grp.role == "train"]
        assert len(train) == 157 - (5 - k) * 26 - 21
        assert train.date.max() < test.date.min()
    assert pos


def test_store_never_overwrites(spark, bars):
    fs = store.FeatureStore(spark, scratch_dir(spark, "store"))
    assert fs.save(bars, "bars", 1) == 1
    assert fs.save(bars.where("symbol = 'AAA'"), "bars", 1) == 2
    assert fs.versions("bars") == [1, 2]
    assert fs.load("bars").select("symbol").distinct().count() == 1
    assert fs.metadata("bars", 1).first().n_rows == bars.count()
    with pytest.raises(FileNotFoundError):
        fs.load("bars", 7)


def test_audit_runs_are_separate(spark):
    audit = store.WeightAudit(spark, scratch_dir(spark, "audit"))
    w = spark.createDataFrame([("A", date(2020, 1, 1), 0.25, 0.25, 0.25, 0.25)], "symbol string, date date, w_return double, w_vol double, w_regime double, w_drawdown double")
    audit.append(w, "one")
    audit.append(w, "two")
    audit.replace(w, "one")
    assert audit.load("one").count() == 1 and audit.load().count() == 2
    audit.clear("one")
    assert audit.load("one").count() == 0 and audit.load("two").count() == 1


def test_asof_fill_and_backfill(spark):
    obs = spark.createDataFrame([("X", date(2020, 1, 2), 1.0), ("X", date(2020, 1, 6), 2.0)], "series_id string, obs_date date, value double")
    days = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2020-01-01", periods=5)], "date date")
    plain = cal.asof_fill(days, obs, ("X",)).orderBy("date").toPandas().value.tolist()
    assert plain[1:] == [1.0, 1.0, 2.0, 2.0] and pd.isna(plain[0])
    assert cal.asof_fill(days, obs, ("X",), allow_backfill=True).orderBy("date").toPandas().value.tolist()[0] == 1.0


def test_out_of_order_rows_across_slices(spark):
    rows = [("A", date(2020, 1, 1 + i % 28), 40000 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, date date, seq long")
    bad = dq.out_of_order(df, "seq").toPandas()
    want = [s for (_, d, s), (_, p, _) in zip(rows[1:], rows) if d <= p]
    assert sorted(bad.seq) == want


def test_price_scan_by_symbol(spark, bars):
    from tidemark.sources.tables import scan_bars

    path = scratch_dir(spark, "bars")
    store.write_panel(bars, path)
    got = by_symbol(scan_bars(spark, path, ["BBB"], "2018-06-01", "2018-06-29"), "BBB")
    assert got.date.min() >= date(2018, 6, 1) and len(got) == 21


def test_target_guard(bars):
    with pytest.raises(ValueError):
        dq.refuse_targets(bars.withColumn("tgt_ret_1d", F.lit(0.0)))


def test_empty_scan_is_an_error(spark, bars):
    from tidemark.sources.tables import require_rows

    assert require_rows(bars, "all symbols") is bars
    with pytest.raises(ValueError, match="no rows for ZZZ"):
        require_rows(bars.where("symbol = 'ZZZ'"), "ZZZ")


def test_trading_days_count_holidays(spark):
    days = [date(2020, 1, d) for d in (2, 3, 6, 8, 9)]  # the 7th is a holiday
    dates = spark.createDataFrame([(d,) for d in [*days, days[0]]] + [(None,)], "date date")
    ask = spark.createDataFrame([(date(2020, 1, d), "x") for d in range(1, 12)] + [(None, "x")], "date date, nth string")
    rows = cal.shift_trading_days(ask, dates, 2).collect()
    got = {r.date and r.date.day: r.shifted and r.shifted.day for r in rows}
    assert got == {1: None, 2: 6, 3: 8, 4: 8, 5: 8, 6: 9, 7: 9, 8: None, 9: None, 10: None, 11: None, None: None}
    back = {r.date.day: r.shifted and r.shifted.day for r in cal.shift_trading_days(ask.na.drop(), dates, -1).collect()}
    assert back[9] == 8 and back[8] == 6 and back[7] == 3 and back[2] is None
    assert cal.shift_trading_days(ask, dates.limit(0), 1).where("shifted IS NOT NULL").count() == 0
    bounds = sp.trading_bounds(dates, "2020-01-05", "2020-01-07").first()
    assert [d.day for d in bounds] == [2, 3, 6, 6, 8, 9]


def test_bucketed_bars_need_no_exchange_and_no_sort(spark, bars):
    from tidemark.operators import price_features as pf

    with store.sorted_buckets(spark):
        table = store.write_buckets(bars, "bars_test_buckets", scratch_dir(spark, "buckets"), 4)
        features = pf.price_features(table)
        plan, plain = (x._jdf.queryExecution().executedPlan().toString() for x in (features, pf.price_features(table, rsi=False)))
        got = features.toPandas()
    assert "Exchange" not in plan and "Exchange" not in plain and "Sort " not in plain  # the RSI sorts its moves by block
    want = pf.price_features(bars).toPandas()
    key = ["symbol", "date"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))
    spark.sql("DROP TABLE bars_test_buckets")
