"""Sources, calendar, features, targets and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, scalars
from tidemark.functions.windows import ordered, rolling
from tidemark.operators import blocks as bl
from tidemark.operators import calendar as cal
from tidemark.operators import macro_features as mf
from tidemark.operators import price_features as pf
from tidemark.operators import splits as sp
from tidemark.operators import targets as tg
from tidemark.operators import trees as tr
from tidemark.plans import inputs as src
from tidemark.plans import oracle_base as ob
from tidemark.plans.registry import register
from tidemark.plans.stage import write_once
from tidemark.sources import tables

BAR_COLS = "symbol date open:9 high:9 low:9 close:9 volume:3"


@register("bars_resample", BAR_COLS, "SELECT * FROM bars")
def bars_resample(spark, sf):
    return tables.lineitem_bars(spark, sf)  # one reader: nothing to write


@register("bars_by_supplier", BAR_COLS, "SELECT * FROM supplier_bars")
def bars_by_supplier(spark, sf):
    return src.supplier_bars(spark, sf)


@register("ticks_hourly", "symbol hour open:6 high:6 low:6 close:6 volume:3", "SELECT * FROM hourly")
def ticks_hourly(spark, sf):
    t = tables.event_ticks(spark, sf).where(F.col("price") > 0)
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    return tables.resample_bars(t.withColumn("date", hour), ["event_id"]).withColumnRenamed("date", "hour")


@register("macro_scan", "series_id obs_date value:9", "SELECT * FROM macro_obs WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def macro_scan(spark, sf):
    return tables.order_macro(spark, sf).where(F.col("obs_date").between("1996-01-01", "2000-12-31"))


@register("shared_calendar", "date", "SELECT date FROM shared_dates")
def shared_calendar(spark, sf):
    return src.panel_dates(spark, sf)


@register("panel", "symbol date close:9", "SELECT * FROM panel")
def panel(spark, sf):
    return src.panel(spark, sf)


@register("logret", "symbol date ret:9 logret:9", "SELECT symbol, date, r AS ret, lag(r) OVER w AS logret FROM panel_ret WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def logret(spark, sf):
    w = ordered("symbol")
    return src.panel(spark, sf).withColumn("ret", pf.log_return(w)).withColumn("logret", F.lag("ret").over(w))


@register("vol_by_split", "symbol split n:b avg_vol:9", f"""
SELECT symbol, split, count(vol_21d) AS n, avg(vol_21d) AS avg_vol
FROM (SELECT *, {ob.SPLIT} AS split FROM feat) WHERE split IS NOT NULL GROUP BY symbol, split""")
def vol_by_split(spark, sf):
    w = ordered("symbol")
    df = pf.with_lags(src.panel(spark, sf), w).withColumns(pf.vol_cols(w))
    df = sp.with_split(df, src.TRAIN_END, src.VAL_END).where("split is not null")
    return df.groupBy("symbol", "split").agg(F.count("vol_21d").alias("n"), F.avg("vol_21d").alias("avg_vol"))


@register("vol_rolling", "symbol date vol_21d:9 vol_63d:9", "SELECT * FROM feat")
def vol_rolling(spark, sf):
    w = ordered("symbol")
    return pf.with_lags(src.panel(spark, sf), w).withColumns(pf.vol_cols(w))


@register("momentum", "symbol date mom_21d:9 mom_63d:9 mom_126d:9", "SELECT * FROM feat")
def momentum(spark, sf):
    w = ordered("symbol")
    return pf.with_lags(src.panel(spark, sf), w).withColumns(pf.mom_cols(w))


@register("rsi_14", "symbol date rsi_14:6", "SELECT * FROM rsi")
def rsi_14(spark, sf):
    return pf.add_rsi(src.panel(spark, sf).select("symbol", "date", "close"))


@register("bb_width", "symbol date bb_width:9", "SELECT * FROM feat")
def bb_width(spark, sf):
    w = ordered("symbol")
    return pf.with_lags(src.panel(spark, sf), w).withColumns(pf.bb_cols(w))


@register("atr_14", "symbol date atr_14:6", "SELECT * FROM atr")
def atr_14(spark, sf):
    return pf.with_atr(cal.weekday_bars(src.bars(spark, sf)), ordered("symbol"))


FEATURE_COLS = "symbol date logret:9 vol_21d:9 vol_63d:9 mom_21d:9 mom_63d:9 mom_126d:9 bb_width:9 atr_14:6"


@register("price_features", FEATURE_COLS + " rsi_14:6", """
SELECT symbol, date, logret, vol_21d, vol_63d, mom_21d, mom_63d, mom_126d, bb_width, atr_14, rsi_14
FROM atr LEFT JOIN feat USING (symbol, date) LEFT JOIN rsi USING (symbol, date)""")
def price_features(spark, sf):
    return pf.price_features(src.flagged_bars(spark, sf))


# The contract has to name its columns: these are the fixture's symbols. The builder pivots whatever symbols there are.
_WIDE = [(s, c) for s in "ANR" for c in pf.PRICE_FEATURES]


@register("price_features_wide", "date " + " ".join(f"{s}_{c}:{6 if c in ('rsi_14', 'atr_14') else 9}" for s, c in _WIDE), """
SELECT date, """ + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN {c} END) AS {s}_{c}" for s, c in _WIDE) + """
FROM atr LEFT JOIN feat USING (symbol, date) LEFT JOIN rsi USING (symbol, date) GROUP BY date""")
def price_features_wide(spark, sf):
    return pf.wide_features(pf.price_features(src.flagged_bars(spark, sf)))


@register("features_by_supplier", FEATURE_COLS, "SELECT * FROM supplier_feat JOIN supplier_atr USING (symbol, date)")
def features_by_supplier(spark, sf):
    return pf.price_features(src.supplier_bars(spark, sf), rsi=False)


@register("features_incremental", "symbol date vol_63d:9 mom_126d:9", "SELECT * FROM feat WHERE date >= DATE '2001-01-01'")
def features_incremental(spark, sf):
    recent = pf.lookback_filter(src.panel(spark, sf), "2001-01-01")
    return pf.price_features(recent, rsi=False).where(F.col("date") >= "2001-01-01")


# --- macro -----------------------------------------------------------------


@register("macro_outer", "date DFF:9 GS10:9 CPIAUCSL:9 T10Y2Y:9 VIXCLS:9", "SELECT obs_date AS date, " + ob.pivot_series("value") + " FROM macro_obs GROUP BY obs_date")
def macro_outer(spark, sf):
    return cal.macro_outer(tables.order_macro(spark, sf))


@register("month_shift", "series_id obs_date value:9", "SELECT * FROM macro_known")
def month_shift(spark, sf):
    return src.macro_obs(spark, sf)


@register("asof_ffill", "series_id date value:9", "SELECT * FROM macro_long")
def asof_ffill(spark, sf):
    return src.macro_long(spark, sf)


@register("asof_backfill", "series_id date value:9", """
SELECT series_id, date, coalesce(value, first_value(value IGNORE NULLS) OVER
  (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM macro_long""")
def asof_backfill(spark, sf):
    return cal.asof_fill(src.panel_dates(spark, sf), src.macro_obs(spark, sf), allow_backfill=True)


@register("bday_resample", "series_id date value:9", """
SELECT g.series_id, g.date, m.value FROM (
  SELECT series_id, CAST(unnest(generate_series(min(obs_date), max(obs_date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM macro_known GROUP BY series_id) g
ASOF LEFT JOIN macro_known m ON g.series_id = m.series_id AND g.date >= m.obs_date
WHERE isodow(g.date) < 6""")
def bday_resample(spark, sf):
    return cal.business_days(src.macro_obs(spark, sf))


@register("rate_spread", "date GS10:9 DFF:9 rate_spread:9", "SELECT *, GS10 - DFF AS rate_spread FROM macro_wide")
def rate_spread(spark, sf):
    return cal.with_rate_spread(cal.macro_wide(src.macro_long(spark, sf)))


@register("rate_change", "date DFF_change_1d:9 DFF_change_5d:9 DFF_change_21d:9 GS10_change_1d:9 GS10_change_5d:9 GS10_change_21d:9", "SELECT * FROM macro_feat")
def rate_change(spark, sf):
    return mf.macro_features(src.macro_long(spark, sf))


@register("cpi_surprise", "date cpi_surprise:9", "SELECT * FROM macro_feat")
def cpi_surprise(spark, sf):
    return mf.macro_features(src.macro_long(spark, sf))


@register("vix_regime", "date vix_regime", "SELECT * FROM macro_feat")
def vix_regime(spark, sf):
    return mf.macro_features(src.macro_long(spark, sf))


@register("vix_change", "date vix_change_5d:9 vix_change_21d:9", "SELECT * FROM macro_feat")
def vix_change(spark, sf):
    return mf.macro_features(src.macro_long(spark, sf))


@register("yield_curve_slope", "date yield_curve_slope:9 yield_curve_slope_21d_ma:9", "SELECT * FROM macro_feat")
def yield_curve_slope(spark, sf):
    return mf.macro_features(src.macro_long(spark, sf))


MACRO_COLS = "date " + " ".join(c if c == "vix_regime" else f"{c}:9" for c in mf.MACRO_FEATURES)


@register("macro_features", MACRO_COLS, "SELECT * FROM macro_feat")
def macro_features(spark, sf):
    return mf.macro_features(src.macro_long(spark, sf))


@register("vix_bucket", "date vix:9 bucket", "SELECT date, VIXCLS AS vix, CASE WHEN VIXCLS <= 15 THEN 'low' WHEN VIXCLS <= 25 THEN 'medium' WHEN VIXCLS IS NOT NULL THEN 'high' END AS bucket FROM macro_wide")
def vix_bucket(spark, sf):
    wide = cal.macro_wide(src.macro_long(spark, sf))
    return wide.select("date", F.col("VIXCLS").alias("vix"), scalars.vix_bucket(F.col("VIXCLS")).alias("bucket"))


@register("vix_ordinal", "date vix_code:1", "SELECT date, CASE vix_regime WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS vix_code FROM macro_feat")
def vix_ordinal(spark, sf):
    return mf.macro_features(src.macro_long(spark, sf)).withColumn("vix_code", scalars.vix_ordinal(F.col("vix_regime")))


JOINED = "symbol date vol_21d:9 atr_14:6 DFF_change_5d:9 vix_regime"


@register("merge_features", JOINED, "SELECT * FROM atr LEFT JOIN feat USING (symbol, date) JOIN macro_feat USING (date)")
def merge_features(spark, sf):
    f = pf.price_features(src.flagged_bars(spark, sf), rsi=False)
    return cal.merge_features(f, mf.macro_features(src.macro_long(spark, sf)))


@register("join_left_ffill", JOINED, "SELECT symbol, date, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("vol_21d", "atr_14", "DFF_change_5d", "vix_regime")) + """
FROM atr LEFT JOIN feat USING (symbol, date) LEFT JOIN macro_feat USING (date)
WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def join_left_ffill(spark, sf):
    f = pf.price_features(src.flagged_bars(spark, sf), rsi=False)
    return cal.join_left_ffill(f, mf.macro_features(src.macro_long(spark, sf)))


# --- targets ---------------------------------------------------------------


@register("fwd_ret", "symbol date tgt_ret_1d:9 tgt_ret_5d:9 tgt_ret_21d:9", "SELECT * FROM tgt_all")
def fwd_ret(spark, sf):
    return tg.forward_targets(src.panel(spark, sf), trim=False)


@register("fwd_vol", "symbol date tgt_vol_5d:9 tgt_vol_21d:9", "SELECT * FROM tgt_all")
def fwd_vol(spark, sf):
    return tg.forward_targets(src.panel(spark, sf), trim=False)


@register("fwd_mdd", "symbol date tgt_mdd_21d:9", "SELECT symbol, date, mdd AS tgt_mdd_21d FROM fwd_mdd_21")
def fwd_mdd(spark, sf):
    return tg.forward_targets(src.panel(spark, sf), trim=False)


TARGET_COLS = "symbol date " + " ".join(f"{c}:9" for c in tg.TARGETS)


@register("targets_all", TARGET_COLS, "SELECT * FROM tgt")
def targets_all(spark, sf):
    return tg.forward_targets(src.panel(spark, sf))


@register("targets_by_supplier", TARGET_COLS, "SELECT * FROM supplier_tgt")
def targets_by_supplier(spark, sf):
    return tg.forward_targets(src.supplier_bars(spark, sf))


@register("causal_target", "symbol date ret_known:9 vol_known:9 mdd_known:9", """
SELECT symbol, date, lag(tgt_ret_1d, 2) OVER w AS ret_known, lag(tgt_vol_5d, 6) OVER w AS vol_known,
  lag(tgt_mdd_21d, 22) OVER w AS mdd_known
FROM tgt WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def causal_target(spark, sf):
    w = ordered("symbol")
    t = tg.forward_targets(src.panel(spark, sf))
    return t.select(
        "symbol", "date",
        tg.causal_target("tgt_ret_1d", w).alias("ret_known"),
        tg.causal_target("tgt_vol_5d", w).alias("vol_known"),
        tg.causal_target("tgt_mdd_21d", w).alias("mdd_known"),
    )


@register("bwd_from_fwd", "symbol date ret_bwd:9", f"""
SELECT * FROM (SELECT symbol, date, lag(tgt_ret_1d) OVER (PARTITION BY symbol ORDER BY date) AS ret_bwd FROM tgt)
WHERE date BETWEEN DATE '{src.VAL_START}' AND DATE '{src.VAL_END}'""")
def bwd_from_fwd(spark, sf):
    t = tg.forward_targets(src.panel(spark, sf)).withColumn("ret_bwd", tg.backward_return(ordered("symbol")))
    return sp.split_rows(t, "val", src.TRAIN_END, src.VAL_END)


@register("horizon_parse", "target horizon:i", """
SELECT target, CASE WHEN regexp_extract(target, '_(\\d+)d$', 1) = '' THEN 1
  ELSE CAST(regexp_extract(target, '_(\\d+)d$', 1) AS INTEGER) END AS horizon
FROM (SELECT DISTINCT symbol || '_' || t.name AS target FROM panel,
  (SELECT unnest(['tgt_ret_1d','tgt_ret_5d','tgt_ret_21d','tgt_vol_5d','tgt_vol_21d','tgt_mdd_21d','close']) AS name) t)""")
def horizon_parse(spark, sf):
    names = F.explode(F.array(*[F.lit(c) for c in (*tg.TARGETS, "close")]))
    symbols = src.panel(spark, sf).select("symbol").distinct()
    df = symbols.select("symbol", names.alias("name")).select(F.concat("symbol", F.lit("_"), "name").alias("target"))
    return df.withColumn("horizon", tg.horizon_col(F.col("target")))


# --- splits and folds ------------------------------------------------------


@register("split3", "symbol date split", f"SELECT symbol, date, {ob.SPLIT} AS split FROM panel")
def split3(spark, sf):
    return sp.with_split(src.panel(spark, sf), src.TRAIN_END, src.VAL_END)


@register("split_info", "train_start train_end val_start val_end test_start test_end", f"""
SELECT min(date) AS train_start, DATE '{src.TRAIN_END}' AS train_end, DATE '{src.VAL_START}' AS val_start,
  DATE '{src.VAL_END}' AS val_end, DATE '{src.TEST_START}' AS test_start, max(date) AS test_end FROM panel""")
def split_info(spark, sf):
    return sp.split_bounds(src.panel(spark, sf), src.TRAIN_END, src.VAL_END)


@register("walk_forward", "fold:i train_start train_end test_start test_end", "SELECT * FROM folds")
def walk_forward(spark, sf):
    return sp.walk_forward(spark, src.stored_dates(spark, sf), src.VAL_END)


@register("fold_range_join", "fold:i role symbol n:b avg_close:6", """
SELECT fold, CASE WHEN date <= train_end THEN 'train' ELSE 'test' END AS role, symbol, count(*) AS n, avg(close) AS avg_close
FROM panel JOIN folds ON date BETWEEN train_start AND train_end OR date BETWEEN test_start AND test_end
GROUP BY ALL""")
def fold_range_join(spark, sf):
    dates_ = src.stored_dates(spark, sf)
    spans = sp.fold_spans(dates_, sp.walk_forward(spark, dates_, src.VAL_END))
    sums = sp.fold_sums(cal.weekday_bars(src.bars(spark, sf)), spans, "close")
    return sums.withColumn("avg_close", F.try_divide("total", "known"))


@register("chrono_70_30", "symbol date part", """
SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date)
  <= floor(0.7 * count(*) OVER (PARTITION BY symbol)) THEN 'train' ELSE 'eval' END AS part FROM panel""")
def chrono_70_30(spark, sf):
    return sp.chrono_split(src.panel(spark, sf))


@register("embargo_cv", "symbol fold:i role n:b first_date last_date", """
SELECT symbol, fold, CASE WHEN pos < start - 21 THEN 'train' ELSE 'test' END AS role, count(*) AS n,
  min(date) AS first_date, max(date) AS last_date
FROM (SELECT symbol, date, fold, pos, n - (5 - fold) * (n // 6) AS start, n // 6 AS size
  FROM (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos,
          count(*) OVER (PARTITION BY symbol) AS n FROM panel), (SELECT unnest([0, 1, 2, 3, 4]) AS fold))
WHERE pos < start - 21 OR (pos >= start AND pos < start + size)
GROUP BY ALL""")
def embargo_cv(spark, sf):
    rows = sp.embargo_folds(src.panel(spark, sf).select("symbol", "date"))
    return rows.groupBy("symbol", "fold", "role").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@register("returns_calendar_start", "symbol val_start", f"SELECT symbol, min(date) AS val_start FROM tgt WHERE date > DATE '{src.TRAIN_END}' AND tgt_ret_1d IS NOT NULL GROUP BY symbol")
def returns_calendar_start(spark, sf):
    return sp.first_date_after(tg.forward_targets(src.panel(spark, sf)), src.TRAIN_END)


# --- scalars ---------------------------------------------------------------


@register("bday_shift", "date next_day prev_day", """
SELECT date, date + CAST(CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS next_day,
  date - CAST(CASE isodow(date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS INTEGER) AS prev_day
FROM (SELECT DISTINCT date FROM bars)""")
def bday_shift(spark, sf):
    d = F.col("date")
    return cal.observed_dates(src.bars(spark, sf)).select(
        "date", dates.next_bday_col(d).alias("next_day"), dates.prev_bday_col(d).alias("prev_day")
    )


# A calendar with holidays: the shared dates without the first trading date of every month.
_TRADING = "SELECT date FROM (SELECT date, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS k FROM shared_dates) WHERE k > 1"


def _trading_dates(spark, sf):
    month = ordered("_m")
    dated = src.stored_dates(spark, sf).withColumn("_m", F.trunc("date", "month"))
    return dated.withColumn("_k", F.row_number().over(month)).where("_k > 1").select("date")


@register("trading_day_shift", "date plus_1 plus_5 minus_3", f"""
WITH t AS (SELECT date, row_number() OVER (ORDER BY date) AS nth FROM ({_TRADING}))
SELECT s.date, a.date AS plus_1, b.date AS plus_5, c.date AS minus_3
FROM (SELECT date, (SELECT max(nth) FROM t WHERE t.date <= s.date) AS nth FROM (SELECT DISTINCT date FROM bars) s) s
LEFT JOIN t a ON a.nth = s.nth + 1 LEFT JOIN t b ON b.nth = s.nth + 5 LEFT JOIN t c ON c.nth = s.nth - 3
WHERE s.date <= (SELECT max(date) FROM t)""")
def trading_day_shift(spark, sf):
    """Shifts by ordinals of a calendar with holidays, from any day, trading or not."""
    dates = write_once(_trading_dates(spark, sf), "trading-dates")
    out = cal.observed_dates(src.bars(spark, sf)).select("date").distinct()
    for n, name in ((1, "plus_1"), (5, "plus_5"), (-3, "minus_3")):
        out = cal.shift_trading_days(out, dates, n, out=name)
    return out.join(dates.agg(F.max("date").alias("_last")), F.col("date") <= F.col("_last"))


@register("trading_bounds", "train_start train_end val_start val_end test_start test_end", f"""
SELECT min(date) AS train_start, max(date) FILTER (date <= DATE '{src.TRAIN_END}') AS train_end, min(date) FILTER (date > DATE '{src.TRAIN_END}') AS val_start,
  max(date) FILTER (date <= DATE '{src.VAL_END}') AS val_end, min(date) FILTER (date > DATE '{src.VAL_END}') AS test_start, max(date) AS test_end FROM ({_TRADING})""")
def trading_bounds(spark, sf):
    return sp.trading_bounds(_trading_dates(spark, sf), src.TRAIN_END, src.VAL_END)


@register("date_filter", "symbol date close:9", "SELECT * FROM panel WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def date_filter(spark, sf):
    return src.panel(spark, sf).where(F.col("date").between("1998-01-01", "1998-12-31"))


@register("scalar_functions", "symbol date gain:9 loss:9 dir:1 mag:9 root:9", """
SELECT symbol, date, greatest(r, 0) AS gain, -least(r, 0) AS loss, sign(r) AS dir, abs(r) AS mag, sqrt(close) AS root
FROM panel_ret WHERE r IS NOT NULL""")
def scalar_functions(spark, sf):
    r = F.col("r")
    df = src.panel(spark, sf).withColumn("r", pf.log_return(ordered("symbol"))).where("r is not null")
    return df.select(
        "symbol", "date", scalars.clip(r, low=0.0).alias("gain"), (-scalars.clip(r, high=0.0)).alias("loss"),
        F.signum(r).alias("dir"), F.abs(r).alias("mag"), F.sqrt("close").alias("root"),
    )


@register("binary_drawdown", "symbol date event:i", "SELECT symbol, date, CASE WHEN tgt_mdd_21d IS NOT NULL THEN CAST(tgt_mdd_21d < -0.05 AS INTEGER) END AS event FROM tgt_all_mdd")
def binary_drawdown(spark, sf):
    t = tg.forward_targets(src.panel(spark, sf), trim=False)
    return t.withColumn("event", scalars.drawdown_event(F.col("tgt_mdd_21d")))


@register("drop_nulls", "symbol kept:b dropped:b", """
SELECT symbol, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM (
  SELECT symbol, tgt_ret_1d IS NOT NULL AND logret IS NOT NULL AND vol_63d IS NOT NULL AND mom_126d IS NOT NULL AS ok
  FROM feat LEFT JOIN tgt USING (symbol, date)) GROUP BY symbol""")
def drop_nulls(spark, sf):
    p = src.panel(spark, sf)
    df = pf.price_features(p, rsi=False).join(tg.forward_targets(p), ["symbol", "date"], "left")
    needed = ["tgt_ret_1d", "logret", "vol_63d", "mom_126d"]
    return tr.null_drops(df, needed, ["symbol"])


@register("features_targets", "symbol date vol_21d:9 mom_63d:9 tgt_ret_1d:9", """
SELECT * FROM feat JOIN tgt USING (symbol, date) WHERE vol_21d IS NOT NULL AND mom_63d IS NOT NULL AND tgt_ret_1d IS NOT NULL""")
def features_targets(spark, sf):
    p = src.panel(spark, sf)
    cols = ["symbol", "date", "vol_21d", "mom_63d"]
    df = pf.price_features(p, rsi=False).select(*cols).join(tg.forward_targets(p), ["symbol", "date"], "left")
    return df.na.drop(subset=["vol_21d", "mom_63d", "tgt_ret_1d"])


@register("rolling_bands", "symbol date mean_20:6 sd_20:6", """
SELECT symbol, date, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS mean_20,
  CASE WHEN count(close) OVER w = 20 THEN stddev_samp(close) OVER w END AS sd_20
FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_bands(spark, sf):
    w = ordered("symbol")
    return src.panel(spark, sf).select(
        "symbol", "date",
        rolling(F.avg, F.col("close"), 20, w).alias("mean_20"),
        rolling(F.stddev_samp, F.col("close"), 20, w).alias("sd_20"),
    )


# --- intraday panels -----------------------------------------------------------

# Small blocks, so that the fixture's histories (720 hours) really span several.
FIXTURE_BLOCK = 200


def _hourly(spark, sf):
    t = tables.event_ticks(spark, sf).where(F.col("price") > 0).withColumn("date", F.date_trunc("hour", "ts"))
    return tables.resample_bars(t, ["event_id"]).select("*", F.col("date").alias("hour"), F.to_date("date").alias("day")).drop("date")


def _hour_text(df):
    return df.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@register("features_intraday", FEATURE_COLS.replace("date", "hour"), "SELECT f.*, a.atr_14, f.date AS hour FROM hourly_feat f JOIN hourly_atr a USING (symbol, date)")
def features_intraday(spark, sf):
    def windows(df, **kw):
        return pf.price_features(df, rsi=False, **kw)

    return _hour_text(bl.over_blocks(_hourly(spark, sf), windows, "hour", "day", back=pf.MAX_LOOKBACK_ROWS, rows=FIXTURE_BLOCK))


@register("targets_intraday", TARGET_COLS.replace("date", "hour"), "SELECT *, date AS hour FROM hourly_tgt")
def targets_intraday(spark, sf):
    return _hour_text(bl.over_blocks(_hourly(spark, sf), tg.forward_targets, "hour", "day", back=1, ahead=21, rows=FIXTURE_BLOCK))


@register("rsi_intraday", "symbol hour rsi_14:6", "SELECT symbol, date AS hour, rsi_14 FROM hourly_rsi")
def rsi_intraday(spark, sf):
    return _hour_text(bl.rsi_over_blocks(_hourly(spark, sf), "hour", "day", rows=FIXTURE_BLOCK))
