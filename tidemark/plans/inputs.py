"""Panels the registered queries start from, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import ANNUAL_DAYS, ordered, rolling
from tidemark.operators import calendar as cal
from tidemark.operators import ensemble, splits, targets
from tidemark.operators.meta import WeightModel, meta_prepare, with_meta_features
from tidemark.operators.price_features import log_return
from tidemark.plans.stage import stage, written
from tidemark.sources import tables

# Split boundaries and crisis windows of the fixtures.
TRAIN_END, VAL_END = "1999-12-31", "2000-12-31"
VAL_START, TEST_START = "2000-01-03", "2001-01-01"
CRISES = [("shock", "1998-08-01", "1998-10-31"), ("slow", "2000-03-01", "2000-08-31")]


@stage
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, written once per query: calendar, panel and macro joins all read them, the ticks are read once."""
    return tables.lineitem_bars(spark, sf_dir)


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finer panel: one symbol per supplier, with calendar gaps."""
    return cal.weekday_bars(tables.lineitem_bars(spark, sf_dir, "l_suppkey"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.panel(bars(spark, sf_dir))


def flagged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cal.weekday_bars(bars(spark, sf_dir))
    return cal.flag_shared(b, cal.shared_calendar(b))


def panel_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared calendar: of the bars where the query has them, else of the ticks' dates alone."""
    dated = bars(spark, sf_dir) if written(bars, sf_dir) else tables.lineitem_dates(spark, sf_dir)
    return cal.shared_calendar(cal.weekday_bars(dated))


@stage
def stored_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared calendar as a written table, for plans that read it several times."""
    return panel_dates(spark, sf_dir)


def macro_obs(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """Observations stamped with the date they became known."""
    return cal.publication_shift(tables.order_macro(spark, sf_dir, exact), {tables.MONTHLY_SERIES: 1})


def macro_long(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    return cal.asof_fill(panel_dates(spark, sf_dir), macro_obs(spark, sf_dir, exact))


# A weight model with given coefficients: the plans that apply weights take it as
# a parameter, so their results do not hang on a fit.
WEIGHT_MODEL = WeightModel(
    mean=(0.02, 0.05, 0.0, 0.0, 0.9),
    scale=(0.22, 0.25, 0.9, 1.5, 0.2),
    coef={
        "return": (0.4, -0.1, 0.3, 0.05, -0.2),
        "vol": (-0.2, 0.3, 0.1, -0.15, 0.1),
        "regime": (0.1, 0.05, -0.25, 0.4, 0.0),
        "drawdown": (0.0, 0.0, 0.0, 0.0, 0.0),
    },
    intercept={"return": 0.1, "vol": -0.05, "regime": 0.02, "drawdown": 0.0},
    saturated=frozenset({"drawdown"}),
)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with the realised (backward) log return of each date."""
    return panel(spark, sf_dir).withColumn("ret_bwd", log_return(ordered("symbol")))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form predictions standing in for the fitted base models."""
    w = ordered("symbol")
    r = returns(spark, sf_dir).select("symbol", "date", "close", "ret_bwd")
    vix = macro_long(spark, sf_dir).where("series_id = 'VIXCLS'").select("date", F.col("value").alias("vix"))
    df = cal.merge_features(r, vix)
    df = df.withColumns({"_rs": F.lag("ret_bwd").over(w), "vlag": F.lag("vix").over(w)})
    v = F.col("vlag")
    return df.select(
        "symbol",
        "date",
        "close",
        "ret_bwd",
        "vlag",
        rolling(F.avg, F.col("_rs"), 5, w).alias("return_pred"),
        (rolling(F.stddev_samp, F.col("_rs"), 21, w) * F.sqrt(F.lit(float(ANNUAL_DAYS)))).alias("vol_pred"),
        F.when(v <= 19, 0).when(v > 30, 1).when(v.isNotNull(), 2).alias("regime_label"),
        (1 / (1 + F.exp(rolling(F.sum, F.col("_rs"), 21, w)))).alias("drawdown_risk_prob"),
    )


def preds_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.fit_and_normalize(preds(spark, sf_dir), TRAIN_END)


def preds_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.with_disagreement(preds_z(spark, sf_dir), VAL_START, VAL_END)


def trimmed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.forward_targets(panel(spark, sf_dir))


def targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the targets of the same rows, flagged instead of trimmed."""
    p = preds_d(spark, sf_dir)
    carry = tuple(c for c in p.columns if c not in ("symbol", "date", "close"))
    return targets.forward_targets(p, carry=carry, mark="has_target")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions, targets and track-record features: one panel, one shuffle by symbol."""
    return with_meta_features(targeted(spark, sf_dir))


def meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = meta(spark, sf_dir)
    known = F.when(F.col("has_target"), F.col("tgt_ret_1d"))
    return meta_prepare(table.withColumn("tgt_ret_1d", known), TRAIN_END, VAL_END)


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the backtest window."""
    return splits.split_rows(preds_d(spark, sf_dir), "val", TRAIN_END, VAL_END)
