"""Base-prediction table: alignment, normalisation and model disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import PRED_COLS, regime_risk, row_std
from tidemark.functions.windows import ordered

MIN_TRAIN_ROWS = 20
VOL_REFERENCE_ROWS = 252


def with_regime_risk(preds: DataFrame) -> DataFrame:
    """Add ``regime_pred`` (risk order) next to the raw ``regime_label``, which stays as it is."""
    return preds.withColumn("regime_pred", regime_risk(F.col("regime_label")))


def align_predictions(returns: DataFrame, drawdown: DataFrame, vol: DataFrame, regime: DataFrame) -> DataFrame:
    """One row per (symbol, date): scored models joined, side tables reindexed onto them."""
    keys = ["symbol", "date"]
    base = returns.select(*keys, "return_pred").join(drawdown.select(*keys, "drawdown_risk_prob"), keys, "full_outer")
    base = base.join(vol.select(*keys, "vol_pred"), keys, "left").join(regime.select(*keys, "regime_label"), keys, "left")
    return base.select(*keys, "return_pred", "vol_pred", "regime_label", "drawdown_risk_prob")


def _reference_rows(preds: DataFrame, train_end: str) -> tuple[DataFrame, dict[str, Column]]:
    """Predictions in risk order, and each column limited to the rows its statistics come from.

    Volatility forecasts have no train period: their reference is the first 252
    known rows of any date.
    """
    train = F.col("date") <= F.lit(train_end).cast("date")
    known_vol = F.count("vol_pred").over(ordered("symbol").rowsBetween(Window.unboundedPreceding, 0))
    df = with_regime_risk(preds).withColumn("_k", known_vol)
    return df, {c: F.when((F.col("_k") <= VOL_REFERENCE_ROWS) if c == "vol_pred" else train, F.col(c)) for c in PRED_COLS}


def _stats(x: Column, col: str, over: WindowSpec | None = None) -> tuple[Column, Column]:
    """(mean, deviation); NULL under 20 train rows or without spread."""
    mean, sd, n = (f(x) if over is None else f(x).over(over) for f in (F.avg, F.stddev_samp, F.count))
    ok = (sd > 0) if col == "vol_pred" else (sd > 0) & (n >= MIN_TRAIN_ROWS)
    return F.when(ok, mean), F.when(ok, sd)


def fit_normalizer(preds: DataFrame, train_end: str) -> DataFrame:
    """Mean and sample deviation per symbol and column over the train period, to be frozen and stored."""
    df, rows = _reference_rows(preds, train_end)
    aggs = []
    for c, x in rows.items():
        mean, sd = _stats(x, c)
        aggs += [mean.alias(f"mu_{c}"), sd.alias(f"sd_{c}")]
    return df.groupBy("symbol").agg(*aggs)


def stats_long(stats: DataFrame) -> DataFrame:
    """Normaliser as rows (symbol, col, mu, sigma), fitted columns only."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"mu_{c}").alias("mu"), F.col(f"sd_{c}").alias("sigma")) for c in PRED_COLS])
    return stats.select("symbol", F.inline(cells)).where("sigma is not null")


def _apply(df: DataFrame) -> DataFrame:
    z = {
        c: F.when(F.col(f"sd_{c}").isNotNull(), (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")).otherwise(F.col(c))
        for c in PRED_COLS
    }
    return df.withColumns(z).drop(*[f"{p}_{c}" for c in PRED_COLS for p in ("mu", "sd")])


def normalize(preds: DataFrame, stats: DataFrame) -> DataFrame:
    """Z-score with frozen statistics; a column without them passes through."""
    return _apply(with_regime_risk(preds).join(stats, "symbol", "left"))


def fit_and_normalize(preds: DataFrame, train_end: str) -> DataFrame:
    """``normalize(preds, fit_normalizer(preds, ...))`` in one pass: the statistics are windows
    over the symbol, so the predictions are neither computed twice nor joined to themselves."""
    df, rows = _reference_rows(preds, train_end)
    w = Window.partitionBy("symbol")
    stats = {}
    for c, x in rows.items():
        stats[f"mu_{c}"], stats[f"sd_{c}"] = _stats(x, c, w)
    return _apply(df.withColumns(stats)).drop("_k")


def _complete() -> Column:
    complete = F.lit(True)
    for c in PRED_COLS:
        complete = complete & F.col(c).isNotNull()
    return complete


def _in_period(start: str | None, end: str | None) -> Column:
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col("date") <= F.lit(end).cast("date"))
    return inside


def _disagreement() -> Column:
    scaled = [
        (F.col(c) - F.col(f"_mu_{c}")) / F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}")) for c in PRED_COLS
    ]
    return F.when(_complete(), row_std(scaled))


def with_disagreement(preds: DataFrame, fit_start: str | None, fit_end: str | None) -> DataFrame:
    """Row-wise sample deviation of the four standardised predictions.

    Statistics (mean, population deviation) come from complete rows inside the
    fit window and are frozen for all other rows. Leaving both bounds open looks
    ahead. A symbol without complete rows in the window has no score.
    """
    fit = _complete() & _in_period(fit_start, fit_end)
    w = Window.partitionBy("symbol")
    stats = {}
    for c in PRED_COLS:
        x = F.when(fit, F.col(c))
        stats[f"_mu_{c}"] = F.avg(x).over(w)
        stats[f"_sd_{c}"] = F.stddev_pop(x).over(w)
    return preds.withColumns(stats).withColumn("disagreement", _disagreement()).drop(*stats)


def fit_disagreement(preds: DataFrame, fit_start: str | None, fit_end: str | None) -> DataFrame:
    """What ``with_disagreement`` fits, as one row per symbol to be stored: statistics, the number of rows and the dates
    they came from."""
    rows = preds.where(_complete() & _in_period(fit_start, fit_end))
    stats = [f(c).alias(f"{n}_{c}") for c in PRED_COLS for n, f in (("_mu", F.avg), ("_sd", F.stddev_pop))]
    return rows.groupBy("symbol").agg(*stats, F.count(F.lit(1)).alias("fit_rows"), F.min("date").alias("fit_from"), F.max("date").alias("fit_to"))


def apply_disagreement(preds: DataFrame, stats: DataFrame) -> DataFrame:
    """``disagreement`` by stored statistics, on a table or a stream. ``in_fit`` marks the rows of the fitted span: there
    the statistics look ahead. A symbol without statistics keeps its rows without a score."""
    df = preds.join(stats, "symbol", "left").withColumn("disagreement", _disagreement())
    df = df.withColumn("in_fit", F.coalesce(F.col("date").between(F.col("fit_from"), F.col("fit_to")), F.lit(False)))
    return df.select(*preds.columns, "disagreement", "in_fit")


def vol_reference(preds: DataFrame, train_end: str) -> DataFrame:
    """Per symbol the last date that the volatility's normaliser reads and how many of its rows lie after the train period.

    Its reference is the first 252 known forecasts of any date; those after ``train_end`` look ahead for the rows between.
    """
    known = F.count("vol_pred").over(ordered("symbol").rowsBetween(Window.unboundedPreceding, 0))
    rows = preds.withColumn("_k", known).where((F.col("_k") <= VOL_REFERENCE_ROWS) & F.col("vol_pred").isNotNull())
    after = F.col("date") > F.lit(train_end).cast("date")
    return rows.groupBy("symbol").agg(F.max("date").alias("vol_reference_to"), F.count_if(after).alias("rows_after_train"))


def require_fit_rows(preds: DataFrame) -> DataFrame:
    """Refuse to score a table in which no row holds all four predictions."""
    if preds.na.drop(subset=list(PRED_COLS)).isEmpty():
        raise ValueError("no row has all four predictions")
    return preds

