"""Macro features, computed in long form and keyed by series (never one global window)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import vix_bucket
from tidemark.functions.windows import ordered, rolling

# Change horizons per series family.
RATE_SERIES, RATE_STEPS = ("DFF", "GS10"), (1, 5, 21)
VIX_STEPS = (5, 21)
MACRO_FEATURES = (
    *[f"{s}_change_{k}d" for s in RATE_SERIES for k in RATE_STEPS],
    "cpi_surprise",
    "vix_regime",
    *[f"vix_change_{k}d" for k in VIX_STEPS],
    "yield_curve_slope",
    "yield_curve_slope_21d_ma",
)


def with_spread_series(long: DataFrame) -> DataFrame:
    """Append the derived series rate_spread = GS10 - DFF."""
    ten = F.max(F.when(F.col("series_id") == "GS10", F.col("value")))
    funds = F.max(F.when(F.col("series_id") == "DFF", F.col("value")))
    spread = long.groupBy("date").agg((ten - funds).alias("value"))
    return long.unionByName(spread.select(F.lit("rate_spread").alias("series_id"), "date", "value"))


def macro_features(long: DataFrame) -> DataFrame:
    """Twelve features per date from filled series (series_id, date, value)."""
    w = ordered("series_id")
    v1 = F.lag("value").over(w)
    steps = {
        "_v1": v1,
        **{f"_d{k}": v1 - F.lag("value", 1 + k).over(w) for k in sorted({*RATE_STEPS, *VIX_STEPS})},
        "_pct": F.try_divide("value", F.lag("value", 21).over(w)) - 1,
    }
    df = with_spread_series(long).withColumns(steps)
    df = df.withColumn("_ma", rolling(F.avg, F.col("_v1"), 21, w))

    def pick(series: str, col: str):
        return F.max(F.when(F.col("series_id") == series, F.col(col)))

    aggs = [pick(s, f"_d{k}").alias(f"{s}_change_{k}d") for s in RATE_SERIES for k in RATE_STEPS]
    aggs += [pick("CPIAUCSL", "_pct").alias("cpi_surprise"), pick("VIXCLS", "_v1").alias("_vix")]
    aggs += [pick("VIXCLS", f"_d{k}").alias(f"vix_change_{k}d") for k in VIX_STEPS]
    aggs += [pick("rate_spread", "_v1").alias("yield_curve_slope"), pick("rate_spread", "_ma").alias("yield_curve_slope_21d_ma")]
    wide = df.groupBy("date").agg(*aggs).withColumn("vix_regime", vix_bucket(F.col("_vix")))
    return wide.select("date", *MACRO_FEATURES)
