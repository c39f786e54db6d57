"""Forward-looking training targets. They look ahead by design and live apart from features."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.arrays import worst_drawdown
from tidemark.functions.windows import forward, ordered

# Horizons, and the lag that makes each target fully past (horizon + 1).
RET_HORIZONS, VOL_HORIZONS, MDD_HORIZON = (1, 5, 21), (5, 21), 21
MAX_HORIZON = 21
CAUSAL_LAG = {"tgt_ret_1d": 2, "tgt_vol_5d": 6, "tgt_mdd_21d": 22}
TARGETS = (
    *[f"tgt_ret_{h}d" for h in RET_HORIZONS],
    *[f"tgt_vol_{h}d" for h in VOL_HORIZONS],
    f"tgt_mdd_{MDD_HORIZON}d",
)


def parse_horizon(name: str) -> int:
    """Trailing ``_<n>d`` of a target name; 1 when absent."""
    hit = re.search(r"_(\d+)d$", name)
    return int(hit.group(1)) if hit else 1


def horizon_col(name: Column) -> Column:
    digits = F.regexp_extract(name, r"_(\d+)d$", 1)
    return F.when(digits == "", 1).otherwise(digits.cast("int"))


def ret_targets(w: WindowSpec) -> dict[str, Column]:
    return {f"tgt_ret_{h}d": F.log(F.try_divide(F.lead("close", h).over(w), F.col("close"))) for h in RET_HORIZONS}


def vol_targets(w: WindowSpec) -> dict[str, Column]:
    """Sample deviation of the next h returns, not annualised; needs a ``_r`` column."""
    return {f"tgt_vol_{h}d": forward(F.stddev_samp, F.col("_r"), h, w) for h in VOL_HORIZONS}


def with_mdd(df: DataFrame, w: WindowSpec, h: int = MDD_HORIZON) -> DataFrame:
    """Deepest fall after a peak within the next h closes; NULL when fewer remain."""
    df = df.withColumn("_ahead_close", F.collect_list("close").over(w.rowsBetween(1, h)))
    mdd = F.when(F.size("_ahead_close") == h, worst_drawdown(F.col("_ahead_close")))
    return df.withColumn(f"tgt_mdd_{h}d", mdd).drop("_ahead_close")


def guarded_prices(panel: DataFrame) -> DataFrame:
    """The panel with a ``close`` whose use fails where it is not positive; unknown closes pass."""
    refused = F.raise_error(F.concat(F.lit("non-positive close for "), F.col("symbol"))).cast("double")
    return panel.withColumn("close", F.when((F.col("close") > 0) | F.col("close").isNull(), F.col("close")).otherwise(refused))


def forward_targets(
    panel: DataFrame,
    trim: bool = True,
    guard_prices: bool = False,
    keys: tuple[str, ...] = ("symbol",),
    order: str = "date",
    carry: tuple[str, ...] = (),
    mark: str | None = None,
) -> DataFrame:
    """All targets per symbol; ``trim`` drops each symbol's last 21 rows, ``mark`` flags the others instead.

    ``guard_prices`` refuses non-positive closes instead of letting them turn into NULL.
    """
    w = ordered(*keys, order=order)
    if guard_prices:
        panel = guarded_prices(panel)
    df = panel.select(*dict.fromkeys(("symbol", *keys, order, *carry, "close"))).withColumn("_r", F.log("close") - F.log(F.lag("close").over(w)))
    df = with_mdd(df.withColumns({**ret_targets(w), **vol_targets(w)}), w)
    full = F.count(F.lit(1)).over(w.rowsBetween(1, MAX_HORIZON)) == MAX_HORIZON
    if mark:
        return df.select("symbol", order, *carry, *TARGETS, full.alias(mark))
    if trim:
        df = df.withColumn("_full", full).where("_full")
    return df.select("symbol", order, *carry, *TARGETS)


def causal_target(name: str, w: WindowSpec) -> Column:
    """A target moved far enough back that its value is known by the previous close."""
    if name not in CAUSAL_LAG:
        raise KeyError(f"target {name!r} has no registered horizon")
    return F.lag(name, CAUSAL_LAG[name]).over(w)


def backward_return(w: WindowSpec, target: str = "tgt_ret_1d") -> Column:
    """Realised return of a date, read from the forward target one row earlier."""
    return F.lag(target).over(w)
