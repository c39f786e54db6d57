"""Kernels over short, bounded arrays collected by a row frame."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _average_ranks(m: np.ndarray) -> np.ndarray:
    """Average-tie ranks along each row, by counting smaller and equal values."""
    a, b = m[:, :, None], m[:, None, :]
    return (a > b).sum(axis=2) + ((a == b).sum(axis=2) + 1) / 2.0


def spearman_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spearman correlation of matching rows, NaN when one side is constant."""
    mid = (x.shape[1] + 1) / 2.0
    rx, ry = _average_ranks(x) - mid, _average_ranks(y) - mid
    spread = (rx * rx).sum(axis=1) * (ry * ry).sum(axis=1)
    return np.where(spread > 0, (rx * ry).sum(axis=1) / np.sqrt(np.where(spread > 0, spread, 1.0)), np.nan)


def rank_correlation(n: int):
    """Arrow-batched Spearman correlation of two ``n``-element array columns.

    NULL for other sizes or when one side is constant. The windows that build the
    arrays stay in the JVM and the call is narrow, so it keeps the partitioning.
    Written with nested array functions the ranks cost a few hundred interpreted
    lambda calls a row, which measured far slower than one batched comparison.
    """

    @F.pandas_udf("double")
    def corr(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = np.full(len(xs), np.nan)
        full = np.flatnonzero((xs.map(len) == n) & (ys.map(len) == n))
        if len(full):
            out[full] = spearman_rows(np.stack(xs.to_numpy()[full]), np.stack(ys.to_numpy()[full]))
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return corr


def worst_drawdown(prices: Column) -> Column:
    """Deepest (price - running peak) / running peak along an array."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(s: Column, p: Column) -> Column:
        peak = F.greatest(s["peak"], p)
        return F.struct(peak.alias("peak"), F.least(s["dd"], (p - peak) / peak).alias("dd"))

    return F.aggregate(prices, start, step, lambda s: s["dd"])
