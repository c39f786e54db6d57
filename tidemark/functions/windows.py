"""Window helpers. All frames count rows, never calendar days.

A panel holds one row per (symbol, date), so a symbol's partition can never be
longer than the trading calendar (about 260 rows a year): the windows below
sort groups of proven, small size however many symbols there are. Raw ticks,
which have no such bound, are reduced to bars with partial aggregation before
any window sees them; intraday panels go through ``operators.blocks``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding
ANNUAL_DAYS = 252


def ordered(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec, min_count: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows, NULL until ``min_count`` of them hold a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (min_count or n), agg(x).over(frame))


def forward(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec, min_count: int | None = None) -> Column:
    """``agg`` over the next ``n`` rows (the current row excluded), NULL when fewer remain."""
    frame = w.rowsBetween(1, n)
    return F.when(F.count(x).over(frame) >= (min_count or n), agg(x).over(frame))


def last_known(x: Column, w: WindowSpec) -> Column:
    """Latest non-null value at or before the current row."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(UNBOUNDED, 0))


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)

