"""Business-day arithmetic (weekends only) and split-boundary helpers."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(d: str | date) -> date:
    return d if isinstance(d, date) else date.fromisoformat(d)


def next_bday(d: str | date) -> date:
    d = as_date(d) + timedelta(days=1)
    while d.weekday() >= 5:
        d += timedelta(days=1)
    return d


def prev_bday(d: str | date) -> date:
    d = as_date(d) - timedelta(days=1)
    while d.weekday() >= 5:
        d -= timedelta(days=1)
    return d


def plus_months(d: str | date, months: int) -> date:
    """Add months, clamping to the end of a shorter month."""
    d = as_date(d)
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def next_bday_col(c: Column) -> Column:
    wd = F.weekday(c)
    return F.date_add(c, F.when(wd == 4, 3).when(wd == 5, 2).otherwise(1))


def prev_bday_col(c: Column) -> Column:
    wd = F.weekday(c)
    return F.date_sub(c, F.when(wd == 0, 3).when(wd == 6, 2).otherwise(1))


def is_weekday(c: Column) -> Column:
    return F.weekday(c) < 5
