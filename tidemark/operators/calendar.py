"""Trading calendars, as-of alignment and panel joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import is_weekday
from tidemark.functions.windows import UNBOUNDED, last_known, ordered
from tidemark.sources.tables import SERIES


def broadcast_calendar(df: DataFrame) -> DataFrame:
    """Broadcast a table keyed by calendar date.

    Its size is bounded by the calendar itself (366 rows a year, whatever the
    number of symbols or ticks), which is what makes the hint safe.
    """
    return F.broadcast(df)


def weekday_bars(bars: DataFrame) -> DataFrame:
    return bars.where(is_weekday(F.col("date")))


def shared_calendar(bars: DataFrame) -> DataFrame:
    """Dates on which every symbol has a bar."""
    n_symbols = bars.select(F.countDistinct("symbol")).scalar()
    per_date = bars.groupBy("date").agg(F.count("symbol").alias("n"))
    return per_date.where(F.col("n") == n_symbols).select("date")


def flag_shared(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """All bars with a ``shared`` flag, so that one shuffle serves shared and own-calendar windows."""
    hit = broadcast_calendar(cal.select("date", F.lit(True).alias("_hit")))
    return bars.join(hit, "date", "left").withColumn("shared", F.coalesce("_hit", F.lit(False))).drop("_hit")


def panel(bars: DataFrame) -> DataFrame:
    """Weekday bars restricted to the shared calendar."""
    b = weekday_bars(bars)
    return b.join(broadcast_calendar(shared_calendar(b)), "date", "left_semi")


def observed_dates(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()


def publication_shift(obs: DataFrame, lags: dict[str, int], lag_days: int = 0) -> DataFrame:
    """Move each listed series' stamp forward by whole months (and optionally days) to its release."""
    month = F.lit(0)
    for series, k in lags.items():
        month = F.when(F.col("series_id") == series, F.lit(k)).otherwise(month)
    moved = F.when(month > 0, F.date_add(F.add_months("obs_date", month), lag_days)).otherwise(F.col("obs_date"))
    return obs.withColumn("obs_date", moved)


def business_days(obs: DataFrame) -> DataFrame:
    """One row per series and business day between its first and last observation, forward filled."""
    span = obs.groupBy("series_id").agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b"))
    days = span.select("series_id", F.explode(F.sequence("a", "b")).alias("date")).where(is_weekday(F.col("date")))
    return _fill_backward(days, obs)


def _fill_backward(grid: DataFrame, obs: DataFrame, allow_backfill: bool = False) -> DataFrame:
    """Last observation at or before each grid row, by one sort of both sides together."""
    marks = grid.select("series_id", "date", F.lit(None).cast("double").alias("value"), F.lit(1).alias("is_grid"))
    points = obs.select("series_id", F.col("obs_date").alias("date"), "value", F.lit(0).alias("is_grid"))
    w = ordered("series_id").orderBy("date", "is_grid")
    filled = last_known(F.col("value"), w)
    if allow_backfill:
        ahead = F.first("value", ignorenulls=True).over(w.rowsBetween(0, -UNBOUNDED))
        filled = F.coalesce(filled, ahead)
    return (
        points.unionByName(marks)
        .withColumn("value", filled)
        .where(F.col("is_grid") == 1)
        .select("series_id", "date", "value")
    )


def asof_fill(cal: DataFrame, obs: DataFrame, series: tuple[str, ...] = SERIES, allow_backfill: bool = False) -> DataFrame:
    """Each series as known on each calendar date (long form).

    ``allow_backfill`` also fills dates before a series' first observation from
    the future; it is a look-ahead and therefore off by default.
    """
    grid = cal.select("date", F.explode(F.array(*[F.lit(s) for s in series])).alias("series_id"))
    return _fill_backward(grid, obs, allow_backfill)


def macro_wide(long: DataFrame, series: tuple[str, ...] = SERIES) -> DataFrame:
    """One row per date, one column per series (a pivot, never an N-way outer join)."""
    aggs = [F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(s) for s in series]
    return long.groupBy("date").agg(*aggs)


def macro_outer(obs: DataFrame, series: tuple[str, ...] = SERIES) -> DataFrame:
    return macro_wide(obs.withColumnRenamed("obs_date", "date"), series)


def with_rate_spread(wide: DataFrame) -> DataFrame:
    return wide.withColumn("rate_spread", F.col("GS10") - F.col("DFF"))


def merge_features(price: DataFrame, macro: DataFrame) -> DataFrame:
    """Inner join of symbol features with the date-keyed macro table."""
    return price.join(broadcast_calendar(macro), "date", "inner")


def join_left_ffill(price: DataFrame, macro: DataFrame) -> DataFrame:
    """Left join, then carry every column forward per symbol."""
    joined = price.join(broadcast_calendar(macro), "date", "left")
    w = ordered("symbol")
    cols = [c for c in joined.columns if c not in ("symbol", "date")]
    return joined.select("symbol", "date", *[last_known(F.col(c), w).alias(c) for c in cols])


def crisis_rows(df: DataFrame, crises: list[tuple[str, str, str]]) -> DataFrame:
    """Rows tagged with the named date windows they fall in (windows may overlap)."""
    hits = F.array_compact(
        F.array(*[F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in crises])
    )
    return df.withColumn("crisis", F.explode(hits))


def in_any_crisis(crises: list[tuple[str, str, str]]):
    cond = F.lit(False)
    for _, a, b in crises:
        cond = cond | F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return cond


def trading_ordinals(dates: DataFrame) -> DataFrame:
    """(day, date, nth): for every calendar day of a trading calendar's span the last trading date up to it and its place.

    The window runs over the calendar's distinct dates, whose number grows with years, not with rows. A day table turns the
    range look-up of a holiday or weekend into an equality join.
    """
    w = Window.orderBy("date")
    days = dates.select("date").where("date IS NOT NULL").distinct()
    days = days.select("date", F.row_number().over(w).alias("nth"), F.coalesce(F.date_sub(F.lead("date").over(w), 1), "date").alias("_to"))
    return days.select(F.explode(F.sequence("date", "_to")).alias("day"), "date", "nth")


def shift_trading_days(df: DataFrame, dates: DataFrame, n: int, col: str = "date", out: str = "shifted") -> DataFrame:
    """Adds ``out``: the date ``n`` trading days after (before, if negative) the last trading date up to ``col``.

    Unknown where the calendar doesn't reach: holidays count because they aren't in the calendar, not by a rule.
    """
    ordinals = trading_ordinals(dates)
    at = broadcast_calendar(ordinals.select(F.col("day").alias(col), F.col("nth").alias("_nth")))
    to = broadcast_calendar(ordinals.where("day = date").select((F.col("nth") - n).alias("_nth"), F.col("date").alias(out)))
    return df.join(at, col, "left").join(to, "_nth", "left").select(*df.columns, out)
