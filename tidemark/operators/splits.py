"""Temporal splits, walk-forward folds and embargoed cross-validation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import as_date, next_bday, plus_months, prev_bday
from tidemark.functions.windows import ordered
from tidemark.operators.calendar import broadcast_calendar


def _d(x: str | date) -> Column:
    return F.lit(str(x)).cast("date")


def split_label(train_end: str, val_end: str, col: str = "date") -> Column:
    """train / val / test; NULL for a weekend date between two boundaries."""
    c = F.col(col)
    return (
        F.when(c <= _d(train_end), "train")
        .when(c.between(_d(next_bday(train_end)), _d(val_end)), "val")
        .when(c >= _d(next_bday(val_end)), "test")
    )


def with_split(df: DataFrame, train_end: str, val_end: str) -> DataFrame:
    return df.withColumn("split", split_label(train_end, val_end))


def split_rows(df: DataFrame, name: str, train_end: str, val_end: str) -> DataFrame:
    return df.where(split_label(train_end, val_end) == name)


def split_bounds(df: DataFrame, train_end: str, val_end: str) -> DataFrame:
    """One row of boundary dates."""
    return df.agg(F.min("date").alias("train_start"), F.max("date").alias("test_end")).select(
        "train_start",
        _d(train_end).alias("train_end"),
        _d(next_bday(train_end)).alias("val_start"),
        _d(val_end).alias("val_end"),
        _d(next_bday(val_end)).alias("test_start"),
        "test_end",
    )


def trading_bounds(dates: DataFrame, train_end: str, val_end: str) -> DataFrame:
    """``split_bounds`` on a trading calendar: every boundary is a date on which there was trading."""
    d = F.col("date")
    last, first = (lambda c: F.max(F.when(c, d))), (lambda c: F.min(F.when(c, d)))
    return dates.agg(
        F.min(d).alias("train_start"), last(d <= _d(train_end)).alias("train_end"), first(d > _d(train_end)).alias("val_start"),
        last(d <= _d(val_end)).alias("val_end"), first(d > _d(val_end)).alias("test_start"), F.max(d).alias("test_end"),
    )


def fold_ranges(first: date, val_end: str, window_months: int = 12, step_months: int = 1) -> list[tuple]:
    """Expanding-window fold boundaries from the first data date up to ``val_end``."""
    end = as_date(val_end)
    train_end = prev_bday(plus_months(first, window_months))
    out = []
    while True:
        test_start = next_bday(train_end)
        test_end = prev_bday(plus_months(test_start, step_months))
        if test_end > end:
            return out
        out.append((len(out), first, train_end, test_start, test_end))
        train_end = plus_months(train_end, step_months)


FOLDS = "fold INT, train_start DATE, train_end DATE, test_start DATE, test_end DATE"


def walk_forward(spark: SparkSession, cal: DataFrame, val_end: str, window_months: int = 12, step_months: int = 1) -> DataFrame:
    """Fold table over a date calendar, cut at the first fold without test dates.

    The only value fetched to the driver is the first date; the table has one
    row per month of history.
    """
    first = cal.agg(F.min("date")).first()[0]
    folds = spark.createDataFrame(fold_ranges(first, val_end, window_months, step_months), FOLDS)
    hit = fold_membership(cal.where(F.col("date") <= _d(val_end)), folds)
    tested = hit.where(F.col("role") == "test").select("fold").distinct()
    empty = folds.join(tested, "fold", "left_anti").agg(F.coalesce(F.min("fold"), F.lit(2**30))).scalar()
    return folds.where(F.col("fold") < empty)


def fold_membership(cal: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, role, date) for each calendar date of each fold.

    The range join runs over the calendar, whose length is bounded, never over
    panel rows; a panel then joins by date on equality.
    """
    f = F.broadcast(folds)
    d = F.col("date")
    role = F.when(d.between(F.col("train_start"), F.col("train_end")), "train").when(
        d.between(F.col("test_start"), F.col("test_end")), "test"
    )
    inside = d.between(F.col("train_start"), F.col("test_end"))
    return cal.select("date").join(f, inside).select("fold", role.alias("role"), "date").where("role is not null")


def fold_spans(cal: DataFrame, folds: DataFrame) -> DataFrame:
    """One row per date: the first fold that trains on it, the last fold, and the folds that test on it.

    Training windows only grow, so a date once in training stays in all later
    folds and two numbers describe it: the table stays one row per calendar date.
    """
    last = folds.agg(F.max("fold")).scalar()
    return fold_membership(cal, folds).groupBy("date").agg(
        F.min(F.when(F.col("role") == "train", F.col("fold"))).alias("train_from"),
        F.collect_set(F.when(F.col("role") == "test", F.col("fold"))).alias("tests"),
    ).withColumn("last_fold", last)


def fold_rows(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """Panel rows of each fold and role, by an equi-join on date."""

    def tagged(folds: Column, role: str) -> Column:
        return F.transform(folds, lambda f: F.struct(f.alias("fold"), F.lit(role).alias("role")))

    train = F.when(F.col("train_from").isNotNull(), F.sequence("train_from", "last_fold")).otherwise(F.array().cast("array<int>"))
    hits = F.explode(F.concat(tagged(train, "train"), tagged(F.col("tests"), "test"))).alias("_hit")
    joined = panel.join(broadcast_calendar(spans), "date")
    return joined.select(*panel.columns, hits).select(*panel.columns, "_hit.fold", "_hit.role")


def fold_sums(panel: DataFrame, spans: DataFrame, value: str) -> DataFrame:
    """(fold, role, symbol, n, known, total): rows, known values and their sum over the rows of each fold and role, without copying rows into folds.

    Training windows only grow, so the rows are summed by the first fold that trains on them and a running sum over
    the folds of a symbol gives every fold; a row tests one fold.
    """
    dated = panel.select("symbol", "date", value).join(broadcast_calendar(spans), "date")
    sums = [F.count(F.lit(1)).alias("n"), F.count(value).alias("known"), F.sum(value).alias("total")]
    first = dated.where("train_from is not null").groupBy("symbol", F.col("train_from").alias("fold"), "last_fold").agg(*sums)
    every = first.groupBy("symbol").agg(F.min("fold").alias("a"), F.max("last_fold").alias("b")).select("symbol", F.explode(F.sequence("a", "b")).alias("fold"))
    w = ordered("symbol", order="fold").rowsBetween(Window.unboundedPreceding, 0)
    grown = every.join(first.drop("last_fold"), ["symbol", "fold"], "left")
    train = grown.select("fold", F.lit("train").alias("role"), "symbol", *[F.sum(c).over(w).alias(c) for c in ("n", "known", "total")])
    test = dated.select("symbol", value, F.explode("tests").alias("fold")).groupBy("fold", F.lit("test").alias("role"), "symbol").agg(*sums)
    return train.unionByName(test)


def chrono_split(df: DataFrame, share: float = 0.7) -> DataFrame:
    """First ``int(share * n)`` rows of a symbol by date are train, the rest eval."""
    w = ordered("symbol")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    part = F.when(F.row_number().over(w) <= F.floor(n * F.lit(share)), "train").otherwise("eval")
    return df.withColumn("part", part)


def embargo_folds(df: DataFrame, splits: int = 5, gap: int = 21) -> DataFrame:
    """Time-series folds per symbol with ``gap`` rows dropped before each test block.

    Every row is tagged with its 0-based position and the symbol's test-block
    size; fold membership is plain arithmetic on those two.
    """
    w = ordered("symbol")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    pos = F.row_number().over(w) - 1
    df = df.withColumns({"_pos": pos, "_n": n, "_size": F.floor(n / (splits + 1)).cast("int")})
    roles = []
    for k in range(splits):
        start = F.col("_n") - (splits - k) * F.col("_size")
        role = F.when(F.col("_pos") < start - gap, "train").when(
            (F.col("_pos") >= start) & (F.col("_pos") < start + F.col("_size")), "test"
        )
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))))
    hit = F.explode(F.array_compact(F.array(*roles))).alias("_hit")
    return df.select("*", hit).select(*df.columns, "_hit.fold", "_hit.role").drop("_pos", "_n", "_size")


def first_date_after(df: DataFrame, train_end: str) -> DataFrame:
    """First known return date after the train period, per symbol."""
    return df.where((F.col("date") > _d(train_end)) & F.col("tgt_ret_1d").isNotNull()).groupBy("symbol").agg(
        F.min("date").alias("val_start")
    )
