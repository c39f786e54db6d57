"""Data-quality and leakage checks: each returns offending rows or a small report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import is_weekday
from tidemark.functions.windows import ordered
from tidemark.operators.targets import parse_horizon


def below_min_rows(bars: DataFrame, min_rows: int = 1000) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_rows)


def bar_report(bars: DataFrame, min_rows: int = 1000) -> DataFrame:
    """All per-symbol checks in one aggregation: a single shuffle of one row per symbol and task."""
    close = F.col("close")
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) >= min_rows).alias("enough_rows"),
        F.count_if(close <= 0).alias("non_positive_close"),
        F.count_if(close.isNull() | F.isnan(close)).alias("null_close"),
        F.count_if(~is_weekday(F.col("date"))).alias("weekend_rows"),
    )


def non_positive_close(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count_if(F.col("close") <= 0).alias("n"))


def null_close(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count_if(F.col("close").isNull() | F.isnan("close")).alias("n"))


def out_of_order(rows: DataFrame, seq: str, key: str = "symbol") -> DataFrame:
    """Rows whose date does not increase over the previous row in arrival order.

    A key with a third of all rows would be one huge sort, so each key is cut
    into slices of the arrival ordinal: rows are compared inside a slice, and the
    first row of a slice with the last row of the slice before it.
    """
    cut = F.floor(F.col(seq) / F.lit(SLICE_ROWS)).alias("_slice")
    sliced = rows.select("*", cut)
    w = ordered(key, "_slice", order=seq)
    inner = sliced.withColumn("_prev", F.lag("date").over(w))
    edges = sliced.groupBy(key, "_slice").agg(F.max_by("date", seq).alias("_edge"))
    edges = edges.withColumn("_edge", F.lag("_edge").over(ordered(key, order="_slice")))
    joined = inner.join(edges, [key, "_slice"])
    prev = F.coalesce("_prev", "_edge")
    return joined.where(F.col("date") <= prev).withColumn("prev_date", prev).drop("_slice", "_prev", "_edge")


SLICE_ROWS = 1 << 16


def duplicate_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def weekend_rows(bars: DataFrame) -> DataFrame:
    return bars.where(~is_weekday(F.col("date")))


def null_cells(cols: list[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNull().cast("int")
    return F.sum(total)


def summary(df: DataFrame, key: str = "symbol", date: str = "date") -> DataFrame:
    cols = [c for c in df.columns if c not in (key, date)]
    return df.groupBy(key).agg(
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count(F.lit(1)).alias("n"),
        null_cells(cols).alias("null_cells"),
    )


def short_history(bars: DataFrame) -> DataFrame:
    """Symbols that start after the earliest date of the whole panel."""
    start = bars.agg(F.min("date")).scalar()
    firsts = bars.groupBy("symbol").agg(F.min("date").alias("first_date"))
    return firsts.where(F.col("first_date") > start)


def null_counts(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    wide = df.groupBy(*(keys or [])).agg(*aggs)
    return wide.unpivot([F.col(k) for k in keys or []], cols, "feature", "n_null")


def missing_dates(calendar: DataFrame, table: DataFrame) -> DataFrame:
    """Calendar dates absent from a table."""
    return calendar.select("date").join(table.select("date").distinct(), "date", "left_anti")


def first_valid(df: DataFrame, cols: list[str]) -> DataFrame:
    """0-based row position of each column's first known value, per symbol."""
    pos = F.row_number().over(ordered("symbol")) - 1
    numbered = df.withColumn("_pos", pos)
    firsts = numbered.groupBy("symbol").agg(
        *[F.min(F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(c) for c in cols]
    )
    return firsts.unpivot(["symbol"], cols, "feature", "first_pos")


def future_rows(df: DataFrame, split_date: str, cols: list[str], warmup: int = 1) -> DataFrame:
    """Verdict per symbol on a table meant to end at the split date.

    Counts the rows beyond it, and names the columns known earlier than ``warmup`` rows into a history: a feature that
    is known on the first row has looked ahead (or at the row itself).
    """
    beyond = F.col("date") > F.lit(split_date).cast("date")
    numbered = df.withColumn("_pos", F.row_number().over(ordered("symbol")) - 1)
    early = [F.when(F.min(F.when(F.col(c).isNotNull(), F.col("_pos"))) < warmup, F.lit(c)) for c in cols]
    return numbered.groupBy("symbol").agg(
        F.max("date").alias("last_date"),
        F.count_if(beyond).alias("future_rows"),
        F.concat_ws(",", *early).alias("early_columns"),
        (F.count_if(beyond) == 0).alias("ok"),
    )


def target_alignment(targets: DataFrame, cols: list[str]) -> DataFrame:
    """Per symbol and target: the last h rows are unknown and the row before them is known."""
    back = F.row_number().over(ordered("symbol").orderBy(F.col("date").desc()))
    numbered = targets.withColumn("_back", back)
    aggs = []
    for c in cols:
        h = parse_horizon(c)
        tail = F.when(F.col("_back") <= h, F.col(c).isNull())
        edge = F.when(F.col("_back") == h + 1, F.col(c).isNotNull())
        aggs.append((F.bool_and(tail) & F.coalesce(F.bool_and(edge), F.lit(True))).cast("int").alias(c))
    return numbered.groupBy("symbol").agg(*aggs).unpivot(["symbol"], cols, "target", "ok")


def split_report(df: DataFrame) -> DataFrame:
    """Row count and date span of each split with the overlap flag against the next one."""
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    per = df.where("split is not null").groupBy("split").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n")
    )
    spans = per.withColumn("rank", rank)
    following = spans.select((F.col("rank") - 1).alias("rank"), F.col("first_date").alias("_next"))
    return spans.join(following, "rank", "left").select(
        "split", "n", "first_date", "last_date", F.coalesce(F.col("last_date") >= F.col("_next"), F.lit(False)).alias("overlap")
    )


def split_overlap(**tables: DataFrame) -> DataFrame:
    """Dates that two of the given tables share: one row per pair of tables and date."""
    tagged = [df.select("date", F.lit(name).alias("split")).distinct() for name, df in tables.items()]
    per_date = reduce(DataFrame.unionByName, tagged).groupBy("date").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    pairs = F.explode(F.flatten(F.transform("splits", lambda a: F.transform(F.filter("splits", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    return per_date.where(F.size("splits") > 1).select("date", pairs.alias("p")).select(F.col("p.a").alias("left_split"), F.col("p.b").alias("right_split"), "date")


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of each of two runs that the other lacks, all columns compared, repeats counted."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    gap = both.groupBy(*cols).agg(F.sum("_d").alias("_d"), F.count_if(F.col("_d") > 0).alias("_n"))
    return gap.agg(F.sum("_n").alias("n"), F.sum(F.abs("_d")).alias("unmatched")).withColumn("ok", F.col("unmatched") == 0)


def shared_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dates present in both tables."""
    return a.select("date").intersect(b.select("date"))


def target_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "tgt_" in c]


def refuse_targets(df: DataFrame) -> DataFrame:
    """Guard for feature and inference tables: no target column may be present."""
    leaked = target_columns(df)
    if leaked:
        raise ValueError(f"target columns in a feature table: {leaked}")
    return df


def require_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Expected columns in the expected order, or an error naming the missing ones."""
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"missing {len(missing)} expected columns: {missing[:10]}")
    return df.select(*expected)


def causality_violations(log: DataFrame) -> DataFrame:
    """Log rows whose feedback does not come after the prediction (unknown dates pass)."""
    return log.where(F.col("feedback_date") <= F.col("prediction_date"))


def bad_weights(df: DataFrame, cols: list[str], floor: float, tol: float = 1e-10) -> DataFrame:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return df.where((F.abs(total - 1.0) > tol) | (F.least(*[F.col(c) for c in cols]) < floor - tol))


def join_loss(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Dates an inner join of each of ``right``'s series with ``left`` would drop, counted per side."""
    a = left.select("date").distinct()
    keys = right.select(key).distinct()
    b = right.select(key, "date").distinct().withColumn("_r", F.lit(1))
    # One row per calendar date and series: both are few whatever the size of the panel.
    wanted = a.join(keys).withColumn("_l", F.lit(1))
    both = wanted.join(b, [key, "date"], "full_outer")
    return both.groupBy(key).agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("kept"),
    )


def returns_convention(prices: DataFrame, returns: DataFrame, col: str, tol: float = 1e-10) -> DataFrame:
    """Classify a return series as backward or forward stamped, per symbol."""
    w = ordered("symbol")
    p = prices.select(
        "symbol",
        "date",
        F.log(F.try_divide(F.col("close"), F.lag("close").over(w))).alias("_b"),
        F.log(F.try_divide(F.lead("close").over(w), F.col("close"))).alias("_f"),
    )
    gaps = (
        returns.select("symbol", "date", F.col(col).alias("_x"))
        .where("_x is not null")
        .join(p, ["symbol", "date"])
        .groupBy("symbol")
        .agg(F.max(F.abs(F.col("_x") - F.col("_b"))).alias("gap_backward"), F.max(F.abs(F.col("_x") - F.col("_f"))).alias("gap_forward"))
    )
    kind = F.when(F.col("gap_backward") < tol, "backward").when(F.col("gap_forward") < tol, "forward").otherwise("unknown")
    return gaps.withColumn("convention", kind)


def audit_counts(audit: DataFrame, signals: DataFrame) -> DataFrame:
    """Audit rows per run against signal dates, with duplicated (symbol, date) keys counted."""
    per_key = audit.groupBy("run_id", "symbol", "date").agg(F.count(F.lit(1)).alias("k"))
    per_run = per_key.groupBy("run_id").agg(F.sum("k").alias("audit_rows"), F.count_if(F.col("k") > 1).alias("duplicates"))
    expected = signals.agg(F.count(F.lit(1))).scalar()
    return per_run.withColumn("signal_rows", expected).withColumn(
        "ok", (F.col("audit_rows") == F.col("signal_rows")) & (F.col("duplicates") == 0)
    )


def run_difference(a: DataFrame, b: DataFrame, col: str, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Largest difference of a column between two runs and the rows only one of them has."""
    x = a.select(*keys, F.col(col).alias("_a"), F.lit(1).alias("_ina"))
    y = b.select(*keys, F.col(col).alias("_b"), F.lit(1).alias("_inb"))
    j = x.join(y, list(keys), "full_outer")
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_ina").isNull() | F.col("_inb").isNull()).alias("unmatched"),
        F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("max_diff"),
    )
