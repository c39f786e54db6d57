"""Scans: bars, macro observations and ticks, plus the mapping of the driver's tables onto them."""

from __future__ import annotations

from functools import reduce

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
MACRO_OBS = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("obs_date", T.DateType()),
        T.StructField("value", T.DoubleType()),
    ]
)
# Order priority standing in for each macro series.
PRIORITY_SERIES = {
    "1-URGENT": "DFF",
    "2-HIGH": "GS10",
    "3-MEDIUM": "CPIAUCSL",
    "4-NOT SPECIFIED": "T10Y2Y",
    "5-LOW": "VIXCLS",
}
SERIES = tuple(PRIORITY_SERIES.values())
MONTHLY_SERIES = "CPIAUCSL"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_range(df: DataFrame, col: str, start: str | date | None, end: str | date | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(col) >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(str(end)).cast("date"))
    return df


def scan_bars(
    spark: SparkSession,
    path: str,
    symbols: list[str] | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Stored bars; symbol prunes folders, the date range prunes row groups."""
    reader = spark.read.schema(BARS).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = _in_range(reader.load(path), "date", start, end)
    return df.where(F.col("symbol").isin(symbols)) if symbols else df


def scan_macro(
    spark: SparkSession,
    path: str,
    series: list[str] | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    reader = spark.read.schema(MACRO_OBS).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = _in_range(reader.load(path), "obs_date", start, end)
    return df.where(F.col("series_id").isin(series)) if series else df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail the caller when a requested symbol, series or range holds nothing."""
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def resample_bars(ticks: DataFrame, order: list[str]) -> DataFrame:
    """Ticks (symbol, date, price, qty) to one OHLCV bar per symbol and date.

    First and last price are ``min_by``/``max_by`` on the tick order: everything
    is combined map-side, so a symbol holding a third of all ticks still sends
    one row per date and task into the shuffle. With a single numeric or time
    order column the aggregation hashes; several columns are compared as a struct,
    which makes Spark sort each task's rows first.
    """
    at: Column = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"),
    )


def line_ordinal() -> Column:
    """Total order of line items as one number: order key, line number, part, supplier.

    Two packed longs (order key up to 2^40, line number 2^3, part 2^35, supplier
    2^30) make one decimal, which a hash aggregation can keep as its order value.
    A key beyond its bits is an error, as it would wrap into another one's place.
    """
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    high = F.shiftleft(line, 20) + F.shiftright("l_partkey", 15)
    low = F.shiftleft(F.col("l_partkey").bitwiseAND(F.lit(32767)), 30) + F.col("l_suppkey")
    packed = high.cast("decimal(19,0)") * F.lit(1 << 45).cast("decimal(14,0)") + low.cast("decimal(14,0)")
    bits = {"l_orderkey": 40, "l_linenumber": 3, "l_partkey": 35, "l_suppkey": 30}
    fits = reduce(Column.__and__, [(F.col(c) >= 0) & (F.col(c) < F.lit(1 << n)) for c, n in bits.items()])
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("line item keys beyond the bits of the order value")))


def lineitem_ticks(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        F.col(symbol).cast("string").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        line_ordinal().alias("seq"),
    )


def lineitem_bars(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    return resample_bars(lineitem_ticks(spark, sf_dir, symbol), ["seq"])


def lineitem_dates(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    """(symbol, date) of the bars, from two columns of the ticks."""
    return lineitem_ticks(spark, sf_dir, symbol).select("symbol", "date").distinct()


def order_macro(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """Macro observations (series_id, obs_date, value) from ``orders``.

    A mean of doubles hangs in its last bits on the order in which a shuffle delivers partial sums. With ``exact`` prices
    are summed as decimals (8 places), so that every run gives the same bits.
    """
    series = F.create_map(*[F.lit(x) for kv in PRIORITY_SERIES.items() for x in kv])
    day = F.col("o_orderdate").cast("date")
    obs = read_table(spark, sf_dir, "orders").select(
        series[F.col("o_orderpriority")].alias("series_id"), day.alias("day"), "o_totalprice"
    )
    obs = obs.withColumn(
        "obs_date", F.when(F.col("series_id") == MONTHLY_SERIES, F.trunc("day", "month")).otherwise(F.col("day"))
    )
    total = F.sum(F.col("o_totalprice").cast("decimal(28,8)")).cast("double")
    mean = F.try_divide(total, F.count("o_totalprice")) if exact else F.avg("o_totalprice")
    return obs.groupBy("series_id", "obs_date").agg((mean / 10000).alias("value"))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(*tick_columns())


def tick_columns() -> list[Column]:
    return [
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("qty"),
        F.col("event_id"),
    ]
