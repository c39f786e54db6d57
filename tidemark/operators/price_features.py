"""Lag-safe price features: every value at date t uses bars before t only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.windows import ANNUAL_DAYS, UNBOUNDED, ordered, rolling
from tidemark.operators.blocks import BLOCK_ROWS

# Window lengths of the feature set.
VOL_WINDOWS = (21, 63)
MOM_WINDOWS = (21, 63, 126)
RSI_WINDOW, BB_WINDOW, ATR_WINDOW = 14, 20, 14
PRICE_FEATURES = (
    "logret",
    *[f"vol_{n}d" for n in VOL_WINDOWS],
    *[f"mom_{n}d" for n in MOM_WINDOWS],
    "rsi_14",
    "bb_width",
    "atr_14",
)
MAX_LOOKBACK_ROWS = 128


def log_return(w: WindowSpec, close: str = "close") -> Column:
    """Same-day backward log return (not lagged)."""
    return F.log(F.col(close)) - F.log(F.lag(close).over(w))


def true_range(w: WindowSpec) -> Column:
    """``greatest`` skips the unknown previous close of a first bar, leaving high - low."""
    prev = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def with_lags(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Shared inputs of the feature columns: the lagged close and lagged return."""
    return (
        df.withColumn("_c1", F.lag("close").over(w))
        .withColumn("_c2", F.lag("close", 2).over(w))
        .withColumn("logret", F.log("_c1") - F.log("_c2"))
        .withColumn("_seen", F.count("logret").over(w.rowsBetween(UNBOUNDED, 0)))
    )


def vol_cols(w: WindowSpec) -> dict[str, Column]:
    return {
        f"vol_{n}d": rolling(F.stddev_samp, F.col("logret"), n, w) * F.sqrt(F.lit(float(ANNUAL_DAYS)))
        for n in VOL_WINDOWS
    }


def mom_cols(w: WindowSpec) -> dict[str, Column]:
    """Sum of n lagged log returns: the sum telescopes to two closes, so no frame is scanned.

    A running count of known returns (one pass) keeps the rule that all n must be known.
    """
    out = {}
    for n in MOM_WINDOWS:
        known = F.col("_seen") - F.coalesce(F.lag("_seen", n).over(w), F.lit(0))
        out[f"mom_{n}d"] = F.when(known == n, F.log("_c1") - F.log(F.lag("close", n + 1).over(w)))
    return out


def bb_cols(w: WindowSpec) -> dict[str, Column]:
    sd = rolling(F.stddev_samp, F.col("_c1"), BB_WINDOW, w)
    mean = rolling(F.avg, F.col("_c1"), BB_WINDOW, w)
    return {"bb_width": F.try_divide(F.lit(4.0) * sd, mean)}


def with_atr(df: DataFrame, w: WindowSpec) -> DataFrame:
    return (
        df.withColumn("_tr", true_range(w))
        .withColumn("_atr", rolling(F.avg, F.col("_tr"), ATR_WINDOW, w))
        .withColumn("atr_14", F.lag("_atr").over(w))
        .drop("_tr", "_atr")
    )


def add_rsi(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "date", n: int = RSI_WINDOW, rows: int = BLOCK_ROWS) -> DataFrame:
    """Wilder RSI of the lagged close, appended as ``rsi_n``.

    The smoothing y_t = r y_(t-1) + (1 - r) x_t is linear: inside a block of ``rows`` rows it is a scaled running sum
    plus the value carried in, and the few block ends of a history are chained. A row with an unknown move keeps the
    value before it. All windows sit on the partitioning by ``keys``.
    """
    r = (n - 1) / n
    w = ordered(*keys, order=order)
    upto = w.rowsBetween(UNBOUNDED, 0)
    df = df.withColumn("_move", F.lag("close", 1).over(w) - F.lag("close", 2).over(w))
    df = df.withColumn("_block", F.floor((F.row_number().over(w) - 1) / rows))
    known = F.col("_move").isNotNull()
    df = df.withColumns({"_up": F.when(known, F.greatest("_move", F.lit(0.0))), "_down": F.when(known, -F.least("_move", F.lit(0.0)))})
    wb = ordered(*keys, "_block", order=order)
    inside = wb.rowsBetween(UNBOUNDED, 0)
    df = df.withColumn("_k", F.count("_move").over(inside))
    grow, fade = F.pow(F.lit(r), -F.col("_k")), F.pow(F.lit(r), F.col("_k"))
    df = df.withColumns({f"{c}_sum": F.coalesce(F.sum(F.lit(1 - r) * F.col(c) * grow).over(inside), F.lit(0.0)) * fade for c in ("_up", "_down")})
    last = F.lead("_block").over(w) != F.col("_block")
    df = df.withColumn("_end", F.when(last, F.struct("_k", "_up_sum", "_down_sum")))
    df = df.withColumns(
        {
            "_ends": F.collect_list("_end").over(w.rowsBetween(UNBOUNDED, -1)),
            "_seen_moves": F.count("_move").over(upto),
            "_up_first": F.first("_up", ignorenulls=True).over(upto),  # the first move seeds the recursion
            "_down_first": F.first("_down", ignorenulls=True).over(upto),
        }
    )

    def smoothed(c: str) -> Column:
        carry = F.aggregate("_ends", F.col(f"{c}_first"), lambda y, e: F.pow(F.lit(r), e["_k"]) * y + e[f"{c}_sum"])
        return fade * carry + F.col(f"{c}_sum")

    df = df.withColumns({c: smoothed(c) for c in ("_up", "_down")})
    up, down = F.col("_up"), F.col("_down")
    rsi = F.when(down > 0, 100 - 100 / (1 + F.try_divide(up, down))).when((up == 0) & (down == 0), 50.0)
    df = df.withColumn(f"rsi_{n}", F.when(F.col("_seen_moves") >= n, rsi))
    return df.drop("_move", "_block", "_k", "_up", "_down", "_up_sum", "_down_sum", "_end", "_ends", "_seen_moves", "_up_first", "_down_first")


def price_features(
    bars: DataFrame,
    rsi: bool = True,
    keys: tuple[str, ...] = ("symbol",),
    order: str = "date",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The nine features of every symbol.

    ``bars`` may carry a ``shared`` flag: then all features but the ATR follow the
    shared calendar and rows outside it keep only their ATR. The windows of both
    calendars, the RSI's among them, all sit on one hash partitioning by symbol.
    """
    flagged = "shared" in bars.columns
    own = ordered(*keys, order=order)
    w = ordered(*keys, "shared", order=order) if flagged else own
    df = with_lags(with_atr(bars, own), w)
    df = df.withColumns({**vol_cols(w), **mom_cols(w), **bb_cols(w)})
    if rsi:
        df = add_rsi(df, (*keys, "shared") if flagged else keys, order)
    lagged = [c for c in PRICE_FEATURES if c != "atr_14" and (rsi or c != "rsi_14")]
    if flagged:
        df = df.withColumns({c: F.when(F.col("shared"), F.col(c)) for c in lagged})
    return df.select("symbol", order, *carry, *[c for c in PRICE_FEATURES if rsi or c != "rsi_14"])


def wide_features(features: DataFrame, cols: tuple[str, ...] = PRICE_FEATURES) -> DataFrame:
    """One row per date with a column ``symbol_feature`` for every symbol and feature.

    The symbols are listed once (a wide table has a column for each, so they are few by nature).
    """
    symbols = [r.symbol for r in features.select("symbol").distinct().orderBy("symbol").collect()]
    return features.groupBy("date").pivot("symbol", symbols).agg(*[F.max(c).alias(c) for c in cols])


def lookback_filter(bars: DataFrame, since: str, rows: int = MAX_LOOKBACK_ROWS) -> DataFrame:
    """Bars needed to compute features from ``since`` on: those plus ``rows`` earlier ones per symbol.

    A date filter cannot pass below a window, so incremental jobs trim here first.
    """
    w = ordered("symbol").orderBy(F.col("date").desc())
    old = F.col("date") < F.lit(since).cast("date")
    older = F.sum(old.cast("int")).over(w.rowsBetween(UNBOUNDED, 0))
    return bars.withColumn("_older", older).where(F.col("_older") <= rows).drop("_older")
