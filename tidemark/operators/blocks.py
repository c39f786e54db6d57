"""Row-position windows over histories too long for one task.

A daily panel bounds a symbol's partition by the calendar. An intraday panel does
not: one busy symbol may hold a third of all rows. Here every history is cut into
blocks of consecutive rows, and each block borrows the few rows before (and after)
it that its windows reach. Windows keyed by (symbol, block) then give exactly the
results of windows keyed by symbol, with tasks of bounded size.

Row positions need no global sort: counts per (symbol, coarse slice) are summed
into slice offsets, and rows are numbered inside slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import UNBOUNDED, ordered

BLOCK = ("symbol", "block")
BLOCK_ROWS = 4096
DOUBLE_UNDERFLOW = 746.0  # exp(-746) is zero in double precision


def number_rows(df: DataFrame, order: str, coarse: str) -> DataFrame:
    """Adds ``pos``, the 0-based position of a row in its symbol's history.

    ``coarse`` is a column that never decreases along ``order`` (the day of a
    timestamp) and keeps a (symbol, coarse) group small.
    """
    counts = df.groupBy("symbol", coarse).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(ordered("symbol", order=coarse).rowsBetween(UNBOUNDED, -1))
    offsets = counts.select("symbol", coarse, F.coalesce(before, F.lit(0)).alias("_offset"))
    place = F.row_number().over(ordered("symbol", coarse, order=order)) - 1
    return df.join(offsets, ["symbol", coarse]).withColumn("pos", F.col("_offset") + place).drop("_offset")


def cut_blocks(df: DataFrame, order: str, coarse: str, back: int, ahead: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``block`` and ``own``: each row once in its own block, and again in a neighbour that reaches it."""
    if max(back, ahead) > rows:
        raise ValueError(f"windows reach {max(back, ahead)} rows, more than a block of {rows}")
    home, place = F.floor(F.col("pos") / rows), F.col("pos") % rows
    homes = F.array_compact(
        F.array(home, F.when(place >= rows - back, home + 1), F.when((place < ahead) & (home > 0), home - 1))
    )
    numbered = number_rows(df, order, coarse)
    return numbered.withColumn("block", F.explode(homes)).withColumn("own", F.col("block") == home)


def over_blocks(
    df: DataFrame,
    windows: Callable[..., DataFrame],
    order: str,
    coarse: str,
    back: int,
    ahead: int = 0,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply a panel operator (taking ``keys``, ``order`` and ``carry``) block by block."""
    out = windows(cut_blocks(df, order, coarse, back, ahead, rows), keys=BLOCK, order=order, carry=("own",))
    return out.where("own").drop("own")


def rsi_over_blocks(df: DataFrame, order: str, coarse: str, n: int = 14, rows: int = BLOCK_ROWS) -> DataFrame:
    """Wilder RSI of the lagged close for histories of any length.

    The smoothing y_t = r y_(t-1) + (1 - r) x_t is linear, so a block needs only
    the value carried into it: y_t = r^k carry + local_t, with the local part a
    running sum. Block ends are chained over the few blocks before it.
    """
    if not 3 <= rows <= BLOCK_ROWS:
        raise ValueError(f"blocks of {rows} rows: larger ones overflow the running sum's scale, smaller ones hold no move")
    r = (n - 1) / n
    w = ordered(*BLOCK, order=order)
    cut = cut_blocks(df.select("symbol", order, coarse, "close"), order, coarse, back=2, rows=rows)
    move = F.lag("close", 1).over(w) - F.lag("close", 2).over(w)
    own = cut.withColumn("_move", move).where("own")
    k = F.count("_move").over(w.rowsBetween(UNBOUNDED, 0))
    own = own.withColumns({"_k": k, "_up": F.greatest("_move", F.lit(0.0)), "_down": -F.least("_move", F.lit(0.0))})
    own = own.withColumns({c: F.when(F.col("_move").isNotNull(), F.col(c)) for c in ("_up", "_down")})
    grow, fade = F.pow(F.lit(r), -F.col("_k")), F.pow(F.lit(r), F.col("_k"))
    local = {
        f"{c}_local": F.coalesce(F.sum(F.lit(1 - r) * F.col(c) * grow).over(w.rowsBetween(UNBOUNDED, 0)), F.lit(0.0)) * fade
        for c in ("_up", "_down")
    }
    own = own.withColumns(local)
    ends = own.groupBy(*BLOCK).agg(
        F.max("_k").alias("k"),
        *[F.max_by(f"{c}_local", "pos").alias(f"{c}_end") for c in ("_up", "_down")],
        *[F.min_by(c, F.when(F.col("_move").isNotNull(), F.col("pos"))).alias(f"{c}_first") for c in ("_up", "_down")],
    )
    # The first move seeds the recursion; every block end then decays by r per move.
    moved_before = F.sum("k").over(ordered("symbol", order="block").rowsBetween(UNBOUNDED, -1))
    ends = ends.withColumn("_first_moved", F.coalesce(moved_before, F.lit(0)) == 0)
    first_moved = F.col("_first_moved")
    ends = ends.withColumns(
        {f"{c}_end": F.when(first_moved & (F.col("k") > 0), F.pow(F.lit(r), F.col("k")) * F.col(f"{c}_first")).otherwise(0.0) + F.col(f"{c}_end") for c in ("_up", "_down")}
    )
    # Ends more moves back than this have decayed below the smallest double: dropping them changes nothing. Blocks
    # without a move pass on what they got, so the chain reaches back by moves, and holds blocks with moves only.
    before = F.sum("k").over(ordered("symbol", order="block").rowsBetween(UNBOUNDED, -1))
    ends = ends.withColumn("_start", F.coalesce(before, F.lit(0)))
    moves = math.ceil(DOUBLE_UNDERFLOW / -math.log(r)) + rows
    near = ordered("symbol", order="_start").rangeBetween(-moves, 0)
    chain = F.collect_list(F.when(F.col("k") > 0, F.struct("block", "k", "_up_end", "_down_end"))).over(near)
    ends = ends.withColumn("_chain", F.array_sort(F.filter(chain, lambda e: e["block"] < F.col("block"))))
    for c in ("_up", "_down"):
        carried = F.aggregate("_chain", F.lit(0.0), lambda y, e: F.pow(F.lit(r), e["k"]) * y + e[f"{c}_end"])
        # The first move may come in a later block: it seeds the recursion there.
        own_first = first_moved & F.col(f"{c}_first").isNotNull()
        ends = ends.withColumn(f"{c}_carry", F.when(own_first, F.col(f"{c}_first")).otherwise(carried))
    out = own.join(ends.select(*BLOCK, "_up_carry", "_down_carry"), list(BLOCK))
    up, down = (fade * F.col(f"{c}_carry") + F.col(f"{c}_local") for c in ("_up", "_down"))
    rsi = F.when(down > 0, 100 - 100 / (1 + F.try_divide(up, down))).when((up == 0) & (down == 0), 50.0)
    return out.select("symbol", order, F.when(F.col("pos") > n, rsi).alias(f"rsi_{n}"))
