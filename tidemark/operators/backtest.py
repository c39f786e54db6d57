"""Signals to PnL to performance, always with a one-row lag between signal and return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import MODELS, direction_signals, equal_signal, weighted_signal
from tidemark.functions.windows import ANNUAL_DAYS, UNBOUNDED, ordered
from tidemark.operators.meta import WeightModel, live_features, with_weights

# Gate on the relative Sharpe gain, in percent.
LIFT_GATE = 5.0
STRATEGIES = ("B1_ret_only", "B2_naive_eq", "B3_signed_eq", "B4_buy_hold")
WEIGHTS = tuple(f"w_{m}" for m in MODELS)


def with_pnl(df: DataFrame, signal: str = "signal", ret: str = "ret_bwd", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``pnl_mag`` = previous signal times today's return; ``pnl_dir`` uses the signal's sign."""
    prev = F.lag(signal).over(ordered(*keys))
    return df.withColumns({"pnl_mag": prev * F.col(ret), "pnl_dir": F.signum(prev) * F.col(ret)})


def sharpe(pnl: Column, ddof: int = 1) -> Column:
    """Annualised mean over deviation; NULL for fewer than two values or no spread."""
    sd = F.stddev_samp(pnl) if ddof else F.stddev_pop(pnl)
    return F.when((F.count(pnl) >= 2) & (sd > 0), F.avg(pnl) / sd * F.sqrt(F.lit(float(ANNUAL_DAYS))))


def with_drawdown(df: DataFrame, pnl: str, keys: tuple[str, ...]) -> DataFrame:
    """Adds ``_dd``: cumulative PnL minus its running peak (unknown days count as 0)."""
    w = ordered(*keys).rowsBetween(UNBOUNDED, 0)
    df = df.withColumn("_cum", F.sum(F.coalesce(pnl, F.lit(0.0))).over(w))
    return df.withColumn("_dd", F.col("_cum") - F.max("_cum").over(w)).drop("_cum")


def performance(df: DataFrame, pnl: str, keys: tuple[str, ...] = ("symbol",), ddof: int = 1) -> DataFrame:
    """Sharpe, annual return and volatility, hit rate, drawdown and days per key."""
    x = F.col(pnl)
    return with_drawdown(df, pnl, keys).groupBy(*keys).agg(
        sharpe(x, ddof).alias("sharpe"),
        (F.avg(x) * ANNUAL_DAYS).alias("ann_ret"),
        (F.stddev_samp(x) * F.sqrt(F.lit(float(ANNUAL_DAYS)))).alias("ann_vol"),
        F.avg((x > 0).cast("double")).alias("hit_rate"),
        F.min("_dd").alias("max_dd"),
        F.count(x).alias("n_days"),
    )


def lift(meta: Column, base: Column) -> Column:
    return F.when(base != 0, (meta - base) / F.abs(base) * 100)


def lift_verdict(pct: Column) -> Column:
    return F.when(pct >= LIFT_GATE, "PASS").when(pct > 0, "MARGINAL").otherwise("FAIL")


def baseline_signals(preds: DataFrame) -> DataFrame:
    """Four reference strategies as columns; unknown predictions count as 0."""
    z = {c: F.coalesce(c, F.lit(0.0)) for c in ("return_pred", "vol_pred", "regime_pred", "drawdown_risk_prob")}
    r, v, g, d = z.values()
    return preds.withColumns(
        {
            "B1_ret_only": F.lit(0.25) * r,
            "B2_naive_eq": F.lit(0.25) * (r + v + g + d),
            "B3_signed_eq": F.lit(0.25) * (r - v - g - d),
            "B4_buy_hold": F.lit(1.0),
        }
    )


def strategies_long(df: DataFrame, names: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """(symbol, date, ret_bwd, strategy, signal) from one column per strategy."""
    return df.select("symbol", "date", "ret_bwd", *names).unpivot(["symbol", "date", "ret_bwd"], list(names), "strategy", "signal")


def strategy_table(df: DataFrame, names: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Directional and magnitude performance of each strategy and symbol."""
    keys = ("symbol", "strategy")
    pnl = with_pnl(strategies_long(df, names), keys=keys)
    return with_drawdown(pnl, "pnl_dir", keys).groupBy(*keys).agg(
        sharpe(F.col("pnl_dir")).alias("dir_sharpe"),
        sharpe(F.col("pnl_mag")).alias("mag_sharpe"),
        (F.avg("pnl_dir") * ANNUAL_DAYS).alias("ann_ret"),
        (F.stddev_samp("pnl_dir") * F.sqrt(F.lit(float(ANNUAL_DAYS)))).alias("ann_vol"),
        F.avg((F.col("pnl_dir") > 0).cast("double")).alias("hit_rate"),
        F.min("_dd").alias("max_dd"),
    )


def strategy_lift(table: DataFrame, candidate: str) -> DataFrame:
    """Relative directional Sharpe of one strategy against every other one of its symbol."""
    mine = F.max(F.when(F.col("strategy") == candidate, F.col("dir_sharpe"))).over(Window.partitionBy("symbol"))
    pct = lift(F.col("_mine"), F.col("dir_sharpe"))
    return (
        table.withColumn("_mine", mine)
        .where(F.col("strategy") != candidate)
        .select("symbol", F.col("strategy").alias("baseline"), pct.alias("lift_pct"), F.coalesce(pct >= LIFT_GATE, F.lit(False)).alias("passes"))
    )


def evaluate_lift(df: DataFrame) -> DataFrame:
    """Meta-weighted against equal-weight signal: magnitude Sharpe of both, and the lift.

    ``df`` holds signals' inputs, the four weight columns and ``ret_bwd``.
    """
    d = direction_signals()
    df = df.withColumns({"meta": weighted_signal({m: F.col(f"w_{m}") for m in MODELS}, d), "equal": equal_signal(d)})
    w = ordered("symbol")
    df = df.withColumns({"_m": F.lag("meta").over(w) * F.col("ret_bwd"), "_e": F.lag("equal").over(w) * F.col("ret_bwd")})
    out = df.groupBy("symbol").agg(
        sharpe(F.col("_m")).alias("meta_sharpe"), sharpe(F.col("_e")).alias("equal_sharpe"), F.count("_m").alias("n_days"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    pct = lift(F.col("meta_sharpe"), F.col("equal_sharpe"))
    return out.withColumn("lift_pct", pct).withColumn("verdict", lift_verdict(F.col("lift_pct")))


def weights_in_force(meta_weights: DataFrame) -> DataFrame:
    """Weights used on each row: the last complete set strictly before it, equal weights until one exists."""
    before = ordered("symbol").rowsBetween(UNBOUNDED, -1)
    return meta_weights.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(0.25)) for c in WEIGHTS}
    )


def backtest(run: DataFrame, model: WeightModel) -> DataFrame:
    """Whole-history replay of the online loop, all symbols at once.

    ``run`` holds the rows of the backtest window: predictions (normalised),
    ``regime_label``, ``disagreement`` and ``ret_bwd``. Everything is a window
    over (symbol, date): one shuffle, no loop over dates.
    """
    df = weights_in_force(with_weights(live_features(run), model))
    signal = weighted_signal({m: F.col(f"w_{m}") for m in MODELS}, direction_signals())
    return with_pnl(df.withColumn("signal", signal))


def performance_log(bt: DataFrame) -> DataFrame:
    """One row per feedback day: what was predicted the row before, what it earned, with which weights."""
    w = ordered("symbol")
    prev = {c: F.coalesce(F.lag(c).over(w), F.lit(0.25)) for c in WEIGHTS}
    return bt.select(
        "symbol",
        F.lag("date").over(w).alias("prediction_date"),
        F.col("date").alias("feedback_date"),
        F.lag("signal").over(w).alias("signal"),
        F.col("ret_bwd").alias("actual_return"),
        F.col("pnl_mag").alias("pnl"),
        *[c.alias(name) for name, c in prev.items()],
    ).where("actual_return is not null").select(
        "symbol", "prediction_date", "feedback_date", "signal", "actual_return", "pnl", F.struct(*WEIGHTS).alias("weights")
    )


def performance_summary(log: DataFrame) -> DataFrame:
    """Sharpe (population deviation), drawdown and days of a performance log."""
    rows = log.where("pnl is not null").withColumnRenamed("feedback_date", "date")
    sd = F.stddev_pop("pnl")
    return with_drawdown(rows, "pnl", ("symbol",)).groupBy("symbol").agg(
        F.when(sd > 0, F.avg("pnl") / sd * F.sqrt(F.lit(float(ANNUAL_DAYS)))).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"),
        F.count("pnl").alias("n_days"),
    )


def weight_trajectory(log: DataFrame) -> DataFrame:
    return log.where("pnl is not null").select("symbol", F.col("feedback_date").alias("date"), "weights.*")


def weight_dispersion(weights: DataFrame, frozen_below: float = 1e-4) -> DataFrame:
    """Spread of each weight over time per symbol, and whether it is frozen."""
    wide = weights.groupBy("symbol").agg(*[F.stddev_samp(c).alias(c) for c in WEIGHTS])
    return wide.unpivot(["symbol"], list(WEIGHTS), "weight", "sd").withColumn("frozen", F.col("sd") < frozen_below)
