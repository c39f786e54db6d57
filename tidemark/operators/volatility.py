"""Volatility predictors: realised volatility and an expanding-window GARCH(1,1)."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import next_bday
from tidemark.functions.windows import ANNUAL_DAYS, ordered, rolling

SCALE = 100.0
MIN_OBS = 60
# Parameter grid of the likelihood search: persistence, its share in the shock
# term, and the long-run variance relative to the sample variance at the start.
PERSISTENCE = (0.0, 0.3, 0.6, 0.8, 0.9, 0.94, 0.97, 0.985, 0.995)
SHOCK_SHARE = (0.02, 0.05, 0.1, 0.15, 0.25, 0.4, 0.7, 1.0)
LONG_RUN = (0.4, 0.6, 0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 2.0)


def realized_vol(returns: DataFrame, ret: str = "ret_bwd", n: int = 21) -> DataFrame:
    """Annualised deviation of the last ``n`` returns before each date."""
    w = ordered("symbol")
    lagged = returns.withColumn("_lag", F.lag(ret).over(w))
    vol = rolling(F.stddev_samp, F.col("_lag"), n, w) * F.sqrt(F.lit(float(ANNUAL_DAYS)))
    return lagged.withColumn("realized_vol_21d", vol).drop("_lag")


def grid() -> np.ndarray:
    """Rows (omega factor, alpha, beta) over the grid."""
    out = []
    for p, share, v in itertools.product(PERSISTENCE, SHOCK_SHARE, LONG_RUN):
        if p == 0.0 and share != SHOCK_SHARE[0]:
            continue
        out.append((v * (1 - p), p * share, p * (1 - share)))
    return np.array(out)


def expanding_garch(returns: np.ndarray, warm: int = MIN_OBS) -> np.ndarray:
    """One-day-ahead annualised volatility for every row, each from the rows before it.

    For fixed parameters the log likelihood of a window [0, t) is a running sum,
    so refitting on every date means keeping one sum per grid point and taking
    the best one: a single pass over the history gives all expanding fits.
    """
    e = SCALE * np.asarray(returns, dtype=float)
    out = np.full(len(e), np.nan)
    if len(e) <= warm:
        return out
    base = e[:warm] - e[:warm].mean()
    anchor = float((base**2).mean())
    if anchor <= 0:
        return out
    params = grid()
    omega, alpha, beta = params[:, 0] * anchor, params[:, 1], params[:, 2]
    var = np.full(len(params), anchor)
    loglik = np.zeros(len(params))
    total = 0.0
    for t, x in enumerate(e):
        if t >= warm:
            out[t] = var[loglik.argmax()]
        mean = total / t if t else 0.0
        shock = (x - mean) ** 2
        loglik -= 0.5 * (np.log(var) + shock / var)
        var = omega + alpha * shock + beta * var
        total += x
    return np.sqrt(out) / SCALE * np.sqrt(ANNUAL_DAYS)


def garch_walk(returns: DataFrame, train_end: str, ret: str = "ret_bwd") -> DataFrame:
    """Walk-forward forecast for every date after the train period.

    Each forecast uses returns strictly before its date. With fewer than 60 of
    them, or no usable fit, the realised volatility of the last 21 (or all, when
    fewer) returns stands in.
    """
    schema = "symbol string, date date, garch_vol_1d_ann double, fitted boolean"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[ret].notna()].sort_values("date")
        r = pdf[ret]
        vol = expanding_garch(r.to_numpy())
        ok = np.isfinite(vol)
        spread = r.rolling(21).std().shift(1)
        short = r.expanding(2).std().shift(1)
        fallback = spread.fillna(short) * np.sqrt(ANNUAL_DAYS)
        return pd.DataFrame(
            {"symbol": pdf["symbol"], "date": pdf["date"], "garch_vol_1d_ann": np.where(ok, vol, fallback), "fitted": ok}
        )

    out = returns.select("symbol", "date", ret).groupBy("symbol").applyInPandas(walk, schema)
    out = out.where(F.col("date") >= F.lit(str(next_bday(train_end))).cast("date"))
    return out.withColumn("garch_vol_1d_ann", F.when(~F.isnan("garch_vol_1d_ann"), F.col("garch_vol_1d_ann")))


HORIZONS = (1, 2, 3, 4, 5)


def garch_horizons(returns: DataFrame, train_end: str, ret: str = "ret_bwd", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(symbol, date, h, vol, fitted): the walk-forward forecast of each date for the h-th day ahead of its information, annualised.

    One ordered array of returns per symbol (bounded by the calendar) is folded in the JVM; the state holds the variance and the
    running likelihood of every grid point. A variance returns to its long-run level by its persistence per day. Without a
    fit the realised volatility of ``garch_walk`` stands in for all horizons.
    """
    w = ordered("symbol")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = returns.where(F.col(ret).isNotNull()).select("symbol", "date", F.col(ret).alias("_r"), (F.col(ret) * SCALE).alias("_e"))
    short = F.stddev_samp("_r").over(past)
    recent = F.when(F.count("_r").over(w.rowsBetween(-21, -1)) == 21, F.stddev_samp("_r").over(w.rowsBetween(-21, -1)))
    rows = rows.withColumns({"_t": F.row_number().over(w) - 1, "_plain": F.coalesce(recent, short) * F.sqrt(F.lit(float(ANNUAL_DAYS)))})
    seen = rows.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("date", "_e", "_plain"))).alias("path"), F.var_pop(F.when(F.col("_t") < MIN_OBS, F.col("_e"))).alias("anchor")
    )
    usable = (F.size("path") > MIN_OBS) & (F.col("anchor") > 0)
    params = grid()
    omega, alpha, beta = (F.array(*[F.lit(float(x)) for x in params[:, i]]) for i in range(3))
    found = F.struct(F.lit(None).cast("double").alias("v"), F.lit(None).cast("int").alias("at"))
    fresh = F.struct(
        F.lit(0).alias("t"), F.lit(0.0).alias("total"), F.transform(omega, lambda _: F.col("anchor")).alias("v"), F.transform(omega, lambda _: F.lit(0.0)).alias("ll"), F.array(found).alias("out")
    )

    def step(s: Column, o: Column) -> Column:
        shock = F.pow(o["_e"] - F.when(s["t"] > 0, s["total"] / s["t"]).otherwise(0.0), 2)
        best = F.array_position(s["ll"], F.array_max(s["ll"])).cast("int")

        def move(q: Column) -> Column:
            ll = F.zip_with(s["ll"], s["v"], lambda a, b: a - 0.5 * (F.log(b) + q["shock"] / b))
            v = F.transform(s["v"], lambda x, i: F.get(omega, i) * F.col("anchor") + F.get(alpha, i) * q["shock"] + F.get(beta, i) * x)
            known = F.when(s["t"] >= MIN_OBS, F.struct(F.get(s["v"], q["best"] - 1).alias("v"), q["best"].alias("at"))).otherwise(found)
            return F.struct((s["t"] + 1).alias("t"), (s["total"] + o["_e"]).alias("total"), v.alias("v"), ll.alias("ll"), F.concat(s["out"], F.array(known)).alias("out"))

        return F.get(F.transform(F.array(F.struct(shock.alias("shock"), best.alias("best"))), move), 0)

    folded = F.aggregate("path", fresh, step, lambda s: F.slice(s["out"], F.lit(2), F.size("path")))
    blank = F.transform("path", lambda _: found)
    days = seen.withColumn("out", F.when(usable, folded).otherwise(blank))
    days = days.select("symbol", "anchor", F.explode(F.arrays_zip("path", "out")).alias("z")).select("symbol", "anchor", "z.path.*", "z.out.*")
    days = days.where(F.col("date") >= F.lit(str(next_bday(train_end))).cast("date"))
    at = F.col("at") - 1
    persistence = F.get(alpha, at) + F.get(beta, at)
    level = F.get(omega, at) * F.col("anchor") / (1 - persistence)
    ahead = days.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    var = level + F.pow(persistence, F.col("h") - 1) * (F.col("v") - level)
    vol = F.sqrt(var) / SCALE * F.sqrt(F.lit(float(ANNUAL_DAYS)))
    return ahead.select("symbol", "date", "h", F.coalesce(vol, "_plain").alias("vol"), F.col("v").isNotNull().alias("fitted"))


def vol_rmse(forecasts: DataFrame, targets: DataFrame, models: list[str]) -> DataFrame:
    """Root mean squared error of each model against the annualised forward volatility, and the winner."""
    y = F.col("tgt_vol_5d") * F.sqrt(F.lit(float(ANNUAL_DAYS)))
    j = forecasts.join(targets.select("symbol", "date", "tgt_vol_5d"), ["symbol", "date"])
    wide = j.groupBy("symbol").agg(*[F.sqrt(F.avg(F.pow(y - F.col(m), 2))).alias(m) for m in models])
    return wide.withColumn("winner", best_column(models))


def best_column(models: list[str]):
    low = F.least(*[F.col(m) for m in models])
    out = F.lit(None).cast("string")
    for m in reversed(models):
        out = F.when(F.col(m) == low, F.lit(m)).otherwise(out)
    return out
