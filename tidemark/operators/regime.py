"""Market regimes: inputs, hidden-state fit and filter, labels and statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.windows import ANNUAL_DAYS, UNBOUNDED, ordered, rolling
from tidemark.operators.calendar import broadcast_calendar

INPUTS = ("ret", "vol_21d", "vix", "slope")
N_STATES = 3
TINY = 1e-300


def regime_inputs(panel: DataFrame, macro_wide: DataFrame) -> DataFrame:
    """Lagged return, its 21-row deviation, lagged VIX and lagged slope; incomplete rows dropped."""
    w = ordered("symbol")
    side = macro_wide.select("date", F.col("VIXCLS").alias("_vix"), F.col("T10Y2Y").alias("_slope"))
    df = panel.select("symbol", "date", "close").join(broadcast_calendar(side), "date", "left")
    df = df.withColumn("_r", F.log("close") - F.log(F.lag("close").over(w)))
    df = df.withColumns({"ret": F.lag("_r").over(w), "vix": F.lag("_vix").over(w), "slope": F.lag("_slope").over(w)})
    df = df.withColumn("vol_21d", rolling(F.stddev_samp, F.col("ret"), 21, w))
    return df.select("symbol", "date", *INPUTS).na.drop()


def scale_train_only(inputs: DataFrame, train_end: str) -> DataFrame:
    """Standardise by each symbol's train-period mean and population deviation; a symbol without train rows keeps its
    rows with unknown values."""
    return scale_by(inputs, scale_stats(inputs, train_end))


def scale_stats(inputs: DataFrame, train_end: str) -> DataFrame:
    """Mean and population deviation of each input over a symbol's train rows, to be stored."""
    train = F.col("date") <= F.lit(train_end).cast("date")
    return inputs.where(train).groupBy("symbol").agg(
        *[F.avg(c).alias(f"mu_{c}") for c in INPUTS], *[F.stddev_pop(c).alias(f"sd_{c}") for c in INPUTS]
    )


def scale_by(inputs: DataFrame, stats: DataFrame) -> DataFrame:
    z = {c: (F.col(c) - F.col(f"mu_{c}")) / F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(1.0) for c in INPUTS}
    return inputs.join(stats, "symbol", "left").select("symbol", "date", *[e.alias(c) for c, e in z.items()])


# --- hidden-state model: one symbol's history per call ------------------------


def log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Gaussian log density of each row under each state, (T, K)."""
    out = np.empty((len(x), len(mean)))
    for k, (m, c) in enumerate(zip(mean, cov)):
        chol = np.linalg.cholesky(c)
        d = np.linalg.solve(chol, (x - m).T)
        out[:, k] = -0.5 * (d**2).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def forward(start: np.ndarray, trans: np.ndarray, dens: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered state probabilities P(s_t | o_1..t) and the log likelihood."""
    shift = dens.max(axis=1)
    b = np.exp(dens - shift[:, None])
    post = np.empty_like(b)
    p, loglik = start, 0.0
    for t in range(len(b)):
        p = (p if t == 0 else p @ trans) * b[t]
        total = p.sum()
        p = p / total
        post[t] = p
        loglik += np.log(total) + shift[t]
    return post, loglik


def expectation(start: np.ndarray, trans: np.ndarray, dens: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Smoothed state probabilities and expected transition counts."""
    alpha, loglik = forward(start, trans, dens)
    gamma = np.empty_like(alpha)
    gamma[-1] = alpha[-1]
    counts = np.zeros_like(trans)
    for t in range(len(alpha) - 2, -1, -1):
        ahead = np.maximum(alpha[t] @ trans, TINY)
        joint = alpha[t][:, None] * trans * (gamma[t + 1] / ahead)[None, :]
        counts += joint
        gamma[t] = joint.sum(axis=1)
    return gamma, counts, loglik


def fit_states(x: np.ndarray, k: int = N_STATES, max_iter: int = 200, tol: float = 1e-2, ridge: float = 1e-3) -> dict:
    """Expectation-maximisation from a deterministic start: states ordered by the VIX input."""
    bins = np.array_split(np.argsort(x[:, INPUTS.index("vix")], kind="stable"), k)
    mean = np.array([x[b].mean(axis=0) for b in bins])
    cov = np.array([np.cov(x.T, bias=True) + ridge * np.eye(x.shape[1])] * k)
    start, trans = np.full(k, 1 / k), np.full((k, k), 0.05 / (k - 1)) + np.eye(k) * (0.95 - 0.05 / (k - 1))
    last, n_iter = -np.inf, 0
    for n_iter in range(1, max_iter + 1):
        gamma, counts, loglik = expectation(start, trans, log_density(x, mean, cov))
        weight = gamma.sum(axis=0) + TINY
        start = gamma[0]
        trans = (counts + TINY) / (counts + TINY).sum(axis=1, keepdims=True)
        mean = gamma.T @ x / weight[:, None]
        for s in range(k):
            d = x - mean[s]
            cov[s] = (gamma[:, s][:, None] * d).T @ d / weight[s] + ridge * np.eye(x.shape[1])
        if loglik - last < tol:
            break
        last = loglik
    return {"start": start, "trans": trans, "mean": mean, "cov": cov, "loglik": loglik, "n_iter": n_iter}


MODEL_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("start", "trans", "mean", "cov")],
        T.StructField("loglik", T.DoubleType()),
        T.StructField("n_iter", T.IntegerType()),
    ]
)


def hmm_fit(scaled: DataFrame, train_end: str, k: int = N_STATES) -> DataFrame:
    """One model per symbol, fitted on its train rows only (symbols run in parallel).

    A symbol's train history is bounded by the calendar; one with fewer than ten
    rows per state gets an empty model (NULL parameters).
    """

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 10 * k:
            return pd.DataFrame({"symbol": [key[0]], **{c: [None] for c in MODEL_SCHEMA.names[1:]}})
        m = fit_states(pdf.sort_values("date")[list(INPUTS)].to_numpy(), k)
        flat = {c: [m[c].ravel().tolist()] for c in ("start", "trans", "mean", "cov")}
        return pd.DataFrame({"symbol": [key[0]], **flat, "loglik": [m["loglik"]], "n_iter": [m["n_iter"]]})

    train = scaled.where(F.col("date") <= F.lit(train_end).cast("date"))
    return train.groupBy("symbol").applyInPandas(fit, MODEL_SCHEMA)


def _unpack(row: pd.Series, k: int) -> tuple[np.ndarray, ...]:
    d = len(INPUTS)
    shapes = {"start": (k,), "trans": (k, k), "mean": (k, d), "cov": (k, d, d)}
    return tuple(np.asarray(row[c], dtype=float).reshape(s) for c, s in shapes.items())


def best_path(start: np.ndarray, trans: np.ndarray, dens: np.ndarray) -> np.ndarray:
    """Most likely state sequence given the whole history (looks ahead)."""
    logt = np.log(trans + TINY)
    score = np.log(start + TINY) + dens[0]
    back = np.zeros(dens.shape, dtype=int)
    for t in range(1, len(dens)):
        cand = score[:, None] + logt
        back[t] = cand.argmax(axis=0)
        score = cand.max(axis=0) + dens[t]
    path = np.empty(len(dens), dtype=int)
    path[-1] = score.argmax()
    for t in range(len(dens) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def decode(scaled: DataFrame, models: DataFrame, smoothed: bool = False, k: int = N_STATES) -> DataFrame:
    """State of every row from its symbol's model.

    The filtered state uses the past only. The smoothed state backtracks over
    the full history and is for diagnostics, never for features. Without a model
    a symbol keeps its rows with an unknown state.
    """
    schema = "symbol string, date date, state int"

    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        if rows.empty or model.empty or model["start"].iloc[0] is None:
            return rows[["symbol", "date"]].assign(state=pd.Series([None] * len(rows), index=rows.index, dtype="Int32"))
        start, trans, mean, cov = _unpack(model.iloc[0], k)
        dens = log_density(rows[list(INPUTS)].to_numpy(), mean, cov)
        states = best_path(start, trans, dens) if smoothed else forward(start, trans, dens)[0].argmax(axis=1)
        return rows[["symbol", "date"]].assign(state=states)

    return scaled.groupBy("symbol").cogroup(models.groupBy("symbol")).applyInPandas(run, schema)


@dataclass(frozen=True)
class GivenModel:
    """A three-state model with known parameters and independent inputs (variances, no covariances)."""

    start: tuple[float, float, float]
    trans: tuple[tuple[float, float, float], ...]
    mean: tuple[tuple[float, ...], ...]
    var: tuple[tuple[float, ...], ...]


def filter_probabilities(scaled: DataFrame, model: GivenModel) -> DataFrame:
    """(symbol, date, p0, p1, p2, state): state probabilities of each row given the rows up to it, for known parameters.

    One ordered array per symbol (bounded by the calendar) is folded from front to back; nothing leaves the JVM. A row
    with an unknown input moves nothing: it has no probabilities and no state.
    """
    k = range(N_STATES)
    log_dens = [
        sum((-0.5 * (F.pow(F.col(c) - m, 2) / v + math.log(2 * math.pi * v)) for c, m, v in zip(INPUTS, model.mean[j], model.var[j])), F.lit(0.0))
        for j in k
    ]
    rows = scaled.withColumns({f"_d{j}": log_dens[j] for j in k}).withColumn("_m", F.greatest(*[f"_d{j}" for j in k]))
    rows = rows.select("symbol", F.struct("date", *[F.exp(F.col(f"_d{j}") - F.col("_m")).alias(f"b{j}") for j in k]).alias("o"))
    path = rows.groupBy("symbol").agg(F.sort_array(F.collect_list("o")).alias("path"))
    item = F.struct(*[F.lit(None).cast("double").alias(f"p{j}") for j in k], F.lit(None).cast("int").alias("state"))
    fresh = F.struct(*[F.lit(model.start[j]).alias(f"p{j}") for j in k], F.lit(True).alias("first"), F.array(item).alias("out"))

    def step(s: Column, o: Column) -> Column:
        known = o["b0"].isNotNull()
        prior = [F.when(s["first"], s[f"p{j}"]).otherwise(sum((s[f"p{i}"] * model.trans[i][j] for i in k), F.lit(0.0))) for j in k]
        joint = [prior[j] * o[f"b{j}"] for j in k]
        total = sum(joint, F.lit(0.0))
        best = F.when(~known, None).when((joint[0] >= joint[1]) & (joint[0] >= joint[2]), 0).when(joint[1] >= joint[2], 1).otherwise(2)
        out = F.struct(*[(joint[j] / total).alias(f"p{j}") for j in k], best.cast("int").alias("state"))
        p = [F.when(known, joint[j] / total).otherwise(s[f"p{j}"]).alias(f"p{j}") for j in k]
        return F.struct(*p, (s["first"] & ~known).alias("first"), F.concat(s["out"], F.array(out)).alias("out"))

    states = path.withColumn("out", F.aggregate("path", fresh, step, lambda s: F.slice(s["out"], F.lit(2), F.size("path"))))
    z = states.select("symbol", F.explode(F.arrays_zip(F.col("path.date").alias("date"), "out")).alias("z"))
    return z.select("symbol", "z.date", "z.out.*")


def filter_given(scaled: DataFrame, model: GivenModel) -> DataFrame:
    """(symbol, date, state): the most likely state of each row given the rows up to it, for known parameters."""
    return filter_probabilities(scaled, model).select("symbol", "date", "state")


def filter_step(x: np.ndarray, p: np.ndarray | None, model: GivenModel) -> tuple[np.ndarray, np.ndarray | None]:
    """One symbol's next rows, in order: their state probabilities (rows with an unknown input: NaN), and the last known ones."""
    out = np.full((len(x), N_STATES), np.nan)
    mean, var, trans = np.array(model.mean), np.array(model.var), np.array(model.trans)
    dens = (-0.5 * ((x[:, None] - mean) ** 2 / var + np.log(2 * np.pi * var))).sum(2)
    for t in np.flatnonzero(~np.isnan(dens).any(axis=1)):
        joint = (np.array(model.start) if p is None else p @ trans) * np.exp(dens[t] - dens[t].max())
        out[t] = p = joint / joint.sum()
    return out, p


# --- labels and statistics: plain aggregations -------------------------------


def label_map(states: DataFrame, vix: DataFrame, k: int = N_STATES, train_end: str | None = None) -> DataFrame:
    """Raw state to label by median VIX: lowest 0, highest 1, the middle ones 2, 3, ...

    A state without rows ranks above every observed one. With ``train_end`` the medians are those of rows up to that
    date, so that labels do not look ahead.
    """
    every = states.select("symbol").distinct().select("symbol", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("state"))
    seen = states.where(F.col("date") <= F.lit(train_end).cast("date")) if train_end else states
    med = seen.join(broadcast_calendar(vix), "date", "left").groupBy("symbol", "state").agg(F.median("vix").alias("median_vix"))
    ranked = every.join(med, ["symbol", "state"], "left")
    order = ordered("symbol").orderBy(F.coalesce("median_vix", F.lit(float("inf"))), "state")
    place = F.row_number().over(order)
    label = F.when(place == 1, 0).when(place == k, 1).otherwise(place)
    return ranked.select("symbol", "state", "median_vix", label.alias("label"))


def apply_labels(states: DataFrame, mapping: DataFrame) -> DataFrame:
    """At most k rows per symbol on the mapping side."""
    return states.join(mapping.select("symbol", "state", "label"), ["symbol", "state"], "left")


def transitions(labels: DataFrame, label: str = "label") -> DataFrame:
    """Counts and row-normalised probabilities of label changes between neighbouring rows."""
    rows = labels.where(F.col(label).isNotNull())
    pairs = rows.select("symbol", F.col(label).alias("src"), F.lead(label).over(ordered("symbol")).alias("dst"))
    counts = pairs.where("dst is not null").groupBy("symbol", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "src")))


def runs(labels: DataFrame, label: str = "label") -> DataFrame:
    """Number and average length of unbroken runs per label."""
    w = ordered("symbol")
    rows = labels.where(F.col(label).isNotNull())
    changed = F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0))
    marked = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w.rowsBetween(UNBOUNDED, 0)))
    lengths = marked.groupBy("symbol", "_run", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_len"))
    return lengths.groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("_len").alias("avg_run"))


def stats_by_label(rows: DataFrame, label: str = "label", vix: str = "vix", ret: str = "ret") -> DataFrame:
    """VIX and return statistics per label; return moments need two observations."""
    r = F.col(ret)
    mean, sd, n = F.avg(r), F.stddev_samp(r), F.count(r)

    def two(c: Column) -> Column:
        return F.when(n >= 2, c)

    root = F.sqrt(F.lit(float(ANNUAL_DAYS)))
    return rows.where(F.col(label).isNotNull()).groupBy("symbol", F.col(label).alias("label")).agg(
        F.median(vix).alias("vix_median"),
        F.avg(vix).alias("vix_mean"),
        F.stddev_samp(vix).alias("vix_std"),
        n.alias("n"),
        two(mean).alias("mean_daily"),
        two(sd).alias("std_daily"),
        two(mean * ANNUAL_DAYS).alias("ann_return"),
        two(sd * root).alias("ann_vol"),
        two(F.when(sd > 0, mean / sd * root).otherwise(0.0)).alias("sharpe_ann"),
    )


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of rows on which two state sequences agree."""
    j = a.select("symbol", "date", F.col("state").alias("_a")).join(b.select("symbol", "date", F.col("state").alias("_b")), ["symbol", "date"])
    return j.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))
