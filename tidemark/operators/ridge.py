"""Ridge fits of the weight learner from aggregated sums of products.

Spark reduces the training rows to a few small Gram rows per symbol;
what is left per symbol is a handful of 5x5 systems, solved where that row lives.
Nothing is collected to the driver, so the number of symbols is not limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import MODELS
from tidemark.functions.windows import ordered
from tidemark.operators.meta import META_FEATURES

# Penalty grids of the first and second learner version.
ALPHAS_V1 = (0.1, 1.0, 10.0, 100.0)
ALPHAS_V2 = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
TARGET_COLS = tuple(f"y_{m}" for m in MODELS)


def standardize(rows: DataFrame, cols: tuple[str, ...] = META_FEATURES) -> DataFrame:
    """Columns ``z_*`` scaled per symbol by mean and population deviation (1 when there is none)."""
    w = Window.partitionBy("symbol")
    stats = {f"mu_{c}": F.avg(c).over(w) for c in cols} | {f"sd_{c}": F.stddev_pop(c).over(w) for c in cols}
    df = rows.withColumns(stats).withColumns({f"sd_{c}": F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(1.0) for c in cols})
    return df.withColumns({f"z_{c}": (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}") for c in cols})


def gram(rows: DataFrame, splits: int = 5, gap: int = 21) -> DataFrame:
    """Sums of products per symbol and segment of its history; no row is copied for a fold.

    The embargoed folds nest (see ``splits.embargo_folds``): a row trains every fold from ``train_from`` on and tests
    the fold ``tests``, if any, so rows with equal pairs are summed once and folds are sums of segments. Layout of
    ``s``: products of every pair of (1, z_1..z_5, y_1..y_4), upper triangle by rows, so counts, means, Gram matrix
    and targets are all in it.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    z = standardize(rows).withColumns({"_pos": F.row_number().over(ordered("symbol")) - 1, "_n": n, "_size": F.floor(n / (splits + 1))})
    after = F.col("_pos") - (F.col("_n") - splits * F.col("_size"))  # rows since the first test block began
    fold = F.when((after >= 0) & (F.col("_size") > 0), F.floor(after / F.col("_size")))
    since = F.when(after + gap < 0, 0).when(F.col("_size") > 0, F.floor((after + gap) / F.col("_size")) + 1).otherwise(splits)
    z = z.withColumns({"train_from": since.cast("int"), "tests": fold.cast("int")})
    terms: list[Column] = [F.lit(1.0), *[F.col(f"z_{c}") for c in META_FEATURES], *[F.col(y) for y in TARGET_COLS]]
    products = [F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]]
    scaling = [F.first(f"{p}_{c}").alias(f"{p}_{c}") for c in META_FEATURES for p in ("mu", "sd")]
    out = z.groupBy("symbol", "train_from", "tests").agg(F.array(*products).alias("s"), *scaling)
    return out.select(
        "symbol",
        "train_from",
        "tests",
        "s",
        F.array(*[F.col(f"mu_{c}") for c in META_FEATURES]).alias("mean"),
        F.array(*[F.col(f"sd_{c}") for c in META_FEATURES]).alias("scale"),
    )


def _square(s: np.ndarray) -> np.ndarray:
    n = 1 + len(META_FEATURES) + len(TARGET_COLS)
    m = np.zeros((n, n))
    m[np.triu_indices(n)] = s
    return m + np.triu(m, 1).T


def _solve(m: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (features x targets) and intercepts of a centred ridge fit."""
    k = 1 + len(META_FEATURES)
    n = m[0, 0]
    mx, my = m[0, 1:k] / n, m[0, k:] / n
    g = m[1:k, 1:k] - n * np.outer(mx, mx)
    c = m[1:k, k:] - n * np.outer(mx, my)
    beta = np.linalg.solve(g + alpha * np.eye(k - 1), c)
    return beta, my - mx @ beta


def _r2(m: np.ndarray, beta: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """R squared per target of a fit on the rows summed in ``m``."""
    k = 1 + len(META_FEATURES)
    full = np.vstack([b0, beta])
    sse = np.diag(m[k:, k:]) - 2 * np.einsum("ij,ij->j", full, m[:k, k:]) + np.einsum("ij,ik,kj->j", full, m[:k, :k], full)
    sst = np.diag(m[k:, k:]) - m[0, k:] ** 2 / m[0, 0]
    return 1 - sse / sst


def _unfitted(n_rows: int) -> dict:
    """Zero scores, so equal weights, marked as not fitted."""
    d = len(META_FEATURES)
    out = {"mean": [0.0] * d, "scale": [1.0] * d, "n_rows": n_rows, "fitted": False}
    for m in MODELS:
        out |= {f"coef_{m}": [0.0] * d, f"intercept_{m}": 0.0, f"alpha_{m}": None, f"saturated_{m}": False}
    return out


def _fit_symbol(rows: list, alphas: tuple[float, ...], splits: int) -> dict:
    """Fit of one symbol; unfitted when its history is too short for every fold to have train and test rows."""
    parts = [(r["train_from"], r["tests"], _square(np.asarray(r["s"], dtype=float))) for r in sorted(rows, key=lambda r: (r["train_from"], -1 if r["tests"] is None else r["tests"]))]
    whole = sum(m for _, _, m in parts)
    by = {(k, "train"): sum(m for first, _, m in parts if first <= k) for k in range(splits)}
    by |= {(k, "test"): sum(m for _, tested, m in parts if tested == k) for k in range(splits)}
    folds = [k for k in range(splits) if isinstance(by[k, "train"], np.ndarray) and isinstance(by[k, "test"], np.ndarray)]
    n_rows = int(whole[0, 0])
    if len(folds) < splits:
        return _unfitted(n_rows)
    scores = np.array([[_r2(by[f, "test"], *_solve(by[f, "train"], a)) for f in folds] for a in alphas])
    picked = scores.mean(axis=1).argmax(axis=0)
    out = {"mean": list(rows[0]["mean"]), "scale": list(rows[0]["scale"]), "n_rows": n_rows, "fitted": True}
    for i, m in enumerate(MODELS):
        alpha = alphas[int(picked[i])]
        beta, b0 = _solve(whole, alpha)
        out |= {
            f"coef_{m}": beta[:, i].tolist(),
            f"intercept_{m}": float(b0[i]),
            f"alpha_{m}": float(alpha),
            f"saturated_{m}": alpha >= max(alphas),
        }
    return out


def fit_schema() -> T.StructType:
    arr, dbl = T.ArrayType(T.DoubleType()), T.DoubleType()
    fields = [T.StructField("symbol", T.StringType()), T.StructField("mean", arr), T.StructField("scale", arr), T.StructField("n_rows", T.LongType()), T.StructField("fitted", T.BooleanType())]
    for m in MODELS:
        fields += [
            T.StructField(f"coef_{m}", arr),
            T.StructField(f"intercept_{m}", dbl),
            T.StructField(f"alpha_{m}", dbl),
            T.StructField(f"saturated_{m}", T.BooleanType()),
        ]
    return T.StructType(fields)


def fit_ridge(train: DataFrame, alphas: tuple[float, ...] = ALPHAS_V2, splits: int = 5, gap: int = 21) -> DataFrame:
    """One fitted weight model per symbol.

    The penalty of each base model maximises the mean R squared over the
    embargoed folds; a pick at the grid's end marks the model as saturated. A
    symbol with too few rows for the folds gets zero scores and ``fitted`` false. A
    symbol's Gram rows number about 3 * splits whatever its history.
    """
    cells = gram(train, splits, gap).groupBy("symbol").agg(F.collect_list(F.struct("train_from", "tests", "s", "mean", "scale")).alias("rows"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fitted = [(s, _fit_symbol(list(rows), alphas, splits)) for s, rows in zip(pdf["symbol"], pdf["rows"])]
            yield pd.DataFrame([{"symbol": s, **m} for s, m in fitted], columns=fit_schema().names)

    return cells.mapInPandas(solve, fit_schema())


def save_fit(fit: DataFrame, path: str) -> None:
    fit.write.mode("overwrite").parquet(path)


def load_fit(spark, path: str) -> DataFrame:
    """Saved fits; flags missing from an older file default to fitted and not saturated."""
    df = spark.read.parquet(path)
    flags = {"fitted": True} | {f"saturated_{m}": False for m in MODELS}
    missing = {c: F.lit(v) for c, v in flags.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df
