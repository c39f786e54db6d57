"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Statistics of a text become a vector of five transformed numbers. For every language and source a minimum covariance
determinant estimate is found by concentration steps: distances under the present estimate, the closest three quarters
of the rows, their mean and covariance; last, one reweighting step over the rows within the 97.5 % ellipsoid. Each step
is two aggregations over all rows, combined before the shuffle, so a large source is not gathered anywhere. Rows whose
Mahalanobis distance is beyond the 99.9 % ellipsoid are rejected.

Groups with fewer than ``MIN_ROWS`` rows use their language's estimate, and languages with fewer that of all rows; with
fewer than that in all, only the base rules decide. Nulls of language or source are groups of their own. A null or
empty text has no words and fails the base rules; repeated rows count as often as they occur; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, staged, utf8

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = re.compile(rb"[#*$%&|<>]")
MIN_ROWS = 60
#: Share of rows in the core of an estimate, concentration steps, and chance that a normal row is rejected.
CORE, STEPS, ALPHA = 0.75, 6, 1e-3
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
#: Least spread of each feature: rates that are zero nearly everywhere would have none.
FLOOR = np.array([0.5, 0.06, 0.5, 0.35, 0.35])
P = len(FEATURES)


def repeated_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more, first ones included; exact for any length."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    # Windows as ranks: of 2 words, of 4 words, of 5; every packed number stays below n squared.
    two = np.unique(ids[:-1] * np.int64(ids.max() + 1) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * np.int64(two.max() + 1) + two[2:], return_inverse=True)[1]
    five = four[:-1] * np.int64(ids.max() + 1) + ids[4:]
    _, at, count = np.unique(five, return_inverse=True, return_counts=True)
    first = np.flatnonzero(count[at] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + size, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a UTF-8 text."""
    words = text.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else [text] if words else []
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(ids), len(lines)


def features(n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat_words: Column, n_lines: Column) -> dict[str, Column]:
    words, lines = F.greatest(n_words, F.lit(1)), F.greatest(n_lines, F.lit(1))
    return {
        "f_words": F.log1p(n_words.cast("double")),
        "f_length": F.log(F.greatest(word_chars, F.lit(1)) / words),
        "f_symbols": F.log(F.lit(0.05) + n_symbols / words),
        "f_lines": F.log(F.lit(0.1) + n_dup_lines / lines),
        "f_repeats": F.log(F.lit(0.1) + n_repeat_words / words),
    }


def base(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: doc_id, lang, source, the statistics, base_failed and the transformed vector."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches):
        for b in batches:
            cols = np.array([statistics(t) for t in utf8(b, "text")], np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, cols)], names=["doc_id", "lang", "source", *names])

    schema = T.StructType([*rows.drop("text").schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    found = map_batches(rows, run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumns(features(*map(F.col, names)))


def chi2_cdf(x: float, df: int) -> float:
    """Chi-squared distribution function, by the series of the incomplete gamma function."""
    a, z = df / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * exp(-z + a * log(z) - lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 1e-9, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return lo


def _key(level: int) -> Column:
    """Text key of a row's group at a level: 0 language and source, 1 language, 2 all."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.concat_ws("\u0001", F.lit(str(level)), *[part(c) for c in ("lang", "source")[: 2 - level]])


_TRIANGLE = [(i, j) for i in range(P) for j in range(i, P)]
_MODEL = "key string, mean array<double>, inverse array<double>, cut double"


def _solver(factor: float):
    """Mean and inverse covariance of each group's sums; variances below the floor are raised to it."""

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                n = row.n
                mean = np.array(row.s1, float) / n
                cov = np.zeros((P, P))
                for v, (i, j) in zip(row.s2, _TRIANGLE):
                    cov[i, j] = cov[j, i] = (v / n - mean[i] * mean[j]) * factor
                raised = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), FLOOR)
                cov[np.diag_indices(P)] = raised**2
                value, vector = np.linalg.eigh(cov)
                inverse = vector / np.maximum(value, 1e-4) @ vector.T
                out.append((row.key, mean.tolist(), inverse.ravel().tolist(), 0.0))
            yield pd.DataFrame(out, columns=["key", "mean", "inverse", "cut"])

    return run


def _distance() -> Column:
    gap = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    return sum((gap[i] * gap[j] * F.col("inverse")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def _sums(rows: DataFrame, factor: float) -> DataFrame:
    """Sums of the groups' rows, then their mean and inverse covariance."""
    sums = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(f) for f in FEATURES]).alias("s1"),
        F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in _TRIANGLE]).alias("s2"),
    )
    return sums.mapInPandas(_solver(factor), _MODEL)


def fit(stats: DataFrame) -> DataFrame:
    """(key, mean, inverse): the estimate of every group of at least MIN_ROWS rows, over the rows that pass the base rules."""
    sound = stats.where(~F.col("base_failed")).select("lang", "source", *FEATURES)
    keyed = sound.select(F.explode(F.array(*[_key(level) for level in range(3)])).alias("key"), *FEATURES)
    # Start: medians, and spreads from the quartiles, no correlation.
    quarters = [F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f) for f in FEATURES]
    start = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *quarters).where(F.col("n") >= MIN_ROWS)
    spread = [F.greatest((F.col(f)[2] - F.col(f)[0]) / 1.349, F.lit(float(FLOOR[i]))) for i, f in enumerate(FEATURES)]
    inverse = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]
    model = staged(start.select("key", F.array(*[F.col(f)[1] for f in FEATURES]).alias("mean"), F.array(*inverse).alias("inverse")), "mcd")
    keyed = staged(keyed.join(model.select("key"), "key", "left_semi"), "vectors")
    core = CORE / chi2_cdf(chi2_quantile(CORE, P), P + 2)
    for _ in range(STEPS):
        far = keyed.join(model, "key").select("key", *FEATURES, _distance().alias("d2"))
        cut = staged(far.groupBy("key").agg(F.percentile_approx("d2", CORE, 1000).alias("cut")).join(model, "key"), "mcd")
        near = keyed.join(cut, "key").where(_distance() <= F.col("cut")).select("key", *FEATURES)
        model = staged(_sums(near, core).select("key", "mean", "inverse"), "mcd")
    inner = chi2_quantile(0.975, P)
    near = keyed.join(model, "key").where(_distance() <= inner).select("key", *FEATURES)
    return staged(_sums(near, 0.975 / chi2_cdf(inner, P + 2)).select("key", "mean", "inverse"), "mcd")


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, statistics, base_failed, distance, kept): distance is null where no estimate applies."""
    stats = staged(base(docs, doc_id, text, lang, source), "statistics")
    model = fit(stats)
    found = stats
    for level in range(3):
        own = model.select(F.col("key").alias("__key"), F.col("mean").alias(f"mean{level}"), F.col("inverse").alias(f"inverse{level}"))
        found = found.join(own, _key(level) == F.col("__key"), "left").drop("__key")
    found = found.withColumn("mean", F.coalesce("mean0", "mean1", "mean2")).withColumn("inverse", F.coalesce("inverse0", "inverse1", "inverse2"))
    d2 = _distance()
    found = found.withColumn("distance", F.when(d2 < 0, 0.0).otherwise(F.sqrt(d2)))
    limit = chi2_quantile(1 - ALPHA, P) ** 0.5
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return found.select("doc_id", *names, kept.alias("kept"), "distance", "lang", "source")
