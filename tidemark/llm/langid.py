"""Language identification by nearest centroids of TF-IDF character n-grams.

A text's letters, lower-cased, with one space for every gap, give counts of hashed n-grams of one to three characters;
counts times inverse document frequency, scaled to length one, is its vector. Document frequencies come from all
learning rows. Each language has up to ``CENTROIDS`` centroids, found by spherical k-means on at most
``SAMPLE_PER_LANGUAGE`` of its learning rows (those with the least hash). The predicted language is that of the centroid
with the largest cosine, which is also the score. A text is rejected if it has no letter, or if that cosine is below
the centroid's floor for texts of that length: the ``QUANTILE`` of the cosines of its own members whose length lies within a
factor of two, or in as many more doublings as ``MEMBERS`` of them take. A centroid of fewer members takes the floors of its
language's whole sample; in a sample of fewer than ``FEW`` a tail can't be told, and the floor is ``SLACK`` times its least cosine.

Null texts and texts without letters are ``und`` with score 0; without learning rows every text is. Rows without
language are not learned from; equal cosines go to the first language by code point; rows repeat as they are; an empty
table gives an empty result; further columns are ignored by ``predict`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import crc_fold, hash_place, map_batches

BUCKETS = 1 << 13
SAMPLE_PER_LANGUAGE = 1000
CENTROIDS = 4
ROUNDS = 8
QUANTILE, MEMBERS, FEW, SLACK, BANDS = 0.005, 100, 50, 0.5, 24
#: Learning rows are those whose crc32 of the id, modulo FOLDS, is not HELD_OUT.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Whatever is no letter: numbers such as ½, ² and ① too, which are word characters.
_GAP = regex.compile(r"\P{L}+")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_counts(text: str | None) -> np.ndarray:
    """Counts by bucket of the n-grams of a text's letters; all zero without letters."""
    letters = _GAP.sub(" ", text.lower()) if text else ""
    if not letters.strip():
        return np.zeros(BUCKETS, np.int64)
    c = np.frombuffer(f" {letters.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * _MULTIPLIERS[0]
    two = one[:-1] ^ (c[1:] * _MULTIPLIERS[1])
    three = two[:-1] * np.uint32(31) ^ (c[2:] * _MULTIPLIERS[2])
    mixed = np.concatenate((one ^ np.uint32(1), two ^ np.uint32(2), three))
    mixed ^= mixed >> np.uint32(15)
    return np.bincount(mixed * np.uint32(0x2C1B3C6D) >> np.uint32(19), minlength=BUCKETS)


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # of each centroid, for texts of 2^i n-grams and more


def learning_rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT))


def _document_frequencies(batches):
    sums, rows = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for t in b.column("text").to_pylist():
            sums += ngram_counts(t) > 0
            rows += 1
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], rows))], names=["bucket", "n"])


def _counted(batches):
    for b in batches:
        counts = [ngram_counts(t) for t in b.column("text").to_pylist()]
        at = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_arrays(
            [b.column("lang"), b.column("h"), pa.array(at, pa.list_(pa.int64())), pa.array([c[i] for c, i in zip(counts, at)], pa.list_(pa.int64()))],
            names=["lang", "h", "bucket", "n"],
        )


def _floors(best: np.ndarray, level: np.ndarray) -> list[float]:
    """Floor of each band of lengths, from the cosines and bands of the members of a centroid or language."""
    if len(best) < FEW:
        return [SLACK * float(best.min())] * BANDS
    out = []
    for band in range(BANDS):
        gap = np.abs(level - band)
        near = np.sort(best[gap <= max(1, np.sort(gap)[:MEMBERS][-1])])
        # The r-th least of n: a further row like them lies below with a chance of r in n + 1.
        out.append(float(near[max(0, int(QUANTILE * (len(near) + 1)) - 1)]))
    return out


def _clusters(idf: np.ndarray):
    """Spherical k-means over one language's sample; starts from rows far from the mean and from each other."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        x = np.zeros((len(pdf), BUCKETS), np.float32)
        for row, (at, n) in enumerate(zip(pdf["bucket"], pdf["n"])):
            x[row, at] = n
        total = x.sum(axis=1)
        x = unit_rows(x * idf.astype(np.float32))
        x, total = x[total > 0], total[total > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "floors": []})
        found = unit_rows(x.mean(axis=0, keepdims=True))
        for _ in range(min(CENTROIDS, len(x)) - 1):
            found = np.vstack((found, x[(x @ found.T).max(axis=1).argmin()]))
        for _ in range(ROUNDS):
            own = (x @ found.T).argmax(axis=1)
            found = unit_rows(np.vstack([x[own == k].mean(axis=0) if (own == k).any() else found[k] for k in range(len(found))]))
        cosine = x @ found.T
        own, best = cosine.argmax(axis=1), cosine.max(axis=1)
        level = np.log2(total).astype(int)
        shared = _floors(best, level)
        floors = [_floors(best[own == k], level[own == k]) if (own == k).sum() >= MEMBERS else shared for k in range(len(found))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [c.astype(float).tolist() for c in found], "floors": floors})

    return run


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    rows = learning_rows(docs, doc_id, text, lang)
    counts = map_batches(rows.select("text"), _document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    seen = np.zeros(BUCKETS + 1)
    for bucket, n in counts:
        seen[bucket] = n
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    # Rows are thinned by their hash, in the tasks, to little more than the sample before those of a language meet in one
    # window; the shares, a row for each language like the model itself, are broadcast.
    placed = rows.select("doc_id", "lang", hash_place(F.col("doc_id")).alias("h"))
    share = placed.groupBy("lang").agg((F.lit(1.5 * SAMPLE_PER_LANGUAGE) / F.count(F.lit(1))).alias("share")).withColumnRenamed("lang", "__lang")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = placed.join(F.broadcast(share), F.col("lang") == F.col("__lang")).where(F.col("h") < F.col("share")).withColumn("nth", F.row_number().over(order))
    picked = picked.where(F.col("nth") <= SAMPLE_PER_LANGUAGE).select("doc_id", "h").distinct()
    # At most SAMPLE_PER_LANGUAGE ids for each language.
    sample = rows.join(F.broadcast(picked), "doc_id").select("text", "lang", "h")
    vectors = map_batches(sample, _counted, "lang string, h double, bucket array<long>, n array<long>")
    found = vectors.groupBy("lang").applyInPandas(_clusters(idf), "lang string, centroid array<double>, floors array<double>").collect()
    found.sort(key=lambda r: r.lang)
    return Model(idf, [r.lang for r in found], np.array([r.centroid for r in found]).reshape(-1, BUCKETS), np.array([r.floors for r in found]).reshape(-1, BANDS))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each text."""
    counts = np.array([ngram_counts(t) for t in texts]).reshape(-1, BUCKETS)
    total = counts.sum(axis=1)
    if not len(model.languages) or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    cosine = unit_rows(counts * model.idf) @ model.centroids.T
    best = cosine.argmax(axis=1)
    score = np.clip(np.where(total > 0, cosine.max(axis=1), 0), 0, 1)
    floor = model.floors[best, np.minimum(np.log2(np.maximum(total, 1)).astype(int), BANDS - 1)]
    return [model.languages[k] if n else UNKNOWN for k, n in zip(best, total)], score, (total == 0) | (score < floor) | (score == 0)


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id, FOLDS) == HELD_OUT


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: CENTROIDS rows of BUCKETS numbers for each language
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            lang, score, rejected = classify(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, lang_pred string, score double, rejected boolean").fields])
    return map_batches(rows, run, schema)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            rejected = classify(shared.value, b.column(text).to_pylist())[2]
            yield b.filter(pa.array(~rejected))

    return map_batches(docs, run, docs.schema)
