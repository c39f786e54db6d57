"""Quality classifier by importance resampling over hashed n-grams.

Two bag-of-n-gram models over a fixed number of hash buckets, one of all documents and one of documents labelled good,
give every document the log ratio of its probability as target text to that as raw text. Resampling without
replacement keeps the documents with the largest log ratio plus Gumbel noise. How many are kept is the share of good
documents among the labels, so the noise decides close calls only.

The raw model counts every word of every document. The target model counts at most ``TARGET_ROWS`` labelled documents,
those with the least hash of the id. A null text or one without words has weight 0; noise comes from a hash of the id
(and of the text, where the id is null), so equal rows are kept or left together unless the cut goes through them, and
then the whole tie is kept; without labels of both kinds everything is kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc_fold, hash_place, least_placed, map_batches, staged, top_by, utf8

BUCKETS = 10_000
TARGET_ROWS = 20_000
#: Labels whose crc32 of the id is 0 modulo this are left for held-out tests.
FOLDS = 5
#: Words remembered with their hashes per task.
MEMO_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """XXH64 of each word met in a task; the memo starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def ngram_buckets(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Buckets of all words and word pairs of a text, A-Z lower-cased."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * _MIX) ^ (h[1:] + _MIX)
    pairs ^= pairs >> np.uint64(29)
    return (np.concatenate((h, pairs * _MIX >> np.uint64(7))) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(batches):
    hashes, sums = WordHashes(), np.zeros((2, BUCKETS))
    for b in batches:
        for text, target in zip(utf8(b, "text"), b.column("target").to_pylist()):
            n = np.bincount(ngram_buckets(text, hashes), minlength=BUCKETS)
            sums[0] += n
            if target:
                sums[1] += n
    at = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at].astype(np.int64)), pa.array(sums[1][at].astype(np.int64))], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float] | None:
    """(log ratio per bucket, share of good labels); None without good labels."""
    known = labels.select(F.col("doc_id").alias("__id"), "quality").where("quality is not null and __id is not null").where(crc_fold(F.col("__id"), FOLDS) != 0)
    rows, n_good = known.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    if not n_good:
        return None
    share = n_good / rows
    good = known.where("quality = 1").select("__id").distinct()
    good = least_placed(good, hash_place(F.col("__id")), "__id", TARGET_ROWS, n_good).withColumn("target", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("__key"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(good), F.col("__key") == F.col("__id"), "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = map_batches(rows, _counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    table = np.zeros((2, BUCKETS))
    for bucket, raw, target in counts:
        table[:, bucket] = raw, target
    smooth = (table + 1) / (table.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(smooth[1]) - np.log(smooth[0]), share


def score(docs: DataFrame, ratio: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_weight, noisy): noisy adds the row's Gumbel noise."""
    noise = F.xxhash64(F.lit("gumbel"), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text)), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), noise.alias("noise"))

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            at = [ngram_buckets(t, hashes) for t in utf8(b, "text")]
            weight = np.array([ratio[x].sum() for x in at], float)
            u = (b.column("noise").to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) + 0.5
            noisy = weight - np.log(-np.log(u / 2.0**53))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, at), pa.int64()), pa.array(weight), pa.array(noisy)], names=["doc_id", "n_grams", "log_weight", "noisy"]
            )

    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n_grams long, log_weight double, noisy double").fields])
    return map_batches(rows, run, schema)


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_weight, noisy, kept): one row per row of ``docs``."""
    model = fit(docs, labels, doc_id, text)
    scored = score(docs, model[0] if model else np.zeros(BUCKETS), doc_id, text)
    if model is None:
        return scored.withColumn("kept", F.lit(True))
    scored = staged(scored, "weights")
    # Ranked by thousandths, so that radix histograms find the cut; equal thousandths are a tie.
    ranked = scored.withColumn("rank", F.floor(F.col("noisy") * 1000).cast("long"))
    bound = top_by(ranked, "rank", round(model[1] * scored.count()))
    return ranked.withColumn("kept", F.col("rank") >= F.lit(bound) if bound is not None else F.lit(True)).drop("rank")
