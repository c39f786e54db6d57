"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_dir

#: Rows of one Arrow batch: documents can be long, so a task holds few of them at once.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` that hands ``fn`` batches of at most ``rows`` rows (Spark bounds its own batches by bytes)."""

    def run(batches):
        return fn(part for b in batches for part in slices(b, rows))

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def slices_by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices whose values of a text column have no more than ``most`` bytes together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def word_count(text: Column) -> Column:
    """Number of maximal runs outside ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo ``k``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(k)).cast("int")


def hash_place(*cols: Column) -> Column:
    """Place of a row in [0, 1) by the hash of some columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(2.0**53)


def least_placed(df: DataFrame, place: Column, tie: str, k: int, rows: int) -> DataFrame:
    """The ``k`` rows of least place out of ``rows``; the others are thinned in the tasks, before any meet."""
    return df.where(place < 1.5 * (k + 50) / max(1, rows)).orderBy(place, tie).limit(k)


def top_by(df: DataFrame, key: str, k: int) -> int | None:
    """The ``k``-th largest value of a non-null long column, found by radix histograms without a sort.

    Four passes of 16 bits; each collects at most 65,536 counts. None if ``k`` is 0 or there are fewer rows.
    """
    if k <= 0:
        return None
    shifted = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    prefix, left = 0, k
    for level in range(4):
        shift = 48 - 16 * level
        high = F.shiftrightunsigned(shifted, shift)
        part = df if level == 0 else df.where(F.shiftrightunsigned(shifted, shift + 16) == F.lit(prefix))
        counts = part.groupBy(high.bitwiseAND(F.lit(0xFFFF)).alias("b")).count().collect()
        for row in sorted(counts, key=lambda r: -r["b"]):
            if row["count"] >= left:
                prefix = (prefix << 16) | row["b"]
                break
            left -= row["count"]
        else:
            return None
    return int(np.uint64(prefix ^ (1 << 63)).astype(np.int64))
