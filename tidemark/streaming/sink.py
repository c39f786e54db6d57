"""Replay-safe table sink for update-mode streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def write_batches(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch overwrites its own ``batch_id=`` folder, so a replayed batch leaves no duplicates."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process what the source holds now and stop; restarting on the same checkpoint goes on from there."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last version of every key over all batches."""
    df = spark.read.parquet(path)
    values = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")


def late_rows(query: StreamingQuery) -> int:
    """Rows a finished query dropped because they were older than the watermark."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])
