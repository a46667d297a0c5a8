"""File streams, event-time windows and query handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from lodestar.functions.columns import epoch_ns_to_ts


def stream_json(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 5) -> DataFrame:
    """JSON file stream with a fixed schema and a bound on files per batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path))


def with_event_time(df: DataFrame, col: str, unit: str = "ns", name: str = "event_time") -> DataFrame:
    """Event time from an epoch column in ns, us, ms or s."""
    c = F.col(col)
    ts = {"ns": lambda: epoch_ns_to_ts(c), "us": lambda: F.timestamp_micros(c),
          "ms": lambda: F.timestamp_millis(c), "s": lambda: F.timestamp_seconds(c)}[unit]()
    return df.withColumn(name, ts)


def window_stats(df: DataFrame, time: str, width: str, keys: Sequence[str], aggs: Sequence[Column],
                 watermark: str | None = None) -> DataFrame:
    """Tumbling-window aggregates per key; the same plan serves batch and stream.

    With a watermark the stream can run in append mode and drop old state.
    """
    if watermark and df.isStreaming:
        df = df.withWatermark(time, watermark)
    out = df.groupBy(F.window(time, width).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys,
                      *[c for c in out.columns if c not in {"w", *keys}])


def start_memory_query(df: DataFrame, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Complete-mode query into an in-memory table; only for small results, it lives on the driver."""
    writer = (df.writeStream.queryName(name).format("memory").outputMode("complete")
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_snapshot_query(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Complete-mode query whose whole result is rewritten per batch as Parquet.

    A repeated batch overwrites its own folder, so a restart leaves no doubles.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_append_query(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append-mode Parquet sink for watermarked aggregates."""
    writer = df.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(query: StreamingQuery) -> int:
    """Wait until all available input is processed; return the last batch number."""
    query.awaitTermination() if not query.isActive else query.processAllAvailable()
    progress = query.lastProgress
    return progress["batchId"] if progress else -1


def stop(query: StreamingQuery) -> None:
    if query.isActive:
        query.stop()


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Result of the last finished batch of a snapshot query."""
    all_batches = spark.read.parquet(path)
    last = all_batches.agg(F.max("batch_id").alias("b")).first()["b"]
    return all_batches.filter(F.col("batch_id") == last).drop("batch_id")
