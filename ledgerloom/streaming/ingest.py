"""Streams: files of transactions or events as they land, windows over events, stage records batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def landing(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def staged(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Each batch through step, written under its batch number: a batch that runs again replaces its own files. Without a trigger it takes what there is and ends."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): counts and sums by window; as a stream, windows close after the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n): runs of a user's events with gaps under `gap`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
