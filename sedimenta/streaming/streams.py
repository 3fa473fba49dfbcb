"""Structured Streaming: mails classified as they arrive, records deduplicated across
batches, and trends by event time (an extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimenta.session import shared_folder


def arrivals(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def append_once(stream: DataFrame, keys: list[str], keep: Column, out: str, checkpoint: str, event_time: str | None = None, delay: str = "30 days") -> StreamingQuery:
    """Append rows that pass a filter, one for each key, as Parquet. The checkpoint replaces
    lists of what was done. With an event time, keys are forgotten after the delay, which
    bounds the state; without, all are kept."""
    s = stream.filter(keep)
    s = s.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys) if event_time else s.dropDuplicates(keys)
    return s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, label: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, label, n): counts by windows of event time; rows later than the watermark are
    left out."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), label).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), label, "n")


def session_counts(df: DataFrame, time: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, n): sessions of a key, closed by a gap."""
    g = df.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def into_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its result; for tests and queries."""
    at = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.table(name)
