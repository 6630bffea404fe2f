"""Streams: change logs and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def compact_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path decides. changes: path, kind, seq."""
    return changes.groupBy("path").agg(F.max_by("kind", "seq").alias("kind"))


def watch(changes: DataFrame, apply, checkpoint: str, every: str = "500 milliseconds"):
    """Gathers changes for `every`, compacts them and hands deleted and changed paths to apply(deleted, changed, batch_id)."""
    def batch(df: DataFrame, batch_id: int) -> None:
        last = compact_changes(df)
        apply(last.where("kind = 'remove'").select("path"), last.where("kind <> 'remove'").select("path"), batch_id)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def tool_windows(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and mean latency by tool and window of event time; works on batches and streams."""
    rows = calls.withWatermark("ts", late) if calls.isStreaming else calls
    return rows.groupBy(F.window("ts", width).alias("w"), "tool_name").agg(F.count("*").alias("calls"), F.sum("latency_ms").alias("latency_ms")).select(F.col("w.start").alias("window_start"), "tool_name", "calls", F.round("latency_ms", 6).alias("latency_ms"))


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drives a stream over what is there now, into a memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
