"""Streaming forms of the history operators (beyond the reference, which has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_churn(changes: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Per file and window the number of commits and lines, from a stream of
    ``commit_id, ts, file_path, added, deleted``. A change that comes twice counts once."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    once = timed.dropDuplicatesWithinWatermark(["commit_id", "file_path"])
    return once.groupBy(F.window("ts", width), "file_path").agg(F.count("*").alias("commits"), F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"))


def append_changes(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Lands a change stream as Parquet that the batch operators read; exactly once."""
    return changes.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
