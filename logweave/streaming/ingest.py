"""Append-only ingest: new session files folded into event rows by Structured Streaming.

The file source sees new files only.  Files that are rewritten or removed need
:meth:`logweave.sources.store.SessionStore.sync`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.sources import logs


def line_stream(spark: SparkSession, root: str) -> DataFrame:
    """Whole files as they arrive, one row per line, numbered within the file."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.jsonl").load(f"{root.rstrip('/')}/*")
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return lines.select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.jsonl$", "").alias("sid"), F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def ingest_available(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Writes the events of all files that have arrived since the last run; exactly once by the checkpoint."""
    return logs.events(line_stream(spark, root)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def message_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Messages per window of event time; rows later than ``late`` are left out."""
    rows = events.withColumn("ts", F.to_timestamp("event_ts")).where(F.col("event_type").isin("user", "assistant"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("messages")).select("w.start", "w.end", "messages")
