"""Continuous ingest: a file stream whose micro-batches go through the store's sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..operators.sync import _named
from ..sources.readers import reader_for


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, format: str = "claude", pattern: str = "*.jsonl", source: str = "session", files_a_batch: int = 1000) -> StreamingQuery:
    """Index files that appear in a folder; a batch that is retried adds nothing twice, for ingest is idempotent."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_a_batch)).load(folder)

    def batch(df: DataFrame, epoch: int) -> None:
        listed = df.select(_named("path").alias("path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mtime"))
        paths = [r["path"] for r in df.select("path").collect()]  # at most files_a_batch names
        if paths:
            store.ingest(reader_for(format)(spark, paths).withColumn("source_path", _named("source_path")), listed, source)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming weekly event counts, weeks from Monday, with a watermark for late rows."""
    week = F.window("timestamp", "7 days", startTime="4 days")
    return events.withWatermark("timestamp", delay).groupBy(week.alias("week"), "tool_name").agg(F.count("*").alias("cnt")).select(F.col("week.start").alias("week_start"), "tool_name", "cnt")
