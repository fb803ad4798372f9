"""Structured Streaming: event windows with late data, and documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import word_count
from quire.sources.plain import split_by_headings


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs a time with a zone; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) by tumbling window; works on batches and streams alike, on streams data later than ``late`` is dropped."""
    x = _timed(events, late)
    return x.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events no further apart than ``gap``."""
    x = _timed(events, late)
    return x.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def arriving_sections(docs: DataFrame) -> DataFrame:
    """Paragraphs of documents by section, without state, so that every new file is cut as it comes."""
    return split_by_headings(docs).withColumn("n_words", word_count(F.col("paragraph")))


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
