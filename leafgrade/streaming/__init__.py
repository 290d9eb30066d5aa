"""Continuous ingestion: page rows that arrive as files are scored as they come, and rolled up by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals


def page_stream(spark: SparkSession, folder: str, schema: str = "filename string, page_number long, text string, arrived timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def scored_stream(pages: DataFrame) -> DataFrame:
    """The garbled signal of each page; it needs no other row, so the stream has no state."""
    return signals.garbled(pages).select("filename", "page_number", "arrived", "garbled_score", "garbled_count", "total_words")


def flagged_by_window(scored: DataFrame, width: str = "10 minutes", late: str = "30 minutes", threshold: float = 0.85) -> DataFrame:
    """Pages and flagged pages of each window; rows later than `late` are dropped with the window's state."""
    return scored.withWatermark("arrived", late).groupBy(F.window("arrived", width).alias("w")).agg(F.count("*").alias("n_pages"), F.count_if(F.col("garbled_score") < threshold).alias("n_flagged")).select(F.col("w.start").alias("start"), "n_pages", "n_flagged")
