"""Captures per host and time window, with late records allowed for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(captures: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per type and window of arrival; streams emit a window once the watermark has passed it."""
    timed = captures.withWatermark("ingested_at", late)
    return timed.groupBy(F.window("ingested_at", window).alias("w"), "type").agg(F.count("*").alias("records"), F.approx_count_distinct("url").alias("addresses")).select(F.col("w.start").alias("start"), "type", "records", "addresses")


def first_deliveries(captures: DataFrame, late: str = "7 days") -> DataFrame:
    """Each record once: deliveries of a record id repeated within the watermark are dropped."""
    return captures.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["record_id"])
