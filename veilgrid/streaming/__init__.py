"""Streaming twins of batch operators: each gives its batch twin's rows on the same, bounded, input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import order


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Event time must be a timestamp with a zone: times without one are taken in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def mask_stream(events: DataFrame, text: str = "props") -> DataFrame:
    """Rows with the prompt mask of a text column; stateless."""
    return events.withColumn("mask", order.mask(F.col(text)))


def class_sizes(events: DataFrame, qi: list[str], ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Class sizes by tumbling window; rows later than the watermark are left out, state older than it is dropped."""
    return _timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *qi).count().select(F.col("w.start").alias("start"), *qi, F.col("count").alias("size"))


def first_of_content(events: DataFrame, content: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row per content hash within the watermark."""
    hashed = _timed(events, ts).withColumn("content", F.sha2(F.concat_ws("\0", *(F.col(c).cast("string") for c in content)), 256))
    return hashed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["content"]) if events.isStreaming else hashed.dropDuplicates(["content"])
