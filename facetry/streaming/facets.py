"""Facet counts over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_terms(events: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """How often each value occurs in each window of event time; a window is final once the watermark passes it."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), value).count()
    return counted.select(F.col("window.start").alias("start"), F.col(value).alias("value"), "count")
