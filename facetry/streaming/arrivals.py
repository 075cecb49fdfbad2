"""Counting arrivals in event time. An addition: the work of this library is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticks(events: DataFrame, at: str = "ts", width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(tick, done) per tumbling window of a batch or a stream; a stream drops what is later than ``late``."""
    source = events.withWatermark(at, late) if events.isStreaming else events
    return source.groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("done")).select(F.col("w.start").alias("tick"), "done")
