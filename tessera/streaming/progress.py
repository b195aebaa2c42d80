"""Progress feeds as streams: counts and sums per kind and window, late rows within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """event_type, start, n, value of each window of a table or stream of events (ts, event_type, value)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    found = timed.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return found.select("event_type", F.col("w.start").alias("start"), "n", "value")
