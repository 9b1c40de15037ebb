"""Activity by day, from a table or a stream: the same query for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(day, event_type, n). On a stream, a day is final once the watermark has passed it; a table ignores that."""
    days = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.to_date("w.start").alias("day"), "event_type", "n")
