"""Structured Streaming form of the hourly series and its all-or-nothing totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_means(stream: DataFrame, time: str, value: str, keys: list[str], lateness: str = "2 hours") -> DataFrame:
    """Mean, count per key and closed hour of a stream; rows later than the watermark are left out."""
    return (
        stream.withWatermark(time, lateness).groupBy(F.window(time, "1 hour"), *keys)
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
        .select(F.col("window.start").alias("hour"), *keys, "mean", "n")
    )


def complete_totals(stream: DataFrame, time: str, value: str, hours: int, lateness: str = "2 hours") -> DataFrame:
    """Sliding windows of whole hours: the sum of a value, null unless every hour of the window had a row.

    Rows are summed by closed hour first, so that a window counts its hours exactly.
    """
    hourly = stream.withWatermark(time, lateness).groupBy(F.window(time, "1 hour").alias("hour")).agg(F.sum(value).alias("s"))
    w = F.window(F.window_time("hour"), f"{hours} hours", "1 hour")
    return (
        hourly.groupBy(w.alias("w")).agg(F.count("*").alias("hours_there"), F.sum("s").alias("total"))
        .select(F.col("w.start").alias("start"), "hours_there", F.when(F.col("hours_there") == hours, F.col("total")).alias("total"))
    )
