"""Windowed features over event streams; an extension beyond the batch operators.

The same functions take a batch table and a stream, since both are DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_features(events: DataFrame, time: str = "ts", value: str = "value", keys: tuple[str, ...] = ("user_id",), length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum of each key and time window."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    window = F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "std", "minimum", "maximum")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Start, end and number of events of each session, runs of events less than ``gap`` apart."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
