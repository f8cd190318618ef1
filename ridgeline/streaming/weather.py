"""Windowed aggregates over event streams, with watermarks for late rows; beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events, sum and largest value of each type per window."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total", "largest")
    )
