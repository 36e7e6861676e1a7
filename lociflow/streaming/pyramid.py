"""A zoom level kept up to date over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(points: DataFrame, time: str, value: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, extremes and sums of each window; points later than `late` no longer count."""
    grouped = points.withWatermark(time, late).groupBy(*by, F.window(time, width).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.min(value).alias("min_val"), F.max(value).alias("max_val"), F.sum(F.col(value).cast("decimal(18,4)")).alias("sum_data")).select(*by, F.col("w.start").alias("start"), "n", "min_val", "max_val", F.col("sum_data").cast("double").alias("sum_data"))
