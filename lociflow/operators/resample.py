"""Resampling of a signal to a fixed number of pixels, with gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_width(signal: DataFrame, width: int | str, by: list[str] | None = None) -> DataFrame:
    """`width` rows (x, max, min) for each value of `by`, or none where there is nothing to draw.

    The axis is the data's own extent, from the first start to the end of the
    last record. A record counts in every pixel it reaches, and one that ends on
    a pixel's edge counts in the next as well. An empty pixel takes the maximum
    of the last filled one before it, or of the first one after. width may be a
    column that is the same in all rows of a value of `by`.
    """
    keys = list(by or [])
    if isinstance(width, int) and width <= 0:
        return signal.select(*keys, F.lit(0).alias("x"), F.col("value").alias("max"), F.col("value").alias("min")).limit(0)
    pixels = F.col(width) if isinstance(width, str) else F.lit(width)
    rows = signal.where("value IS NOT NULL AND NOT isnan(value)").withColumn("__all", F.lit(0)).withColumn("__width", pixels.cast("int")).where("__width > 0")
    group = ["__all", *keys]
    bounds = rows.groupBy(*group).agg(F.min("start").alias("lo"), F.max(F.struct("start", "end")).alias("last"), F.max("__width").alias("__pixels"))
    bounds = bounds.select(*group, "__pixels", F.col("lo").cast("double").alias("lo"), ((F.col("last.end") - F.col("lo")).cast("double") / F.col("__pixels")).alias("size")).where("size > 0")
    pixel = lambda c: F.greatest(F.lit(0), F.least(F.col("__pixels") - 1, F.floor((F.col(c) - F.col("lo")) / F.col("size")).cast("int")))
    hit = rows.join(bounds if keys else F.broadcast(bounds), group).select(*group, "value", pixel("start").alias("a"), pixel("end").alias("b")).where("a <= b")
    drawn = hit.select(*group, "value", F.explode(F.sequence("a", "b")).alias("x")).groupBy(*group, "x").agg(F.max("value").alias("mx"), F.min("value").alias("mn"))
    axis = bounds.select(*group, F.explode(F.sequence(F.lit(0), F.col("__pixels") - 1)).alias("x"))
    line = Window.partitionBy(*group).orderBy("x")
    before, after = F.last("mx", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.first("mx", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    fill = F.coalesce(before, after)
    return axis.join(drawn, [*group, "x"], "left").select(*keys, "x", F.coalesce("mx", fill).alias("max"), F.coalesce("mn", fill).alias("min"))
