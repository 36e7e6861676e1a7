"""Zoom pyramid: a signal summed up at several reductions, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases a pixel from which a zoom level is used (fixed value).
THRESHOLD = 2.0


_SUMS = ("valid_count", "sum_data", "sum_squares")


def _bins(signal: DataFrame, reductions: list[int]) -> DataFrame:
    """chr, reduction, bin and what the records have there; sums are decimal."""
    level = F.explode(F.array(*map(F.lit, reductions))).alias("reduction")
    placed = signal.where("start < end").select("chr", "start", "end", F.col("value").cast("double").alias("v"), level)
    spread = placed.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / F.col("reduction")), F.floor((F.col("end") - 1) / F.col("reduction")))))
    lo = F.col("bin") * F.col("reduction")
    bases = F.least(F.col("end").cast("bigint"), lo + F.col("reduction")) - F.greatest(F.col("start").cast("bigint"), lo)
    exact = F.col("v").cast("decimal(18,4)")
    weight = F.col("bases").cast("decimal(12,0)")
    return (
        spread.withColumn("bases", bases)
        .groupBy("chr", "reduction", "bin")
        .agg(F.sum("bases").alias("valid_count"), F.min("v").alias("min_val"), F.max("v").alias("max_val"), F.sum(exact * weight).alias("sum_data"), F.sum((exact * exact).cast("decimal(24,4)") * weight).alias("sum_squares"))
    )


def build(signal: DataFrame, reductions: list[int]) -> DataFrame:
    """A row for each chr, reduction and bin with data: count of bases, extremes, sums and mean.

    A record counts in every bin it reaches with the bases it has there. It is
    spread over the bins of the finest level only; levels that are multiples of
    that are put together from its bins, so a record is not a row for each level,
    and a long one not a row for each bin of each level. Other levels are made
    from the records. Sums are decimal, so any order gives the same.
    """
    finest = min(reductions)
    multiples, others = [r for r in reductions if r % finest == 0], [r for r in reductions if r % finest]
    level = F.explode(F.array(*map(F.lit, multiples))).alias("of")
    fine = _bins(signal, [finest]).select("chr", "bin", *_SUMS, "min_val", "max_val", level)
    again = fine.groupBy("chr", F.col("of").alias("reduction"), F.floor(F.col("bin") * finest / F.col("of")).alias("bin"))
    out = again.agg(*(F.sum(c).alias(c) for c in _SUMS), F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"))
    if others:
        out = out.unionByName(_bins(signal, others))
    sums = [F.col(c).cast("double").alias(c) for c in _SUMS[1:]]
    told = out.select("chr", "reduction", (F.col("bin") * F.col("reduction")).alias("start"), "valid_count", "min_val", "max_val", *sums)
    return told.withColumn("value", mean(F.col("sum_data"), F.col("valid_count")))


def mean(total: Column, count: Column) -> Column:
    """float32 mean of a zoom record; 0 where nothing was counted."""
    return F.when(count == 0, F.lit(0.0)).otherwise(total / count).cast("float").cast("double")


def select_level(start: int, end: int, width: int, reductions: list[int]) -> int:
    """Index of the coarsest level that is no coarser than a pixel; -1 for full resolution."""
    per_pixel = (end - start) / width if width > 0 else 0.0
    fitting = [(r, -i) for i, r in enumerate(reductions) if r <= per_pixel and r > 0]
    return -max(fitting)[1] if fitting and per_pixel >= THRESHOLD else -1


def reduction_for(span: Column, width: Column, reductions: list[int]) -> Column:
    """The chosen reduction for a column of requests; -1 for full resolution."""
    per_pixel = F.when(width > 0, span / width)
    best = F.array_max(F.filter(F.array(*map(F.lit, reductions)), lambda r: r <= per_pixel))
    return F.when(per_pixel >= THRESHOLD, F.coalesce(best, F.lit(-1))).otherwise(F.lit(-1)).cast("int")


def write(pyramid: DataFrame, path: str) -> None:
    """One folder for each reduction, so a query reads the chosen level only."""
    pyramid.repartitionByRange("reduction", "chr", "start").sortWithinPartitions("chr", "start").write.mode("overwrite").partitionBy("reduction").parquet(path)


def read_level(spark, path: str, reduction: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("reduction") == reduction)
