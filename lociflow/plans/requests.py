"""A table of requests on a signal, answered in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pyramid, resample
from ..operators.intervals import interval_join

#: Widths of the bins in which requests and records meet.
WIDTHS = [1 << 12, 1 << 16, 1 << 20, 1 << 24]


def records(requests: DataFrame, signal: DataFrame, levels: DataFrame, reductions: list[int], request: str = "id") -> DataFrame:
    """Each request's records (request, width, start, end, value), from the level that its width asks for.

    requests: (request, chr, start, end, width); levels: a pyramid's rows, or a
    table of them partitioned by reduction, of which only the levels in use are
    read. A level's bins and, for full resolution, the signal's records are
    served by where they start, as a single request is. Requests meet records in
    bins of positions, so a chromosome that all ask for is many tasks' work.
    """
    asked = requests.where("chr IS NOT NULL AND start < end").select(
        F.col(request).alias("__id"), "chr", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("width").cast("int").alias("width"),
        pyramid.reduction_for(F.col("end") - F.col("start"), F.col("width"), reductions).alias("reduction"),
    )
    start = F.col("start").cast("bigint")
    # a record is a point: it is served where it starts
    fine = signal.select("chr", F.lit(-1).alias("reduction"), start.alias("start"), (start + 1).alias("end"), F.col("end").cast("bigint").alias("stop"), F.col("value").cast("float").alias("value"))
    coarse = levels.where(F.col("reduction").isin(reductions)).select("chr", F.col("reduction").cast("int").alias("reduction"), start.alias("start"), (start + 1).alias("end"), (start + F.col("reduction")).alias("stop"), F.col("value").cast("float").alias("value"))
    met = interval_join(asked, fine.unionByName(coarse), ["chr", "reduction"], WIDTHS)
    return met.select(F.col("__id").alias(request), "width", F.col("r_start").alias("start"), F.col("r_stop").alias("end"), F.col("r_value").alias("value"))


def pixels(requests: DataFrame, signal: DataFrame, levels: DataFrame, reductions: list[int], request: str = "id") -> DataFrame:
    """(request, x, max, min) of all requests with a width, as each would be answered alone. Those of a width of 0 or less, and those without data, have no pixels; repeated ids are one request's."""
    return resample.to_width(records(requests.where("width > 0"), signal, levels, reductions, request), "width", [request])
