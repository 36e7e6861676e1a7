"""Work along a line in cells, so that a chromosome is many tasks' work.

A line is cut into cells of equal width. What a record needs from before or
behind its cell comes from a table of one row a cell, and that table alone is
read in order along the whole line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a cell where none is given.
WIDTH = 1 << 16


def with_cell(df: DataFrame, at: str, width: int) -> DataFrame:
    return df.withColumn("__cell", F.floor(F.col(at) / width))


def line(keys: list[str]):
    """The window of one row a cell along each line."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__cell")


def within(keys: list[str], *order):
    """The window of records inside a cell."""
    return Window.partitionBy(*keys, "__cell").orderBy(*order)


def join_cells(df: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns that cells has for each cell; null keys are a line of their own."""
    named = cells.select(*(F.col(k).alias(f"__of_{k}") for k in [*keys, "__cell"]), *(c for c in cells.columns if c not in (*keys, "__cell")))
    same: Column = F.col("__cell") == F.col("__of___cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return df.join(named, same).drop(*(f"__of_{k}" for k in [*keys, "__cell"]))
