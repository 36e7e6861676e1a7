"""Region queries over signal and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

#: Modes of a region query: how a record must lie to the range.
MODES = ("start", "touching", "overlap")


def region(df: DataFrame, chrom: str, lo: int, hi: int, mode: str = "start") -> DataFrame:
    """Records of a region. The predicates are on plain columns, so they reach a Parquet scan and its row groups."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    hit = {"start": P.start_in_range("start", lo, hi), "touching": P.overlaps_touching("start", "end", lo, hi), "overlap": P.overlaps_strict("start", "end", lo, hi)}[mode]
    return df.where((F.col("chr") == chrom) & hit)


def with_chrom_id(df: DataFrame, chroms: DataFrame, strict: bool = True) -> DataFrame:
    """Joins the dictionary (chrom, id, size) on chr. Unknown names raise where strict, else the rows go."""
    names = chroms.select(F.col("chrom").alias("chr"), F.col("id").alias("chrom_id"))
    if not strict:
        return df.join(names, "chr")
    joined = df.join(names, "chr", "left")
    return joined.withColumn("chrom_id", F.when(F.col("chrom_id").isNull(), F.raise_error(F.concat(F.lit("unknown chromosome: "), "chr")).cast("int")).otherwise(F.col("chrom_id")))


def summary(signal: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bases covered, extremes and base-weighted sums of a signal, as the file summary has them."""
    bases = (F.col("end") - F.col("start")).cast("decimal(18,0)")
    value = F.col("value").cast("double").cast("decimal(18,4)")
    return signal.groupBy(*(by or [])).agg(
        F.sum((F.col("end") - F.col("start")).cast("bigint")).alias("bases_covered"),
        F.min(F.col("value").cast("double")).alias("min_val"),
        F.max(F.col("value").cast("double")).alias("max_val"),
        F.sum(value * bases).cast("double").alias("sum_data"),
        F.sum((value * value).cast("decimal(24,4)") * bases).cast("double").alias("sum_squares"),
    )


def cluster(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes records in (chr, start) order, so that a region query reads few row groups."""
    ordered = df.repartitionByRange(*([partitions] if partitions else []), "chr", "start").sortWithinPartitions("chr", "start", "end")
    ordered.write.mode("overwrite").parquet(path)
