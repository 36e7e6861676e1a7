"""Readers of binary track files as Spark data sources, and of GTF text."""

from .bigfile import BigBedSource, BigWigSource
from .gtf import IndexedGtfSource, read_gtf, read_indexed, write_indexed


def register(spark) -> None:
    """Makes format("bigwig"), format("bigbed") and format("indexed_gtf") known to the session."""
    spark.dataSource.register(BigWigSource)
    spark.dataSource.register(BigBedSource)
    spark.dataSource.register(IndexedGtfSource)


__all__ = ["BigBedSource", "BigWigSource", "IndexedGtfSource", "read_gtf", "read_indexed", "register", "write_indexed"]
