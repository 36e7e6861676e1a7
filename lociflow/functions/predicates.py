"""The three meanings of "in the range", as boolean columns that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chromosome names that requests may use (fixed value).
CHROM = r"^chr([1-9]|1[0-9]|2[0-2]|X|Y|M|MT)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def start_in_range(start, lo, hi) -> Column:
    """The record begins in [lo, hi): what is served by default."""
    return (_c(start) >= _c(lo)) & (_c(start) < _c(hi))


def overlaps_touching(start, end, lo, hi) -> Column:
    """The record overlaps [lo, hi) or ends exactly at lo."""
    return (_c(start) < _c(hi)) & (_c(end) >= _c(lo))


def overlaps_strict(start, end, lo, hi) -> Column:
    """Half-open intervals that share a base."""
    return (_c(start) < _c(hi)) & (_c(end) > _c(lo))


def block_overlaps(start_chrom, start, end_chrom, end, q_chrom, lo, hi) -> Column:
    """Index blocks may span chromosomes: (chrom, base) compares in that order, and touching does not count."""
    q = _c(q_chrom)
    ends_before = (_c(end_chrom) < q) | ((_c(end_chrom) == q) & (_c(end) <= _c(lo)))
    starts_after = (_c(start_chrom) > q) | ((_c(start_chrom) == q) & (_c(start) >= _c(hi)))
    return ~ends_before & ~starts_after


def is_chrom(name) -> Column:
    return _c(name).rlike(CHROM)
