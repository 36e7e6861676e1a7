"""Request validation: the first failing rule as struct(code, message, field), or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import is_chrom

CODE = "VALIDATION_ERROR"


def _rule(field: str, fails: Column, message) -> tuple[Column, Column]:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.coalesce(fails, F.lit(True)), F.struct(F.lit(CODE).alias("code"), text.alias("message"), F.lit(field).alias("field"))


def _first(rules) -> Column:
    out = None
    for fails, error in rules:
        out = F.when(fails, error) if out is None else out.when(fails, error)
    return out


# The texts of messages below are what clients of the service match on (fixed values).


def region_rules(chrom: Column, start: Column, end: Column) -> list:
    return [
        _rule("chrom", F.coalesce(chrom, F.lit("")) == "", "chrom is required"),
        _rule("chrom", ~is_chrom(chrom), F.concat(F.lit("invalid chromosome format: "), chrom)),
        _rule("start", start < 0, "start must be >= 0"),
        _rule("end", end <= start, "end must be greater than start"),
    ]


def url_rules(url: Column) -> list:
    """A URL is absolute (scheme) or an absolute path."""
    return [
        _rule("url", F.coalesce(url, F.lit("")) == "", "url is required"),
        _rule("url", ~(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$") | url.rlike(r"^/[^\s]*$")), F.concat(F.lit("invalid url: "), url)),
    ]


def signal_error(url: Column, chrom: Column, start: Column, end: Column, width: Column) -> Column:
    return _first([*url_rules(url), *region_rules(chrom, start, end), _rule("preRenderedWidth", F.coalesce(width, F.lit(0)) < 0, "preRenderedWidth must be >= 0")])


def feature_error(url: Column, chrom: Column, start: Column, end: Column) -> Column:
    return _first([*url_rules(url), *region_rules(chrom, start, end)])


def transcript_error(chrom: Column, start: Column, end: Column) -> Column:
    return _first(region_rules(chrom, start, end))


def browser_error(chrom: Column, start: Column, end: Column, tracks: Column) -> Column:
    return _first([*region_rules(chrom, start, end), _rule("tracks", F.coalesce(F.size(tracks), F.lit(0)) <= 0, "at least one track is required")])
