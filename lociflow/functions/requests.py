"""Requests as JSON text: decoded, with the defaults of what they leave out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import validation as V

#: The fields of requests for one track and for several; a track's config is read by the track's own type.
TRACK = "url string, chrom string, start bigint, `end` bigint, preRenderedWidth bigint, type string, paddingBp bigint"
BROWSER = "chrom string, start bigint, `end` bigint, tracks array<struct<id:string,type:string,config:string>>"


def decode(text: Column, form: str = TRACK) -> Column:
    """The request as a struct with absent numbers 0 and absent texts empty; null where the text is no JSON object of this form."""
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    got = F.from_json(text, form + ", __bad string", strict)
    filled = []
    for field in form.split(", "):
        name, kind = field.replace("`", "").split(" ", 1)
        value = got[name]
        filled.append((F.coalesce(value, F.lit(0).cast("bigint")) if kind == "bigint" else F.coalesce(value, F.lit("")) if kind == "string" else value).alias(name))
    return F.when(text.isNotNull() & got["__bad"].isNull() & got.isNotNull(), F.struct(*filled))


def track_config(config: Column) -> Column:
    """A track's own settings; a track without any has the defaults."""
    return F.coalesce(decode(F.coalesce(config, F.lit("{}"))), decode(F.lit("{}")))


def signal_request(text: Column) -> Column:
    """struct(request, error) of a request for a signal: what was asked, and what is wrong with it (null if nothing is)."""
    got = decode(text)
    bad = F.struct(F.lit("INVALID_JSON").alias("code"), F.lit("the request is not valid JSON").alias("message"), F.lit("").alias("field"))
    return F.struct(got.alias("request"), F.when(got.isNull(), bad).otherwise(V.signal_error(got["url"], got["chrom"], got["start"], got["end"], got["preRenderedWidth"])).alias("error"))
