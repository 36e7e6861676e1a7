"""Text to columns: region literals, attribute strings, feature columns, client addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_region(text: Column) -> Column:
    """struct(chrom, start, end) of "chr:start-end" with or without thousands commas; null if malformed."""
    form = r"^([^:]*):([^:-]*)-([^:-]*)$"
    number = lambda i: F.regexp_replace(F.regexp_extract(text, form, i), ",", "")
    digits = r"^\+?[0-9]+$"
    good = text.rlike(form) & number(2).rlike(digits) & number(3).rlike(digits)
    return F.when(good, F.struct(F.regexp_extract(text, form, 1).alias("chrom"), number(2).try_cast("bigint").alias("start"), number(3).try_cast("bigint").alias("end")))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each computed once a row however often and wherever it is used later.

    A projection is merged into those above it and into pushed filters, which
    then repeat its expressions; a generator is not.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def attribute_map(text: Column, strict: bool = False) -> Column:
    """GTF's ninth column as a map. Values of a repeated key are joined by commas, quotes do not protect a semicolon.

    A pair without a value raises where strict, and is left out where not. To
    read several keys of a map, make it with once().
    """
    items = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pair = lambda x: F.struct(F.substring_index(x, " ", 1).alias("k"), F.btrim(F.substr(x, F.instr(x, " ") + 1), F.lit('"')).alias("v"))

    def fold(p: Column) -> Column:
        keys, values = p["p"]["k"], p["p"]["v"]
        joined = F.transform(p["d"], lambda k: F.array_join(F.filter(values, lambda v, i: F.get(keys, i) == k), ","))
        return F.when(F.size(p["d"]) == F.size(p["p"]), F.map_from_arrays(keys, values)).otherwise(F.map_from_arrays(p["d"], joined))

    # a lambda's variable is computed once
    pairs = F.transform(F.array(items), lambda i: F.transform(F.filter(i, lambda x: F.instr(x, " ") > 0), pair))
    folded = F.transform(F.transform(pairs, lambda p: F.struct(p.alias("p"), F.array_distinct(p["k"]).alias("d"))), fold)[0]
    broken = F.exists(items, lambda x: F.instr(x, " ") == 0)
    return F.when(broken, F.raise_error(F.concat(F.lit("invalid attribute pair in: "), text)).cast("map<string,string>")).otherwise(folded) if strict else folded


def has_tag(tags: Column, tag: str = "MANE_Select") -> Column:
    """Whether tag is an element of the comma list."""
    return F.coalesce(F.array_contains(F.split(tags, ","), tag), F.lit(False))


def with_ccre_columns(features: DataFrame, strict: bool = True) -> DataFrame:
    """Seven typed columns from the tab-separated rest; what follows them stays in rest.

    Too few fields or a bad number raise where strict; else the row's new columns are null.
    """
    split = once(features, __fields=F.split("rest", "\t", 8))
    fields, enough = F.col("__fields"), F.size("__fields") >= 7
    number = (lambda i: fields[i].cast("int")) if strict else (lambda i: fields[i].try_cast("int"))
    if strict:
        split = split.where(F.when(enough, True).otherwise(F.raise_error(F.lit("too few fields in rest")).cast("boolean")))
    pick = lambda x: F.when(enough, x)
    return split.select(
        *(c for c in features.columns if c != "rest"),
        pick(F.coalesce(F.get(fields, F.lit(7)), F.lit(""))).alias("rest"),
        pick(F.get(fields, F.lit(0))).alias("name"),
        pick(number(1)).alias("score"),
        pick(F.get(fields, F.lit(2))).alias("strand"),
        pick(number(3)).alias("thick_start"),
        pick(number(4)).alias("thick_end"),
        pick(F.get(fields, F.lit(5))).alias("color"),
        pick(F.get(fields, F.lit(6))).alias("class"),
    )


def client_key(forwarded: Column, real_ip: Column, remote: Column) -> Column:
    """The first forwarded address, else the proxy's, else the peer's without its port."""
    present = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(present(forwarded), F.trim(F.split(forwarded, ",")[0])).when(present(real_ip), real_ip).otherwise(F.regexp_replace(F.coalesce(remote, F.lit("")), r":[^:]*$", ""))


def region_text(chrom: Column, start: Column, end: Column) -> Column:
    """"chr:start-end", which parse_region reads."""
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def track_key(url: Column, chrom: Column, level: Column) -> Column:
    """The name under which a track's rows of a chromosome are kept: "url-chrom" at full resolution (a level below 0 or null), "url-chrom-zoomN" at level N."""
    return F.concat_ws("-", url, chrom, F.when(level >= 0, F.concat(F.lit("zoom"), level.cast("string"))))


def hex_id(of: Column | None = None) -> Column:
    """Sixteen hexadecimal digits in four groups: at random, or the same for the same value of a column."""
    digits = F.md5(of.cast("string").cast("binary")) if of is not None else F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    return F.concat_ws("-", *(F.substring(digits, i, 4) for i in (1, 5, 9, 13)))
