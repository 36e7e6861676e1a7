"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as T
from .functions import parsing, predicates, validation
from .functions import requests as asking
from .operators import annotations, intervals, layout, pyramid, resample
from .operators import signal as signals
from .plans import requests
from .plans.browser import Browser, lines, union_tracks
from .plans.semantic_cache import cache_stats
from .sources import bigwriter, folders, gtf, regions, register
from .streaming import limits

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A region of the signal, and reductions of its pyramid.
CHROM, LO, HI = "chr19", 100_000, 900_000
REDUCTIONS = [600, 3600, 21600, 86400]

_SIG = """pts AS (SELECT 'chr' || (user_id % 22 + 1) AS chr, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s, value::FLOAT AS v, event_id FROM events),
sig AS (SELECT chr, s, e, v FROM (SELECT *, lead(s) OVER (PARTITION BY chr ORDER BY s, event_id) AS e FROM pts) WHERE e > s)"""
_FEAT = """feat AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chr, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS s,
  date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + floor(l_quantity)::BIGINT AS e, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus FROM lineitem)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _spans(df: DataFrame, *more) -> DataFrame:
    """Column names that SQL dialects accept, and types that compare."""
    return df.select("chr", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), *more)


def _value():
    return F.col("value").cast("double").alias("value")


@query(f"WITH {_SIG} SELECT chr, s AS start_pos, e AS end_pos, v::DOUBLE AS value FROM sig WHERE chr = '{CHROM}' AND s >= {LO} AND s < {HI}")
def signal_region(spark, sf_dir):
    return _spans(signals.region(T.signal(spark, sf_dir), CHROM, LO, HI), _value())


@query(f"WITH {_SIG} SELECT chr, s AS start_pos, e AS end_pos, v::DOUBLE AS value FROM sig WHERE chr = '{CHROM}' AND s < {HI} AND e >= {LO}")
def signal_region_touching(spark, sf_dir):
    return _spans(signals.region(T.signal(spark, sf_dir), CHROM, LO, HI, "touching"), _value())


@query(f"""WITH {_FEAT}, b AS (SELECT l_suppkey AS c, s // 256 AS k, min(s) AS s, max(e) AS e, count(*) AS n FROM feat GROUP BY ALL)
SELECT c AS chrom_id, s AS start_pos, e AS end_pos, n FROM b WHERE c = 7 AND NOT (e <= 1500 OR s >= 2500)""")
def block_overlap_strict(spark, sf_dir):
    blocks = T.features(spark, sf_dir).groupBy(F.col("l_suppkey").alias("chrom_id"), F.floor(F.col("start") / 256).alias("k")).agg(F.min("start").cast("bigint").alias("start_pos"), F.max("end").cast("bigint").alias("end_pos"), F.count("*").alias("n"))
    return blocks.where(predicates.block_overlaps("chrom_id", "start_pos", "chrom_id", "end_pos", 7, 1500, 2500)).drop("k")


@query(f"""WITH {_SIG}, z AS (SELECT chr, r, unnest(range(s // r, (e - 1) // r + 1)) AS bin, s, e, v::DOUBLE AS v FROM sig, (SELECT unnest({REDUCTIONS}) AS r)),
w AS (SELECT chr, r, bin, least(e, (bin + 1) * r) - greatest(s, bin * r) AS n, v, v::DECIMAL(18,4) AS d FROM z),
a AS (SELECT chr, r, bin, sum(n)::BIGINT AS valid_count, min(v) AS min_val, max(v) AS max_val, sum(d * n::DECIMAL(12,0))::DOUBLE AS sum_data, sum((d * d)::DECIMAL(24,4) * n::DECIMAL(12,0))::DOUBLE AS sum_squares FROM w GROUP BY ALL)
SELECT chr, r AS reduction, bin * r AS start_pos, valid_count, min_val, max_val, sum_data, sum_squares, (sum_data / valid_count)::FLOAT::DOUBLE AS value FROM a""")
def signal_zoom_pyramid(spark, sf_dir):
    return pyramid.build(T.signal(spark, sf_dir), REDUCTIONS).select("chr", "reduction", F.col("start").cast("bigint").alias("start_pos"), "valid_count", "min_val", "max_val", "sum_data", "sum_squares", "value")


@query(f"""WITH q AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS span, o_orderkey % 400 - 5 AS width FROM orders),
p AS (SELECT *, CASE WHEN width > 0 THEN span / width END AS bpp FROM q),
g AS (SELECT o_orderkey, max(CASE WHEN r <= bpp THEN r END) AS r, any_value(bpp) AS bpp FROM p, (SELECT unnest({REDUCTIONS[:2] + [60, 7]}) AS r) GROUP BY o_orderkey)
SELECT o_orderkey, CASE WHEN bpp >= 2.0 THEN coalesce(r, -1) ELSE -1 END::INTEGER AS reduction FROM g""")
def zoom_level_select(spark, sf_dir):
    asked = T.read(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("span"), (F.col("o_orderkey") % 400 - 5).alias("width"))
    return asked.select("o_orderkey", pyramid.reduction_for(F.col("span"), F.col("width"), REDUCTIONS[:2] + [60, 7]).alias("reduction"))


@query("""SELECT l_orderkey, l_linenumber, n, total, CASE WHEN n = 0 THEN 0.0 ELSE (total / n)::FLOAT::DOUBLE END AS value
FROM (SELECT l_orderkey, l_linenumber, sum(l_linenumber % 3)::BIGINT AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY ALL)""")
def zoom_mean_zero_count(spark, sf_dir):
    got = T.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_linenumber").cast("bigint") % 3).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total"))
    return got.withColumn("value", pyramid.mean(F.col("total"), F.col("n")))


def _resample_sql(by: str, where: str, width: int) -> str:
    return f"""WITH {_SIG}, d AS (SELECT * FROM sig WHERE {where}),
b AS (SELECT chr, min(s) AS lo, arg_max(e, s * 10000000 + e) AS hi FROM d GROUP BY chr),
k AS (SELECT chr, lo, (hi - lo)::DOUBLE / {width} AS size FROM b WHERE hi > lo),
h AS (SELECT d.chr, v, greatest(0, least({width - 1}, floor((s - lo) / size)::BIGINT)) AS a, greatest(0, least({width - 1}, floor((e - lo) / size)::BIGINT)) AS z FROM d JOIN k USING (chr)),
g AS (SELECT chr, x, max(v) AS mx, min(v) AS mn FROM (SELECT chr, v, unnest(range(a, z + 1)) AS x FROM h) GROUP BY ALL),
f AS (SELECT k.chr, t.x, g.mx, g.mn, coalesce(last_value(g.mx IGNORE NULLS) OVER (PARTITION BY k.chr ORDER BY t.x ROWS UNBOUNDED PRECEDING),
  first_value(g.mx IGNORE NULLS) OVER (PARTITION BY k.chr ORDER BY t.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fill
  FROM k CROSS JOIN (SELECT unnest(range({width})) AS x) t LEFT JOIN g ON g.chr = k.chr AND g.x = t.x)
SELECT {by} x::BIGINT AS x, coalesce(mx, fill)::DOUBLE AS max_val, coalesce(mn, fill)::DOUBLE AS min_val FROM f"""


def _pixels(df: DataFrame, *by) -> DataFrame:
    return df.select(*by, F.col("x").cast("bigint").alias("x"), F.col("max").cast("double").alias("max_val"), F.col("min").cast("double").alias("min_val"))


@query(_resample_sql("", "chr = 'chr1' AND s >= 0 AND s < 2000000", 400))
def signal_resample(spark, sf_dir):
    return _pixels(resample.to_width(signals.region(T.signal(spark, sf_dir), "chr1", 0, 2_000_000), 400))


@query(_resample_sql("chr,", "true", 200))
def signal_resample_all_chroms(spark, sf_dir):
    return _pixels(resample.to_width(T.signal(spark, sf_dir), 200, ["chr"]), "chr")


_ASKED = """q AS (SELECT o_orderkey AS id, 'chr' || (o_custkey % 22 + 1) AS chr, o_orderkey * 7919 % 1500000 AS lo, o_orderkey * 7919 % 1500000 + 20000 * (1 + o_orderkey % 60) AS hi, 4 + o_orderkey % 12 AS width FROM orders),
a AS (SELECT *, (hi - lo)::DOUBLE / width AS bpp FROM q)"""


@query(f"""WITH {_SIG}, {_ASKED}, l AS (SELECT a.*, CASE WHEN bpp >= 2.0 THEN coalesce((SELECT max(r) FROM (SELECT unnest({REDUCTIONS}) AS r) WHERE r <= bpp), -1) ELSE -1 END AS r FROM a),
z AS (SELECT chr, r, bin * r AS s, (bin + 1) * r AS e, (sum(v::DOUBLE::DECIMAL(18,4) * n::DECIMAL(12,0))::DOUBLE / sum(n))::FLOAT AS v FROM (
  SELECT chr, r, v, bin, least(e, (bin + 1) * r) - greatest(s, bin * r) AS n FROM (SELECT chr, r, v, s, e, unnest(range(s // r, (e - 1) // r + 1)) AS bin FROM sig, (SELECT unnest({REDUCTIONS}) AS r))) GROUP BY ALL),
d AS (SELECT id, width, s, e, v FROM l JOIN sig ON sig.chr = l.chr AND s >= lo AND s < hi WHERE r = -1 UNION ALL SELECT id, width, s, e, v FROM l JOIN z ON z.chr = l.chr AND z.r = l.r AND s >= lo AND s < hi),
b AS (SELECT id, any_value(width) AS width, min(s) AS lo, arg_max(e, s * 10000000 + e) AS hi FROM d GROUP BY id),
k AS (SELECT id, width, lo, (hi - lo)::DOUBLE / width AS size FROM b WHERE hi > lo),
h AS (SELECT d.id, v, greatest(0, least(k.width - 1, floor((s - lo) / size)::BIGINT)) AS a, greatest(0, least(k.width - 1, floor((e - lo) / size)::BIGINT)) AS z FROM d JOIN k USING (id)),
g AS (SELECT id, x, max(v) AS mx, min(v) AS mn FROM (SELECT id, v, unnest(range(a, z + 1)) AS x FROM h) GROUP BY ALL),
t AS (SELECT id, unnest(range(width)) AS x FROM k),
f AS (SELECT t.id, t.x, g.mx, g.mn, coalesce(last_value(g.mx IGNORE NULLS) OVER (PARTITION BY t.id ORDER BY t.x ROWS UNBOUNDED PRECEDING),
  first_value(g.mx IGNORE NULLS) OVER (PARTITION BY t.id ORDER BY t.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fill FROM t LEFT JOIN g ON g.id = t.id AND g.x = t.x)
SELECT id, x::BIGINT AS x, coalesce(mx, fill)::DOUBLE AS max_val, coalesce(mn, fill)::DOUBLE AS min_val FROM f""")
def signal_requests(spark, sf_dir):
    """A request of its own region and width for each order, all answered in one plan: level by row, records of that level, pixels."""
    k = F.col("o_orderkey")
    lo = k * 7919 % 1_500_000
    asked = T.read(spark, sf_dir, "orders").select(k.alias("id"), T.chrom_of("o_custkey").alias("chr"), lo.alias("start"), (lo + 20_000 * (1 + k % 60)).alias("end"), (4 + k % 12).alias("width"))
    rows = T.signal(spark, sf_dir)
    path = folders.scratch(spark, "pyramid")
    pyramid.write(pyramid.build(rows, REDUCTIONS), path)
    return _pixels(requests.pixels(asked, rows, spark.read.parquet(path), REDUCTIONS), "id")


@query(f"""WITH {_SIG} SELECT chr, sum(e - s)::BIGINT AS bases_covered, min(v::DOUBLE) AS min_val, max(v::DOUBLE) AS max_val,
sum(v::DOUBLE::DECIMAL(18,4) * (e - s)::DECIMAL(12,0))::DOUBLE AS sum_data, sum((v::DOUBLE::DECIMAL(18,4) * v::DOUBLE::DECIMAL(18,4))::DECIMAL(24,4) * (e - s)::DECIMAL(12,0))::DOUBLE AS sum_squares FROM sig GROUP BY chr""")
def file_total_summary(spark, sf_dir):
    return signals.summary(T.signal(spark, sf_dir), ["chr"])


@query(f"WITH {_FEAT} SELECT chr, s::BIGINT AS start_pos, e::BIGINT AS end_pos, l_orderkey, l_linenumber FROM feat WHERE chr = 'chr7' AND s >= 1500 AND s < 2500")
def feature_region(spark, sf_dir):
    return _spans(signals.region(T.features(spark, sf_dir), "chr7", 1500, 2500), "l_orderkey", "l_linenumber")


@query(f"""WITH {_FEAT} SELECT chr, s::BIGINT AS start_pos, e::BIGINT AS end_pos, l_partkey || chr(9) || l_suppkey AS rest, 'E' || l_orderkey || '_' || l_linenumber AS name, (l_linenumber * 10)::BIGINT AS score,
CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, s::BIGINT AS thick_start, e::BIGINT AS thick_end, '255,0,0' AS color, l_returnflag AS class FROM feat""")
def ccre_parse(spark, sf_dir):
    got = parsing.with_ccre_columns(T.features(spark, sf_dir).select("chr", "start", "end", "rest"))
    return _spans(got, "rest", "name", *(F.col(c).cast("bigint").alias(c) for c in ("score", "thick_start", "thick_end")), "strand", "color", "class")


@query(f"""WITH {_FEAT} SELECT chr, n_nationkey::BIGINT AS chrom_id, count(*) AS n, min(s)::BIGINT AS first_start FROM feat JOIN nation ON chr = 'chr' || n_nationkey GROUP BY ALL""")
def chrom_dictionary_join(spark, sf_dir):
    chroms = T.read(spark, sf_dir, "nation").select(F.concat(F.lit("chr"), "n_nationkey").alias("chrom"), F.col("n_nationkey").cast("bigint").alias("id"))
    rows = signals.with_chrom_id(T.features(spark, sf_dir), chroms, strict=False)
    return rows.groupBy("chr", "chrom_id").agg(F.count("*").alias("n"), F.min("start").cast("bigint").alias("first_start"))


def _part_text():
    return F.concat(F.lit('gene_id "P'), "p_partkey", F.lit('"; gene_type "'), "p_type", F.lit('"; tag "'), "p_brand", F.lit('"; tag "MANE_Select"; size '), "p_size", F.lit(";"))


@query("""SELECT p_partkey, k, string_agg(v, ',' ORDER BY n) AS v FROM (
  SELECT p_partkey, n, split_part(x, ' ', 1) AS k, trim(substr(x, position(' ' IN x) + 1), '"') AS v FROM (
    SELECT p_partkey, unnest(range(1, len(xs) + 1)) AS n, trim(unnest(xs)) AS x FROM (
      SELECT p_partkey, string_split('gene_id "P' || p_partkey || '"; gene_type "' || p_type || '"; tag "' || p_brand || '"; tag "MANE_Select"; size ' || p_size || ';', ';') AS xs FROM part)) WHERE x <> '')
GROUP BY p_partkey, k""")
def attribute_map_parse(spark, sf_dir):
    return T.read(spark, sf_dir, "part").select("p_partkey", F.explode(parsing.attribute_map(_part_text())).alias("k", "v"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'chr' || (o_custkey % 22 + 1) END AS chrom, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 1000 END AS start_pos,
CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 1000 + 1500 END AS end_pos FROM orders""")
def region_literal_parse(spark, sf_dir):
    lo, hi = F.format_number(F.col("o_orderkey") * 1000, 0), F.format_number(F.col("o_orderkey") * 1000 + 1500, 0)
    text = F.concat(F.lit("chr"), F.col("o_custkey") % 22 + 1, F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(":"), lo, F.lit("-"), hi)
    return T.read(spark, sf_dir, "orders").select("o_orderkey", parsing.parse_region(text).alias("r")).select("o_orderkey", "r.chrom", F.col("r.start").alias("start_pos"), F.col("r.end").alias("end_pos"))


@query("""SELECT o_orderkey, list_contains(string_split(CASE WHEN o_orderpriority = '1-URGENT' THEN 'basic,MANE_Select' WHEN o_orderpriority = '2-HIGH' THEN 'MANE_Select_2' ELSE 'basic' END, ','), 'MANE_Select') AS canonical FROM orders""")
def tag_canonical(spark, sf_dir):
    tags = F.when(F.col("o_orderpriority") == "1-URGENT", "basic,MANE_Select").when(F.col("o_orderpriority") == "2-HIGH", "MANE_Select_2").otherwise("basic")
    return T.read(spark, sf_dir, "orders").select("o_orderkey", parsing.has_tag(tags).alias("canonical"))


_EXON = """ex AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, l_linenumber AS number, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 1 AS t0,
  min(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 10) AS s, min(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 10) + max(floor(l_quantity)::BIGINT) AS e,
  count(*) FILTER (WHERE l_returnflag = 'R') AS n_utrs, count(*) FILTER (WHERE l_returnflag = 'A') AS n_cdss FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


@query(f"""WITH {_EXON}, e AS (SELECT o_custkey, count(*) AS n_exons, sum(n_utrs) AS u, sum(n_cdss) AS c FROM ex GROUP BY ALL),
t AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS m, min('T' || o_orderkey) AS f FROM orders GROUP BY ALL)
SELECT 'N' || c_custkey AS name, 'G' || c_custkey AS gene_id, c_mktsegment AS gene_type, CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand, coalesce(t.n, 0)::BIGINT AS n_transcripts, coalesce(t.m, 0)::BIGINT AS n_canonical,
coalesce(e.n_exons, 0)::BIGINT AS n_exons, coalesce(e.u, 0)::BIGINT AS n_utrs, coalesce(e.c, 0)::BIGINT AS n_cdss, t.f AS first_transcript
FROM customer LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN e ON e.o_custkey = c_custkey""")
def gene_fold_counts(spark, sf_dir):
    genes = annotations.fold_genes(T.records(spark, sf_dir))
    exons = F.flatten(F.transform("transcripts", lambda t: t["exons"]))
    total = lambda c: F.aggregate(exons, F.lit(0).cast("bigint"), lambda n, e: n + F.size(e[c]))
    return genes.select(
        "name", F.col("id").alias("gene_id"), F.col("type").alias("gene_type"), "strand", F.size("transcripts").cast("bigint").alias("n_transcripts"), F.size(F.filter("transcripts", lambda t: t["canonical"])).cast("bigint").alias("n_canonical"),
        F.size(exons).cast("bigint").alias("n_exons"), total("utrs").alias("n_utrs"), total("cdss").alias("n_cdss"), F.get(F.col("transcripts"), F.lit(0))["name"].alias("first_transcript"),
    )


@query(f"WITH {_EXON} SELECT 'T' || o_orderkey AS transcript, 'E' || o_orderkey || '.' || number AS exon_id, number, s::BIGINT AS start_pos, e::BIGINT AS end_pos, n_utrs, n_cdss FROM ex")
def exon_utr_cds_join(spark, sf_dir):
    got = annotations.exons_of(T.records(spark, sf_dir))
    return got.select(F.col("transcript_name").alias("transcript"), F.col("id").alias("exon_id"), "number", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), F.size("utrs").cast("bigint").alias("n_utrs"), F.size("cdss").cast("bigint").alias("n_cdss"))


@query(f"""WITH {_EXON}, n AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n, CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM ex JOIN customer ON c_custkey = o_custkey)
SELECT 'T' || o_orderkey AS transcript, number,
CASE WHEN o_orderstatus = 'F' AND (strand = '+' AND number = 1 OR strand = '-' AND number = n) THEN t0 + 10 END::BIGINT AS start_codon,
CASE WHEN o_orderstatus = 'F' AND (strand = '+' AND number = n OR strand = '-' AND number = 1) THEN t0 + 400 END::BIGINT AS stop_codon FROM n""")
def codon_assignment(spark, sf_dir):
    got = annotations.exons_of(T.records(spark, sf_dir))
    return got.select(F.col("transcript_name").alias("transcript"), "number", F.col("start_codon.start").cast("bigint").alias("start_codon"), F.col("stop_codon.start").cast("bigint").alias("stop_codon"))


@query(f"""WITH {_EXON}, t AS (SELECT o_custkey, count(*) AS n, min('T' || o_orderkey) AS f FROM orders GROUP BY ALL)
SELECT 'N' || c_custkey AS name, 'Gene' AS kind, CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand, coalesce(t.n, 0)::BIGINT AS n_transcripts, t.f AS first_name,
CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'MANE_Select' END AS first_tag, (date_diff('day', DATE '1992-01-01', o.o_orderdate::DATE) * 10 + 1)::BIGINT AS first_start
FROM customer LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN orders o ON 'T' || o.o_orderkey = t.f""")
def transcript_wire_json(spark, sf_dir):
    wire = annotations.wire_genes(annotations.fold_genes(T.records(spark, sf_dir)))
    of = lambda path: F.get_json_object("json", path)
    return wire.select(
        "name", of("$.__typename").alias("kind"), of("$.strand").alias("strand"), F.coalesce(F.json_array_length(of("$.transcripts")), F.lit(0)).cast("bigint").alias("n_transcripts"),
        of("$.transcripts[0].name").alias("first_name"), of("$.transcripts[0].tag").alias("first_tag"), of("$.transcripts[0].coordinates.start").cast("bigint").alias("first_start"),
    )


@query(f"""WITH RECURSIVE {_EXON}, o AS (SELECT o_custkey, o_orderkey, o_orderpriority, 'chr' || (o_custkey % 22 + 1) AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 1 AS s FROM orders),
t AS (SELECT k, o_orderkey, s - 100 AS ls, s + 599 AS le, row_number() OVER (PARTITION BY k ORDER BY s, 'X' || o_orderkey) AS n FROM o),
r(k, n, o_orderkey, line, ends) AS (SELECT k, n, o_orderkey, 0::BIGINT, [le::BIGINT] FROM t WHERE n = 1
  UNION ALL SELECT k, n, o_orderkey, coalesce(p - 1, len(ends))::BIGINT, CASE WHEN p IS NULL THEN list_append(ends, le::BIGINT) ELSE list_concat(list_concat(ends[:p - 1], [le::BIGINT]), ends[p + 1:]) END
  FROM (SELECT t.k, t.n, t.o_orderkey, t.le, r.ends, nullif(list_position(list_transform(r.ends, lambda x: x <= t.ls), true), 0) AS p FROM r JOIN t ON t.k = r.k AND t.n = r.n + 1)),
u AS (SELECT l_orderkey, l_linenumber, string_agg(a || '-' || (a + q), ',' ORDER BY a, q) AS utrs FROM (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 10 AS a, floor(l_quantity)::BIGINT AS q FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL),
x AS (SELECT o_orderkey, string_agg(s || '-' || e || '[' || coalesce(utrs, '') || ']', ';' ORDER BY number) AS exons FROM ex LEFT JOIN u ON l_orderkey = o_orderkey AND l_linenumber = number GROUP BY o_orderkey)
SELECT 'N' || o_custkey AS gene, 'T' || o_orderkey AS transcript, 'X' || o_orderkey AS id, o.s::BIGINT AS start_pos, (o.s + 499)::BIGINT AS end_pos, line AS row_no, CASE WHEN o_orderpriority = '1-URGENT' THEN 'MANE_Select' END AS tag, coalesce(exons, '') AS exons
FROM o JOIN r USING (o_orderkey) LEFT JOIN x USING (o_orderkey)""")
def transcript_wire_full(spark, sf_dir):
    """Every transcript of the genes' JSON: its row in the layout, tag, exons and their UTRs."""
    spot = "struct<start:bigint,`end`:bigint,__typename:string>"
    form = f"struct<transcripts:array<struct<coordinates:{spot},name:string,id:string,`row`:bigint,tag:string,exons:array<struct<coordinates:{spot},UTRs:array<struct<coordinates:{spot}>>>>>>>"
    wire = annotations.wire_genes(annotations.fold_genes(T.records(spark, sf_dir)))
    told = wire.select(F.col("name").alias("gene"), F.explode(F.from_json("json", form)["transcripts"]).alias("t"))
    place = lambda c: F.concat(c["start"].cast("string"), F.lit("-"), c["end"].cast("string"))
    exon = lambda e: F.concat(place(e["coordinates"]), F.lit("["), F.array_join(F.transform(e["UTRs"], lambda u: place(u["coordinates"])), ","), F.lit("]"))
    return told.select("gene", F.col("t.name").alias("transcript"), "t.id", F.col("t.coordinates.start").alias("start_pos"), F.col("t.coordinates.end").alias("end_pos"), F.col("t.row").alias("row_no"), "t.tag", F.array_join(F.transform("t.exons", exon), ";").alias("exons"))


def _customer_transcripts(spark, sf_dir) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) * 10
    return T.read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("id"), day.alias("start"), (day + 1 + F.col("o_orderkey") % 3000).alias("end"))


_PACK = """RECURSIVE t AS (SELECT o_custkey AS k, id, ls, le, row_number() OVER (PARTITION BY o_custkey ORDER BY ls, le, id) AS n FROM (
  SELECT o_custkey, o_orderkey::VARCHAR AS id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 - 100 AS ls,
    date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 1 + o_orderkey % 3000 + 100 AS le FROM orders)),
r(k, n, id, line, ends) AS (SELECT k, n, id, 0::BIGINT, [le::BIGINT] FROM t WHERE n = 1
  UNION ALL SELECT k, n, id, coalesce(p - 1, len(ends))::BIGINT,
    CASE WHEN p IS NULL THEN list_append(ends, le::BIGINT) ELSE list_concat(list_concat(ends[:p - 1], [le::BIGINT]), ends[p + 1:]) END
  FROM (SELECT t.k, t.n, t.id, t.le, r.ends, nullif(list_position(list_transform(r.ends, lambda x: x <= t.ls), true), 0) AS p FROM r JOIN t ON t.k = r.k AND t.n = r.n + 1))"""


@query(f"WITH {_PACK} SELECT k AS o_custkey, id, line::INTEGER AS row_no FROM r")
def transcript_pack_rows(spark, sf_dir):
    return layout.pack_rows(_customer_transcripts(spark, sf_dir), ["o_custkey"]).withColumnRenamed("row", "row_no")


@query(f"WITH {_PACK} SELECT k AS o_custkey, (max(line) + 1)::INTEGER AS total_rows FROM r GROUP BY k")
def layout_total_rows(spark, sf_dir):
    return layout.total_rows(layout.pack_rows(_customer_transcripts(spark, sf_dir), ["o_custkey"]), ["o_custkey"])


@query(f"""WITH {_FEAT}, i AS (SELECT *, CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END AS b FROM (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM feat)),
j AS (SELECT *, sum(b) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM i)
SELECT l_suppkey, min(s)::BIGINT AS start_pos, max(e)::BIGINT AS end_pos, count(*) AS n FROM j GROUP BY l_suppkey, k""")
def range_merge(spark, sf_dir):
    got = intervals.merge(T.features(spark, sf_dir), ["l_suppkey"], width=128)
    return got.select("l_suppkey", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), "n")


_RANGES = "rg AS (SELECT o_custkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 30 + o_orderkey % 90 AS e FROM orders)"


def _ranges(spark, sf_dir) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint")
    return T.read(spark, sf_dir, "orders").select("o_custkey", day.alias("start"), (day + 30 + F.col("o_orderkey") % 90).alias("end"))


@query(f"""WITH {_RANGES}, q AS (SELECT c_custkey, 1000 + c_custkey % 500 AS lo, 3000 + c_custkey % 300 AS hi FROM customer),
c AS (SELECT c_custkey, greatest(s, lo) AS s, least(e, hi) AS e FROM q JOIN rg ON o_custkey = c_custkey WHERE s < hi AND e > lo UNION ALL SELECT c_custkey, lo, lo FROM q UNION ALL SELECT c_custkey, hi, hi FROM q),
g AS (SELECT *, max(e) OVER (PARTITION BY c_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c)
SELECT c_custkey AS o_custkey, m AS start_pos, s AS end_pos FROM g WHERE s > m""")
def range_remainder(spark, sf_dir):
    asked = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.col("c_custkey").alias("o_custkey"), (1000 + F.col("c_custkey") % 500).alias("start"), (3000 + F.col("c_custkey") % 300).alias("end"))
    return intervals.remainder(asked, _ranges(spark, sf_dir), ["o_custkey"], "request").select(F.col("request").alias("o_custkey"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query(f"WITH {_SIG} SELECT DISTINCT chr, s AS start_pos, e AS end_pos, v::DOUBLE AS value FROM sig WHERE s >= {LO} AND s < {HI}")
def cache_seam_union(spark, sf_dir):
    rows = T.signal(spark, sf_dir)
    fetched = [rows.where(predicates.overlaps_touching("start", "end", lo, hi)) for lo, hi in ((LO, 400_000), (400_000, HI))]
    kept = fetched[0].unionByName(fetched[1]).where(predicates.start_in_range("start", LO, HI)).dropDuplicates()
    return _spans(kept, _value())


@query("""WITH k AS (SELECT o_orderpriority AS key, count(*) AS ranges, max(o_custkey % 50) AS n FROM orders GROUP BY ALL),
b AS (SELECT key, ranges, n, octet_length(encode(key)) + 40 + ranges * 40 + n * 32 AS bytes FROM k)
SELECT key, count(*) AS entries, sum(ranges)::BIGINT AS ranges, sum(n)::BIGINT AS n, sum(bytes)::BIGINT AS bytes FROM b GROUP BY ROLLUP (key)""")
def cache_stats_by_key(spark, sf_dir):
    return cache_stats(T.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), (F.col("o_custkey") % 50).alias("rows"))).withColumnRenamed("rows", "n")


@query(f"""WITH {_FEAT}, r AS (SELECT *, row_number() OVER () AS n FROM feat) SELECT a.l_partkey, a.l_orderkey AS order_a, b.l_orderkey AS order_b, count(*) AS n
FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.s < b.e AND b.s < a.e GROUP BY ALL""")
def interval_join(spark, sf_dir):
    """Orders whose line items of the same part overlap in time, all line items against all."""
    rows = T.features(spark, sf_dir).select("l_partkey", "start", "end", "l_orderkey")
    met = intervals.interval_join(rows.withColumnRenamed("l_orderkey", "order_a"), rows, ["l_partkey"], 64)
    return met.groupBy("l_partkey", "order_a", F.col("r_l_orderkey").alias("order_b")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT event_id, user_id, event_type, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s FROM events),
j AS (SELECT a.event_id, b.event_id AS nearest_id, abs(a.s - b.s) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.s - b.s), b.event_id) AS n
  FROM p a JOIN p b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'view')
SELECT a.event_id, j.nearest_id, j.distance::BIGINT AS distance FROM p a LEFT JOIN j ON j.event_id = a.event_id AND j.n = 1 WHERE a.event_type = 'purchase'""")
def nearest_point(spark, sf_dir):
    every = T.points(spark, sf_dir)
    bought, seen = every.where("event_type = 'purchase'").select("event_id", "user_id", "start"), every.where("event_type = 'view'")
    got = intervals.nearest(bought, seen, ["user_id"], "start", "start", "event_id", "value")
    return got.select("event_id", "nearest_id", F.col("distance").cast("bigint").alias("distance"))


@query(f"""WITH q AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'no url' WHEN 2 THEN '/data/a.bw' ELSE 'https://example.org/a.bw' END AS url,
  CASE WHEN o_custkey % 27 = 26 THEN '' ELSE 'chr' || (o_custkey % 27) END AS chrom, o_orderkey % 50 - 3 AS s, o_orderkey % 50 - 3 + o_orderkey % 4 - 1 AS e, o_orderkey % 11 - 1 AS w FROM orders)
SELECT o_orderkey, CASE WHEN url = '' OR url = 'no url' THEN 'url' WHEN chrom = '' OR NOT regexp_matches(chrom, '{predicates.CHROM}') THEN 'chrom'
  WHEN s < 0 THEN 'start' WHEN e <= s THEN 'end' WHEN w < 0 THEN 'preRenderedWidth' END AS field,
 CASE WHEN url = '' THEN 'url is required' WHEN url = 'no url' THEN 'invalid url: no url' WHEN chrom = '' THEN 'chrom is required'
  WHEN NOT regexp_matches(chrom, '{predicates.CHROM}') THEN 'invalid chromosome format: ' || chrom
  WHEN s < 0 THEN 'start must be >= 0' WHEN e <= s THEN 'end must be greater than start' WHEN w < 0 THEN 'preRenderedWidth must be >= 0' END AS message FROM q""")
def request_validation(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    url = F.when(k % 7 == 0, "").when(k % 7 == 1, "no url").when(k % 7 == 2, "/data/a.bw").otherwise("https://example.org/a.bw")
    chrom = F.when(c % 27 == 26, "").otherwise(F.concat(F.lit("chr"), c % 27))
    start = k % 50 - 3
    error = validation.signal_error(url, chrom, start, start + k % 4 - 1, k % 11 - 1)
    return T.read(spark, sf_dir, "orders").select("o_orderkey", error.alias("e")).select("o_orderkey", "e.field", "e.message")


@query(f"""WITH {_SIG}, {_FEAT} SELECT 'sig' AS track, 'bigwig' AS type, s::BIGINT AS start_pos, e::BIGINT AS end_pos FROM sig WHERE chr = 'chr7' AND s >= 1500 AND s < 250000
UNION ALL SELECT 'feat', 'bigbed', s::BIGINT, e::BIGINT FROM feat WHERE chr = 'chr7' AND s >= 1500 AND s < 250000""")
def browser_fan_in(spark, sf_dir):
    tracks = {("sig", "bigwig"): signals.region(T.signal(spark, sf_dir), "chr7", 1500, 250_000), ("feat", "bigbed"): signals.region(T.features(spark, sf_dir), "chr7", 1500, 250_000)}
    of = lambda c: F.get_json_object("data", f"$.{c}").cast("bigint")
    return union_tracks(tracks).select("track", "type", of("start").alias("start_pos"), of("end").alias("end_pos"))


@query(f"""WITH q AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 27 = 26 THEN '' ELSE 'chr' || (o_custkey % 27) END AS chrom, o_orderkey % 50 AS s, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 50 + 7 END AS e, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 11 END AS w, o_orderkey % 13 = 0 AS broken FROM orders)
SELECT k AS o_orderkey, CASE WHEN NOT broken THEN chrom END AS chrom, CASE WHEN NOT broken THEN s END AS start_pos, CASE WHEN NOT broken THEN e END AS end_pos, CASE WHEN NOT broken THEN w END AS width,
CASE WHEN broken THEN 'INVALID_JSON' WHEN chrom = '' OR NOT regexp_matches(chrom, '{predicates.CHROM}') OR e <= s THEN 'VALIDATION_ERROR' END AS code FROM q""")
def request_decode(spark, sf_dir):
    """A JSON request for each order, some of them broken or without an end or a width, decoded and checked."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit('{"url": "/data/a.bw", "chrom": "'), F.when(c % 27 == 26, "").otherwise(F.concat(F.lit("chr"), c % 27)), F.lit('", "start": '), k % 50,
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(', "end": '), k % 50 + 7)), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(', "preRenderedWidth": '), k % 11)), F.when(k % 13 == 0, ', "x": [').otherwise("}"),
    )
    got = T.read(spark, sf_dir, "orders").select("o_orderkey", asking.signal_request(text).alias("r"))
    return got.select("o_orderkey", "r.request.chrom", F.col("r.request.start").alias("start_pos"), F.col("r.request.end").alias("end_pos"), F.col("r.request.preRenderedWidth").alias("width"), "r.error.code")


@query("""SELECT o_orderkey, '/data/' || o_orderpriority || '.bw-chr' || (o_custkey % 22 + 1) || CASE WHEN o_orderkey % 5 > 0 THEN '-zoom' || (o_orderkey % 5 - 1) ELSE '' END AS track_key,
'chr' || (o_custkey % 22 + 1) || ':' || o_orderkey || '-' || (o_orderkey + 500) AS region, substr(h, 1, 4) || '-' || substr(h, 5, 4) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) AS hex_id
FROM (SELECT *, md5(o_orderkey::VARCHAR) AS h FROM orders)""")
def key_formats(spark, sf_dir):
    k = F.col("o_orderkey")
    url, chrom = F.concat(F.lit("/data/"), "o_orderpriority", F.lit(".bw")), T.chrom_of("o_custkey")
    return T.read(spark, sf_dir, "orders").select(k, parsing.track_key(url, chrom, k % 5 - 1).alias("track_key"), parsing.region_text(chrom, k, k + 500).alias("region"), parsing.hex_id(k).alias("hex_id"))


_VIEW = ("chr7", 2000, 2300)


def _browser(spark, sf_dir) -> Browser:
    path = folders.scratch(spark, "pyramid")
    pyramid.write(pyramid.build(T.signal(spark, sf_dir), REDUCTIONS), path)
    return Browser(spark, "", lambda s, url: T.signal(s, sf_dir), lambda s, url: T.features(s, sf_dir).select("chr", "start", "end", "rest"), lambda s, path: T.records(s, sf_dir), {"/zoomed": (path, REDUCTIONS)})


@query(f"""WITH {_FEAT}, {_EXON}, g AS (SELECT * FROM orders WHERE 'chr' || (o_custkey % 22 + 1) = 'chr7' AND date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 < 2300 AND date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 500 > 2000)
SELECT 'features' AS track, 'bigbed' AS type, 'E' || l_orderkey || '_' || l_linenumber AS name, s::BIGINT AS start_pos, e::BIGINT AS end_pos FROM feat WHERE chr = 'chr7' AND s >= 2000 AND s < 2300
UNION ALL SELECT 'genes', 'transcript', 'T' || o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 1, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 500 FROM g
UNION ALL SELECT 'other', 'nothing', 'unknown track type: nothing', NULL, NULL""")
def browser_answer(spark, sf_dir):
    """A request for several tracks as text that is streamed, taken apart again: typed features, transcripts of the region's genes, and a track that fails."""
    tracks = [{"id": "features", "type": "bigbed", "config": {"url": "/x", "type": "ccre"}}, {"id": "genes", "type": "transcript"}, {"id": "other", "type": "nothing"}]
    text = "".join(_browser(spark, sf_dir).stream({"chrom": _VIEW[0], "start": _VIEW[1], "end": _VIEW[2], "tracks": tracks}))
    told = spark.createDataFrame([(text,)], "text string")  # one answer, which Spark made of the tables
    each = told.select(F.explode(F.from_json("text", "array<struct<id:string,type:string,data:string,error:string>>")).alias("t")).select("t.*")
    row = "array<struct<name:string,start:bigint,`end`:bigint>>"
    features = each.where("type = 'bigbed'").select(F.col("id").alias("track"), "type", F.explode(F.from_json("data", row)).alias("r")).select("track", "type", "r.name", F.col("r.start").alias("start_pos"), F.col("r.end").alias("end_pos"))
    tree = "struct<gene:array<struct<transcripts:array<struct<name:string,coordinates:struct<start:bigint,`end`:bigint>>>>>>"
    genes = each.where("type = 'transcript'").select(F.col("id").alias("track"), "type", F.explode(F.flatten(F.from_json("data", tree)["gene"]["transcripts"])).alias("r"))
    genes = genes.select("track", "type", "r.name", F.col("r.coordinates.start").alias("start_pos"), F.col("r.coordinates.end").alias("end_pos"))
    failed = each.where("error IS NOT NULL").select(F.col("id").alias("track"), "type", F.col("error").alias("name"), F.lit(None).cast("bigint").alias("start_pos"), F.lit(None).cast("bigint").alias("end_pos"))
    return features.unionByName(genes).unionByName(failed)


@query(_resample_sql("", "chr = 'chr5' AND s >= 0 AND s < 2400000", 30).replace(_SIG, f"""pts AS (SELECT 'chr' || (user_id % 22 + 1) AS chr, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s, value::FLOAT AS v, event_id FROM events),
raw AS (SELECT chr, s, e, v FROM (SELECT *, lead(s) OVER (PARTITION BY chr ORDER BY s, event_id) AS e FROM pts) WHERE e > s),
sig AS (SELECT chr, bin * {REDUCTIONS[2]} AS s, (bin + 1) * {REDUCTIONS[2]} AS e, (sum(v::DOUBLE::DECIMAL(18,4) * n::DECIMAL(12,0))::DOUBLE / sum(n))::FLOAT AS v FROM (
  SELECT chr, v, bin, least(e, (bin + 1) * {REDUCTIONS[2]}) - greatest(s, bin * {REDUCTIONS[2]}) AS n FROM (SELECT *, unnest(range(s // {REDUCTIONS[2]}, (e - 1) // {REDUCTIONS[2]} + 1)) AS bin FROM raw)) GROUP BY ALL)"""))
def browser_zoomed_signal(spark, sf_dir):
    """A request with a width, which is answered from the level of the pyramid that fits it, streamed as JSON lines and read again."""
    answer = _browser(spark, sf_dir).signal("/zoomed", "chr5", 0, 2_400_000, 30)  # 80 000 bases a pixel: the level of 21 600
    text = spark.createDataFrame([(line,) for line in lines(answer)], "line string")  # a row a pixel
    return text.select(F.from_json("line", "x bigint, max double, min double").alias("r")).select("r.x", F.col("r.max").cast("float").cast("double").alias("max_val"), F.col("r.min").cast("float").cast("double").alias("min_val"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.0.' || user_id || '.1' WHEN 1 THEN '10.9.' || user_id || '.2' ELSE '192.168.0.' || user_id END AS client FROM events""")
def client_key_extract(spark, sf_dir):
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    forwarded = F.when(k == 0, F.concat(F.lit(" 10.0."), u, F.lit(".1 , 1.1.1.1")))
    real = F.when(k == 1, F.concat(F.lit("10.9."), u, F.lit(".2"))).otherwise("")
    return T.read(spark, sf_dir, "events").select("event_id", parsing.client_key(forwarded, real, F.concat(F.lit("192.168.0."), u, F.lit(":8080"))).alias("client"))


@query("""WITH RECURSIVE p AS (SELECT user_id, event_id, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY date_diff('second', TIMESTAMP '2024-01-01', ts), event_id) AS n FROM events),
r(user_id, n, event_id, s, tokens, allowed) AS (SELECT user_id, n, event_id, s, (3 * 60000 - 60000)::BIGINT, true FROM p WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, s, (t - CASE WHEN t >= 60000 THEN 60000 ELSE 0 END)::BIGINT, t >= 60000 FROM (
    SELECT p.user_id, p.n, p.event_id, p.s, least(3 * 60000, r.tokens + p.s - r.s) AS t FROM r JOIN p ON p.user_id = r.user_id AND p.n = r.n + 1))
SELECT user_id, event_id, allowed FROM r""")
def token_bucket(spark, sf_dir):
    return limits.token_bucket(T.points(spark, sf_dir).select("user_id", F.col("start").alias("at"), "event_id"), "user_id", "at", "event_id", rate=1, burst=3, per=60_000)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS opened, count(*) AS requests FROM k GROUP BY user_id, k""")
def idle_sessions(spark, sf_dir):
    return limits.sessions(T.read(spark, sf_dir, "events"), "user_id", "ts", "6 hours").select("user_id", "opened", "requests")


@query(f"""WITH {_FEAT}, e AS (SELECT l_suppkey, s AS p, 1 AS d FROM feat WHERE e > s UNION ALL SELECT l_suppkey, e, -1 FROM feat WHERE e > s),
a AS (SELECT l_suppkey, p, sum(d) AS d FROM e GROUP BY ALL) SELECT l_suppkey, max(n)::BIGINT AS depth FROM (SELECT l_suppkey, sum(d) OVER (PARTITION BY l_suppkey ORDER BY p) AS n FROM a) GROUP BY l_suppkey""")
def coverage_depth(spark, sf_dir):
    return intervals.depth(T.features(spark, sf_dir), ["l_suppkey"], width=128)


def _bigwig(spark, sf_dir, **options) -> DataFrame:
    """The signal written as bigWig files by tasks, read again."""
    register(spark)
    path = folders.scratch(spark, "bigwig")
    bigwriter.write_bigwig(T.signal(spark, sf_dir), path, REDUCTIONS[1:3])
    return spark.read.format("bigwig").options(**options).load(path)


@query(f"WITH {_SIG} SELECT chr, s AS start_pos, e AS end_pos, v::DOUBLE AS value FROM sig")
def bigwig_round_trip(spark, sf_dir):
    return _spans(_bigwig(spark, sf_dir), _value())


@query(f"WITH {_SIG} SELECT chr, s AS start_pos, e AS end_pos, v::DOUBLE AS value FROM sig WHERE chr = '{CHROM}' AND s < {HI} AND e >= {LO}")
def bigwig_region(spark, sf_dir):
    """Only blocks that the index finds are read."""
    return _spans(_bigwig(spark, sf_dir, chrom=CHROM, start=LO, end=HI), _value())


@query(f"""WITH {_SIG}, z AS (SELECT chr, unnest(range(s // {REDUCTIONS[1]}, (e - 1) // {REDUCTIONS[1]} + 1)) AS bin, s, e, v FROM sig)
SELECT chr, bin * {REDUCTIONS[1]} AS start_pos, sum(least(e, (bin + 1) * {REDUCTIONS[1]}) - greatest(s, bin * {REDUCTIONS[1]}))::BIGINT AS valid_count, min(v)::DOUBLE AS min_val, max(v)::DOUBLE AS max_val FROM z GROUP BY ALL""")
def bigwig_zoom_level(spark, sf_dir):
    """A zoom level of the files; a bin that two files share is put together."""
    rows = _bigwig(spark, sf_dir, zoom=0).groupBy("chr", F.col("start").cast("bigint").alias("start_pos"))
    return rows.agg(F.sum("valid_count").alias("valid_count"), F.min("min").cast("double").alias("min_val"), F.max("max").cast("double").alias("max_val"))


@query(f"WITH {_SIG} SELECT chr AS chrom, max(e)::BIGINT AS size FROM sig GROUP BY chr")
def bigwig_chromosomes(spark, sf_dir):
    return _bigwig(spark, sf_dir, view="chroms").groupBy("chrom").agg(F.max("size").cast("bigint").alias("size"))


@query(f"WITH {_SIG} SELECT sum(e - s)::BIGINT AS bases_covered, min(v)::DOUBLE AS min_val, max(v)::DOUBLE AS max_val FROM sig")
def bigwig_summary(spark, sf_dir):
    """The summaries in the files' headers, put together."""
    return _bigwig(spark, sf_dir, view="summary").agg(F.sum("bases_covered").alias("bases_covered"), F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"))


@query(SQL["ccre_parse"])
def bigbed_round_trip(spark, sf_dir):
    """Features written as bigBed files by tasks, read again and parsed."""
    register(spark)
    path = folders.scratch(spark, "bigbed")
    bigwriter.write_bigbed(T.features(spark, sf_dir), path)
    got = parsing.with_ccre_columns(spark.read.format("bigbed").load(path))
    return _spans(got, "rest", "name", *(F.col(c).cast("bigint").alias(c) for c in ("score", "thick_start", "thick_end")), "strand", "color", "class")


@query(f"""WITH {_SIG}, q AS (SELECT o_orderkey, 'chr' || (o_custkey % 22 + 1) AS chr, o_orderkey * 7919 % 2000000 AS lo, o_orderkey * 7919 % 2000000 + 500 + o_orderkey % 2000 AS hi FROM orders)
SELECT o_orderkey, count(*) AS n, min(s)::BIGINT AS first_start, max(v)::DOUBLE AS max_val FROM q JOIN sig ON sig.chr = q.chr AND s < hi AND e >= lo GROUP BY o_orderkey""")
def bigwig_many_regions(spark, sf_dir):
    """A region for each order against the files of the signal: indexes as a table, each block that any region needs fetched once, no region paired with its records."""
    register(spark)
    path = folders.scratch(spark, "bigwig")
    bigwriter.write_bigwig(T.signal(spark, sf_dir), path)
    lo = F.col("o_orderkey") * 7919 % 2_000_000
    asked = T.read(spark, sf_dir, "orders").select("o_orderkey", T.chrom_of("o_custkey").alias("chr"), lo.alias("start"), (lo + 500 + F.col("o_orderkey") % 2000).alias("end"))
    return regions.sums_of_regions(asked, path, ["o_orderkey"]).withColumnRenamed("max_value", "max_val")


@query(f"WITH {_SIG} SELECT chr, s AS start_pos, e AS end_pos, v::DOUBLE AS value FROM sig")
def bigwig_one_file(spark, sf_dir):
    """The whole signal as one file of all chromosomes, made by many tasks, read again."""
    register(spark)
    path = folders.scratch(spark, "one") + ".bw"
    bigwriter.write_one_bigwig(T.signal(spark, sf_dir), path, REDUCTIONS[1:3], fan=16, chrom_fan=8)
    return _spans(spark.read.format("bigwig").load(path), _value())


@query(f"""WITH {_SIG}, z AS (SELECT chr, unnest(range(s // {REDUCTIONS[1]}, (e - 1) // {REDUCTIONS[1]} + 1)) AS bin, s, e, v FROM sig)
SELECT chr, bin * {REDUCTIONS[1]} AS start_pos, sum(least(e, (bin + 1) * {REDUCTIONS[1]}) - greatest(s, bin * {REDUCTIONS[1]}))::BIGINT AS valid_count, min(v)::DOUBLE AS min_val, max(v)::DOUBLE AS max_val FROM z GROUP BY ALL""")
def bigwig_one_file_zoom(spark, sf_dir):
    """A zoom level of that file, in which each bin comes once."""
    register(spark)
    path = folders.scratch(spark, "one") + ".bw"
    bigwriter.write_one_bigwig(T.signal(spark, sf_dir), path, REDUCTIONS[1:3], fan=16, chrom_fan=8)
    rows = spark.read.format("bigwig").option("zoom", 1).load(path)  # levels are numbered from the last in the file
    return rows.select("chr", F.col("start").cast("bigint").alias("start_pos"), "valid_count", F.col("min").cast("double").alias("min_val"), F.col("max").cast("double").alias("max_val"))


@query("""WITH p AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chr, l_partkey AS k, sum(floor(l_quantity)::BIGINT)::BIGINT AS n FROM lineitem GROUP BY ALL)
SELECT chr, k * 10 AS start_pos, k * 10 + 5 + (CASE WHEN k % 1000 < 100 THEN k % 3 ELSE 0 END) AS end_pos, n::DOUBLE AS value FROM p WHERE k % 1000 >= 100 OR k % 7 > 1""")
def bigwig_step_sections(spark, sf_dir):
    """Supplies by part as a signal of fixed steps, equal spans and other ranges, which are sections of their own kinds, written and read again."""
    register(spark)
    path, k = folders.scratch(spark, "steps"), F.col("k")
    parts = T.features(spark, sf_dir).groupBy("chr", F.col("l_partkey").cast("bigint").alias("k")).agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    odd = k % 1000 < 100
    rows = parts.where(~odd | (k % 7 > 1)).select("chr", (k * 10).alias("start"), (k * 10 + 5 + F.when(odd, k % 3).otherwise(0)).alias("end"), F.col("n").alias("value"))
    bigwriter.write_bigwig(rows, path)
    return _spans(spark.read.format("bigwig").load(path), _value())


def _annotated(spark, sf_dir) -> str:
    """The annotation records as block-gzip files with indexes, written by tasks."""
    register(spark)
    path = folders.scratch(spark, "gtf")
    gtf.write_indexed(T.records(spark, sf_dir), path)
    return path


_RECORD_SQL = f"""{_EXON}, rec AS (SELECT 'chr' || (c_custkey % 22 + 1) AS chrom, 'gene' AS feature, 1::BIGINT AS s, 40000::BIGINT AS e, 'N' || c_custkey AS gene, NULL AS transcript FROM customer
UNION ALL SELECT 'chr' || (o_custkey % 22 + 1), 'transcript', date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 1, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 500, 'N' || o_custkey, 'T' || o_orderkey FROM orders
UNION ALL SELECT 'chr' || (o_custkey % 22 + 1), k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 1 + d, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 3 + d, 'N' || o_custkey, 'T' || o_orderkey
  FROM orders, (VALUES ('start_codon', 10), ('stop_codon', 400)) AS c(k, d) WHERE o_orderstatus = 'F'
UNION ALL SELECT 'chr' || (o_custkey % 22 + 1), 'exon', s, e, 'N' || o_custkey, 'T' || o_orderkey FROM ex
UNION ALL SELECT 'chr' || (o_custkey % 22 + 1), CASE l_returnflag WHEN 'R' THEN 'UTR' ELSE 'CDS' END, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 10, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 10 + floor(l_quantity)::BIGINT, 'N' || o_custkey, 'T' || o_orderkey
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('R', 'A'))"""


def _record_columns(records: DataFrame) -> DataFrame:
    return records.select("chrom", "feature", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), F.col("attributes")["gene_name"].alias("gene"), F.col("attributes")["transcript_name"].alias("transcript"))


@query(f"WITH {_RECORD_SQL} SELECT chrom, feature, s AS start_pos, e AS end_pos, gene, transcript FROM rec WHERE chrom = 'chr7' AND s - 1 < 12000 AND e > 9000")
def indexed_annotation_region(spark, sf_dir):
    """A region of the files: only those of the region are planned, and in them only members that the index names are read."""
    return _record_columns(gtf.read_indexed(spark, _annotated(spark, sf_dir), "chr7", 9000, 12_000))


@query(f"WITH {_RECORD_SQL} SELECT chrom, feature, s AS start_pos, e AS end_pos, gene, transcript FROM rec")
def indexed_annotation_round_trip(spark, sf_dir):
    """All records written as block-gzip files with indexes, read again and parsed."""
    return _record_columns(gtf.read_indexed(spark, _annotated(spark, sf_dir)))


@query(f"WITH {_RECORD_SQL} SELECT feature, count(*) AS n, sum(s)::BIGINT AS starts FROM rec WHERE chrom = 'chr3' AND s - 1 < 12000 AND e > 9000 GROUP BY feature")
def indexed_annotation_one_file(spark, sf_dir):
    """A region of one file with one index, into which the parts that tasks wrote were joined."""
    path = _annotated(spark, sf_dir)
    file = f"{path}/joined.gz"
    gtf.join_parts(spark, path, file).write.format("noop").mode("overwrite").save()
    return gtf.read_indexed(spark, file, "chr3", 9000, 12_000).groupBy("feature").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


def _error_fields(kind: str) -> str:
    bad = "NOT regexp_matches(chrom, '" + predicates.CHROM + "')"
    url = "WHEN url = '' OR url = 'no url' THEN 'url' " if kind == "feature" else ""
    tracks = " WHEN n = 0 THEN 'tracks'" if kind == "browser" else ""
    return f"""WITH q AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'no url' ELSE '/data/a.bb' END AS url, CASE WHEN o_custkey % 27 = 26 THEN '' ELSE 'chr' || (o_custkey % 27) END AS chrom,
  o_orderkey % 50 - 3 AS s, o_orderkey % 50 - 3 + o_orderkey % 4 - 1 AS e, o_orderkey % 3 AS n FROM orders)
SELECT o_orderkey, CASE {url}WHEN chrom = '' OR {bad} THEN 'chrom' WHEN s < 0 THEN 'start' WHEN e <= s THEN 'end'{tracks} END AS field FROM q"""


def _errors(spark, sf_dir, of):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    url = F.when(k % 7 == 0, "").when(k % 7 == 1, "no url").otherwise("/data/a.bb")
    chrom, start = F.when(c % 27 == 26, "").otherwise(F.concat(F.lit("chr"), c % 27)), k % 50 - 3
    return T.read(spark, sf_dir, "orders").select("o_orderkey", of(url, chrom, start, start + k % 4 - 1, k % 3).alias("e")).select("o_orderkey", "e.field")


@query(_error_fields("feature"))
def feature_validation(spark, sf_dir):
    return _errors(spark, sf_dir, lambda url, chrom, start, end, n: validation.feature_error(url, chrom, start, end))


@query(_error_fields("transcript"))
def transcript_validation(spark, sf_dir):
    return _errors(spark, sf_dir, lambda url, chrom, start, end, n: validation.transcript_error(chrom, start, end))


@query(_error_fields("browser"))
def browser_validation(spark, sf_dir):
    return _errors(spark, sf_dir, lambda url, chrom, start, end, n: validation.browser_error(chrom, start, end, F.array_repeat(F.lit("t"), n.cast("int"))))


@query(f"""WITH {_PACK}, n AS (SELECT k, max(line) + 1 AS total_rows FROM r GROUP BY k) SELECT r.k AS o_custkey, id::BIGINT AS o_orderkey, line::INTEGER AS row_no, total_rows::INTEGER AS total_rows FROM r JOIN n ON n.k = r.k""")
def transcript_layout_in_order(spark, sf_dir):
    rows = _customer_transcripts(spark, sf_dir).withColumn("o_orderkey", F.col("id").cast("bigint"))
    return layout.in_order(rows, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", F.col("row").alias("row_no"), "total_rows")


@query(f"""WITH {_EXON}, g AS (SELECT * FROM orders WHERE 'chr' || (o_custkey % 22 + 1) = 'chr7' AND date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 < 12000 AND date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + 500 > 9000),
x AS (SELECT o_custkey, count(*) AS n FROM ex WHERE o_orderkey IN (SELECT o_orderkey FROM g) AND s - 1 < 12000 AND e > 9000 GROUP BY o_custkey)
SELECT 'N' || c_custkey AS name, count(g.o_orderkey) AS n_transcripts, coalesce(any_value(x.n), 0)::BIGINT AS n_exons FROM customer LEFT JOIN g ON g.o_custkey = c_custkey LEFT JOIN x ON x.o_custkey = c_custkey WHERE c_custkey % 22 = 6 GROUP BY c_custkey""")
def region_fold(spark, sf_dir):
    """Genes folded from the records of a region alone; exons of transcripts that the region leaves out are no transcript's."""
    records = annotations.in_region(T.records(spark, sf_dir), "chr7", 9000, 12_000)
    genes = annotations.fold_genes(records, strict=False)
    exons = F.flatten(F.transform("transcripts", lambda t: t["exons"]))
    return genes.select("name", F.size("transcripts").cast("bigint").alias("n_transcripts"), F.size(exons).cast("bigint").alias("n_exons"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_resample(spark, sf_dir)
