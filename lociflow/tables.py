"""The driver's tables seen as tracks: which column plays which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.cells import join_cells, line, with_cell, within


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chrom_of(column: str):
    return F.concat(F.lit("chr"), (F.col(column) % 22 + 1).cast("string"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: chr, start (seconds of 2024), value, event_id."""
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").cast("int")
    return read(spark, sf_dir, "events").select(chrom_of("user_id").alias("chr"), at.alias("start"), F.col("value").cast("float").alias("value"), "event_id", "user_id", "event_type")


def signal(spark: SparkSession, sf_dir: str, width: int = 86_400) -> DataFrame:
    """Events as a signal: each holds until the next of its chromosome, which is looked for in its cell and then in the next one that has any."""
    placed = with_cell(points(spark, sf_dir).select("chr", "start", "value", "event_id"), "start", width)
    firsts = placed.groupBy("chr", "__cell").agg(F.min("start").alias("__first"))
    ahead = firsts.select("chr", "__cell", F.lead("__first").over(line(["chr"])).alias("__next"))
    following = F.coalesce(F.lead("start").over(within(["chr"], "start", "event_id")), "__next")
    return join_cells(placed, ahead, ["chr"]).select("chr", "start", following.alias("end"), "value").where("end > start")


def _days(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1992-01-01").cast("date"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as features; rest has seven columns and two more."""
    rows = read(spark, sf_dir, "lineitem").withColumn("start", _days("l_shipdate")).withColumn("end", _days("l_shipdate") + F.floor("l_quantity").cast("int"))
    rest = F.concat_ws("\t", F.concat_ws("_", F.concat(F.lit("E"), F.col("l_orderkey")), "l_linenumber"), (F.col("l_linenumber") * 10).cast("string"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("255,0,0"), "l_returnflag", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return rows.select(chrom_of("l_suppkey").alias("chr"), "start", "end", rest.alias("rest"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


def _attributes(**values) -> Column:
    """A record's attributes, as parsing its ninth column gives them; a null value is an absent key for those who look it up."""
    return F.create_map(*(x for name, value in values.items() for x in (F.lit(name), value.cast("string"))))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as genes, orders as transcripts, line items as exons, UTRs and CDSs: annotation records.

    The tables have columns already, so no attribute text is made and parsed.
    """
    named = lambda letter, key: F.concat(F.lit(letter), F.col(key))
    customers = read(spark, sf_dir, "customer").select(
        chrom_of("c_custkey").alias("chrom"), F.lit("gene").alias("feature"), F.lit(1).alias("start"), F.lit(40_000).alias("end"), F.when(F.col("c_nationkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        _attributes(gene_id=named("G", "c_custkey"), gene_name=named("N", "c_custkey"), gene_type=F.col("c_mktsegment")).alias("attributes"), (F.col("c_custkey") * 10).alias("ord"),
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (_days("o_orderdate") * 10 + 1).alias("start"))
    of = {"gene_id": named("G", "o_custkey"), "gene_name": named("N", "o_custkey"), "transcript_id": named("X", "o_orderkey"), "transcript_name": named("T", "o_orderkey")}
    base = F.lit(10_000_000_000) + F.col("o_orderkey") * 1000
    heads = orders.select(
        chrom_of("o_custkey").alias("chrom"), F.lit("transcript").alias("feature"), "start", (F.col("start") + 499).alias("end"), F.lit("+").alias("strand"),
        _attributes(**of, tag=F.when(F.col("o_orderpriority") == "1-URGENT", "basic,MANE_Select").otherwise("basic")).alias("attributes"), base.alias("ord"),
    )
    codons = orders.where("o_orderstatus = 'F'").select("*", F.explode(F.array(F.lit("start_codon"), F.lit("stop_codon"))).alias("feature"))
    codons = codons.select(
        chrom_of("o_custkey").alias("chrom"), "feature", (F.col("start") + F.when(F.col("feature") == "start_codon", 10).otherwise(400)).alias("start"), (F.col("start") + F.when(F.col("feature") == "start_codon", 12).otherwise(402)).alias("end"), F.lit("+").alias("strand"), _attributes(**of).alias("attributes"), (base + 1).alias("ord"),
    )
    kind = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2)
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.cast("byte").alias("kind"), (_days("l_shipdate") * 10).alias("at"), F.floor("l_quantity").cast("int").alias("q"))
    # dealt by order once, for the exons, what is in them and the join; each exon comes with its UTRs and CDSs
    inner = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct(F.when(F.col("kind") == 1, "UTR").otherwise("CDS").alias("feature"), "at", "q")))
    exons = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.struct(F.lit("exon").alias("feature"), F.min("at").alias("at"), F.max("q").alias("q")).alias("exon"), inner.alias("inner"))
    rows = exons.select("l_orderkey", "l_linenumber", F.explode(F.concat(F.array("exon"), "inner")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    parts = rows.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        chrom_of("o_custkey").alias("chrom"), "feature", F.col("at").alias("start"), (F.col("at") + F.col("q")).alias("end"), F.lit("+").alias("strand"),
        _attributes(**of, exon_number=F.col("l_linenumber"), exon_id=F.concat(F.lit("E"), "o_orderkey", F.lit("."), "l_linenumber")).alias("attributes"), (base + 10 * F.col("l_linenumber")).alias("ord"),
    )
    every = customers.unionByName(heads).unionByName(codons).unionByName(parts)
    return every.select("chrom", F.lit("table").alias("source"), "feature", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(".").alias("score"), "strand", F.lit(".").alias("frame"), "attributes", F.col("ord").cast("bigint").alias("ord"))
