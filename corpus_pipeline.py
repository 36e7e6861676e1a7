"""From raw documents to packed training sequences, in five stages.

Each stage takes the table that the one before it wrote and returns a DataFrame;
all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.common import Scratch, fresh
from lociflow.llm.language import held_out, identify
from lociflow.llm.neardup import join
from lociflow.llm.packing import pack
from lociflow.llm.quality import apply_rules
from lociflow.llm.repeats import remove_repeats

#: A text of which the best language's phrases are shorter than this many letters is in no known language.
LEAST_PHRASE = 2.0

#: Suffix automata, MinHash, suffix merging and tokenizers have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def keeping(docs: DataFrame, names: set[str], stage) -> DataFrame:
    """stage(docs) with the columns of docs, of which those that an operator would replace by its own (names) are set aside meanwhile."""
    aside = {c: fresh(docs, f"{c}_of_caller") for c in docs.columns if c.lower() in names}
    return stage(docs.withColumnsRenamed(aside)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts that no learned language reads.

    A row without a lang is not learned from; rows are independent, so repeated
    ones go or stay alike. Columns of any other name, those of the operator's own
    results too, stay as they are; so in all stages.
    """

    def stage(rows: DataFrame) -> DataFrame:
        got = identify(rows, rows.where(~held_out(F.col("doc_id"))))
        return got.where((F.col("lang_pred") != "und") & (F.col("phrase_rate") <= 1 / LEAST_PHRASE))

    return keeping(docs, {"lang_pred", "score", "phrase_rate"}, stage)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the lines that many documents of a host hold; rejects what fails the base rules and documents depleted of their own lines.

    A null text has no words and goes; a null source is a host of its own;
    repeated rows stay as many as they are.
    """
    key, text = fresh(docs, "row_key"), fresh(docs, "cleaned")
    kept = apply_rules(docs).where("kept").select(F.col("row_key").alias(key), F.col("text").alias(text)).dropDuplicates([key])
    rest = docs.withColumn(key, F.xxhash64("doc_id", "source", F.coalesce("text", F.lit("")))).join(kept, key)
    return rest.withColumn("text", F.col(text)).withColumn("n_chars", F.length(text).cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every class of near copies: that of the smallest doc_id (a null one comes last), then of the smallest hash of its text.

    Of repeated rows one stays. A text without words is alone, but for rows that
    equal it in doc_id and text.
    """
    body = fresh(docs, "body")
    first = join(docs).groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")).alias("f")).select(F.col("f.doc_id").alias("first"), F.col("f.body").alias("of_body"))
    rows = docs.withColumn(body, F.xxhash64("text"))
    left = rows.join(first, rows["doc_id"].eqNullSafe(first["first"]) & (rows[body] == first["of_body"]), "left_semi")
    return left.dropDuplicates(["doc_id", body]).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts long strings that stand earlier; documents of which nothing is left go.

    Strings are of bytes, so a cut may begin or end inside a character; what is
    left of such a character goes too. A text in which nothing repeats stays as
    it is, a null one too.
    """

    def stage(rows: DataFrame) -> DataFrame:
        cut = remove_repeats(rows, as_text=True)
        text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
        return cut.where((F.col("n_removed") == 0) | (F.length("kept") > 0)).withColumns({"text": text, "n_chars": F.length(text).cast("long")})

    return keeping(docs, {"n_bytes", "n_removed", "n_spans", "kept"}, stage)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens at their places in training sequences; a null or empty text is its end mark alone, repeated rows are packed each."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_copies", one_of_each),
    ("repeats", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    disk = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = disk.write(stage(spark, docs, sf_dir), name)
    return docs
