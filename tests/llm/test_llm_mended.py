import random
import resource
import time
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from lociflow.llm import common, language, neardup, pagetext, quality, repeats  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_nested_lists_and_bold_take_linear_time():
    for page in ("<ul><li><ul>" + "<b>" * 30_000 + "<li></li>" * 30_000, "<p>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<td><table>" * 30_000):
        began = time.perf_counter()
        pagetext.candidates_of(page)
        assert time.perf_counter() - began < 10


def shared_line_rows(ids):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    return [(i, "\n".join(["this very line is on all pages of the host", " ".join(r.choice(words) for _ in range(60)), "x" * 9]), "en", "h", 1) for i in ids]


def test_hosts_without_ids_lose_what_others_lose(spark, duck, same, tmp_path):
    ids = list(range(60))
    with_ids, without = (spark.createDataFrame(shared_line_rows(i), DOCS) for i in (ids, [None] * 60))
    lost = [quality.apply_rules(d).agg(F.sum("removed_words")).first()[0] for d in (with_ids, without)]
    assert lost[0] == lost[1] == 59 * 11
    half = spark.createDataFrame(shared_line_rows([i if i % 2 else None for i in ids]) + shared_line_rows([7, None]), DOCS)
    half.write.parquet(f"{tmp_path}/documents.parquet")
    same(quality.op3_quality(spark, str(tmp_path)), duck(str(tmp_path), quality.SQL))


def test_many_labels(spark):
    r = random.Random(1)

    def text(k):
        letters = [chr(0x4E00 + 37 * k + j) for j in range(30)]
        return " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(400))

    samples = {f"l{k:03d}": [text(k)] for k in range(300)}
    parser = language.CrossParser(samples)
    assert len(parser.groups) > 3
    asked = [samples[f"l{k:03d}"][0][:200] for k in (0, 17, 150, 299)]
    assert [p[0] for p in parser.predict(asked)] == ["l000", "l017", "l150", "l299"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_500_000
    # whatever the groups, the counts are the same
    few = {k: samples[k] for k in ("l001", "l002", "l003")}
    whole, usual = language.CrossParser(few), language.ENTRIES
    rows = [whole.alphabet.symbols(t)[0] for t in (text(1), text(2), text(90))]
    try:
        language.ENTRIES = 1
        apart = language.CrossParser(few)
    finally:
        language.ENTRIES = usual
    assert len(apart.groups) == 4 and (apart.phrases(rows) == whole.phrases(rows)).all() and (apart.phrases(rows[:1]) == whole.phrases(rows[:1])).all()
    docs = spark.createDataFrame([(i, "some text", f"x{i % 9}") for i in range(40)], "doc_id long, text string, lang string")
    assert set(language.labelled_sample(docs, "doc_id", "text", "lang", languages=4)) == {"x0", "x1", "x2", "x3"}


def test_the_callers_columns_stay(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    own = {"score": F.lit(7.0), "kept": F.lit("mine"), "n_bytes": F.col("doc_id") * 2, "lang_pred": F.lit("?"), "phrase_rate": F.lit(1), "n_removed": F.lit("r"), "n_spans": F.lit(None).cast("long"), "cleaned": F.lit(3), "row_key": F.lit("k"), "body": F.lit(1.5), "kept_of_caller": F.lit(4)}
    docs = docs.withColumns(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        got.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        assert docs.count() > 20
        assert docs.where("score <> 7 OR kept <> 'mine' OR n_bytes <> doc_id * 2 OR lang_pred <> '?' OR phrase_rate <> 1 OR n_removed <> 'r' OR n_spans IS NOT NULL OR cleaned <> 3 OR row_key <> 'k' OR body <> 1.5 OR kept_of_caller <> 4").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_each_pair_is_looked_at_once_when_the_recall_is_measured(spark, tmp_path, monkeypatch):
    """The filter on the agreement once made Spark work it out twice, in two Python workers a task."""
    looked, agreement = tmp_path / "looked", neardup.agreement

    def noted(a: pd.Series, b: pd.Series) -> pd.Series:
        with open(looked, "a") as f:
            f.write(f"{len(a)}\n")
        return agreement(a, b)

    monkeypatch.setattr(neardup, "agreement", noted)
    n = 2 * neardup.TREES * neardup.LEVELS
    ways = spark.createDataFrame([(k, bytearray([k // 3] * n)) for k in range(30)], "key long, way binary")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(29)], "a long, b long")
    assert neardup.measured_recall(pairs, ways, neardup.LEVELS, 0.8) == 1.0
    assert sum(map(int, looked.read_text().split())) == 29


class Tasks:
    """Stands for a DataFrame; what its map tasks would run is run here."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        tracemalloc.start()
        rows = sum(b.num_rows for b in run(iter([self.batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, peak


def test_workers_hold_a_small_part_of_what_spark_sends_at_once():
    """Tables of 10 000 rows of 4 KB are sent at once; lists of their texts and bytes took another 35 to 55 MB of each worker."""
    r = random.Random(5)
    texts = ["".join(r.choices("abcdefgh ", k=4000)) for _ in range(100)]
    rows = [f"{i} {texts[i % 100]}" for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(range(len(rows))), pa.array(rows)], names=["doc", "body", "text"])
    for (rows_out, peak), most in ((repeats._anchored(Tasks(batch), 100, 20), 100), (neardup._shingled(Tasks(batch.select(["doc", "text", "body"]))), 30)):
        assert rows_out >= len(rows) and peak < most << 20
    assert [len(b) for b in common.small([batch, batch.slice(0, 0), batch.slice(0, 5)], 4000)] == [4000, 4000, 2000, 5]
