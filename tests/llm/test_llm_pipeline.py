import math
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_llm_corpus import brute_classes, brute_repeats  # noqa: E402
from test_llm_text import brute_phrases, brute_rules  # noqa: E402

from lociflow.llm import language, neardup  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(n))


def corpus():
    r = random.Random(11)
    rows = [(i, words(r, "abcdefg" if i % 2 else "tuvwxyz", 90), "en" if i % 2 else "fr", f"src{i % 3}") for i in range(40)]
    passage = words(r, "abcdefg", 60)
    rows += [(100, rows[3][1], "en", "src0"), (101, rows[5][1] + " extra", "en", "src1")]  # a copy and a near copy
    rows += [(102, words(r, "abcdefg", 80) + " " + passage, "en", "src2"), (103, passage + " " + words(r, "abcdefg", 80), "en", "src0")]
    rows += [(104, "??? 123", "en", "src0"), (105, None, "en", "src0"), (106, "too short", "en", "src0"), (107, "abc def gab " * 40, "en", "src0")]
    return rows, passage


def test_run_is_its_stages_one_by_one_and_decisions_take_effect(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.dtypes == spark.createDataFrame([], COLUMNS).dtypes
        kept[name] = {d["doc_id"]: d for d in docs.collect()}
        docs = spark.createDataFrame(list(kept[name].values()), COLUMNS)
    every = {r[0] for r in rows}
    assert set(kept["language"]) == every - {104, 105}
    assert set(kept["quality"]) == every - {104, 105, 106, 107}
    assert set(kept["near_copies"]) == every - {100, 101, 104, 105, 106, 107}
    final = kept["repeats"]
    assert set(final) == set(kept["near_copies"])
    assert passage in final[102]["text"] and passage not in final[103]["text"] and len(final[103]["text"]) == final[103]["n_chars"]
    texts = {r[0]: r[1] for r in rows}
    assert all(d["text"] == texts[i] for i, d in final.items() if i != 103)


def near_pair(seed):
    r = random.Random(seed)
    a = [f"w{r.randrange(10**6)}" for _ in range(50)]
    return " ".join(a), " ".join([*a[:20], f"v{r.randrange(10**6)}", *a[21:]])


def test_near_copies_do_not_hang_on_which_pairs_the_recall_is_measured(spark, monkeypatch):
    """The texts of seed 136 share prefixes of 7 and none of 8, to which only the measure on all pairs leads."""
    monkeypatch.setattr(neardup, "MEASURED", 1, raising=False)  # once the size of a sample of pairs
    texts = [t for seed in [136, *range(40)] for t in near_pair(seed)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert kept == {i for i, (first, _) in brute_classes(list(enumerate(texts))).items() if i == first} == set(range(0, 82, 2))


def test_packed_rows_hold_every_kept_token(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, _ = corpus()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = {r[0]: r[1] for r in rows}
    for i in range(20):
        assert got[got["doc_id"] == i]["length"].sum() == len(lib.encode(plain[i], add_special_tokens=False).ids) + 1
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024
    assert set(got["doc_id"]) == {r[0] for r in rows} - {100, 101, 104, 105, 106, 107}


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_stage_passes_cleaned_texts_on(spark):
    r = random.Random(12)
    own = [words(r, "abcdefg", 60) for _ in range(30)]
    rows = [(i, f"{own[i]}\nAll rights reserved", "en", "src0", None) for i in range(30)]
    got = {d["doc_id"]: d for d in corpus_pipeline.good_quality(spark, spark.createDataFrame(rows + rows[5:6], COLUMNS), "").collect()}
    assert got[0]["text"] == rows[0][1]
    assert all((got[i]["text"], got[i]["n_chars"]) == (own[i], len(own[i])) for i in range(1, 30))


def brute_run(spark, rows):
    """What run() has to pack: {doc_id: text}, each stage in plain Python over all rows."""
    docs = spark.createDataFrame([(*r, 0) for r in rows], COLUMNS)
    samples = language.labelled_sample(docs.where(~language.held_out(docs["doc_id"])), "doc_id", "text", "lang")
    parser = language.CrossParser(samples)
    chars = lambda t: "".join(map(chr, parser.alphabet.symbols(t.lower())[0]))
    own = {k: "".join(chars(t) + "\0" for t in samples[k]) for k in parser.langs}
    left = []
    for doc_id, text, _, source in rows:
        if text and any(c.isalpha() for c in text):
            counts = {k: brute_phrases(chars(text), own[k]) for k in own}
            best = min(own, key=lambda k: (counts[k] * math.log2(len(own[k]) + 2), k))
            if 2 * counts[best] <= len(chars(text)):
                left.append((doc_id, text, source))
    norm = lambda line: " ".join(line.split()).lower()
    good = []
    for doc_id, text, source in left:
        host = [(i, t) for i, t, s in left if s == source]
        kept = []
        for line in text.split("\n"):
            holders = [(i, t) for i, t in host if norm(line) and norm(line) in map(norm, t.split("\n"))]
            n, every = len({t for _, t in holders}), len({t for _, t in host})
            if not (n > 20 and n > 0.02 * every and doc_id != min(i for i, _ in holders)):
                kept.append(line)
        n_words, _, _, _, repeated = brute_rules(text)
        cleaned = "\n".join(kept)
        if not (n_words < 50 or 100 * repeated > 50 * n_words or len(cleaned.split()) < 0.5 * n_words):
            good.append((doc_id, cleaned))
    classes = brute_classes(good)
    one = [(i, t) for i, t in good if classes[i][0] == i]
    out = {}
    seen = set()
    for i, t in sorted(one):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            gone[p : p + 100] |= raw[p : p + 100] in seen
            seen.add(raw[p : p + 100])
        assert brute_repeats(one)[i][1] == gone.sum()
        if not gone.all():
            out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


def test_run_is_what_brute_force_gives(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, _ = corpus()
    r = random.Random(15)
    rows += [(200 + i, words(r, "abcdefg", 70) + "\nAll rights  reserved\n" + words(r, "abcdefg", 9), "en", "boiler") for i in range(25)]
    rows += [(300, words(r, "abcdefg", 30) + "\nall rights reserved" * 20, "en", "boiler"), (301, "\u4f60\u597d " * 60, None, None), (302, words(r, "abcdefg", 2500), "en", "src1")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas().sort_values(["doc_id", "piece"])
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: [*lib.encode(t, add_special_tokens=False).ids, 2] for i, t in brute_run(spark, rows).items()}
    assert {i: np.frombuffer(b"".join(g["ids"]), "<u4").tolist() for i, g in got.groupby("doc_id")} == expected
    room = [1024] * len(got)  # best-fit decreasing, piece by piece
    for n in sorted(got["length"], reverse=True):
        room[min((x, k) for k, x in enumerate(room) if x >= n)[1]] -= n
    assert got["sequence_id"].nunique() == sum(x < 1024 for x in room)


def test_one_row_of_a_class_stays_whatever_its_ids(spark):
    r = random.Random(16)
    text, other = words(r, "abcdefg", 90), words(r, "tuvwxyz", 90)
    rows = [(None, text, "en", None, 0), (None, text, "en", None, 0), (None, text + " end", "en", None, 0), (4, other, "en", None, 0), (4, text, "en", None, 0), (4, other, "en", None, 0)]
    got = sorted((d["doc_id"], d["text"]) for d in corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, COLUMNS), "").collect())
    assert got == sorted([(4, other), (4, text)])
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows[:3], COLUMNS), "").collect()
    assert len(got) == 1 and got[0]["doc_id"] is None
