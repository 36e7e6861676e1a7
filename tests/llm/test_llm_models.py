import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from lociflow.llm import align, blocks, lm, runs  # noqa: E402
from lociflow.llm.bpe import byte_symbols  # noqa: E402

SF = "/root/testdata/sf0.001"
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score double, held_out string, block long"


def brute_context_trees(texts, learn, depth):
    """log10 probability of each text, by recursion over dictionaries."""

    def decisions(t):
        whole = b"\0" * depth + t + b"\xff"
        for i in range(depth, len(whole)):
            p = 1
            for k in range(7, -1, -1):
                bit = whole[i] >> k & 1
                yield p, whole[i - depth : i][::-1], bit
                p = 2 * p + bit

    counts = collections.defaultdict(lambda: [0, 0])
    below = collections.defaultdict(set)
    for t, use in zip(texts, learn, strict=True):
        for p, context, bit in decisions(t) if use else ():
            for d in range(depth + 1):
                counts[p, context[:d]][bit] += 1
                if d:
                    below[p, context[: d - 1]].add(context[:d])
    block, weighted = {}, {}
    for d in range(depth, -1, -1):
        for (p, c), (a, b) in counts.items():
            if len(c) == d:
                block[p, c] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
                down = sum(weighted[p, x] for x in below[p, c])
                weighted[p, c] = block[p, c] if d == depth else np.logaddexp(math.log(0.5) + block[p, c], math.log(0.5) + down)

    def chance(p, context, bit, d=0):
        at = (p, context[:d])
        if at not in counts:
            return 0.5
        n = counts[at]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth or (p, context[: d + 1]) not in counts:
            return own
        stay = math.exp(math.log(0.5) + block[at] - weighted[at])
        return stay * own + (1 - stay) * chance(p, context, bit, d + 1)

    return [sum(math.log10(chance(*x)) for x in decisions(t)) for t in texts]


def lm_rows(n, seed=1):
    r = random.Random(seed)
    words = ["the", "The", "cat", "naïve", "x", "日本", "\x00", "a" * 9]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(12)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\x0b"), (n + 3, "CAT dog\x85"), (None, "no id"), *rows[:3]]


@pytest.mark.parametrize("depth", [3, 5])
def test_context_tree_scores(spark, depth):
    rows = lm_rows(50)
    docs = spark.createDataFrame([(*r, 7.0, "mine", 3) for r in rows], DOCS)
    got = collections.Counter()
    for r in lm.score(docs, ~lm.held_out(F.col("doc_id")), depth).collect():
        got[r["doc_id"], r["held_out"], r["n_bytes"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 4), round(r["bits_per_byte"], 4)] += 1
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [(t or "").encode().lower() for _, t in rows]
    words = collections.Counter(w for t, h in zip(texts, held, strict=True) if not h for w in [*t.split(), None])
    total, kinds = sum(words.values()), len(words)
    expected = collections.Counter()
    for (i, _), t, h, s in zip(rows, texts, held, brute_context_trees(texts, [not h for h in held], depth), strict=True):
        own = [*t.split(), None]
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        expected[i, h, len(t), len(own), sum(words[w] > 0 for w in own), total, round(base, 6), round(s, 4), round(-s * math.log2(10) / (len(t) + 1), 4)] += 1
    assert got == expected


def test_chances_of_all_texts_add_up_to_one(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, "abab")], "doc_id long, text string")
    keys = np.array([(0x616263 << 8 | b) for b in range(256)], np.uint64)
    root_like = blocks.counted(np.array([0x616263 << 8 | 97] * 5, np.uint64))
    counts = np.zeros(256, np.int64)
    counts[97] = root_like[1][0]
    total = np.zeros(256)
    for bit in range(8):
        level, of, own = lm.leaves(keys, counts, bit)
        total += lm.bit_scores(lm.descend(level, np.array([[0.2], [0.8], [0.3]]).repeat(len(level.keys), axis=1))[:, of], own)
    assert (10**total).sum() == pytest.approx(1)
    assert lm.score(docs, F.lit(False)).where("score < 0").count() == 3


def test_nothing_to_learn_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(docs, F.lit(None).cast("boolean")).collect()}
    assert got[1]["score"] == pytest.approx(-24 * math.log10(2)) and got[2]["score"] == pytest.approx(-8 * math.log10(2))
    assert got[1]["base_score"] == 0 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_what_is_held_out_is_scored_better_than_by_words(spark):
    got = lm.op11_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_log_kt():
    for a, b in ((0, 0), (1, 0), (3, 5), (16383, 16384), (10**6, 7), (0, 10**9)):
        own = lm.log_kt(np.array([float(a)]), np.array([float(b)]))[0]
        assert own == pytest.approx(math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1), rel=1e-9, abs=1e-5)


def test_packed_lists():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert (blocks.unpack_keys(blocks.pack_keys(keys)) == keys).all()
    asked = np.random.default_rng(1).permutation(keys)
    assert (keys[blocks.Lookup(keys).places(asked)] == asked).all()
    got = list(blocks.dealt(3, 1, keys, np.array([keys * 2.0, keys * 3.0]), blocks.bucket_of(keys, 7)))
    assert sum(len(blocks.unpack_keys(r[3])) for r in got) == len(keys) and len(got) == 7
    sums = blocks.Sums(most=10)
    for _ in range(9):
        sums.add(keys[:50], np.ones(50, np.int64))
    assert (sums.total()[0] == keys[:50]).all() and (sums.total()[1] == 9).all()


def brute_runs(words):
    """Every maximal run by trying all starts and periods."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                s, e = i, j + q
                if not any(words[s : e - k] == words[s + k : e] for k in range(1, q)):
                    out.add((s, e, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_lists(seed):
    r = random.Random(seed)
    unit = [r.randrange(4) for _ in range(r.randrange(1, 40))]
    yield [r.randrange(2) for _ in range(r.randrange(150))]
    yield [r.randrange(50) for _ in range(60)] + unit * r.randrange(2, 6) + unit[: r.randrange(len(unit))] + [r.randrange(50) for _ in range(40)]
    yield ([0, 1] * r.randrange(1, 40) + [0]) * r.randrange(1, 4)
    yield ([0] * r.randrange(1, 40) + [1]) * r.randrange(1, 5)
    yield unit * 3 + unit[::-1] * 2 + unit * 2
    a, b = [0], [0, 1]
    for _ in range(r.randrange(9)):
        a, b = b, b + a
    yield b + [2] + b
    yield [x for i in range(20) for x in ([7] * r.randrange(1, 30) + [r.randrange(3)])]


@pytest.mark.parametrize("seed", range(40))
def test_all_runs(seed):
    lists = list(run_lists(seed))
    sizes = np.array([len(x) for x in lists])
    ends = np.cumsum(sizes)
    got = runs.runs_of(np.array([w for x in lists for w in x], np.int64), ends - sizes, ends)
    expected = [(s + o, e + o, q) for x, o in zip(lists, (ends - sizes).tolist(), strict=True) for s, e, q in brute_runs(x)]
    assert [tuple(r) for r in got.tolist()] == expected


def test_very_long_lists_of_one_word_and_one_line():
    for words in (np.zeros(1_000_000, np.int64), np.tile(np.arange(50_000), 20), np.append(np.tile([1, 2], 100_000), np.tile([3, 4, 5], 100_000))):
        began = time.perf_counter()
        got = runs.runs_of(words, np.array([0]), np.array([len(words)]))
        assert 1 <= len(got) <= 2 and time.perf_counter() - began < 60


def test_runs_of_documents(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(90)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "x " * 30), (1003, "é ü " * 13 + "z"), (20, "ab cd " * 9), *rows[:2]]
    docs = spark.createDataFrame([(*x, 1.0, "y", 2) for x in rows], DOCS)
    docs.write.parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/runs-{random.random()}/documents.parquet")
    got = collections.Counter(tuple(x) for x in runs.op12_runs(spark, path.rpartition("/")[0]).drop("n_words").collect())
    expected = collections.Counter()
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        found = brute_runs(words)
        gone = {j for s, e, q in found for j in range(s + q, e)}
        best = min(((-(e - s), s, q) for s, e, q in found), default=None)
        text = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        left = " ".join(w for j, w in enumerate(words) if j not in gone)
        expected[i, len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else [None] * 4), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()] += 1
    assert got == expected
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def brute_alignment(texts):
    """Groups and links of whole texts by the libraries, and the answers by counting."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(BYTE_BPE)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    symbols = {s: b for b, s in enumerate(byte_symbols())}
    spell_a = {i: bytes(symbols[c] for c in t) for t, i in a_lib.get_vocab().items() if all(c in symbols for c in t)}
    docs = []
    for t in texts:
        links, groups = [], []
        if t:
            a, b = a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)
            sa = [spell_a[i] for i in a]
            sb = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(sa) == b"".join(sb) == (" " + t).encode():
                ea, eb = np.cumsum([len(x) for x in sa]), np.cumsum([len(x) for x in sb])
                cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
                groups = [([i for i, e in zip(a, ea, strict=True) if lo < e <= hi], [i for i, e in zip(b, eb, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)]
                links = [(i, j) for i, e, x in zip(a, ea, sa, strict=True) for j, f, y in zip(b, eb, sb, strict=True) if max(e - len(x), f - len(y)) < min(e, f)]
            else:
                a = b = []
        docs.append((len(a) if t else 0, len(b) if t else 0, groups, links))
    count = collections.Counter(p for d in docs for p in set(d[3]))
    best = collections.defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    for n_a, n_b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""


ODD_TEXTS = [
    None, "", " ", "  ", "\n", "a\n", "a  b", "a   \n b ", "it's <|endoftext|> </s> <0x41>", "x▁y", "▁", "naïve café ﬁ ²", "日本語 テキスト　a", "é ö", "if (x) {\r\n\t}\r\n",
    "a\xa0 b\x85 c\x1c d\x0b e  f", "a᠎ b", "\x00 \x01", "😀 👩‍👩‍👧 x", "aaaaaaa " * 9, "word;\r word)\r\r x", "don't we'LL  they've", "12345 67,890.1", "\t\tx\t y", "!!!???...\n\n\n-- ##", "x" * 3000,
]


def test_alignment(spark):
    r = random.Random(2)
    letters = "abcdeéßñ  ,.'\n\t123\r\xa0"
    texts = [*ODD_TEXTS, *("".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(60)), *("".join(chr(r.randrange(1, 0x2FF)) for _ in range(40)) for _ in range(30))]
    texts += [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(4).collect()] + ODD_TEXTS[10:14]
    rows = [(i if i % 7 else None, t, 1.0, "x", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = collections.Counter(tuple(x) for x in align.align(docs, BYTE_BPE, PIECES).collect())
    assert got == collections.Counter((row[0], *x) for row, x in zip(rows, brute_alignment(texts), strict=True))
    assert align.align(docs.limit(0), BYTE_BPE, PIECES).count() == 0
    assert align.align(docs.where("text is null"), BYTE_BPE, PIECES).select("n_a", "groups_sha256").distinct().collect() == [(0, "")]


def test_identity_map():
    both = align.vocabularies(BYTE_BPE, PIECES)
    known = np.flatnonzero(both.same >= 0)
    assert both.cuts and len(known) > 10_000 and all(both.a_bytes[i] == both.b_bytes[both.same[i]] for i in known)


def test_long_texts_in_pieces(monkeypatch):
    texts = [b"", b"abc" * 50, b"x", b"y" * 64, b"zz" * 99]
    whole = list(lm.grams(texts, 4))
    monkeypatch.setattr(lm, "_STEP", 16)
    cut = list(lm.grams(texts, 4))
    assert len(whole) == 1 and len(cut) > 20
    assert (np.concatenate([k for k, _, _ in cut]) == whole[0][0]).all()
    sums = np.zeros(len(texts))
    for keys, starts, of in cut:
        np.add.at(sums, of, np.add.reduceat(np.ones(len(keys)), starts))
    assert sums.tolist() == [len(t) + 1 for t in texts]
    both = align.vocabularies(BYTE_BPE, PIECES)
    text = "some words\n and more  of them " * 5
    monkeypatch.setattr(align, "LONG", 10)
    one_by_one = list(both.units(text))
    monkeypatch.undo()
    assert one_by_one == both.units(text)
