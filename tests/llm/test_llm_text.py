import collections
import hashlib
import json
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from lociflow.llm import bpe, language, packing, pagetext, quality  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "é" * 300, "ΑΣ İ ñ 你好 😀", "it's  a <|endoftext|> b", "x\n\ny \n z", "word " * 3000, "%%% ***", "aaaaaaa aaa"]


def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, 1, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[:4] + [(None, "no id", "en", "s", 1, 1, "x")], DOCS)


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_bpe_is_the_librarys(spark):
    lib = library(WORD_BPE)
    got = bpe.encode_decode(odd(spark), WORD_BPE).collect()
    expected = []
    for r in odd(spark).collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        expected.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_bpe_on_random_texts():
    lib, own, r = library(WORD_BPE), bpe.loaded(WORD_BPE), random.Random(3)
    texts = ["".join(r.choice("aehinorst '.0éß") for _ in range(200)) for _ in range(60)]
    texts += ["".join(chr(r.choice([r.randrange(32, 600), r.randrange(0x300, 0x2FFF)])) for _ in range(60)) for _ in range(60)]
    texts += ["a" * i + "th" * (i // 2) + "!" * i for i in range(40)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_bpe_without_a_mark_for_word_ends():
    lib, own = library(BYTE_BPE), bpe.loaded(BYTE_BPE)
    for word in ("hello", "onthe", "aaaaaaaaa", "thththth", "zzzzzz"):
        assert own.word(word) == lib.encode(word, add_special_tokens=False).ids


def test_token_ids_are_the_librarys():
    lib, own = library(BYTE_BPE), packing.token_ids(BYTE_BPE)
    for t in ODD[1:]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def brute_best_fit(sizes, room):
    left = []
    for s in sorted(sizes, reverse=True):
        fit = min((x for x in left if x >= s), default=None)
        if fit is None:
            left.append(room - s)
        else:
            left.remove(fit)
            left.append(fit - s)
    return sorted(left)


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins_as_best_fit_decreasing_does(seed):
    r, room = random.Random(seed), 40
    sizes = [r.randrange(1, room + 1) for _ in range(300)]
    counts = {s: sizes.count(s) for s in set(sizes)}
    used = {}
    for size, rank, n, first, each, base in packing.best_fit_plan(counts, room).tolist():
        for k in range(n):
            at = used.setdefault(first + k // each, [])
            at.append((base + k % each * size, size))
    for parts in used.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert sorted(room - sum(n for _, n in p) for p in used.values()) == brute_best_fit(sizes, room)


def test_packing_keeps_every_token_once(spark):
    got = packing.pack(odd(spark), BYTE_BPE, room=16).toPandas()
    lib = library(BYTE_BPE)
    lengths = sorted(len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd(spark).collect())
    assert got["length"].sum() == sum(lengths) and (got["piece"] == 0).sum() == len(lengths)
    assert (got[got["piece"] > 0]["length"] == 16).all() and (got["offset"] + got["length"] <= 16).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]]
    assert packing.pack(odd(spark).limit(0), BYTE_BPE).count() == 0


def brute_phrases(text, sample):
    """Greedy longest matches of the sample's substrings, as the parser's symbols."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


def test_cross_parsing_counts_greedy_longest_matches():
    r = random.Random(1)
    samples = {"x": ["".join(r.choice("abc ") for _ in range(80)) for _ in range(3)], "y": ["".join(r.choice("bcd ") for _ in range(80))]}
    parser = language.CrossParser(samples)
    for _ in range(20):
        text = "".join(r.choice("abcd ") for _ in range(r.randrange(1, 120)))
        row, _ = parser.alphabet.symbols(text)
        own = [["".join(map(chr, [*parser.alphabet.symbols(s)[0], 0])) for s in samples[k]] for k in parser.langs]
        expected = [brute_phrases("".join(map(chr, row)), "".join(o)) for o in own]
        assert parser.phrases([row])[0].tolist() == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_language_of_held_out_documents(spark):
    got = language.op9_language(spark, SF.replace("0.001", "0.01"))
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    assert held.where(F.col("lang") == F.col("lang_pred")).count() >= 0.97 * held.count() > 0


def test_language_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in language.identify(odd(spark), odd(spark)).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[9]["lang_pred"] == "und" and got[9]["score"] == 0
    assert got[3]["lang_pred"] == "en" and got[3]["size"] == 1
    none = language.identify(odd(spark), odd(spark).limit(0)).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    assert language.identify(odd(spark).limit(0), odd(spark)).count() == 0


def brute_rules(text):
    words = [w for w in "".join(c if c not in SPACE else " " for c in text or "").split(" ") if w]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    r = random.Random(2)
    texts = [*ODD, *(" ".join(r.choice("abcdefg") for _ in range(n)) for n in (2, 3, 4, 50, 400)), "a b c\n a b c\na b c\r\nx", "a\xa0b c a\xa0b c a\xa0b"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {g["doc_id"]: g for g in quality.apply_rules(df).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == brute_rules(t), t
        assert g["base_failed"] == (g["n_words"] < 50 or 100 * g["n_repeat_words"] > 50 * g["n_words"])


def test_lines_on_many_documents_go_and_copies_count_once(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(i, f"{own(i)}\n{shared}", "h") for i in range(30)] + [(100 + i, own(7) + "\n" + " ".join(f"c{k}" for k in range(60)), "h") for i in range(40)] + [(200, f"{own(200)}\n{shared}", "other"), (201, f"{own(201)}\n{shared.upper()}", "h")]
    got = {g["doc_id"]: g for g in quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["kept"] and got[0]["removed_words"] == 0  # the host's first document keeps the line
    assert not any(got[i]["kept"] for i in range(1, 30)) and got[5]["removed_words"] == 60 and not got[201]["kept"]
    assert all(got[100 + i]["kept"] for i in range(40)) and got[200]["kept"]


def test_quality_of_an_empty_table_and_repeated_rows(spark):
    assert quality.apply_rules(odd(spark).limit(0)).count() == 0
    assert quality.apply_rules(odd(spark)).count() == odd(spark).count()


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">Cookies</div><div id="sidebar">Side</div><form><input><p>Sign up</p></form><article><header><h1>Head&amp;line</h1><span>by x</span></header>
<p>One<br>two <b>th</b>ree<p>Four &lt;x&gt; &nbsp; five<ul><li>a<li>b</ul><script>if (a<b) "</p>"</script><!-- no --><div class="ad">Buy</div>
<section class="comments"><p>First!</p></section></article><footer>(c)</footer></body></html>"""


def main_text(page):
    return pagetext.chosen(pagetext.candidates_of(page)[0])


def test_main_text():
    assert main_text(PAGE) == ["Head&line", "One two three", "Four <x> five", "a", "b"]
    assert main_text("a < b <p>c") == ["a < b", "c"]
    assert main_text("") == [] and main_text("<nav>x") == []


def test_templates_of_a_site_go(spark):
    page = lambda i, host: f"<body><article><p>Text {i}</p><p>Quoted by all</p><div><span>Follow our site</span></div></article></body>"
    rows = [(i, f"http://A.example/{i}", page(i, "a")) for i in range(30)] + [(100 + i, f"http://b.example/{i}", page(0, "b")) for i in range(30)]
    rows += [(200, None, None), (201, "x", ""), (201, "x", ""), (None, "http://a.example/n", page(77, "a"))]
    got = {g["page_id"]: g for g in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))).collect()}
    assert got[3]["text"] == "Text 3\nQuoted by all" and got[3]["n_template"] == 1 and got[None]["text"] == "Text 77\nQuoted by all"
    assert got[100]["text"].endswith("Follow our site")  # copies of one page are one page
    assert got[200]["text"] == got[201]["text"] == "" and got[3]["n_chars"] == len(got[3]["text"])


def test_text_outside_a_teaser_article_and_inside_forms_stays(spark):
    long = lambda i: f"<h1>Title {i}</h1><p>Long story {i} " + f"word{i} " * 40 + "</p>"
    teaser, chrome = "<article><p>Read this next</p></article>", "<div><p>One of our sites</p></div>"
    shapes = [
        lambda i: f"<body>{chrome}<div class=content>{long(i)}</div>{teaser}</body>",
        lambda i: f"<body>{chrome}<main>{long(i)}{teaser}</main></body>",
        lambda i: f"<body>{chrome}<form id=form1 role=form><div><label>Name</label><input><article>{long(i)}</article></div></form></body>",
        lambda i: f"<body><div><form class=form>{chrome}<div>{long(i)}</div><button>Go</button></form></div></body>",
        lambda i: f"<body><div><form class=search-page><div><article>{long(i)}</article></div></form></div></body>",
    ]
    rows = [(100 * k + i, f"http://h{k}.example/{i}", shape(i)) for k, shape in enumerate(shapes) for i in range(30)]
    got = {g["page_id"]: g["text"] for g in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(len(shapes)):
        for i in range(30):
            text = got[100 * k + i]
            assert text.startswith(f"Title {i}\nLong story {i} word{i}"), (k, text)
            assert not any(x in text for x in ("One of our sites", "Name", "Go")), (k, text)


def test_lines_over_the_limits_are_cut_from_the_text(spark):
    own = lambda i: "\n\n".join(" ".join(f"w{i}x{k}y{j}" for k in range(20)) for j in range(3))
    rows = [(i, f" Read  our Terms\n{own(i)}\nread our terms\n \n", "h") for i in range(30)] + [(50, f"{own(50)}\nread our terms", "other")]
    df = spark.createDataFrame(rows + rows[3:4], "doc_id long, text string, source string")
    got = {g["doc_id"]: g for g in quality.apply_rules(df).collect()}
    assert got[0]["text"] == rows[0][1] and got[50]["text"] == rows[30][1] and got[50]["removed_words"] == 0
    for i in range(1, 30):
        assert (got[i]["text"], got[i]["removed_words"], got[i]["kept"]) == (f"{own(i)}\n \n", 6, True)


def test_bpe_on_ascii_controls():
    lib, own, r = library(WORD_BPE), bpe.loaded(WORD_BPE), random.Random(5)
    texts = ["alpha\x1cbeta", "x\x1d\x1ey", *(f"a{chr(c)}b {chr(c)}" for c in range(128))]
    texts += ["".join(r.choice("abc \x00\x0b\x0c\x1c\x1d\x1e\x1f\x7f") for _ in range(80)) for _ in range(40)]
    for t in texts:
        ids = own.encode(t)
        expected = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, repr(t)
        assert own.decode(ids) == lib.decode(expected, skip_special_tokens=False)


def test_ids_and_decoded_texts_come_out(spark):
    lib = library(WORD_BPE)
    rows = odd(spark).collect()
    got = bpe.tokenised(odd(spark), WORD_BPE).collect()
    ids = [lib.encode(r["text"] or "", add_special_tokens=False).ids for r in rows]
    expected = [(r["doc_id"], i, lib.decode(i, skip_special_tokens=False)) for r, i in zip(rows, ids, strict=True)]
    assert sorted(map(str, expected)) == sorted(str((g["doc_id"], np.frombuffer(g["ids"], "<u4").tolist(), g["decoded"])) for g in got)


def test_sequences_hold_the_ids_of_every_text(spark):
    lib, placed = library(BYTE_BPE), packing.pack(odd(spark), BYTE_BPE, room=16)
    got = {g["sequence_id"]: np.frombuffer(g["ids"], "<u4").tolist() for g in packing.sequences(placed).collect()}
    assert max(map(len, got.values())) <= 16
    texts = {}
    for p in placed.where("doc_id >= 4").orderBy("doc_id", "piece").collect():
        own = got[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]]
        assert own == np.frombuffer(p["ids"], "<u4").tolist()
        texts.setdefault(p["doc_id"], []).extend(own)
    assert texts == {i: [*lib.encode(ODD[i], add_special_tokens=False).ids, 2] for i in range(4, len(ODD))}


def test_windows_that_only_hash_alike_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "down", lambda value, bits: F.call_function("shiftright", F.call_function("shiftright", value, bits), F.lit(50)))
    random.seed(5)
    texts = [" ".join(random.choices("abcdef", k=n)) for n in (3, 40, 120, 400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(quality.repeated_words(quality.words_of(F.col("t")))).collect()]
    expected = []
    for t in texts:
        w = t.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        expected.append(len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}))
    assert got == expected


def test_a_null_host_is_not_the_empty_one(spark):
    rows = [(i, f"the same line on all of them\nown {i} " + "word " * 9, "en", host, 1, 1, "x") for i, host in enumerate([None] * 15 + [""] * 15)]
    got = quality.apply_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["removed_words"] for r in got} == {0}


@pytest.mark.parametrize(("lane", "lanes"), [(512, 2048), (7, 5), (40, 1000)])
def test_lanes_count_as_one_pass_over_the_text_does(monkeypatch, lane, lanes):
    monkeypatch.setattr(language, "LANE", lane)
    monkeypatch.setattr(language, "LANES", lanes)
    r = random.Random(3)
    word = lambda k: "".join(r.choice("abcdefg"[:k]) for _ in range(r.randrange(1, 7)))
    samples = {"x": [" ".join(word(6) for _ in range(60))], "y": [" ".join(word(7) for _ in range(90))], "z": ["abababababab" * 9]}
    parser = language.CrossParser(samples)
    texts = [" ".join(word(7) for _ in range(n)) for n in (1, 200, 900, 30)] + ["ab" * 700, "\u4f60\u597d" * 300 + " a b"]
    rows = [parser.alphabet.symbols(t)[0] for t in texts]
    own = ["".join(map(chr, np.concatenate([np.append(parser.alphabet.symbols(s)[0], 0) for s in samples[k]]))) for k in parser.langs]
    expected = [[brute_phrases("".join(map(chr, row)), o) for o in own] for row in rows]
    assert parser.phrases(rows).tolist() == expected


def test_many_scripts_fit_in_the_table():
    r = random.Random(4)
    samples = {f"l{k}": ["".join(chr(0x4E00 + r.randrange(6000)) for _ in range(8000))] for k in range(9)}
    parser = language.CrossParser(samples)
    assert parser.predict([samples["l3"][0][100:160]])[0][0] == "l3"


@pytest.mark.parametrize("page", ["<a " * 400_000, "<div>" * 100_000 + "x", "<b>" * 50_000 + "<p>x</p>" * 50_000, "<div>" * 50_000 + "</span>" * 50_000, "<p title='" * 100_000, "<script>" * 100_000, "<" * 400_000, "<li>" * 100_000, "<!--" * 200_000, "&amp" * 200_000])
def test_odd_pages_take_linear_time(page):
    began = time.perf_counter()
    pagetext.candidates_of(page)
    assert time.perf_counter() - began < 8


def site(r, n):
    """Pages of nested divs: their parts as (text, subtrees around it), and the html."""
    pieces = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12)]

    def div(depth):
        inside = [div(depth - 1) if depth and r.random() < 0.5 else r.choice(pieces) for _ in range(r.randrange(1, 4))]
        return "<div>" + "<hr>".join(inside) + "</div>"

    return ["".join(div(2) for _ in range(3)) for _ in range(n)]


def subtrees(page):
    """(text, [the html of each div around it]) of each text, by matching tags one by one."""
    out, stack = [], []
    for m in re.finditer(r"<div>|</div>|<hr>|[a-h]+", page):
        if m[0] == "<div>":
            stack.append((m.start(), []))
        elif m[0] == "</div>":
            start, held = stack.pop()
            for i in held:
                out[i][1].append(page[start : m.end()])
            if stack:
                stack[-1][1].extend(held)
        elif m[0] != "<hr>":
            stack[-1][1].append(len(out))
            out.append((m[0], []))
    return out


def test_templates_are_those_that_a_plain_count_finds(spark):
    pages = site(random.Random(12), 60)
    counts = collections.Counter(t for page in set(pages) for t in {t for _, trees in subtrees(page) for t in trees})
    often = {t for t, n in counts.items() if n > 3 and n > 0.1 * len(set(pages))}
    expected = {i: "\n".join(text for text, trees in subtrees(p) if not often & set(trees)) for i, p in enumerate(pages)}
    df = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {g["page_id"]: g["text"] for g in pagetext.extract(df, least_pages=3, share=0.1).collect()}
    assert got == expected and often


def test_shapes_of_a_site_go_whatever_they_say(spark):
    r = random.Random(13)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    page = lambda: f"<body><div class='x1'><ul>{''.join(f'<li><a href=#>{say(1)}</a></li>' for _ in range(r.randrange(3, 7)))}</ul></div><article><h1>{say(4)}</h1><p class=lead>{say(30)}</p><p>{say(60)}</p></article><div class='y{r.randrange(9)}'>{say(5)}</div></body>"
    pages = [page() for _ in range(30)]
    df = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = pagetext.extract(df).collect()
    assert all(g["n_blocks"] == 3 and g["n_template"] >= 4 for g in got)


def test_every_character_below_3000_is_read_as_the_library_reads_it():
    lib, own, ids = library(WORD_BPE), bpe.Bpe(WORD_BPE), packing.TokenIds(BYTE_BPE)
    byte_lib = library(BYTE_BPE)
    r = random.Random(17)
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 8):
        text = "".join(c + r.choice(["", " ", "a", "B1"]) for c in every[at : at + 8])
        for t in (text, *(f"a{c}b {c}" for c in every[at : at + 8])):
            assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)
            assert np.frombuffer(ids.ids(t), "<u4").tolist() == byte_lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_files_with_other_rules_go_through_the_library(tmp_path):
    whole = json.load(open(WORD_BPE, encoding="utf-8"))
    whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+"
    (tmp_path / "other.json").write_text(json.dumps(whole), encoding="utf-8")
    own, lib = bpe.Bpe(str(tmp_path / "other.json")), library(str(tmp_path / "other.json"))
    for t in ("it's a b2c, 77", "x<|endoftext|>y"):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
