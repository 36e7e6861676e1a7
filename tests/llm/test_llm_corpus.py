import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import neardup, repeats, search, sharding, warc
from lociflow.llm.common import Scratch
from lociflow.llm.graph import components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 30)] + [(50, 40), (40, 60), (7, 7), (61, 60)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()
    assert {(r["node"], r["root"]) for r in got} == {(i, 10) for i in range(10, 31)} | {(i, 40) for i in (40, 50, 60, 61)}


def brute_classes(rows):
    import re

    words = {k: re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower()) for k, t in rows}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for k, w in words.items()}
    root = {k: k for k in sets}
    links = dict.fromkeys(sets, 0)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys, seen = list(sets), {}
    for k in keys:
        if words[k]:
            seen.setdefault(tuple(words[k]), []).append(k)
    firsts = [v[0] for v in seen.values()]
    for i, a in enumerate(firsts):
        for b in firsts[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    for same in seen.values():
        for k in same[1:]:
            links[k] = links[same[0]]
            root[max(top(k), top(same[0]))] = min(top(k), top(same[0]))
    return {k: (top(k), links[k]) for k in keys}


def near_rows():
    r = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(3, 220))]
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(9999)}"
            rows.append(" ".join(copy) if r.random() < 0.7 else " ".join(base).upper() + "!")
    rows += [None, "", "???", "one two", "one, two", "x " * 6000]
    return list(enumerate(rows))


def test_near_copies(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, root int")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.join(df).collect()}
    assert got == brute_classes(rows)
    assert neardup.join(df.limit(0)).count() == 0


def test_near_copies_in_blocks_are_those_in_one(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK", 2)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.join(df).collect()} == brute_classes(rows)


def test_repeated_rows_are_copies(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(5, text), (5, text), (9, text), (None, text + " 41")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["class_id"], r["n_copies"]) for r in neardup.join(df).collect())
    assert got == [("5", 5, 3), ("5", 5, 3), ("9", 5, 3), ("None", 5, 1)]


def test_prefixes_are_shortened_until_the_recall(spark, monkeypatch):
    level = neardup.stop_level()
    assert neardup.chance(neardup.THRESHOLD, level) >= neardup.RECALL > neardup.chance(neardup.THRESHOLD, level + 1)
    seen = []
    monkeypatch.setattr(neardup, "measured_recall", lambda pairs, ways, at, threshold: seen.append(at) or (0.9 if at > 6 else 1.0))
    monkeypatch.setattr(neardup, "stop_level", lambda threshold, recall: 3)
    df = spark.createDataFrame(near_rows(), "doc_id long, text string")
    neardup.join(df)
    assert seen == [8, 7, 6]


def test_the_measured_recall_is_that_of_all_pairs(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(400)]
        other = list(words)
        for at in r.sample(range(400), 8 + i % 9):
            other[at] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g["doc_id"]: (g["class_id"], g["n_links"]) for g in neardup.join(df).collect()}
    assert got == brute_classes(rows)
    disk = neardup.Scratch(spark, "recall")
    walked = disk.write(neardup.forest(df, "doc_id", "text"), "forest")
    pairs = neardup.candidates(walked, 0.8, 0.5, disk)  # full depth
    assert 0.97 < neardup.measured_recall(pairs, walked.select("key", "way"), neardup.LEVELS, 0.8) <= 1


def test_no_pair_is_left_out_of_the_measure_however_many_there_are(spark):
    r = np.random.default_rng(5)
    n, base = 900, r.integers(0, 1 << 16, neardup.TREES * neardup.LEVELS, np.uint16)
    ways = np.where(r.random((n, len(base))) < r.uniform(0.85, 0.99, (n, 1)), base, r.integers(0, 1 << 16, (n, len(base)), np.uint16))
    alike = np.concatenate([(ways[i] == ways[i + 1 :]).mean(1) for i in range(n - 1)])
    alike = alike[alike >= 0.8]
    expected = len(alike) / (1 / neardup.chance(alike, neardup.LEVELS)).sum()
    pairs = spark.range(n).toDF("a").join(spark.range(n).toDF("b"), F.col("a") < F.col("b"))  # 404 550
    held = spark.createDataFrame([(i, w.astype(">u2").tobytes()) for i, w in enumerate(ways)], "key long, way binary")
    assert neardup.measured_recall(pairs, held, neardup.LEVELS, 0.8) == pytest.approx(expected, rel=1e-9)


def test_texts_of_the_same_words_in_another_order_have_other_keys():
    a, b = ["x"], ["y"]
    for _ in range(11):
        a, b = a + b, b + a  # words of which a polynomial's hashes are equal
    end = ["the", "same", "end"]
    keys = neardup.text_keys(*neardup.word_hashes([" ".join(a + end), " ".join(b + end), " ".join(a + end)]))
    assert keys[0] != keys[1] and keys[0] == keys[2]


def test_overlaps_count_shared_shingles():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in r.integers(1, 50, 40)]
    expected = [[0 if a is b else len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert neardup.overlaps(sets).tolist() == expected


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            piece = raw[p : p + length]
            if piece in seen:
                gone[p : p + length] = True
            seen.add(piece)
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[key] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("merged", "hot", "piece"), [(repeats.MERGED, repeats.HOT, repeats.PIECE), (8, repeats.HOT, 250), (8, 2, 250)])
def test_repeats(spark, monkeypatch, merged, hot, piece):
    for name, value in (("MERGED", merged), ("HOT", hot), ("PIECE", piece)):
        monkeypatch.setattr(repeats, name, value)
    r = random.Random(6)
    base = ["".join(r.choice("abcé \n") for _ in range(r.randrange(0, 600))) for _ in range(10)]
    rows = [(i, "".join(r.choice(base)[r.randrange(0, 200) : r.randrange(100, 600)] for _ in range(r.randrange(0, 4)))) for i in range(80)]
    rows += [(200, "a" * 500), (201, "ab" * 300), (202, "a" * 99), (203, "a" * 100), (204, ""), (205, None), (None, base[0])]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, pos int, hash string")
    got = repeats.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "pos", "hash", "n_bytes", "n_removed", "n_spans", "kept"]
    mine = {g["doc_id"]: tuple(g)[1:] for g in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert mine == brute_repeats(rows)


def test_repeats_of_rows_that_share_an_id(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((g["doc_id"], g["n_removed"]) for g in repeats.remove_repeats(df).collect()) == sorted([(1, repeats_of(text)), (1, repeats_of(text)), (2, 300)])
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_rows_of_one_id_and_other_texts_are_cut_on_their_own(spark):
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    piece, other = letters(150), letters(300)
    rows = [(i, t) for i in (7, None) for t in (piece + letters(20) + piece, other + str(i))]
    got = {(g["doc_id"], g["text"]): g["n_removed"] for g in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None, rows[2][1]] == 150 and got[None, rows[3][1]] == 0  # an id of null comes first
    assert got[7, rows[0][1]] == 300 and got[7, rows[1][1]] == 300


def test_a_passage_in_very_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 1000)
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage = letters(120)
    rows = [(i, letters(60) + passage + letters(60)) for i in range(3000)]
    got = {g["doc_id"]: g["n_removed"] for g in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(120 <= got[i] <= 140 for i in range(1, 3000))


def repeats_of(text):
    return brute_repeats([(1, text)])[1][1]


def test_cut_text_is_what_is_utf8(spark):
    text = "é" * 120
    (g,) = repeats.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string"), as_text=True).collect()
    assert set(g["kept"]) <= {"é"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_top_k_is_what_sql_gives(spark, duck, same):
    same(search.op7_topk(spark, SF), duck(SF, search.SQL))


def test_top_k_with_odd_vectors_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-2, 3)) / 4 for _ in range(3)]) for i in range(100)]
    rows += [(200, None), (250, [0.1, None, 0.2]), (300, [float("nan")] * 3), (350, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (400, []), (7, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q in (0, 50, 400):
        (own,) = (v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    got = [(g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in search.top_k(df, lambda i: i % 50 == 0).collect()]
    assert sorted(got) == sorted(expected)
    assert search.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_elimination_stops_early():
    r = np.random.default_rng(2)
    rows = np.concatenate([r.integers(-5, 6, (400, 8)) + c for c in (0, 90, -90)]).astype(float)
    pivots = search.choose_pivots(rows, 16)
    assert len(pivots) == 16
    table = search._distances(rows, pivots)
    got = search.eliminate(np.array([5]), rows[5:6], table[5:6], np.arange(len(rows)), rows, table, 5)
    score = rows @ rows[5]
    score[5] = -np.inf
    assert got["score"].tolist() == sorted(score, reverse=True)[:5]


def test_differencing_is_tight_and_keeps_sums():
    r = np.random.default_rng(3)
    start = np.zeros((500, 24), np.int64)
    start[:, 0] = r.integers(1, 10_000, 500)
    goes, sums = sharding.difference(start)
    parts = np.bincount(goes[:, 0], weights=start[:, 0], minlength=24)
    assert sorted(parts) == sorted(sums) and sums.max() - sums.min() < 200
    assert sharding.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))[1].tolist() == [16, 14]  # the textbook case


def test_floors_keep_every_row_of_the_best(spark):
    r = np.random.default_rng(3)
    rows, ids = r.integers(-9, 9, (300, 6)), np.arange(300)
    pivots = search.choose_pivots(rows.astype(float), 8)
    table = search._distances(rows.astype(float), pivots)
    low = search.floors(ids[:20], rows[:20], ids[::3], rows[::3], 5)
    with_floor = search.eliminate(ids[:20], rows[:20], table[:20], ids, rows, table, 5, low)
    without = search.eliminate(ids[:20], rows[:20], table[:20], ids, rows, table, 5)
    key = lambda d: d.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(5).to_numpy().tolist()
    assert key(with_floor) == key(without)


def brute_differencing(rows):
    """The sums that differencing leaves, by looking at all partial partitions in every step."""
    parts = [(n, sorted(map(int, x), reverse=True)) for n, x in enumerate(rows)]
    nth = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][-1] - p[1][0], p[0]))
        (_, a), (_, b) = parts[:2]
        parts = [*parts[2:], (nth, sorted((x + y for x, y in zip(a, b[::-1], strict=True)), reverse=True))]
        nth += 1
    return parts[0][1]


@pytest.mark.parametrize("seed", range(8))
def test_differencing_is_what_brute_force_gives(seed):
    r = np.random.default_rng(seed)
    k = int(r.integers(2, 7))
    start = np.zeros((int(r.integers(1, 30)), k), np.int64)
    start[:, 0] = r.integers(0, 12 if seed % 2 else 1000, len(start))  # few sizes give many ties
    if seed > 5:
        start = r.integers(0, 50, start.shape)
    goes, sums = sharding.difference(start)
    held = np.zeros(k, np.int64)
    np.add.at(held, goes.ravel(), start.ravel())
    assert sums.tolist() == brute_differencing(start) == held.tolist()
    assert all(sorted(g) == list(range(k)) for g in goes.tolist())


@pytest.mark.parametrize("groups", [40, 7])
def test_levels_spread_no_more_than_a_group(spark, monkeypatch, groups):
    monkeypatch.setattr(sharding, "GROUPS", groups)
    monkeypatch.setattr(sharding, "FAN", 3)
    r = random.Random(31)
    rows = [(i, "x" * r.randrange(1, 400) + str(i % 190)) for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= got["size"].max()


def test_shards(spark):
    r = random.Random(8)
    rows = [(i, "x" * r.randrange(0, 400) if i % 7 else "the same") for i in range(900)] + [(i, None) for i in (1000, 1001, 1001)] + [(1002, ""), (None, "no id")]
    df = spark.createDataFrame([(i, t, 3, "a") for i, t in rows], "doc_id long, text string, shard int, key string")
    got = sharding.shard(df).toPandas()
    assert len(got) == len(rows) and got["size"].sum() == sum(len(t or "") + 8 for _, t in rows) and (got["law"] == "bytes").all()
    assert set(got[got["text_crc32"] == zlib.crc32(b"the same")]["shard"]).__len__() == 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 16
    assert sharding.shard(df.limit(0)).count() == 0


def test_units_are_differenced_in_turn(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS", 10)
    monkeypatch.setattr(sharding, "FAN", 3)
    df = spark.createDataFrame([(i, f"{i} " + "x" * (i * 37 % 300)) for i in range(300)], "doc_id long, text string")
    sums = sharding.shard(df, 4).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert len(sums) == 4 and sums.max() - sums.min() < 0.01 * sums.sum()


def pages(spark):
    big, other = "<p>" + "é" * 700, "y" * 1500
    rows = [(i, f"http://h/{i}", big if i % 3 else other) for i in range(40)] + [(100, None, None), (101, "u\r\n x", ""), (102, "v", "small"), (103, "v", "small"), (None, "w", big), (39, "again", other), (7, "http://h/7", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("x"))


def test_archive_round_trip(spark):
    disk = Scratch(spark, "a")
    warc.write_archive(pages(spark), disk.path, shard_bytes=9000, file_bytes=900)
    got = warc.read_archive(spark, disk.path).collect()
    rows = pages(spark).collect()
    keeper = {}
    for r in rows:
        raw = (r["html"] or "").encode()
        if len(raw) >= 1000 and r["page_id"] is not None:
            keeper[raw] = max(keeper.get(raw, -1), r["page_id"])
    expected = []
    for r in rows:
        raw = (r["html"] or "").encode()
        k = keeper.get(raw)
        again = k is not None and r["page_id"] != k
        expected.append((r["page_id"], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", k if again else None))
    assert sorted(map(str, expected)) == sorted(str((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"])) for g in got)
    assert len({g["file"] for g in got}) > 3


def files(path):
    root = path.removeprefix("file://")
    return {f: hashlib.sha256(open(f"{root}/{f}", "rb").read()).hexdigest() for f in sorted(os.listdir(root))}


def test_archives_are_the_same_bytes_however_rows_are_dealt(spark):
    one, two = Scratch(spark, "b"), Scratch(spark, "c")
    warc.write_archive(pages(spark).coalesce(1), one.path, shard_bytes=9000, file_bytes=900)
    warc.write_archive(pages(spark).repartition(7), two.path, shard_bytes=9000, file_bytes=900)
    assert files(one.path) == files(two.path) and "manifest.json" in files(one.path)
    assert not any(f.startswith("_temporary") for f in files(one.path))


def test_rows_without_an_id_are_spread_and_record_ids_are_unique(spark, tmp_path):
    rows = [(None, f"http://x/{i}", f"page {i} " * 600) for i in range(400)] + [(5, "http://y", "z" * 3000)] * 3 + [(i, f"http://z/{i}", "short") for i in range(6, 20)]
    path = f"file://{tmp_path}/a"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, shard_bytes=50_000)
    got = warc.read_archive(spark, path)
    assert max(r["count"] for r in got.groupBy("file").count().collect()) < 60 and got.count() == len(rows)
    seen = []
    for name in os.listdir(tmp_path / "a"):
        if name.endswith(".gz"):
            with open(tmp_path / "a" / name, "rb") as f:
                found = [m.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for m in warc.members(f)]
            assert found[0].startswith(b"<urn:file:part-")
            seen += found
    assert len(set(seen)) == len(seen) and b"<urn:page:5>" in seen


def test_an_empty_archive(spark):
    disk = Scratch(spark, "d")
    warc.write_archive(pages(spark).limit(0), disk.path)
    assert warc.read_archive(spark, disk.path).count() == 0


def test_damaged_records_raise():
    member = next(warc.members(__import__("io").BytesIO(warc.record(1, "u", b"x" * 50, None, "2020-01-01T00:00:00Z"))))
    assert warc.parse(member)[:3] == (1, "u", 50)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(member.replace(b"xxxx", b"xxxy", 1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op3_quality", "op4_neardup", "op6_warc"])
def test_query_gives_what_sql_gives(spark, duck, same, name):
    from lociflow.llm import registry

    same(registry.QUERIES[name](spark, SF), duck(SF, registry.SQL[name]))
