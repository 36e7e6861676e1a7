import json
import random

import pytest
from pyspark.sql import functions as F

from lociflow.functions import parsing
from lociflow.functions import requests as asking
from lociflow.operators import intervals, pyramid
from lociflow.plans import errors, requests
from lociflow.plans.browser import Browser
from lociflow.streaming import limits

SIGNAL = "chr string, start int, end int, value float"
REDUCTIONS = [10, 100, 1000]


@pytest.fixture(scope="module")
def tracks(spark, tmp_path_factory):
    r = random.Random(1)
    rows = []
    for c in ("chr1", "chr2"):
        at = 0
        while at < 30_000:
            at += r.randrange(0, 60)
            size = r.randrange(1, 90)
            rows.append((c, at, at + size, float(r.randrange(100)) / 4))
            at += size
    signal = spark.createDataFrame(rows, SIGNAL)
    path = str(tmp_path_factory.mktemp("levels"))
    pyramid.write(pyramid.build(signal, REDUCTIONS), path)
    return signal, path


def test_many_requests_are_answered_as_each_alone(spark, tracks):
    signal, path = tracks
    r = random.Random(2)
    asked = [(i, r.choice(["chr1", "chr2", "chr3"]), at, at + r.choice([1, 40, 500, 9000, 40_000]), r.choice([-1, 0, 1, 3, 20, 200])) for i in range(30) for at in [r.randrange(30_000)]]
    table = spark.createDataFrame([*asked, (90, None, 1, 5, 3), (91, "chr1", 9, 9, 3), (92, "chr1", 9, None, 3)], "id long, chr string, start long, end long, width int")
    got = {}
    for x in requests.pixels(table, signal, spark.read.parquet(path), REDUCTIONS).collect():
        got.setdefault(x["id"], []).append((x["x"], x["max"], x["min"]))
    browser = Browser(spark, open_signal=lambda s, url: signal, pyramids={"/x": (path, REDUCTIONS)})
    for i, chrom, lo, hi, width in asked[:12]:
        alone = [tuple(x) for x in browser.signal("/x", chrom, lo, hi, width).select("x", "max", "min").collect()] if width > 0 else []
        assert sorted(got.get(i, [])) == sorted(alone)
    assert not {90, 91, 92} & set(got)


def brute_remainder(lo, hi, covered):
    free = [p for p in range(lo, hi) if not any(s <= p < e for s, e in covered)]
    out = []
    for p in free:
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


def test_remainders(spark):
    r = random.Random(3)
    cover = {k: [(s, s + r.randrange(0, 30)) for s in (r.randrange(-50, 400) for _ in range(r.randrange(12)))] for k in range(6)}
    asked = [(i, r.randrange(8), lo, lo + r.randrange(0, 200)) for i in range(60) for lo in [r.randrange(-80, 400)]] + [(99, None, 0, 10)]
    ranges = spark.createDataFrame([(k, s, e) for k, own in cover.items() for s, e in own] + [(None, 0, 10)], "k int, start long, end long")
    for width in (8, 1 << 16):
        got = sorted((x["id"], x["start"], x["end"]) for x in intervals.remainder(spark.createDataFrame(asked, "id int, k int, start long, end long"), ranges, ["k"], "id", width=width).collect())
        assert got == sorted((i, *p) for i, k, lo, hi in asked for p in brute_remainder(lo, hi, cover.get(k, [])))


def test_remainder_pairs_no_request_with_all_ranges(spark):
    ranges = spark.range(30_000).select((F.col("id") % 1).alias("k"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    asked = spark.range(2000).select("id", (F.col("id") % 1).alias("k"), (F.col("id") * 150).alias("start"), (F.col("id") * 150 + 20).alias("end"))
    got = intervals.remainder(asked, ranges, ["k"], "id", width=4096)
    assert got.count() == 4000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_an_answer_is_streamed(spark, tracks):
    signal, path = tracks
    features = spark.createDataFrame([("chr1", i, i + 5, f"n{i}") for i in range(0, 3000, 2)], "chr string, start int, end int, rest string")
    browser = Browser(spark, open_signal=lambda s, url: signal, open_features=lambda s, url: features, pyramids={"/x": (path, REDUCTIONS)})
    asked = {"chrom": "chr1", "start": 0, "end": 3000, "tracks": [
        {"id": 1, "type": "bigbed", "config": {"url": "/f"}}, {"id": 2, "type": "bigwig", "config": json.dumps({"url": "/x", "preRenderedWidth": 7})}, {"id": 3, "type": "bigwig", "config": {"url": "no url"}}, {"id": 4, "type": "?"}, {"id": 5, "type": "bigbed", "config": "{"}, {"id": 6, "type": "bigbed", "config": {"url": "/f", "type": "ccre"}},
    ]}
    with pytest.raises(Exception, match="too few fields"):
        browser.browse(asked)
    asked["tracks"].pop()
    pieces = list(browser.stream(asked))
    assert len(pieces) > 1500 and max(map(len, pieces)) < 400
    got = json.loads("".join(pieces))
    assert got == browser.browse(json.dumps(asked)) and [t["id"] for t in got] == [1, 2, 3, 4, 5]
    assert len(got[0]["data"]) == 1500 and len(got[1]["data"]) == 7 and all(t["data"] is None and t["error"] for t in got[2:])
    some = browser.stream(asked)
    assert next(some) == "["
    some.close()  # whoever stops early leaves no thread behind
    with pytest.raises(errors.RequestError, match="at least one track"):
        next(browser.stream({"chrom": "chr1", "start": 0, "end": 5}))


def test_decoding_requests(spark):
    texts = ['{"url": "/a", "chrom": "chr1", "start": 1, "end": 5}', "{", "[]", "null", None, '{"start": "x"}', '{"chrom": "chr1", "end": 9, "more": {"a": [1]}}', "{}", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", asking.signal_request(F.col("t")).alias("r")).orderBy("i").collect()
    assert [x["r"]["error"]["code"] if x["r"]["error"] else None for x in rows] == [None, "INVALID_JSON", "INVALID_JSON", "INVALID_JSON", "INVALID_JSON", "INVALID_JSON", "VALIDATION_ERROR", "VALIDATION_ERROR", "INVALID_JSON"]
    assert rows[0]["r"]["request"].asDict() == {"url": "/a", "chrom": "chr1", "start": 1, "end": 5, "preRenderedWidth": 0, "type": "", "paddingBp": 0}
    many = '{"chrom": "chr2", "start": 1, "end": 2, "tracks": [{"id": "a", "type": "bigwig", "config": {"url": "/u", "preRenderedWidth": 3}}, {"id": "b"}]}'
    got = spark.createDataFrame([(many,)], "t string").select(F.explode(asking.decode(F.col("t"), asking.BROWSER)["tracks"]).alias("t")).select("t.id", asking.track_config(F.col("t.config")).alias("c")).collect()
    assert [(x["id"], x["c"]["url"], x["c"]["preRenderedWidth"]) for x in got] == [("a", "/u", 3), ("b", "", 0)]


def test_names(spark):
    got = spark.range(1).select(parsing.track_key(F.lit("u"), F.lit("chr1"), F.lit(-1)), parsing.track_key(F.lit("u"), F.lit("chr1"), F.lit(2)), parsing.region_text(F.lit("chr1"), F.lit(5), F.lit(9)), parsing.hex_id().alias("h"), parsing.hex_id().alias("g")).first()
    assert tuple(got)[:3] == ("u-chr1", "u-chr1-zoom2", "chr1:5-9")
    assert got["h"] != got["g"] and len(got["h"]) == 19 and set(got["h"]) <= set("0123456789abcdef-")
    back = spark.range(1).select(parsing.parse_region(parsing.region_text(F.lit("chrX"), F.lit(5), F.lit(9))).alias("r")).first()["r"]
    assert tuple(back) == ("chrX", 5, 9)


def test_limits_come_from_the_session(spark):
    events = spark.createDataFrame([(1, 0, i) for i in range(50)], "client int, at int, n int")
    assert limits.token_bucket(events, "client", "at", "n").where("allowed").count() == limits.BURST
    spark.conf.set("lociflow.limit.burst", "7")
    try:
        assert limits.token_bucket(events, "client", "at", "n").where("allowed").count() == 7
    finally:
        spark.conf.unset("lociflow.limit.burst")
    assert limits.token_bucket(events, "client", "at", "n", burst=3).where("allowed").count() == 3


def sequential(rows, rate, burst, per):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((at, n) for k, at, n in rows if k == c)
        allowed, _, _ = limits.spend([at for at, _ in own], 0, None, rate, burst, per)
        out |= {(c, n): ok for (_, n), ok in zip(own, allowed, strict=True)}
    return out


@pytest.mark.parametrize("seed", range(60))
def test_a_stretch_of_requests_is_a_function_of_tokens(seed):
    r = random.Random(seed)
    burst, per, rate = r.randrange(1, 6), r.choice([1, 2, 7, 50]), r.randrange(1, 5)
    gaps = [r.choice([0, 0, 1, 2, r.randrange(60)]) for _ in range(r.randrange(1, 60))]
    made = limits.Transition(burst, per)
    for g in gaps:
        made.request(g * rate)
    for x in range(burst * per + 1):
        tokens = x
        for g in gaps:
            tokens = min(burst * per, tokens + g * rate)
            tokens -= per if tokens >= per else 0
        assert made.after(x) == tokens
    assert len(made.pieces) <= 4 * burst + 4


def test_one_clients_requests_are_many_tasks(spark):
    r = random.Random(9)
    rows, at = [], 0
    for i in range(6000):
        at += r.choice([0, 0, 0, 1, 2, 30 if i % 500 == 0 else 0])
        rows.append(("hot" if i % 10 else None, at, i))
    rows += [(f"c{i}", i, 10_000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "client string, at int, n int").repartition(4)
    for rate, burst, per in ((1, 3, 4), (2, 40, 1)):
        got = limits.token_bucket(df, "client", "at", "n", rate, burst, per)
        assert {(x["client"], x["n"]): x["allowed"] for x in got.collect()} == sequential(rows, rate, burst, per)
    assert df.where("client = 'hot'").repartitionByRange(8, "client", "at", "n").select(F.spark_partition_id()).distinct().count() > 3
    assert limits.token_bucket(df.limit(0), "client", "at", "n").count() == 0


@pytest.mark.parametrize("levels", [[10, 20, 100], [10, 15, 30], [7]])
def test_levels_from_the_finest(spark, levels):
    r = random.Random(5)
    rows = [("c", at, at + r.choice([0, 1, 9, 300]), r.randrange(99) / 4) for at in (r.randrange(2000) for _ in range(80))]
    got = {(x["reduction"], x["start"]): (x["valid_count"], x["min_val"], x["max_val"], x["sum_data"], x["sum_squares"]) for x in pyramid.build(spark.createDataFrame(rows, SIGNAL), levels).collect()}
    expected = {}
    for w in levels:
        for b in range(0, 2400, w):
            held = [(min(e, b + w) - max(s, b), v) for _, s, e, v in rows if max(s, b) < min(e, b + w)]
            if held:
                expected[w, b] = (sum(n for n, _ in held), min(v for _, v in held), max(v for _, v in held), sum(n * v for n, v in held), sum(n * v * v for n, v in held))
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in expected)
