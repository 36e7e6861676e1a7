import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from lociflow.functions.predicates import overlaps_touching
from lociflow.operators import pyramid
from lociflow.plans.browser import Browser
from lociflow.plans.errors import RequestError
from lociflow.plans.semantic_cache import RangeCache
from lociflow.streaming import limits
from lociflow.streaming import pyramid as stream_pyramid

SIGNAL = "chr string, start int, end int, value float"


@pytest.fixture
def tables(spark, tmp_path):
    rows = [("chr1", 10 * i, 10 * i + 10, float(i % 7)) for i in range(200)]
    spark.createDataFrame(rows, SIGNAL).write.parquet(str(tmp_path / "sig"))
    spark.createDataFrame([("chr1", 5, 20, "n\t1\t+\t5\t20\tc\tk\tmore")], "chr string, start int, end int, rest string").write.parquet(str(tmp_path / "feat"))
    from test_operators import GTF

    from lociflow.operators.annotations import parse_gtf

    parse_gtf(spark.createDataFrame(list(enumerate(GTF.splitlines())), "ord long, value string")).write.parquet(str(tmp_path / "gtf"))
    pyramid.write(pyramid.build(spark.read.parquet(str(tmp_path / "sig")), [20, 100]), str(tmp_path / "zoom"))
    return Browser(spark, str(tmp_path / "gtf"), pyramids={str(tmp_path / "sig"): (str(tmp_path / "zoom"), [20, 100])}), str(tmp_path / "sig"), str(tmp_path / "feat")


def test_signal_requests(tables):
    browser, sig, _ = tables
    assert browser.signal(sig, "chr1", 100, 200).count() == 10
    assert browser.signal(sig, "chr1", 0, 2000, 10).count() == 10  # 200 bases a pixel: from the pyramid's 100
    with pytest.raises(RequestError) as e:
        browser.signal(sig, "chr99", 0, 1)
    assert e.value.field == "chrom" and json.loads(e.value.to_json())["error"]["code"] == "VALIDATION_ERROR"


def test_transcript_envelope(tables):
    got = json.loads(tables[0].transcripts("chr1", 0, 10_000))
    assert [g["name"] for g in got["gene"]] == ["A", "B"] and got["totalRows"] == 1 and got["paddingBp"] == 100
    assert json.loads(tables[0].transcripts("chr2", 0, 10)) == {"gene": [], "paddingBp": 100}


def test_tracks_fan_out_and_report_their_own_errors(tables):
    browser, sig, feat = tables
    tracks = [
        {"id": "a", "type": "bigwig", "config": {"url": sig, "preRenderedWidth": 4}},
        {"id": "b", "type": "bigbed", "config": json.dumps({"url": feat, "type": "ccre"})},
        {"id": "c", "type": "transcript"},
        {"id": "d", "type": "bigwig"},
        {"id": "e", "type": "other"},
    ]
    a, b, c, d, e = browser.browse({"chrom": "chr1", "start": 0, "end": 1000, "tracks": tracks})
    assert len(a["data"]) == 4 and b["data"][0]["name"] == "n" and b["data"][0]["rest"] == "more" and c["data"]["gene"][0]["name"] == "A"
    assert d["error"] == "url is required" and e["error"].startswith("unknown track type")
    with pytest.raises(RequestError) as none:
        browser.browse({"chrom": "chr1", "start": 0, "end": 1, "tracks": []})
    assert none.value.field == "tracks"


def test_warm_cache_gives_what_a_cold_one_gives(spark, tmp_path):
    source = spark.createDataFrame([("chr1", 10 * i, 10 * i + 15, float(i)) for i in range(50)], SIGNAL)
    asked = []

    def fetch(lo, hi):
        asked.append((lo, hi))
        return source.where(overlaps_touching("start", "end", lo, hi))

    warm = RangeCache(spark, str(tmp_path / "warm"), SIGNAL)
    warm.read("u-chr1", "chr1", 100, 200, fetch)
    warm.read("u-chr1", "chr1", 150, 300, fetch)
    got = warm.read("u-chr1", "chr1", 50, 400, fetch)
    assert asked == [(100, 200), (200, 300), (50, 100), (300, 400)]
    cold = RangeCache(spark, str(tmp_path / "cold"), SIGNAL).read("u-chr1", "chr1", 50, 400, fetch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cold.collect())) == [("chr1", 10 * i, 10 * i + 15, float(i)) for i in range(5, 40)]
    total = warm.stats().where("key IS NULL").first()
    assert (total["entries"], total["ranges"]) == (1, 4)


def test_cache_forgets_the_least_recently_used(spark, tmp_path):
    source = spark.createDataFrame([("chr1", 5, 6, 1.0)], SIGNAL)
    asked = []
    cache = RangeCache(spark, str(tmp_path / "c"), SIGNAL, most=1)
    for key in ("a", "b", "a"):
        cache.read(key, "chr1", 0, 10, lambda lo, hi, key=key: asked.append(key) or source).count()
    assert list(cache.used) == ["a"]


def test_token_bucket_counts():
    allowed, tokens, last = limits.spend([0] * 42 + [1], 0, None, 15, 40, 1)
    assert allowed == [True] * 40 + [False] * 2 + [True] and (tokens, last) == (14, 1)


def decided(limited, state, n):
    """The first n decisions of a stream; timers for idle clients keep it busy, so it is stopped then."""
    out = []
    run = limited.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", state).start()
    until = time.monotonic() + 120
    while run.isActive and len(out) < n and time.monotonic() < until:
        time.sleep(0.2)
    run.stop()
    return out


def test_limit_over_a_stream_is_that_over_a_table(spark, tmp_path):
    rows = [(c, 10 * i // (c + 1), i) for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "client int, at int, n int")
    for k in range(2):  # a file a batch: state is carried from one to the next
        df.where(F.col("n").between(10 * k, 10 * k + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = decided(limits.limit_stream(stream, "client", "at", "n", rate=1, burst=4, per=4), str(tmp_path / "state"), len(rows))
    assert sorted(got) == sorted(map(tuple, limits.token_bucket(df, "client", "at", "n", rate=1, burst=4, per=4).collect()))


def test_an_idle_client_is_forgotten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("client int, at int, n int").parquet(str(tmp_path / "in"))
    limited = limits.limit_stream(stream, "client", "at", "n", rate=1, burst=2, per=1000, idle=1)
    allowed = []
    for k in range(2):
        spark.createDataFrame([(1, 0, 10 * k + i) for i in range(3)], "client int, at int, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        allowed += [r[2] for r in decided(limited, str(tmp_path / "state"), 3)]
        time.sleep(2)
    assert sorted(allowed) == [False] * 2 + [True] * 4  # both times a full bucket


def test_streamed_windows(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [("a", day + datetime.timedelta(minutes=m), float(m)) for m in (0, 10, 59, 61, 300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = stream_pyramid.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "v", ["k"])
    run = got.writeStream.format("memory").queryName("zoomed").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    first = spark.table("zoomed").orderBy("start").first()
    assert (first["n"], first["max_val"], first["sum_data"]) == (3, 59.0, 69.0)
    assert spark.table("zoomed").agg(F.sum("n")).first()[0] == 4


def test_large_answers_come_line_by_line(spark):
    from lociflow.plans.browser import lines

    answer = spark.range(100).repartition(5).withColumnRenamed("id", "start")
    got = lines(answer)
    assert json.loads(next(got)).keys() == {"start"} and sum(1 for _ in got) == 99


def test_limits_are_the_sessions(spark):
    from lociflow.streaming import limits

    assert limits.settings(spark) == {"rate": 15, "burst": 40, "idle": 600}
    spark.conf.set("lociflow.limit.rate", "3")
    spark.conf.set("lociflow.limit.burst", "none")
    assert limits.settings(spark) == {"rate": 3, "burst": 40, "idle": 600}
    spark.conf.unset("lociflow.limit.rate")
    spark.conf.unset("lociflow.limit.burst")
