import http.server
import os
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociflow import sources
from lociflow.operators import pyramid
from lociflow.sources import bigwriter as W
from lociflow.sources import commit, ranges, regions
from lociflow.sources.bigfile import BigFile, BigReader, signal_rows

SIGNAL = "chr string, start int, end int, value float"


def signal(spark, n=4000, chroms=30, seed=1):
    r = random.Random(seed)
    rows = []
    for c in range(chroms):
        at = 0
        for _ in range(n // chroms):
            at += r.randrange(0, 50)
            size = r.randrange(1, 60)
            rows.append((f"chr{c}", at, at + size, float(r.randrange(1000)) / 4))
            at += size
    return spark.createDataFrame(rows, SIGNAL).repartition(7), sorted(rows)


def load(spark, kind, path, **options):
    sources.register(spark)
    return spark.read.format(kind).options(**options).load(str(path))


@pytest.mark.parametrize(("fan", "chrom_fan"), [(2, 2), (3, 5), (256, 256)])
def test_one_file_of_all_chromosomes(spark, tmp_path, monkeypatch, fan, chrom_fan):
    df, rows = signal(spark)
    path = str(tmp_path / "all.bw")
    n = W.write_one_bigwig(df, path, [100, 1000], fan, chrom_fan, partitions=5)
    f = BigFile(path, W.SIGNAL)
    assert len(f.chroms) == 30 and [f.chroms[c][0] for c in sorted(f.chroms)] == list(range(30))
    assert n == len(f.blocks(f.index_at, None, 0, 1 << 31)) >= 30
    if fan == 2:
        assert len(W._nodes(n, fan)) >= 5 and len(W._nodes(30, chrom_fan)) >= 4
    assert sorted(map(tuple, load(spark, "bigwig", path).collect())) == rows
    lo, hi = 500, 900
    assert sorted(map(tuple, load(spark, "bigwig", path, chrom="chr17", start=lo, end=hi).collect())) == [r for r in rows if r[0] == "chr17" and r[1] < hi and r[2] >= lo]
    for level, reduction in enumerate((1000, 100)):
        got = {(r["chr"], r["start"]): (r["valid_count"], r["min"], r["max"], round(r["sum"], 2)) for r in load(spark, "bigwig", path, zoom=level).collect()}
        expected = {(r["chr"], r["start"]): (r["valid_count"], r["min_val"], r["max_val"], round(float(np.float32(r["sum_data"])), 2)) for r in pyramid.build(df, [reduction]).collect()}
        assert got == expected
    total = load(spark, "bigwig", path, view="summary").first()
    assert total["bases_covered"] == sum(r[2] - r[1] for r in rows) and total["sum_squares"] == pytest.approx(sum((r[2] - r[1]) * r[3] ** 2 for r in rows))


def test_one_file_does_not_depend_on_partitions(spark, tmp_path):
    df, _ = signal(spark, 500, 3)
    for k in (1, 6):
        W.write_one_bigwig(df.repartition(k), str(tmp_path / f"{k}.bw"), [100], partitions=1)
    assert (tmp_path / "1.bw").read_bytes() == (tmp_path / "6.bw").read_bytes()
    assert W.write_one_bigwig(df.limit(0), str(tmp_path / "none.bw"), [100]) == 0
    assert load(spark, "bigwig", tmp_path / "none.bw").count() == 0 and load(spark, "bigwig", tmp_path / "none.bw", zoom=0).count() == 0


@pytest.mark.parametrize("fan", [2, 7, 100])
def test_index_of_any_depth_finds_what_overlaps(tmp_path, fan):
    blocks = [W.section("<", c, [(s, s + 7, 1.0)], 1) for c in range(4) for s in range(0, 300, 10)]
    path = str(tmp_path / "a.bw")
    W.write(path, W.SIGNAL, "<", {f"chr{c}": 400 for c in range(4)}, blocks, fan=fan, chrom_fan=2)
    f = BigFile(path, W.SIGNAL)
    assert f.chroms == {f"chr{c}": (c, 400) for c in range(4)}
    for c, lo, hi in ((0, 0, 5), (2, 95, 131), (3, 290, 400), (1, 8, 9)):
        assert len(f.blocks(f.index_at, c, lo, hi)) == sum(s < hi and s + 7 >= lo for s in range(0, 300, 10))


def test_step_sections(spark, tmp_path):
    fixed = [(s, s + 5, float(s)) for s in range(1000, 1400, 10)]
    equal = [(s, s + 7, 1.0) for s in sorted(random.Random(1).sample(range(2000, 9000, 8), 60))]
    other = [(9000 + 20 * i, 9000 + 20 * i + 1 + i % 9, 2.0) for i in range(50)]
    rows = fixed + equal + other + [(20_000, 20_001, 5.0)]
    start, end, value = (np.array(x) for x in zip(*rows, strict=True))
    made = W.sections_of("<", 0, start, end, value)
    kinds = [raw[20] for raw, _ in made]
    assert set(kinds) == {1, 2, 3} and sum(len(raw) for raw, _ in made) < 24 + 12 * len(rows)
    W.write(path := str(tmp_path / "a.bw"), W.SIGNAL, "<", {"chr1": 30_000}, made)
    f = BigFile(path, W.SIGNAL)
    got = [x for raw, _ in made for x in zip(*(a.tolist() for a in signal_rows(f, raw)[1:]), strict=True)]
    assert got == [(s, e, v) for s, e, v in rows]
    assert sorted(tuple(r)[1:] for r in load(spark, "bigwig", path).collect()) == rows
    for n in (1, 2, 3, 15, 16, 17, 1500):
        s = np.arange(n) * 3
        assert sum(len(x) for x, _ in W.sections_of("<", 0, s, s + 2, s.astype(float))) <= 24 * 2 + 12 * n
    repeated = W.sections_of("<", 0, np.zeros(40, int), np.full(40, 9), np.ones(40))
    assert [raw[20] for raw, _ in repeated] == [2]


def test_only_files_of_the_region_are_planned(spark, tmp_path):
    df, rows = signal(spark)
    W.write_bigwig(df, str(tmp_path / "f"), [100], partitions=12, roll=150)
    files = commit.listed(str(tmp_path / "f"))
    assert sum(f["records"] for f in files) == len(rows) and max(f["records"] for f in files) <= 150
    planned = BigReader(str(tmp_path / "f"), W.SIGNAL, ".bw", {"chrom": "chr19", "start": "100", "end": "300"}).partitions()
    assert {p.path.rpartition("/")[2] for p in planned} == {f["name"] for f in files if "chr19" in f["zones"] and f["zones"]["chr19"][0] < 300 and f["zones"]["chr19"][1] >= 100}
    assert 1 <= len(planned) <= 3
    assert sorted(map(tuple, load(spark, "bigwig", tmp_path / "f").collect())) == rows
    assert load(spark, "bigwig", tmp_path / "f", chrom="nowhere").count() == 0


def test_a_killed_attempt_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "f")
    df, rows = signal(spark, 300, 3)
    W.write_bigwig(df, path)
    before = set(os.listdir(path))

    def broken(batches):
        for b in batches:
            if "chr2" in b.column(0).to_pylist():
                raise OSError("the disk is gone")
            yield b

    with pytest.raises(Exception, match="the disk is gone"):
        df.repartitionByRange(3, "chr").sortWithinPartitions("chr", "start").mapInArrow(broken, SIGNAL).write.format("bigwig").mode("append").save(path)
    assert set(os.listdir(path)) == before and sorted(map(tuple, load(spark, "bigwig", path).collect())) == rows
    df.sortWithinPartitions("chr", "start").coalesce(1).sortWithinPartitions("chr", "start").write.format("bigwig").mode("append").save(path)
    assert load(spark, "bigwig", path).count() == 2 * len(rows)


def test_many_regions_read_each_block_once(spark, tmp_path):
    df, rows = signal(spark, 9000, 3)
    W.write_bigwig(df, str(tmp_path / "f"), partitions=4)
    r = random.Random(4)
    asked = [(i, f"chr{r.randrange(4)}", at, at + r.choice([1, 10, 300, 100_000])) for i in range(400) for at in [r.randrange(150_000)]]
    asked += [(900, None, 1, 2), (901, "chr1", 5, 5), (902, "chr1", None, 7), *asked[:3]]
    regions_df = spark.createDataFrame(asked, "id long, chr string, start long, end long")
    got = sorted((x["id"], x["chr"], x["r_start"], x["r_end"], x["r_value"]) for x in regions.records_of_regions(regions_df, "bigwig", str(tmp_path / "f")).collect())
    expected = sorted((i, c, s, e, v) for i, c, lo, hi in asked if c and lo is not None and lo < hi for chrom, s, e, v in rows if chrom == c and s < hi and e >= lo)
    assert got == expected
    sources.register(spark)
    blocks = regions.blocks_of(spark, "bigwig", str(tmp_path / "f"))
    met = regions.blocks_met(regions_df.where("chr IS NOT NULL AND start < end"), blocks)
    assert met.count() == met.distinct().count() <= blocks.count()
    one = regions.blocks_met(spark.createDataFrame([(1, "chr1", 0, 10)], "id long, chr string, start long, end long"), blocks)
    assert one.count() < blocks.count() / 3
    features = spark.createDataFrame([("chr1", 5, 9, "a"), ("chr1", 50, 90, "b"), ("chr2", 5, 9, "é")], "chr string, start int, end int, rest string")
    W.write_bigbed(features, str(tmp_path / "b"))
    found = regions.records_of_regions(spark.createDataFrame([(1, "chr1", 9, 51), (2, "chr2", 0, 5), (3, "chr2", 0, 6)], "id long, chr string, start long, end long"), "bigbed", str(tmp_path / "b"))
    assert sorted((x["id"], x["r_rest"]) for x in found.collect()) == [(1, "a"), (1, "b"), (3, "é")]


def test_sums_of_many_regions(spark, tmp_path):
    r = random.Random(7)
    # records overlap, some reach over many bins, and one place is in very many records and regions
    rows = [("chr%d" % (i % 2), s, s + r.choice([1, 20, 3000, 400_000]), float(r.randrange(-50, 50))) for i in range(3000) for s in [r.choice([1 << 17, r.randrange(600_000)])]]
    W.write_bigwig(spark.createDataFrame(rows, SIGNAL), str(tmp_path / "f"), partitions=3)
    asked = [(i % 500, f"chr{i % 3}", at, at + r.choice([1, 10, 300, 300_000, 5_000_000])) for i in range(900) for at in [r.choice([1 << 17, r.randrange(700_000)])]]
    asked += [(None, "chr0", 0, 1000), (900, None, 1, 2), (901, "chr1", 5, 5), (902, "chr1", None, 7), *asked[:3]]
    regions_df = spark.createDataFrame(asked, "id long, chr string, start long, end long")
    expected = {}
    for i, c, lo, hi in asked:
        for chrom, s, e, v in rows:
            if c == chrom and lo is not None and lo < hi and s < hi and e >= lo:
                n, first, most = expected.get(i, (0, s, v))
                expected[i] = (n + 1, min(first, s), max(most, v))
    assert {x["id"]: (x["n"], x["first_start"], x["max_value"]) for x in regions.sums_of_regions(regions_df, str(tmp_path / "f"), ["id"]).collect()} == expected
    assert regions.sums_of_regions(regions_df.limit(0), str(tmp_path / "f"), ["id"]).count() == 0


def test_sums_do_not_depend_on_how_many_regions_a_task_holds(monkeypatch):
    monkeypatch.setattr(regions, "AT_ONCE", 7)
    r = np.random.default_rng(1)
    start = r.integers(0, 5000, 200)
    end = start + r.integers(1, 30, 200)
    batches = [pa.RecordBatch.from_arrays([pa.array(["a"] * 20), pa.array(start[k : k + 20]), pa.array(end[k : k + 20])], names=["chr", "start", "end"]) for k in range(0, 200, 20)]
    told = [x for b in regions._unions(iter(batches)) for x in b.to_pylist()]
    bases = lambda ranges: {x for s, e in ranges for x in range(s, e)}
    assert bases((x["start"], x["end"]) for x in told) == bases(zip(start.tolist(), end.tolist(), strict=True))
    value = r.integers(-9, 9, 200).astype(float)
    value[5] = np.nan
    lo = r.integers(-10, 5100, 300)
    hi = lo + r.integers(1, 900, 300)
    for a, b, n, first, most in zip(lo, hi, *regions._summed(start, end, value, lo, hi), strict=True):
        met = (start < b) & (end >= a)
        assert n == met.sum()
        if n:
            assert first == start[met].min() and np.array_equal(most, value[met].max(), equal_nan=True)


class Counting(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    data, connections, requests, broken = b"", 0, 0, 0

    def setup(self):
        Counting.connections += 1
        super().setup()

    def log_message(self, *a):
        pass

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("ETag", "x")
        self.send_header("Content-Length", str(len(self.data)))
        self.end_headers()

    def do_GET(self):
        Counting.requests += 1
        if Counting.broken:
            Counting.broken -= 1
            self.send_response(503)
            self.send_header("Content-Length", "0")
            self.end_headers()
            return
        a, b = self.headers["Range"].removeprefix("bytes=").split("-")
        some = self.data[int(a) : int(b) + 1]
        self.send_response(206)
        self.send_header("Content-Length", str(len(some)))
        self.end_headers()
        self.wfile.write(some)


@pytest.fixture
def server():
    Counting.connections = Counting.requests = Counting.broken = 0
    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Counting)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/a.bw"
    made.shutdown()


def test_ranges_share_a_connection_and_come_together(server, monkeypatch):
    monkeypatch.setattr(ranges, "PAUSE", 0.001)
    Counting.data = bytes(range(256)) * 100
    for i in range(20):
        assert ranges.read_range(server, 10 * i, 5) == Counting.data[10 * i : 10 * i + 5]
    assert (Counting.connections, Counting.requests) == (1, 20)
    got = dict(ranges.read_many(server, [(i * 100, 50) for i in range(100)], gap=64))
    assert got == {i: Counting.data[i * 100 : i * 100 + 50] for i in range(100)} and Counting.requests == 21
    Counting.broken = 2
    assert ranges.read_range(server, 0, 4) == b"\0\1\2\3" and Counting.requests == 24
    Counting.broken = 99
    with pytest.raises(OSError, match="after 4 requests"):
        ranges.read_range(server, 0, 4)
    Counting.broken = 0
    with pytest.raises(OSError, match="bytes at"):
        ranges.read_range(server, len(Counting.data) - 2, 4)
    assert ranges.read_range(server, len(Counting.data) - 2, 4, short=True) == b"\xfe\xff"


def test_a_file_on_a_server(spark, tmp_path, server):
    df, rows = signal(spark, 3000, 3)
    W.write_one_bigwig(df, str(tmp_path / "a.bw"), [100], fan=4)
    Counting.data = (tmp_path / "a.bw").read_bytes()
    f = BigFile(server, W.SIGNAL)
    before = Counting.requests
    assert len(f.blocks(f.index_at, None, 0, 1 << 31)) >= 3
    assert Counting.requests - before <= 2 + len(W._nodes(len(rows), 4))  # a request a level
    got = load(spark, "bigwig", server, chrom="chr1", start=0, end=1 << 30)
    assert sorted(map(tuple, got.collect())) == [r for r in rows if r[0] == "chr1"]
