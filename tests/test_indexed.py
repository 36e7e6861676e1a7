import json
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lociflow import sources
from lociflow.operators.annotations import parse_gtf
from lociflow.sources import bgzf, commit, gtf, ranges

LINE = "value string, ord bigint"


def gtf_lines(n, seed=1, hot=0.3):
    r = random.Random(seed)
    for i in range(n):
        chrom = r.choice(["chr1", "chr2", "chr10", "chrX"])
        start = 777_777 if r.random() < hot else r.randrange(1, 3_000_000)
        size = r.choice([0, 5, 3000, 40_000, 2_000_000 if i % 97 == 0 else 9])
        yield f'{chrom}\ts\t{r.choice(["gene", "exon"])}\t{start}\t{start + size}\t.\t+\t.\tgene_id "G{i}"; note "{"x" * r.randrange(80)}";'


def table(spark, n, parts=5):
    return parse_gtf(spark.createDataFrame([(x, i) for i, x in enumerate(gtf_lines(n))], LINE).repartition(parts))


def rows(df):
    return sorted((r["chrom"], r["start"], r["end"], r["feature"], sorted(r["attributes"].items())) for r in df.collect())


def overlap(df, chrom, lo, hi):
    return df.where((F.col("chrom") == chrom) & (F.col("start") - 1 < hi) & (F.col("end") > lo))


REGIONS = [("chr1", 0, 10), ("chr1", 777_000, 778_000), ("chr2", 1_500_000, 1_600_000), ("chrX", 0, 1 << 29), ("chr10", 2_999_999, 3_000_001), ("chr7", 0, 1000), ("chr2", 5_000_000, 6_000_000)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gtf"))
    records = table(spark, 4000).cache()
    gtf.write_indexed(records, path, unit=40_000)
    return path, records


def test_a_region_equals_a_full_scan(spark, folder):
    path, records = folder
    assert rows(gtf.read_indexed(spark, path)) == rows(records)
    for region in REGIONS:
        assert rows(gtf.read_indexed(spark, path, *region)) == rows(overlap(records, *region))


def test_only_files_and_members_of_the_region_are_read(folder, monkeypatch):
    path, _ = folder
    files = commit.listed(path)
    reader = gtf.IndexedReader({"path": path, "chrom": "chr2", "start": "1500000", "end": "1600000"})
    planned = reader.partitions()
    assert 0 < len(planned) < len(files) / 3
    assert {p.path.rpartition("/")[2] for p in planned} == {f["name"] for f in files if "chr2" in f["zones"] and f["zones"]["chr2"][0] < 1_600_000 and f["zones"]["chr2"][1] >= 1_500_000}


def test_one_file_with_one_index(spark, folder, tmp_path, monkeypatch):
    path, records = folder
    one = str(tmp_path / "all.gtf.gz")
    made = gtf.join_parts(spark, path, one).collect()
    assert made[0]["bytes"] == os.path.getsize(one)
    assert rows(gtf.read_indexed(spark, one)) == rows(records)
    import gzip

    assert gzip.open(one).read().count(b"\n") == 4000  # any gzip reads it
    inflated = []
    whole = bgzf.inflate
    monkeypatch.setattr(bgzf, "inflate", lambda data, at, size: inflated.append(size) or whole(data, at, size))
    index = bgzf.Index.parse(open(one + ".tbi", "rb").read())
    for region in REGIONS:
        expected = rows(overlap(records, *region))
        reader = gtf.IndexedReader({"path": one, "chrom": region[0], "start": str(region[1]), "end": str(region[2])})
        named = index.chunks(*region)
        inflated.clear()
        bgzf.Index.parse(open(one + ".tbi", "rb").read())
        of_index = len(inflated)
        inflated.clear()
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert len(got) == len(expected)
        # members from a chunk's first to the one where its last line ends, and no other
        most = sum(members_between(one, a, b) for a, b in named)
        assert len(inflated) - of_index <= most + len(named)
    assert members_between(one, *bgzf.Index.parse(open(one + ".tbi", "rb").read()).chunks("chr1", 0, 10)[0]) < 5


def members_between(path, begin, stop):
    data, at, n = open(path, "rb").read(), begin >> 16, 0
    while at <= stop >> 16 and at < len(data):
        at += bgzf.member_size(data, at)
        n += 1
    return n


def test_bytes_do_not_depend_on_partitions(spark, tmp_path, folder):
    path, records = folder

    def bytes_of(where):
        return [(f["records"], f["zones"], open(f"{where}/{f['name']}", "rb").read(), open(f"{where}/{f['name']}.tbi", "rb").read()) for f in commit.listed(where)]

    for parts in (1, 3, 17):
        gtf.write_indexed(records.repartition(parts), str(tmp_path / f"p{parts}"), unit=40_000, partitions=parts)
        assert bytes_of(str(tmp_path / f"p{parts}")) == bytes_of(path)
    assert max(r for r, *_ in bytes_of(path)) < 2000  # a third of all records share a position


def shuffled(spark):
    """Bytes that all stages so far have written for a shuffle."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_text_is_not_shuffled(spark, tmp_path):
    text = F.concat_ws("", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")), 512) for k in range(16)))
    records = spark.range(4000).select(F.lit("chr1").alias("chrom"), F.lit("s").alias("source"), F.lit("exon").alias("feature"), (F.col("id") % 100 + 1).cast("int").alias("start"), (F.col("id") % 100 + 9).cast("int").alias("end"), *(F.lit(".").alias(c) for c in ("score", "strand", "frame")), F.create_map(F.lit("k"), text).alias("attributes"), F.col("id").alias("ord"))
    before = shuffled(spark)
    gtf.write_indexed(records, str(tmp_path / "f"), unit=1 << 20)
    assert shuffled(spark) - before < 100_000  # of 8 MB, which hardly compress
    assert gtf.read_indexed(spark, str(tmp_path / "f")).select(F.sum(F.length(F.col("attributes")["k"]))).first()[0] == 4000 * 16 * 128


def test_bytes_do_not_depend_on_runs_and_ranges(spark, tmp_path, folder, monkeypatch):
    path, records = folder
    bytes_of = lambda where: [(f["records"], f["zones"], open(f"{where}/{f['name']}", "rb").read()) for f in commit.listed(where)]
    for held, one, group, unit in ((4000, 1500, 6000, 40_000), (1 << 20, 90_000, 360_000, 40_000)):
        monkeypatch.setattr(gtf, "HELD", held)
        monkeypatch.setattr(gtf, "RANGE", one)
        monkeypatch.setattr(gtf, "GROUP", group)
        where = str(tmp_path / f"r{one}")
        gtf.write_indexed(records.repartition(3), where, unit=unit, partitions=2)
        assert bytes_of(where) == bytes_of(path) and not [x for x in os.listdir(where) if x.startswith("_runs")]
    sizes = [0, 5, 0, 17, 40, 1, 0, 9, 30, 0]
    base = [sum(sizes[:i]) for i in range(11)]
    for unit in (1, 7, 10, 45, 1000):
        for tasks in (1, 2, 5, 40):
            told = gtf._tasks(gtf.np.array(sizes), unit, tasks)
            units = sorted({(first, last) for *_, first, last in told})
            assert [u for first, last in units for u in range(first, last + 1)] == list(range(-(-102 // unit)))
            for first, last in units:
                held = [(r, before) for _, r, before, a, _ in told if a == first]
                assert {r for r, _ in held} == {r for r in range(10) if sizes[r] and base[r + 1] > first * unit and base[r] < (last + 1) * unit}
                assert {before for _, before in held} == {base[held[0][0]]}


def test_lines_of_a_run_come_back(spark, tmp_path):
    import pyarrow as pa

    rows = sorted((r.choice(["a", "b\u00e9"]), r.randrange(-5, 1 << 31), r.randrange(-(1 << 31), 1 << 31), r.choice([-(1 << 63), i, (1 << 63) - 1]), "x\n\u00e9" * r.randrange(4)) for r in [random.Random(3)] for i in range(500))
    t = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=gtf._KEY)
    for some in (t, t.slice(7, 1), t.slice(100, 300)):
        assert gtf._unpacked(gtf._packed(some)).to_pylist() == some.to_pylist()


def test_what_does_not_count_is_ignored_and_deleted(spark, tmp_path):
    path = str(tmp_path / "f")
    writer = gtf.IndexedWriter(path, ".gtf.gz", True)
    open(f"{path}/{writer.fresh()}", "wb").write(b"left by a killed attempt")
    open(f"{path}/{writer.fresh()}.tbi", "wb").write(b"this too")
    sources.register(spark)
    with pytest.raises(Exception, match="No such file|NO_SUCH|not found|Cannot open|Errno 2|Failed to open"):
        spark.read.format("indexed_gtf").load(path).collect()
    writer.commit([None, commit.Written([])])
    assert sorted(os.listdir(path)) == [commit.MANIFEST] and spark.read.format("indexed_gtf").load(path).count() == 0
    gtf.write_indexed(table(spark, 50), path)
    first = set(os.listdir(path))
    gtf.write_indexed(table(spark, 60), path)
    assert not (set(os.listdir(path)) - {commit.MANIFEST}) & first and gtf.read_indexed(spark, path).count() == 60
    other = gtf.IndexedWriter(path, ".gtf.gz", False)
    open(f"{path}/{other.fresh()}", "wb").write(b"x")
    other.abort([])
    assert gtf.read_indexed(spark, path).count() == 60 and len(os.listdir(path)) == 3


def test_pushed_filters(spark, folder):
    path, records = folder
    sources.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("indexed_gtf").option("pushdown", "true").load(path)
        got = read.where("chrom = 'chr2' AND start <= 1600000 AND end >= 1500001")
        assert got.count() == overlap(records, "chr2", 1_500_000, 1_600_000).count() and got.rdd.getNumPartitions() < len(commit.listed(path)) / 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_odd_records(spark, tmp_path):
    text = ["chr1\ts\tgene\t5\t4\t.\t+\t.\tk \"v\";", "chr1\ts\tgene\t5\t5\t.\t+\t.\t", f'chr1\ts\tgene\t6\t9\t.\t+\t.\tk "{"é" * 90_000}";']
    records = parse_gtf(spark.createDataFrame([(x, i) for i, x in enumerate(text)], LINE))
    records = records.unionByName(records.where("start = 6").withColumn("chrom", F.lit(None).cast("string")))
    gtf.write_indexed(records, str(tmp_path / "f"))
    got = gtf.read_indexed(spark, str(tmp_path / "f")).orderBy("ord").collect()
    assert [(r["start"], r["end"], len(r["attributes"].get("k", ""))) for r in got] == [(5, 4, 1), (5, 5, 0), (6, 9, 90_000)]
    assert gtf.read_indexed(spark, str(tmp_path / "f"), "chr1", 8, 9).count() == 1
    gtf.write_indexed(records.limit(0), str(tmp_path / "none"))
    assert gtf.read_indexed(spark, str(tmp_path / "none")).count() == 0


def test_members_and_bins():
    import numpy as np

    text = os.urandom(bgzf.MEMBER)
    packed = bgzf.member(text)
    assert bgzf.member_size(packed) == len(packed) <= 1 << 16 and bgzf.inflate(packed, 0, len(packed)) == text
    with pytest.raises(ValueError, match="not block-gzip"):
        bgzf.member_size(zlib.compress(b"x") + b"y" * 20)
    for start, end in ((0, 1), (16_383, 16_385), (0, 1 << 29), (130_000, 140_000), ((1 << 29) - 1, 1 << 29)):
        (own,) = bgzf.bin_of(np.array([start]), np.array([end])).tolist()
        assert own in bgzf.bins_over(start, end)
    assert bgzf.bin_of(np.array([0, 16_384]), np.array([1, 16_385])).tolist() == [4681, 4682]
    assert struct.unpack("<H", bgzf.END[16:18])[0] + 1 == len(bgzf.END) and json.dumps(bgzf.COLUMNS)


def test_near_ranges_come_together():
    assert ranges.joined([(100, 10), (0, 5), (50, 60), (1000, 5)], gap=50) == [(0, 110, [1, 2, 0]), (1000, 5, [3])]
    assert ranges.joined([(0, 100), (100, 100)], most=150) == [(0, 100, [0]), (100, 100, [1])]
