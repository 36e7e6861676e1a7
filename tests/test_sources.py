import functools
import http.server
import os
import threading

from lociflow.sources import bigwriter as W
import pytest
from pyspark.sql import functions as F

from lociflow import sources
from lociflow.sources.bigfile import BigFile, read_range

CHROMS = {"chr1": 100_000, "chr2": 50_000}


def signal_file(path, order="<", compress=True):
    """Sections of all three kinds on two chromosomes, and one zoom level."""
    rows = {1: [(0, 10, 1.0), (10, 30, 2.5), (40, 50, 3.0)], 2: [(100, 105, 4.0), (120, 125, 5.0)], 3: [(200, 205, 6.0), (210, 215, 7.0), (220, 225, 8.0)]}
    blocks = [W.section(order, 0, rows[1], 1), W.section(order, 0, rows[2], 2, span=5), W.section(order, 0, rows[3], 3, step=10, span=5), W.section(order, 1, [(0, 7, 9.0)], 1)]
    zoom = [W.zooms(order, [(0, 0, 100, 10, 1.0, 3.0, 20.0, 50.0), (0, 100, 200, 0, 0.0, 0.0, 5.0, 0.0)]), W.zooms(order, [(1, 0, 100, 7, 9.0, 9.0, 63.0, 567.0)])]
    W.write(path, W.SIGNAL, order, CHROMS, blocks, [(100, zoom)], compress, summary=(57, 1.0, 9.0, 100.0, 500.0))
    return [("chr1", *r) for k in (1, 2, 3) for r in rows[k]] + [("chr2", 0, 7, 9.0)]


def load(spark, kind, path, **options):
    sources.register(spark)
    return spark.read.format(kind).options(**options).load(str(path))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compress", [True, False])
def test_signal_round_trip(spark, tmp_path, order, compress):
    path = tmp_path / "a.bw"
    rows = signal_file(path, order, compress)
    assert sorted(map(tuple, load(spark, "bigwig", path).collect())) == sorted(rows)
    near = load(spark, "bigwig", path, chrom="chr1", start=30, end=121)
    assert sorted(map(tuple, near.collect())) == [r for r in sorted(rows) if r[0] == "chr1" and r[1] < 121 and r[2] >= 30]


def test_signal_metadata_and_zoom(spark, tmp_path):
    path = tmp_path / "a.bw"
    signal_file(path)
    assert {tuple(r) for r in load(spark, "bigwig", path, view="chroms").collect()} == {("chr1", 0, 100_000), ("chr2", 1, 50_000)}
    assert [tuple(r) for r in load(spark, "bigwig", path, view="zooms").collect()] == [(0, 100)]
    assert [tuple(r) for r in load(spark, "bigwig", path, view="summary").collect()] == [(57, 1.0, 9.0, 100.0, 500.0)]
    zoom = load(spark, "bigwig", path, zoom=0, chrom="chr1", start=0, end=1000).orderBy("start").collect()
    assert [(r["start"], r["value"], r["valid_count"]) for r in zoom] == [(0, 2.0, 10), (100, 0.0, 0)]


def test_pushed_filters_prune_blocks(spark, tmp_path):
    path = tmp_path / "a.bw"
    signal_file(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = load(spark, "bigwig", path, pushdown="true").where((F.col("chr") == "chr1") & (F.col("start") >= 100) & (F.col("start") < 130)).collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(r["value"] for r in got) == [4.0, 5.0]


def test_index_walk_reads_overlapping_blocks_only(tmp_path):
    path = str(tmp_path / "a.bw")
    signal_file(path)
    f = BigFile(path, W.SIGNAL)
    assert len(f.blocks(f.index_at, None, 0, 1 << 31)) == 4
    assert len(f.blocks(f.index_at, 0, 50, 100)) == 1  # it ends where the range begins
    assert len(f.blocks(f.index_at, 0, 51, 101)) == 1
    assert len(f.blocks(f.index_at, 1, 0, 5)) == 1
    assert f.auto_sql == "table x"


@pytest.mark.parametrize("order", ["<", ">"])
def test_features_round_trip(spark, tmp_path, order):
    path = tmp_path / "a.bb"
    rows = [(0, 5, 10, "a\tb"), (0, 20, 40, ""), (0, 60, 70, "é")]
    W.write(path, W.FEATURE, order, CHROMS, [W.features(order, rows[:2]), W.features(order, rows[2:]), W.features(order, [(1, 1, 2, "z")])])
    assert sorted(map(tuple, load(spark, "bigbed", path).collect())) == [*(("chr1", *r[1:]) for r in rows), ("chr2", 1, 2, "z")]
    assert load(spark, "bigbed", path, chrom="chr1", start=40, end=61).count() == 2


def test_wrong_files_raise(spark, tmp_path):
    path = tmp_path / "a.bw"
    signal_file(path)
    with pytest.raises(ValueError, match="not of this format"):
        BigFile(str(path), W.FEATURE)
    with pytest.raises(Exception, match="unknown chromosome"):
        load(spark, "bigwig", path, chrom="chr9").collect()
    path.write_bytes(path.read_bytes()[:100])
    with pytest.raises(OSError, match="bytes at"):
        BigFile(str(path), W.SIGNAL)


def test_server_must_honour_ranges(tmp_path):
    (tmp_path / "x").write_bytes(bytes(range(200)))
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = lambda *a: None
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with pytest.raises(OSError, match="ignores ranges"):
            read_range(f"http://127.0.0.1:{server.server_port}/x", 5, 10)
    finally:
        server.shutdown()


def test_gtf_text_to_clustered_table(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\nchr1\ts\tgene\t5\t9\t.\t+\t.\tgene_id "G";\nchr1\ts\tgene\t1\t3\t.\t-\t.\tgene_id "H";\n')
    from lociflow.sources.gtf import read_gtf, write_clustered

    write_clustered(read_gtf(spark, str(tmp_path / "a.gtf")), str(tmp_path / "t"), 1)
    assert [r["attributes"]["gene_id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["H", "G"]
    assert os.path.isdir(tmp_path / "t")
