import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociflow.functions import parsing, validation
from lociflow.operators import annotations, intervals, layout, pyramid, resample, signal

SIGNAL = "chr string, start int, end int, value float"


def gaps(spark, lo, hi, held):
    asked = spark.createDataFrame([(1, "k", lo, hi)], "request int, key string, start int, end int")
    got = intervals.remainder(asked, spark.createDataFrame([("k", s, e) for s, e in held], "key string, start int, end int"), ["key"], "request")
    return sorted((r["start"], r["end"]) for r in got.collect())


@pytest.mark.parametrize(
    "lo, hi, held, expected",
    [
        (0, 100, [(200, 300)], [(0, 100)]),
        (0, 100, [(50, 150)], [(0, 50)]),
        (75, 125, [(50, 150)], []),
        (75, 200, [(50, 150)], [(150, 200)]),
        (175, 200, [(50, 150)], [(175, 200)]),
        (100, 200, [(100, 200)], []),
        (0, 500, [(50, 150), (200, 300)], [(0, 50), (150, 200), (300, 500)]),
        (0, 10, [], [(0, 10)]),
        (5, 5, [], []),
    ],
)
def test_remainder(spark, lo, hi, held, expected):
    assert gaps(spark, lo, hi, held) == expected


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=8))
def test_remainder_and_covered_make_up_the_request(spark, ranges):
    held = [(s, s + n) for s, n in ranges]
    free = {x for s, e in gaps(spark, 10, 50, held) for x in range(s, e)}
    assert free == set(range(10, 50)) - {x for s, e in held for x in range(s, e)}


@pytest.mark.parametrize("ranges, expected", [([(0, 10), (10, 20)], [(0, 20)]), ([(0, 10), (11, 20)], [(0, 10), (11, 20)]), ([(0, 50), (10, 20)], [(0, 50)]), ([], [])])
def test_merge(spark, ranges, expected):
    df = spark.createDataFrame([("k", s, e) for s, e in ranges], "key string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in intervals.merge(df, ["key"]).collect()) == expected


def test_interval_join_pairs_each_overlap_once(spark):
    a = [(i, i * 7 % 90, i * 7 % 90 + i % 40) for i in range(40)]
    b = [(i, i * 11 % 90, i * 11 % 90 + i % 25) for i in range(40)]
    left, right = (spark.createDataFrame([("c", *r) for r in rows], "chr string, id int, start int, end int") for rows in (a, b))
    got = sorted((r["id"], r["r_id"]) for r in intervals.interval_join(left, right, ["chr"], 16).collect())
    assert got == sorted((i, j) for i, s, e in a for j, u, v in b if s < v and u < e)


def pixels(spark, rows, width):
    df = spark.createDataFrame([("chr1", *r) for r in rows], SIGNAL)
    return [(r["x"], r["max"], r["min"]) for r in resample.to_width(df, width).orderBy("x").collect()]


@pytest.mark.parametrize(
    "rows, width, expected",
    [
        ([], 100, []),
        ([(0, 10, 1.0)], 0, []),
        ([(5, 5, 1.0)], 3, []),
        ([(0, 10, 1.0), (10, 20, 5.0), (20, 30, 3.0)], 1, [(0, 5, 1)]),
        ([(0, 25, 10.0), (25, 50, 20.0), (50, 75, 5.0), (75, 100, 15.0)], 2, [(0, 20, 10), (1, 20, 5)]),
        ([(0, 10, 50.0), (10, 20, 100.0), (20, 30, 25.0), (30, 40, 75.0)], 1, [(0, 100, 25)]),
        ([(0, 10, 1.0), (0, 10, 4.0), (90, 100, 9.0)], 10, [(0, 4, 1), (1, 4, 1), *((x, 4, 4) for x in range(2, 9)), (9, 9, 9)]),
    ],
)
def test_resample(spark, rows, width, expected):
    assert pixels(spark, rows, width) == expected


def test_resample_has_exactly_width_rows(spark):
    got = pixels(spark, [(10 * i, 10 * i + 10, float(i % 100)) for i in range(775)], 1000)
    assert [x for x, _, _ in got] == list(range(1000)) and all(mx >= mn for _, mx, mn in got)


@pytest.mark.parametrize(
    "start, end, width, reductions, expected",
    [(0, 10_000, 1000, [], -1), (0, 10_000, 0, [10], -1), (0, 10_000, -10, [10], -1), (0, 100, 100, [10], -1), (0, 10_000_000, 1000, [10, 100, 1000], 2), (0, 1000, 100, [100, 1000], -1), (0, 100_000_000, 800, [10, 100, 1000, 10000], 3), (0, 100_000, 100, [10, 100, 1000], 2)],
)
def test_select_level(start, end, width, reductions, expected):
    assert pyramid.select_level(start, end, width, reductions) == expected


def test_pyramid_weighs_by_bases_and_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 0, 150, 2.0), ("chr1", 150, 200, 6.0)], SIGNAL)
    built = pyramid.build(df, [100, 200])
    pyramid.write(built, str(tmp_path / "p"))
    got = {(r["start"], r["valid_count"], r["value"]) for r in pyramid.read_level(spark, str(tmp_path / "p"), 100).collect()}
    assert got == {(0, 100, 2.0), (100, 100, 4.0)}
    assert [r["sum_squares"] for r in built.where("reduction = 200").collect()] == [150 * 4 + 50 * 36]


def packed(spark, rows, padding):
    df = spark.createDataFrame(rows, "id string, start int, end int")
    return {r["id"]: r["row"] for r in layout.pack_rows(df, [], padding=padding).collect()}


@pytest.mark.parametrize(
    "rows, padding, expected",
    [
        ([], 100, {}),
        ([("t1", 100, 200)], 100, {"t1": 0}),
        ([("t1", 100, 200), ("t2", 400, 500)], 100, {"t1": 0, "t2": 0}),
        ([("t1", 100, 200), ("t2", 150, 250)], 100, {"t1": 0, "t2": 1}),
        ([("t1", 100, 200), ("t2", 250, 350)], 100, {"t1": 0, "t2": 1}),
        ([("t1", 100, 200), ("t2", 250, 350)], 10, {"t1": 0, "t2": 0}),
        ([("t1", 100, 200), ("t2", 250, 350)], 0, {"t1": 0, "t2": 1}),
        ([("tb", 100, 200), ("ta", 100, 200)], 100, {"ta": 0, "tb": 1}),
        ([("t1", 100, 200), ("t2", 150, 250), ("t3", 500, 600), ("t4", 550, 650)], 100, {"t1": 0, "t2": 1, "t3": 0, "t4": 1}),
    ],
)
def test_pack_rows(spark, rows, padding, expected):
    assert packed(spark, rows, padding) == expected


def test_packing_uses_as_many_rows_as_the_depth_and_never_overlaps(spark):
    rows = [(f"t{i:03}", i * 37 % 500, i * 37 % 500 + 5 + i * 13 % 60) for i in range(120)]
    got = packed(spark, rows, 1)
    padded = spark.createDataFrame([("k", s - 1, e + 1) for _, s, e in rows], "key string, start int, end int")
    assert max(got.values()) + 1 == intervals.depth(padded, ["key"]).first()["depth"]
    at = {i: (s - 1, e + 1) for i, s, e in rows}
    assert not any(got[a] == got[b] and at[a][0] < at[b][1] and at[b][0] < at[a][1] for a in got for b in got if a < b)


def test_region_literal(spark):
    texts = ["chr19:44,905,754-44,907,754", "chr19:1-2", "chr19", "chr19:12", "chr1:1-2-3", "chr1:a-5", "a:b:1-2"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parsing.parse_region(F.col("t"))).collect()]
    assert [tuple(r) if r else None for r in got] == [("chr19", 44905754, 44907754), ("chr19", 1, 2), None, None, None, None, None]


def test_attributes_and_tags(spark):
    text = 'gene_id "G1"; tag "basic"; tag "MANE_Select"; exon_number 1;'
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(parsing.attribute_map(F.col("t")).alias("m")).select("m", parsing.has_tag(F.col("m")["tag"]).alias("c")).first()
    assert got["m"] == {"gene_id": "G1", "tag": "basic,MANE_Select", "exon_number": "1"} and got["c"]
    broken = spark.createDataFrame([("gene_id;",)], "t string")
    assert broken.select(parsing.attribute_map(F.col("t"))).first()[0] == {}
    with pytest.raises(Exception, match="invalid attribute pair"):
        broken.select(parsing.attribute_map(F.col("t"), strict=True)).collect()


def test_ccre_columns(spark):
    rows = [("EH38E1\t0\t.\t100\t200\t255,0,0\tPLS\textra1\textra2",), ("a\tb",), ("n\tx\t.\t1\t2\tc\td",)]
    df = spark.createDataFrame([("chr1", 1, 2, *r) for r in rows], "chr string, start int, end int, rest string")
    good, short, bad = parsing.with_ccre_columns(df, strict=False).collect()
    assert tuple(good)[3:] == ("extra1\textra2", "EH38E1", 0, ".", 100, 200, "255,0,0", "PLS")
    assert short["name"] is None and bad["score"] is None and bad["rest"] == ""
    for i in (1, 2):
        with pytest.raises(Exception):  # noqa: B017, PT011
            parsing.with_ccre_columns(df.where(F.col("rest") == rows[i][0])).collect()


@pytest.mark.parametrize(
    "url, chrom, start, end, width, field",
    [("/a", "chr1", 0, 1, 0, None), ("/a", "chr22", 0, 1, 0, None), ("http://x/y", "chrMT", 0, 1, 0, None), ("/a", "chr0", 0, 1, 0, "chrom"), ("/a", "chr23", 0, 1, 0, "chrom"), ("/a", "1", 0, 1, 0, "chrom"), ("/a", "", 0, 1, 0, "chrom"), ("/a", "chrX", -1, 1, 0, "start"), ("/a", "chrX", 5, 5, 0, "end"), ("/a", "chrX", 5, 6, -1, "preRenderedWidth"), ("", "", -1, -1, -1, "url")],
)
def test_validation(spark, url, chrom, start, end, width, field):
    got = spark.range(1).select(validation.signal_error(*map(F.lit, (url, chrom, start, end, width))).alias("e")).first()["e"]
    assert (got and got["field"]) == field


GTF = """#comment
chr1\tx\tgene\t100\t900\t.\t+\t.\tgene_id "G1"; gene_name "A"; gene_type "coding";
chr1\tx\ttranscript\t100\t900\t.\t+\t.\tgene_id "G1"; gene_name "A"; transcript_id "X1"; transcript_name "A-1"; tag "basic"; tag "MANE_Select";
chr1\tx\texon\t100\t200\t.\t+\t.\tgene_name "A"; transcript_name "A-1"; exon_number 1; exon_id "E1";
chr1\tx\texon\t400\t900\t.\t+\t.\tgene_name "A"; transcript_name "A-1"; exon_number 2; exon_id "E2";
chr1\tx\tUTR\t100\t120\t.\t+\t.\tgene_name "A"; transcript_name "A-1"; exon_number 1;
chr1\tx\tCDS\t121\t200\t.\t+\t.\tgene_name "A"; transcript_name "A-1"; exon_number 1;
chr1\tx\tstart_codon\t121\t123\t.\t+\t.\tgene_name "A"; transcript_name "A-1"; exon_number 1;
chr1\tx\tstop_codon\t880\t882\t.\t+\t.\tgene_name "A"; transcript_name "A-1"; exon_number 2;
chr1\tx\tgene\t5000\t6000\t.\t-\t.\tgene_id "G2"; gene_name "B"; gene_type "coding";
chr1\tx\ttranscript\t5000\t6000\t.\t-\t.\tgene_name "B"; transcript_id "X2"; transcript_name "B-1";
chr1\tx\texon\t5500\t6000\t.\t-\t.\tgene_name "B"; transcript_name "B-1"; exon_number 1; exon_id "E3";
chr1\tx\texon\t5000\t5100\t.\t-\t.\tgene_name "B"; transcript_name "B-1"; exon_number 2; exon_id "E4";
chr1\tx\tstart_codon\t5990\t5992\t.\t-\t.\tgene_name "B"; transcript_name "B-1"; exon_number 1;
"""


@pytest.fixture
def records(spark):
    return annotations.parse_gtf(spark.createDataFrame(list(enumerate(GTF.splitlines())), "ord long, value string"))


def test_gene_fold(records):
    a, b = annotations.fold_genes(records).orderBy("name").collect()
    (t,) = a["transcripts"]
    one, two = t["exons"]
    assert (a["id"], a["strand"], a["type"], t["id"], t["canonical"]) == ("G1", "+", "coding", "X1", True)
    assert one["start_codon"]["start"] == 121 and one["stop_codon"] is None and two["stop_codon"]["start"] == 880
    assert [u["end"] for u in one["utrs"]] == [120] and [c["start"] for c in one["cdss"]] == [121] and two["utrs"] == []
    first, last = b["transcripts"][0]["exons"]
    assert first["start_codon"] is None and last["start_codon"]["start"] == 5990  # reverse strand: on the last exon


def test_region_folds_only_what_overlaps(records):
    (a,) = annotations.fold_genes(annotations.in_region(records, "chr1", 0, 300)).collect()
    (t,) = a["transcripts"]
    assert [e["id"] for e in t["exons"]] == ["E1"] and t["exons"][0]["stop_codon"] is None


def test_transcripts_must_be_one(records, spark):
    twice = records.unionByName(records.where("feature = 'transcript' AND start = 100").withColumn("ord", F.col("ord") + 1000))
    with pytest.raises(Exception, match="expected one transcript"):
        annotations.fold_genes(twice).collect()
    assert [len(g["transcripts"]) for g in annotations.fold_genes(twice, strict=False).orderBy("name").collect()] == [0, 1]


def test_wire_form(records):
    wire = [json.loads(r["json"]) for r in annotations.wire_genes(annotations.fold_genes(records)).orderBy("name").collect()]
    t = wire[0]["transcripts"][0]
    assert (wire[0]["__typename"], t["tag"], t["row"], t["coordinates"]) == ("Gene", "MANE_Select", 0, {"start": 100, "end": 900, "__typename": "GenomicRange"})
    assert t["exons"][0]["UTRs"] == [{"coordinates": {"start": 100, "end": 120, "__typename": "GenomicRange"}, "__typename": "UTR"}]
    assert "tag" not in wire[1]["transcripts"][0]


def test_unknown_chromosome(spark):
    df = spark.createDataFrame([("chr1", 0, 5, 1.0), ("chrQ", 0, 5, 1.0)], SIGNAL)
    chroms = spark.createDataFrame([("chr1", 0)], "chrom string, id int")
    assert signal.with_chrom_id(df, chroms, strict=False).count() == 1
    with pytest.raises(Exception, match="unknown chromosome"):
        signal.with_chrom_id(df, chroms).collect()


def test_region_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("chr1", i, i + 1, 1.0) for i in range(50)], SIGNAL).write.parquet(str(tmp_path / "s"))
    plan = signal.region(spark.read.parquet(str(tmp_path / "s")), "chr1", 5, 10).select("value")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(start,5)" in plan and "ReadSchema: struct<chr:string,start:int,value:float>" in plan


def lines_of(r, n, reach, top=2000):
    return [(r.choice(["k", "l", None]), at, at + r.randrange(0, reach)) for at in (r.randrange(top) for _ in range(n))]


@pytest.mark.parametrize(("reach", "seed"), [(5, 1), (40, 2), (900, 3)])
def test_cells_give_what_whole_lines_give(spark, reach, seed):
    rows = lines_of(random.Random(seed), 150, reach)
    df = spark.createDataFrame(rows, "key string, start int, end int")
    expected, deepest = [], {}
    for key in {k for k, _, _ in rows}:
        own = sorted((s, e) for k, s, e in rows if k == key)
        held = []
        for s, e in own:
            if held and s <= held[-1][1]:
                held[-1] = (held[-1][0], max(held[-1][1], e), held[-1][2] + 1)
            else:
                held.append((s, e, 1))
        expected += [(key, *x) for x in held]
        deepest[key] = max(sum(s <= x < e for s, e in own) for x in range(3000))
    for width in (16, 100, 1 << 16):
        got = [tuple(r) for r in intervals.merge(df, ["key"], width=width).select("key", "start", "end", "n").collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected))
        assert {r["key"]: r["depth"] for r in intervals.depth(df, ["key"], width=width).collect()} == deepest
        named = df.withColumn("id", F.concat_ws("-", F.coalesce("key", F.lit("x")), "start", "end"))
    for pieces in (1, 3, 9):
        got = {(r["key"], r["id"]): r["row"] for r in layout.pack_rows(named, ["key"], padding=1, pieces=pieces).collect()}
        assert got == packed_in_turn(rows)


def packed_in_turn(rows):
    """Rows of first fit, line by line; an id's last interval counts."""
    out = {}
    for key in {k for k, _, _ in rows}:
        ends = []
        for s, e in sorted((s - 1, e + 1) for k, s, e in rows if k == key):
            row = next((i for i, x in enumerate(ends) if x <= s), len(ends))
            ends[row : row + 1] = [e]
            out[key, f"{key or 'x'}-{s + 1}-{e - 1}"] = row
    return out


def test_a_line_without_gaps_is_packed_in_pieces(spark):
    r = random.Random(6)
    rows = [("a", at, at + r.choice([5, 50, 300])) for at in (r.randrange(4000) for _ in range(900))] + [("a", 700, 5000), ("b", 1, 9)]
    named = spark.createDataFrame(rows, "key string, start int, end int").withColumn("id", F.concat_ws("-", "key", "start", "end")).repartition(5)
    got = {(x["key"], x["id"]): x["row"] for x in layout.pack_rows(named, ["key"], padding=1, pieces=8).collect()}
    assert got == packed_in_turn(rows)
    assert layout.pack_rows(named.limit(0), ["key"]).count() == 0


def test_nearest_looks_beyond_its_cell(spark):
    r = random.Random(4)
    points = [(i, r.choice("ab"), r.randrange(3000)) for i in range(60)]
    targets = [(i, r.choice("abc"), r.randrange(3000), i * 1.0) for i in range(9)]
    p, t = spark.createDataFrame(points, "id int, key string, at int"), spark.createDataFrame(targets, "tid int, key string, spot int, v double")
    expected = {}
    for i, k, at in points:
        near = sorted((abs(at - x), j) for j, kk, x, _ in targets if kk == k)
        expected[i] = near[0] if near else (None, None)
    for width in (64, 1 << 16):
        got = {r["id"]: (r["distance"], r["nearest_id"]) for r in intervals.nearest(p, t, ["key"], "at", "spot", "tid", "v", width).collect()}
        assert got == expected


def test_interval_join_with_several_widths(spark):
    r = random.Random(5)
    a, b = ([(i, s, s + r.choice([3, 10, 200, 1500])) for i, s in enumerate(r.randrange(2000) for _ in range(50))] for _ in range(2))
    left, right = (spark.createDataFrame([("c", *x) for x in rows], "chr string, id int, start int, end int") for rows in (a, b))
    got = sorted((x["id"], x["r_id"]) for x in intervals.interval_join(left, right, ["chr"], [16, 128, 1024]).collect())
    assert got == sorted((i, j) for i, s, e in a for j, u, v in b if s < v and u < e)


def test_narrow_records_meet_in_narrow_bins_only(spark):
    df = spark.range(1000).select(F.lit("c").alias("chr"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 90).alias("end"))
    left, right = (intervals._binned(df, [128, 1 << 12, 1 << 20], "start", "end", "first", sides) for sides in (([0, 1], 2), ([0, 2], 1)))
    key = ["__level", "__side", "__bin"]
    candidates = left.groupBy(key).count().join(right.groupBy(key).agg(F.count("*").alias("other")), key).agg(F.sum(F.col("count") * F.col("other"))).first()[0]
    assert candidates < 10 * 1000  # every record with every other, if they met in the widest bin


def test_rows_in_input_order_with_totals(spark):
    df = spark.createDataFrame([(0, "t3", 900, 950), (1, "t2", 150, 250), (2, "t1", 100, 200)], "at int, id string, start int, end int")
    got = [tuple(r) for r in layout.in_order(df, [], "at").orderBy("at").select("id", "row", "total_rows").collect()]
    assert got == [("t3", 0, 2), ("t2", 1, 2), ("t1", 0, 2)]


def test_no_plan_reads_a_whole_line_in_one_task(spark):
    df = spark.createDataFrame([("k", 1, 2)], "key string, start int, end int")
    named = df.withColumn("id", F.lit("x"))
    for got in (intervals.merge(df, ["key"]), intervals.depth(df, ["key"]), layout.pack_rows(named, ["key"])):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        # windows along a line are over one row a cell
        assert all("__cell" in x or "__of___cell" in x for x in plan.splitlines() if "windowspecdefinition" in x)
