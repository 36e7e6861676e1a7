"""Many regions against track files at once: which blocks hold them, their records, and what these come to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.intervals import interval_join
from .bigfile import FEATURE_MAGIC, SIGNAL_MAGIC, feature_rows, opened, signal_rows
from .ranges import read_many

#: Widths of the bins in which regions meet blocks and records.
WIDTHS = [1 << 14, 1 << 18, 1 << 22]
#: Bytes of neighbouring blocks that one task fetches.
RUN = 4 << 20
#: Width of the bins in which records are summed up for regions, and the regions that a task holds at once.
CELL, AT_ONCE = 1 << 17, 1 << 18
_RECORDS = {"bigwig": "chr string, start int, end int, value float", "bigbed": "chr string, start int, end int, rest string"}


def blocks_of(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The block indexes of a file, or of a folder's files (each walked by a task), as a table: chr, start, end, path, at, size."""
    return spark.read.format(kind).option("view", "blocks").load(path)


def _unions(batches):
    """Ranges (chr, start, end) of a task as their unions, as far as it holds them at once."""
    held: dict[str, list] = {}
    count = lambda: sum(len(s) for parts in held.values() for s, _ in parts)

    def merge():
        for c, parts in held.items():
            start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(start)
            start, reach = start[by], np.maximum.accumulate(end[by])
            new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
            held[c] = [(start[new], reach[np.append(new[1:], len(start)) - 1])]

    def told():
        for c, [(start, end)] in held.items():
            for at in range(0, len(start), 1 << 14):
                some = slice(at, at + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(start[some]), pa.string()), pa.array(start[some]), pa.array(end[some])], names=["chr", "start", "end"])

    n = 0
    for b in batches:
        chrom = b.column(0).dictionary_encode()
        which, start, end = chrom.indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
        for i, c in enumerate(chrom.dictionary.to_pylist()):
            held.setdefault(c, []).append((start[which == i], end[which == i]))
        n += len(b)
        if n >= AT_ONCE:
            merge()
            n = count()
            if n >= AT_ONCE // 2:
                yield from told()
                held, n = {}, 0
    merge()
    yield from told()


def blocks_met(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, at, size) of the blocks that any region meets or touches, each once. Each task makes unions of its regions first."""
    asked = regions.select("chr", F.col("start").cast("bigint").alias("start"), (F.col("end").cast("bigint") + 1).alias("end")).mapInArrow(_unions, "chr string, start bigint, end bigint")
    held = blocks.select("chr", (F.col("start") - 1).cast("bigint").alias("start"), (F.col("end") + 1).cast("bigint").alias("end"), "path", "at", "size")
    met = interval_join(held, asked, ["chr"], WIDTHS)
    return met.groupBy("path", "at").agg(F.max("size").alias("size"))


def fetched(blocks: DataFrame, kind: str) -> DataFrame:
    """The records of blocks (path, at, size). Each block is read once; a task has neighbours of a file, near ones in one request."""
    magic = SIGNAL_MAGIC if kind == "bigwig" else FEATURE_MAGIC
    names = ["chr", "start", "end", "value" if kind == "bigwig" else "rest"]

    def rows(f, raw):
        of = {i: n for n, (i, _) in f.chroms.items()}
        block = f.inflate(raw)
        if kind == "bigwig":
            chrom, start, end, value = signal_rows(f, block)
            if chrom in of:
                yield pa.RecordBatch.from_arrays([pa.array([of[chrom]] * len(start), pa.string()), pa.array(np.asarray(start).astype(np.int32)), pa.array(np.asarray(end).astype(np.int32)), pa.array(value.astype(np.float32))], names=names)
            return
        some = [(of[c], s, e, r) for c, s, e, r in feature_rows(f, block) if c in of]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=names)

    def run(batches):
        for b in batches:
            paths = b.column(0).to_pylist()
            ranges = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            at = 0
            while at < len(paths):
                to = at
                while to < len(paths) and paths[to] == paths[at]:
                    to += 1
                f = opened(paths[at], magic)
                for _, raw in read_many(paths[at], ranges[at:to]):
                    yield from rows(f, raw)
                at = to

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(n, "path", F.expr(f"at div {RUN}")).sortWithinPartitions("path", "at").select("path", "at", "size")
    return dealt.mapInArrow(run, _RECORDS[kind])


def records_of_regions(regions: DataFrame, kind: str, path: str) -> DataFrame:
    """regions (chr, start, end and any other columns) with each record of the files that overlaps one or ends where it begins: r_start, r_end, r_value or r_rest.

    Regions meet the block indexes as tables, so no region walks an index by
    itself; the blocks that any of them needs are fetched once, whatever their
    number; then records meet regions. Empty and null regions meet nothing;
    repeated regions are answered each; columns must not begin with r_ or two
    low lines.
    """
    spark = regions.sparkSession
    asked = regions.where("chr IS NOT NULL AND start < end")
    met = blocks_met(asked, blocks_of(spark, kind, path))
    rows = fetched(met, kind).withColumn("end", F.col("end").cast("bigint") + 1)
    found = interval_join(asked, rows, ["chr"], WIDTHS)
    return found.withColumn("r_end", (F.col("r_end") - 1).cast("int"))


def _summed(start, end, value, lo, hi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each range [lo, hi) the number of records with start < hi and end >= lo, the least start and the largest value of them.

    Records may overlap. Those that begin before hi are blocks of powers of two
    of the records in order of start; of a block, sorted by end, those that reach
    lo are the last ones.
    """
    by = np.argsort(start, kind="stable")
    start, end, value = start[by], end[by], value[by]
    before = np.searchsorted(start, hi, "left")
    n, first, most = np.zeros(len(lo), np.int64), np.full(len(lo), np.iinfo(np.int64).max), np.full(len(lo), -np.inf)
    base = int(end.min()) if len(end) else 0
    reach = int(end.max()) - base + 2 if len(end) else 0
    near = np.clip(lo - base, 0, max(reach - 1, 0))
    for k in range(int(before.max(initial=0)).bit_length()):
        ask = np.flatnonzero(before >> k & 1)
        if not len(ask):
            continue
        size, blocks = 1 << k, len(start) >> k
        each = lambda x: x[: blocks << k].reshape(blocks, size)
        order = np.argsort(each(end), axis=1, kind="stable")
        sorted_end = np.take_along_axis(each(end), order, 1) - base + np.arange(blocks)[:, None] * reach
        last_min = np.minimum.accumulate(np.take_along_axis(each(start), order, 1)[:, ::-1], axis=1)[:, ::-1].ravel()
        last_max = np.maximum.accumulate(np.take_along_axis(each(value), order, 1)[:, ::-1], axis=1)[:, ::-1].ravel()
        block = before[ask] >> (k + 1) << 1
        at, stop = np.searchsorted(sorted_end.ravel(), block * reach + near[ask], "left"), (block + 1) * size
        n[ask] += stop - at
        ask, at = ask[at < stop], at[at < stop]
        first[ask], most[ask] = np.minimum(first[ask], last_min[at]), np.maximum(most[ask], last_max[at])
    return n, first, most


def sums_of_regions(regions: DataFrame, path: str, by: list[str]) -> DataFrame:
    """by, n, first_start, max_value: how many records of a bigWig file or folder overlap the regions (chr, start, end) of equal `by` columns or end where one begins, their first start and largest value. Groups without records are left out, and a record counts for each region.

    What records_of_regions pairs is never made: regions and records go to the
    bins that they reach, a bin's records are held in one task, its regions are
    read in order, and each finds its numbers in sorted blocks of the records. A
    pair counts in the later of its two first bins. Names that begin with two
    low lines are kept for this.
    """
    spark = regions.sparkSession
    asked = regions.where("chr IS NOT NULL AND start < end")
    rows = fetched(blocks_met(asked, blocks_of(spark, "bigwig", path)), "bigwig")
    kept = regions.select(*by).schema
    names = ["__chr", "__start", "__end", "__value"]

    def placed(df: DataFrame, kind: int, columns: list) -> DataFrame:
        """__end is the last base that counts."""
        typed = df.select(*(c.alias(x) for c, x in zip(columns, names, strict=True)), *(F.col(f.name) if kind else F.lit(None).cast(f.dataType).alias(f.name) for f in kept))
        cell = lambda c: F.floor(F.col(c) / CELL)
        return typed.withColumn("__kind", F.lit(kind)).withColumn("__bin", F.explode(F.sequence(cell("__start"), F.greatest(cell("__start"), cell("__end")))))

    start, end = F.col("start").cast("bigint"), F.col("end").cast("bigint")
    both = placed(rows, 0, [F.col("chr"), start, end, F.col("value").cast("double")]).unionByName(placed(asked, 1, [F.col("chr"), start, end - 1, F.lit(None).cast("double")]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "__chr", "__bin").sortWithinPartitions("__chr", "__bin", "__kind").select("__chr", "__bin", "__kind", *names[1:], *kept.names)

    def answers(held: list, wanted: list, cell: int):
        if not held or not wanted:
            return
        s, e, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (3, 4, 5))
        own = s // CELL == cell
        for b in wanted:
            lo, hi = b.column(3).to_numpy(), b.column(4).to_numpy() + 1
            here = lo // CELL == cell
            n, first, most = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), np.zeros(len(b))
            for which, records in ((here, slice(None)), (~here, own)):
                n[which], first[which], most[which] = _summed(s[records], e[records], v[records], lo[which], hi[which])
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in b.columns[6:]), pa.array(n[some]), pa.array(first[some]), pa.array(most[some])], names=[*kept.names, "__n", "__first", "__most"])

    def sums(batches):
        key, held, wanted, count = None, [], [], 0
        for whole in batches:
            chrom, cell = whole.column(0).dictionary_encode(), whole.column(1).to_numpy()
            which, kind = chrom.indices.to_numpy(), whole.column(2).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (cell[1:] != cell[:-1]), [True]])).tolist() if len(whole) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = (chrom.dictionary[int(which[a])].as_py(), int(cell[a]))
                if now != key or count >= AT_ONCE:
                    yield from answers(held, _one(wanted), key[1]) if key else ()
                    key, held, wanted, count = now, held if now == key else [], [], 0
                k = int(b - a - kind[a:b].sum())
                if k:
                    held.append(whole.slice(a, k))
                if a + k < b:
                    wanted.append(whole.slice(a + k, b - a - k))
                    count += b - a - k
        yield from answers(held, _one(wanted), key[1]) if key else ()

    schema = StructType([*kept.fields, StructField("__n", LongType()), StructField("__first", LongType()), StructField("__most", DoubleType())])
    return dealt.mapInArrow(sums, schema).groupBy(*by).agg(F.sum("__n").alias("n"), F.min("__first").alias("first_start"), F.max("__most").alias("max_value"))


def _one(batches: list) -> list:
    """Batches of a bin as one."""
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []
