"""GTF text: plain, as a table clustered by position, and as block-gzip files with tabix indexes."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.annotations import parse_gtf
from . import bgzf
from .commit import FolderWriter, holding, listed
from .folders import release, scratch
from .ranges import is_web, read_many, read_range, storage

#: Bytes of text of a file that a folder is written in, and compressed bytes of a file that one task reads.
UNIT, RUN = 16 << 20, 4 << 20
#: Bytes of text: of a range of keys, of the ranges that a task sorts at a time, and of what a task holds before it writes a run.
RANGE, GROUP, HELD = 8 << 20, 32 << 20, 64 << 20
#: The share of records of which text is made for the ranges' borders, and keys that a task tells of them.
SHARE, TOLD = 1 / 16, 256
#: What a file's place in its folder is multiplied by to number its lines.
_FILE = 1 << 44
_LINE = "chrom string, start int, end int, value string, ord bigint"
_KEY = ["chrom", "start", "end", "ord", "value"]


def read_gtf(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of GTF text files, which may be gzipped; ord is the order in the file."""
    return parse_gtf(spark.read.text(path), strict)


def write_clustered(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet in (chrom, start) order; a region query then reads few row groups."""
    records.repartitionByRange(*([partitions] if partitions else []), "chrom", "start").sortWithinPartitions("chrom", "start", "ord").write.mode("overwrite").parquet(path)


def read_indexed(spark: SparkSession, path: str, chrom: str | None = None, start: int = 0, end: int | None = None, strict: bool = True) -> DataFrame:
    """Records of a block-gzip file with its index beside it (.tbi), or of a folder that write_indexed made.

    With a chromosome, those that share a base with the 0-based half-open range:
    only members that the index names are read, and of a folder only files whose
    part of the genome meets the range.
    """
    told = {"path": path, "start": start, "end": end if end is not None else (1 << 31) - 1} | ({"chrom": chrom} if chrom is not None else {})
    return parse_gtf(spark.read.format("indexed_gtf").options(**told).load().select("value", "ord"), strict)


def gtf_line(attributes: str = "attributes"):
    """A record as a GTF line; absent fields are dots. Attributes that hold a quote or a semicolon can't be told apart when read."""
    pairs = F.transform(F.map_entries(attributes), lambda x: F.concat(x["key"], F.lit(' "'), x["value"], F.lit('";')))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "source", "feature", "start", "end", "score", "strand", "frame")]
    return F.concat_ws("\t", *fields, F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " "))


def write_indexed(records: DataFrame, path: str, unit: int = UNIT, partitions: int | None = None) -> None:
    """Writes records as a folder of block-gzip files with indexes, in the order of chrom, start, end and ord.

    Records are sorted by ranges, and every `unit` bytes of their text are a
    file. So the files' bytes depend on the records alone and not on how they
    were dealt to tasks, and a position that very many records share is several
    files. Records without a chromosome, start or end are left out. Files count
    when all are written (see commit).

    Text is many times the size of the tables it is made of, so it is never
    shuffled: tasks write it as sorted and compressed runs beside the files, with
    a table of where each range stands in them. The ranges' sizes say where
    units begin; a task then reads the ranges of its units from all runs. It
    holds their text (GROUP), and runs go when the files are written.
    """
    spark = records.sparkSession
    register(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = records.where("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")

    def text(df: DataFrame) -> DataFrame:
        order = F.coalesce(F.col("ord").cast("bigint"), F.lit(-(1 << 63)))  # those without come first
        return df.select("chrom", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), gtf_line().alias("value"), order.alias("ord"))

    bounds = _bounds(text(whole.where(F.rand(0) < SHARE)).mapInArrow(_told, f"{_LINE}, bytes double").toArrow(), n)
    release(spark)
    store, base = storage(path)
    folder = f"{path.rstrip('/')}/_runs-{uuid.uuid4().hex}"
    own = f"{base.rstrip('/')}/{folder.rpartition('/')[2]}"
    store.create_dir(own, recursive=True)
    try:
        held, kept = HELD, scratch(spark, "runs")

        def runs(batches):
            some, size = [], 0
            for b in batches:
                some.append(b)
                size += b.nbytes
                if size >= held:
                    yield _run(some, bounds, folder)
                    some, size = [], 0
            if some:
                yield _run(some, bounds, folder)

        text(whole).mapInArrow(runs, "range int, run string, at bigint, size bigint, bytes bigint").write.parquet(kept)
        release(spark)
        index = spark.read.parquet(kept)
        sizes = np.zeros(len(bounds) + 1, np.int64)
        for r in index.groupBy("range").agg(F.sum("bytes").alias("bytes")).collect():  # a number a range
            sizes[r["range"]] = r["bytes"]
        told = _tasks(sizes, unit, n)
        tasks = spark.createDataFrame(told, "task int, range int, before bigint, first bigint, last bigint")
        refs = index.join(F.broadcast(tasks), "range").repartition(max(n, len({t[0] for t in told})), "task").sortWithinPartitions("task", "run", "at")
        found = refs.select("task", "run", "at", "size", "before", "first", "last").mapInArrow(lambda batches: _units(batches, folder, unit), _LINE)
        found.write.format("indexed_gtf").mode("overwrite").save(path)
    finally:
        store.delete_dir(own)


def _sizes(values) -> np.ndarray:
    """Bytes of lines, with their ends."""
    return pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _told(batches):
    """Some of a task's lines, any as likely as another, and the bytes of text (of a share of all) that each stands for."""
    random, held, size = np.random.default_rng(TaskContext.get().partitionId()), None, 0
    for b in batches:
        size += int(_sizes(b.column(3)).sum())
        t = pa.Table.from_batches([b]).append_column("drawn", pa.array(random.random(len(b))))
        t = t if held is None else pa.concat_tables([held, t])
        held = t.take(pc.sort_indices(t, sort_keys=[("drawn", "ascending")])[:TOLD]) if len(t) > TOLD else t
    if held is not None and len(held):
        own = _sizes(held.column(3).combine_chunks())
        yield from held.select(held.column_names[:-1]).append_column("bytes", pa.array(size * own / own.sum())).combine_chunks().to_batches()


def _bounds(told: pa.Table, tasks: int) -> pa.Table:
    """Keys at which ranges of about equal bytes begin, but for the first."""
    told = told.take(_sorted(told))
    done = np.cumsum(told.column("bytes").to_numpy())
    each = min(min(RANGE, GROUP // 4) * SHARE, max(done[-1] / (4 * tasks), 1)) if len(told) else 1
    first = np.flatnonzero(np.diff((done / each).astype(np.int64))) + 1
    return told.select(_KEY).take(first).cast(pa.schema(list(zip(_KEY, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)))).combine_chunks()


def _sorted(t: pa.Table, *more: str) -> np.ndarray:
    return pc.sort_indices(t, sort_keys=[(k, "ascending") for k in (*_KEY, *more)]).to_numpy()


def _run(batches: list[pa.RecordBatch], bounds: pa.Table, folder: str) -> pa.RecordBatch:
    """Writes lines as a file of chunks, a chunk a range: range, run, at, size, and bytes of text."""
    rows = pa.Table.from_batches(batches).select(_KEY).cast(bounds.schema)
    both = pa.concat_tables([bounds.append_column("kind", pa.array(np.zeros(len(bounds), np.int8))), rows.append_column("kind", pa.array(np.ones(len(rows), np.int8)))])
    order = _sorted(both, "kind")
    border = np.flatnonzero(order < len(bounds))
    rows = rows.take(order[order >= len(bounds)] - len(bounds)).combine_chunks()
    edges = [0, *(border - np.arange(len(border))).tolist(), len(rows)]
    run, at, out = uuid.uuid4().hex, 0, []
    store, base = storage(f"{folder}/{run}")
    with store.open_output_stream(base, compression=None) as f:
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                some = rows.slice(a, b - a)
                data = _packed(some)
                f.write(data)
                out.append((k, run, at, len(data), int(_sizes(some.column(4).combine_chunks()).sum())))
                at += len(data)
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["range", "run", "at", "size", "bytes"])


#: Effort of compression.
_LEVEL = 9


def _packed(rows: pa.Table) -> bytes:
    """Sorted lines in few bytes: numbers by planes of bytes, starts by their differences, then the text."""
    chrom = rows.column(0).combine_chunks().dictionary_encode()
    start, end, order = (rows.column(i).to_numpy() for i in (1, 2, 3))
    value = pa.concat_arrays(rows.column(4).chunks)  # from its own beginning
    ends = np.frombuffer(value.buffers()[1], np.int32)[value.offset : value.offset + len(value) + 1]
    planes = lambda x, kind: x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()
    text = memoryview(value.buffers()[2])[int(ends[0]) : int(ends[-1])] if ends[-1] > ends[0] else b""
    body = b"".join((planes(chrom.indices.to_numpy(), "<i4"), planes(np.diff(start.astype(np.int64), prepend=0), "<i8"), planes(end.astype(np.int64) - start, "<i8"), planes(order, "<i8"), planes(np.diff(ends), "<i4"), text))
    head = json.dumps([len(rows), len(body), chrom.dictionary.to_pylist()]).encode()
    return struct.pack("<I", len(head)) + head + pa.Codec("zstd", _LEVEL).compress(body, asbytes=True)


def _unpacked(data: bytes) -> pa.Table:
    at = 4 + struct.unpack_from("<I", data)[0]
    n, size, names = json.loads(data[4:at])
    body, place = pa.Codec("zstd").decompress(data[at:], decompressed_size=size, asbytes=True), 0

    def planes(width: int) -> np.ndarray:
        nonlocal place
        place += width * n
        return np.ascontiguousarray(np.frombuffer(body, np.uint8, width * n, place - width * n).reshape(width, n).T).view(f"<i{width}").ravel()

    which, start, long, order, sizes = planes(4), np.cumsum(planes(8)), planes(8), planes(8), planes(4)
    value = pa.StringArray.from_buffers(n, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(body[place:]))
    chrom = pa.DictionaryArray.from_arrays(pa.array(which), pa.array(names, pa.string())).cast(pa.string())
    return pa.table([chrom, pa.array(start.astype(np.int32)), pa.array((start + long).astype(np.int32)), pa.array(order), value], names=_KEY)


def _tasks(sizes: np.ndarray, unit: int, tasks: int) -> list[tuple]:
    """(task, range, before, first, last): which ranges hold the text of a task's units, first to last, and the bytes before these ranges.

    A task has the units that begin in its own ranges, some following each
    other, and for the last of these it reads on.
    """
    base = np.concatenate([[0], np.cumsum(sizes)])
    each = min(GROUP, max(int(base[-1]) // tasks, 1))
    out, a = [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(base, base[a] + each, "right")) - 1)
        first, last = -(-int(base[a]) // unit), -(-int(base[b]) // unit) - 1
        if first <= last:
            held = np.flatnonzero((base[1:] > first * unit) & (base[:-1] < (last + 1) * unit) & (sizes > 0)).tolist()
            out += [(a, r, int(base[held[0]]), first, last) for r in held]
        a = b
    return out


def _units(batches: Iterator[pa.RecordBatch], folder: str, unit: int) -> Iterator[pa.RecordBatch]:
    """Lines in order with their units, of chunks that come by task."""

    def told(refs: list[dict]):
        parts, at = [], 0
        while at < len(refs):
            to = at
            while to < len(refs) and refs[to]["run"] == refs[at]["run"]:
                to += 1
            parts += [_unpacked(data) for _, data in read_many(f"{folder}/{refs[at]['run']}", [(r["at"], r["size"]) for r in refs[at:to]])]
            at = to
        rows = pa.concat_tables(parts)
        parts.clear()
        rows = rows.take(_sorted(rows))
        sizes = np.concatenate([_sizes(c) for c in rows.column(4).chunks])
        which = (refs[0]["before"] + np.cumsum(sizes) - sizes) // unit
        a, b = np.searchsorted(which, [refs[0]["first"], refs[0]["last"] + 1]).tolist()
        rows = rows.select(["chrom", "start", "end", "value"]).append_column("ord", pa.array(which))
        yield from rows.slice(a, b - a).to_batches(max_chunksize=4096)

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["task"] != held[0]["task"]:
                yield from told(held)
                held = []
            held.append(r)
    if held:
        yield from told(held)


def join_parts(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """Copies a folder's files one after another into one file with one index, in one task that holds a file and the index: (path, bytes)."""
    names = [f["name"] for f in listed(folder)]

    def copy(batches):
        for _ in batches:
            index, done = bgzf.Index(), 0
            store, base = storage(file)
            with store.open_output_stream(base, compression=None) as out:
                for name in names:
                    data = _whole(f"{folder}/{name}").removesuffix(bgzf.END)
                    index.append(bgzf.Index.parse(_whole(f"{folder}/{name}.tbi")), done)
                    out.write(data)
                    done += len(data)
                out.write(bgzf.END)
            with store.open_output_stream(base + ".tbi", compression=None) as out:
                out.write(index.packed())
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([done + len(bgzf.END)])], names=["path", "bytes"])

    return spark.range(1, numPartitions=1).mapInArrow(copy, "path string, bytes bigint")


def _whole(path: str) -> bytes:
    if is_web(path):
        return read_range(path, 0, 1 << 30, short=True)
    store, base = storage(path)
    with store.open_input_stream(base, compression=None) as f:
        return f.read()


@dataclass
class Stretch(InputPartition):
    """Part of a file, or (chunks None) what its own index says."""

    path: str
    rank: int
    chunks: list | None


class IndexedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chrom = options["path"].rstrip("/"), options.get("chrom")
        self.lo, self.hi = int(options.get("start", 0)), int(options.get("end", (1 << 31) - 1))

    def _chunks(self, index: bgzf.Index) -> list[tuple[int, int | None]]:
        return index.cuts(RUN) if self.chrom is None else index.chunks(self.chrom, self.lo, self.hi)

    def partitions(self):
        files = listed(self.path)
        if files is not None:
            ranks = {f["name"]: i for i, f in enumerate(files)}
            return [Stretch(f"{self.path}/{f['name']}", ranks[f["name"]], None) for f in holding(files, self.chrom, self.lo, self.hi)]
        index = bgzf.Index.parse(_whole(self.path + ".tbi"))
        out: list[Stretch] = []
        size = 0
        for begin, stop in self._chunks(index):
            own = RUN if stop is None else (stop >> 16) - (begin >> 16)
            if not out or size + own > RUN:
                out.append(Stretch(self.path, 0, []))
                size = 0
            out[-1].chunks.append((begin, stop))
            size += own
        return out

    def read(self, partition):
        if partition is None:
            return
        chunks = partition.chunks
        if chunks is None:
            chunks = [(0, None)] if self.chrom is None else self._chunks(bgzf.Index.parse(_whole(partition.path + ".tbi")))
        rows: list[tuple] = []
        for begin, stop in chunks:
            for at, line in bgzf.lines_between(partition.path, begin, stop):
                if not line or line.startswith(b"#"):
                    continue
                chrom, _, _, start, end = line.split(b"\t", 5)[:5]
                start, end = int(start), int(end)
                if self.chrom is not None and (chrom.decode() != self.chrom or start - 1 >= self.hi or end <= self.lo):
                    continue
                rows.append((chrom.decode(), start, end, line.decode(), partition.rank * _FILE + at))
                if len(rows) == 4096:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chrom", "start", "end", "value", "ord"])


class PushedIndexedReader(IndexedReader):
    """Narrows the range by filters on chrom, start and end; Spark still applies them to the rows."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                self.chrom = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                self.hi = min(self.hi, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute in (("start",), ("end",)):
                self.lo = max(self.lo, f.value - 1)
            yield f


class IndexedWriter(FolderWriter):
    """A file for each number in ord, of lines that come in order."""

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            unit = whole.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if held and held[-1].column(4)[0].as_py() != int(unit[a]):
                        yield self._file(held)
                        held = []
                    held.append(whole.slice(a, b - a))
        if held:
            yield self._file(held)

    def _file(self, held: list[pa.RecordBatch]) -> dict:
        rows = pa.Table.from_batches(held).combine_chunks()
        chroms, start, end = rows.column(0).to_pylist(), rows.column(1).to_numpy().astype(np.int64) - 1, rows.column(2).to_numpy().astype(np.int64)
        end = np.maximum(end, start + 1)
        data, index = bgzf.parted([x.encode() for x in rows.column(3).to_pylist()], chroms, start, end)
        name = self.fresh()
        store, base = storage(self.path)
        for more, content in (("", data + bgzf.END), (".tbi", index.packed())):
            with store.open_output_stream(f"{base}/{name}{more}", compression=None) as f:
                f.write(content)
        of = np.array(chroms)
        zones = {c: [int(start[of == c].min()), int(end[of == c].max())] for c in index.bins}
        return {"name": name, "records": len(chroms), "first": [chroms[0], int(start[0])], "unit": rows.column(4)[0].as_py(), "zones": zones}


class IndexedGtfSource(DataSource):
    @classmethod
    def name(cls):
        return "indexed_gtf"

    def schema(self):
        return _LINE

    def reader(self, schema):
        return (PushedIndexedReader if self.options.get("pushdown", "false") == "true" else IndexedReader)(dict(self.options))

    def writer(self, schema, overwrite):
        return IndexedWriter(self.options["path"], ".gtf.gz", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexedGtfSource)
