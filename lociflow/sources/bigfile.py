"""bigWig and bigBed files as Python data sources.

A query's chromosome and range are options or pushed filters; the index is
walked once on the driver, blocks that do not overlap are never fetched, and
each partition reads a run of neighbouring blocks, near ones in one request.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .commit import holding, listed
from .ranges import is_web, read_many, read_range, stamp, storage

#: Magic numbers of the layout (fixed values).
SIGNAL_MAGIC, FEATURE_MAGIC, CHROM_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0
HEADER_BYTES, INDEX_HEADER_BYTES, NODE_BYTES = 64, 48, 4096
#: Bytes of neighbouring blocks that one partition reads.
RUN_BYTES = 4 << 20
#: Headers that a worker remembers.
HEADERS = 250


def files_of(path: str, suffix: str) -> list[str]:
    """The files that a path stands for: itself, or those with the suffix in the folder that it is."""
    from pyarrow import fs

    if is_web(path):
        return [path]
    store, base = storage(path)
    if store.get_file_info(base).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(suffix))
    return [f"{path.rstrip('/')}/{name}" for name in found]


_opened: dict[tuple[str, int], tuple[str, BigFile]] = {}


def opened(path: str, magic: int) -> BigFile:
    """The file's header and chromosomes, read again only when it has changed; a worker remembers at most HEADERS."""
    try:
        now = stamp(path)
    except OSError:
        now = ""
    held = _opened.get((path, magic))
    if held and now and held[0] == now:
        return held[1]
    if len(_opened) >= HEADERS:
        _opened.clear()
    file = BigFile(path, magic)
    _opened[path, magic] = (now, file)
    return file


@dataclass
class BigFile:
    """Header, zoom levels, summary and chromosomes of a file."""

    path: str
    magic: int
    order: str = "<"
    zooms: list = field(default_factory=list)
    chroms: dict = field(default_factory=dict)
    summary: tuple | None = None
    auto_sql: str = ""

    def __post_init__(self):
        head = read_range(self.path, 0, HEADER_BYTES)
        self.order = next((o for o in "<>" if struct.unpack(o + "I", head[:4])[0] == self.magic), "")
        if not self.order:
            raise ValueError(f"{self.path}: not of this format (magic {head[:4].hex()})")
        (self.version, n_zooms, chrom_at, self.data_at, self.index_at, self.fields, _, sql_at, summary_at, self.buffer, _) = self.unpack("HHQQQHHQQiQ", head, 4)
        meta = read_range(self.path, HEADER_BYTES, self.data_at - HEADER_BYTES)
        local = lambda at: at - HEADER_BYTES
        # levels are numbered from the last in the file
        found = [self.unpack("iiQQ", meta, 24 * i) for i in range(n_zooms)]
        self.zooms = [(r, index) for r, _, _, index in reversed(found)]
        if sql_at:
            self.auto_sql = meta[local(sql_at) : meta.index(b"\0", local(sql_at))].decode("latin-1")
        if summary_at:
            self.summary = self.unpack("Qdddd", meta, local(summary_at))
        magic, _, key_size = self.unpack("Iii", meta, local(chrom_at))
        if magic != CHROM_MAGIC:
            raise ValueError(f"{self.path}: no chromosome tree")
        todo = [local(chrom_at) + 32]
        while todo:
            at = todo.pop()
            leaf, _, count = self.unpack("BBH", meta, at)
            for i in range(count):
                item = at + 4 + i * (key_size + 8)
                name = bytes(b for b in meta[item : item + key_size] if b > 32).decode("latin-1")
                if leaf:
                    self.chroms[name] = self.unpack("ii", meta, item + key_size)
                else:
                    todo.append(local(self.unpack("Q", meta, item + key_size)[0]))

    def unpack(self, form: str, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.order + form, data, at)

    def name_of(self, chrom: int) -> str | None:
        return next((n for n, (i, _) in self.chroms.items() if i == chrom), None)

    def blocks(self, index_at: int, chrom: int | None, lo: int, hi: int) -> list[tuple[int, int]]:
        """(offset, size) of the blocks that overlap the range or end where it begins, in file order."""
        return sorted((where, size) for _, _, _, _, where, size in self.entries(index_at, chrom, lo, hi))

    def entries(self, index_at: int, chrom: int | None = None, lo: int = 0, hi: int = 1 << 32) -> list[tuple]:
        """(chrom, base, chrom, base, offset, size) of those blocks; a level's nodes are read together, those that lie near each other in one request."""
        head = read_range(self.path, index_at, INDEX_HEADER_BYTES)
        if self.unpack("I", head)[0] != INDEX_MAGIC:
            raise ValueError(f"{self.path}: no index at {index_at}")
        usual = min(4 + 32 * self.unpack("I", head, 4)[0], NODE_BYTES)
        found, level = [], [index_at + INDEX_HEADER_BYTES]
        while level:
            below: list[int] = []
            for k, data in read_many(self.path, [(at, usual) for at in level], short=True):
                leaf, _, count = self.unpack("BBH", data)
                size = 32 if leaf else 24
                if len(data) < 4 + count * size:
                    data = read_range(self.path, level[k], 4 + count * size)
                for i in range(count):
                    c0, b0, c1, b1, where = self.unpack("IIIIQ", data, 4 + i * size)
                    if chrom is not None and ((c1, b1) < (chrom, lo) or (c0, b0) >= (chrom, hi)):
                        continue
                    if leaf:
                        found.append((c0, b0, c1, b1, where, self.unpack("Q", data, 4 + i * size + 24)[0]))
                    else:
                        below.append(where)
            level = below
        return found

    def inflate(self, block: bytes) -> bytes:
        return zlib.decompress(block) if self.buffer > 0 else block


def signal_rows(f: BigFile, block: bytes):
    """(chrom id, starts, ends, values) of one section."""
    chrom, start, _, step, span, kind, _, count = f.unpack("iiiiiBBH", block)
    o = f.order
    if kind == 1:
        items = np.frombuffer(block, np.dtype([("s", o + "i4"), ("e", o + "i4"), ("v", o + "f4")]), count, 24)
        return chrom, items["s"], items["e"], items["v"]
    if kind == 2:
        items = np.frombuffer(block, np.dtype([("s", o + "i4"), ("v", o + "f4")]), count, 24)
        return chrom, items["s"], items["s"] + span, items["v"]
    starts = start + np.arange(count, dtype=np.int64) * step
    return chrom, starts, starts + span, np.frombuffer(block, o + "f4", count, 24)


def zoom_rows(f: BigFile, block: bytes) -> np.ndarray:
    """Zoom records of a block; a cut-off last one is left out."""
    o = f.order
    form = np.dtype([("chrom", o + "i4"), ("start", o + "i4"), ("end", o + "i4"), ("n", o + "u4"), ("min", o + "f4"), ("max", o + "f4"), ("sum", o + "f4"), ("squares", o + "f4")])
    return np.frombuffer(block, form, len(block) // form.itemsize)


def feature_rows(f: BigFile, block: bytes):
    """(chrom id, start, end, rest) of a block; rest is Latin-1 up to a NUL byte."""
    at = 0
    while at < len(block):
        chrom, start, end = f.unpack("iii", block, at)
        stop = block.index(b"\0", at + 12)
        yield chrom, start, end, block[at + 12 : stop].decode("latin-1")
        at = stop + 1


_SIGNAL = "chr string, start int, end int, value float"
_FEATURE = "chr string, start int, end int, rest string"
_ZOOM = "chr string, start int, end int, value float, valid_count bigint, min float, max float, sum float, sum_squares float"
_META = {"chroms": "chrom string, id int, size int", "zooms": "level int, reduction int", "blocks": "chr string, start int, end int, path string, at bigint, size bigint", "summary": "bases_covered bigint, min_val double, max_val double, sum_data double, sum_squares double"}


@dataclass
class Run(InputPartition):
    path: str
    blocks: list | None


class BigReader(DataSourceReader):
    """Reads one file, of which the driver walks the index, or a folder of files, each of which is a task's, index and all. Of a folder with a list only files of the range are planned."""

    def __init__(self, path: str, magic: int, suffix: str, options: dict):
        self.path, self.magic, self.suffix = path, magic, suffix
        self.view, self.zoom = options.get("view", "data"), int(options.get("zoom", -1))
        self.chrom, self.lo, self.hi = options.get("chrom"), int(options.get("start", 0)), int(options.get("end", 1 << 31))

    def _blocks(self, f: BigFile) -> list:
        chrom = f.chroms[self.chrom][0] if self.chrom is not None else None
        return f.blocks(f.index_at if self.zoom < 0 else f.zooms[self.zoom][1], chrom, self.lo, self.hi)

    def partitions(self):
        known = listed(self.path)
        if known is not None:
            return [Run(f"{self.path.rstrip('/')}/{f['name']}", None) for f in holding(known, self.chrom, self.lo, self.hi)]
        files = files_of(self.path, self.suffix)
        if files != [self.path]:
            return [Run(f, None) for f in files]
        if self.view != "data":
            return [Run(self.path, [])]
        f = opened(self.path, self.magic)
        if self.chrom is not None and self.chrom not in f.chroms:
            raise ValueError(f"{self.path}: unknown chromosome {self.chrom}")
        runs: list[Run] = []
        size = 0
        for block in self._blocks(f):
            if not runs or size + block[1] > RUN_BYTES:
                runs.append(Run(self.path, []))
                size = 0
            runs[-1].blocks.append(block)
            size += block[1]
        return runs

    def read(self, partition):
        if partition is None:
            return
        f = opened(partition.path, self.magic)
        if self.view == "chroms":
            yield from ((n, i, s) for n, (i, s) in f.chroms.items())
        elif self.view == "zooms":
            yield from ((i, r) for i, (r, _) in enumerate(f.zooms))
        elif self.view == "summary":
            if f.summary:
                yield f.summary
        elif self.view == "blocks":
            names = {i: (n, size) for n, (i, size) in f.chroms.items()}
            for c0, b0, c1, b1, at, size in f.entries(f.index_at if self.zoom < 0 else f.zooms[self.zoom][1]):
                for c in range(c0, c1 + 1):  # a block of several chromosomes is a row of each
                    if c in names:
                        yield names[c][0], b0 if c == c0 else 0, b1 if c == c1 else names[c][1], partition.path, at, size
        else:
            names = {i: n for n, (i, _) in f.chroms.items()}
            blocks = partition.blocks
            if blocks is None:
                blocks = self._blocks(f) if self.chrom in (None, *f.chroms) else []
            for _, raw in read_many(partition.path, blocks):
                yield from self._batch(f, names, f.inflate(raw))

    def _batch(self, f, names, block):
        near = lambda s, e: (s < self.hi) & (e >= self.lo)
        if self.magic == FEATURE_MAGIC:
            rows = [(names[c], s, e, r) for c, s, e, r in feature_rows(f, block) if c in names and self.chrom in (None, names[c]) and near(s, e)]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], names=["chr", "start", "end", "rest"])
            return
        if self.zoom < 0:
            chrom, start, end, value = signal_rows(f, block)
            if chrom not in names or self.chrom not in (None, names[chrom]):
                return
            keep = near(start, end)
            yield pa.RecordBatch.from_arrays([pa.array([names[chrom]] * int(keep.sum()), pa.string()), pa.array(start[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32)), pa.array(value[keep].astype(np.float32))], names=["chr", "start", "end", "value"])
            return
        z = zoom_rows(f, block)
        z = z[near(z["start"], z["end"]) & np.isin(z["chrom"], [i for i, n in names.items() if self.chrom in (None, n)])]
        mean = np.divide(z["sum"], z["n"].astype(np.float32), out=np.zeros(len(z), np.float32), where=z["n"] > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[c] for c in z["chrom"].tolist()], pa.string()), pa.array(z["start"].astype(np.int32)), pa.array(z["end"].astype(np.int32)), pa.array(mean.astype(np.float32)), pa.array(z["n"].astype(np.int64)), *(pa.array(z[c].astype(np.float32)) for c in ("min", "max", "sum", "squares"))],
            names=["chr", "start", "end", "value", "valid_count", "min", "max", "sum", "sum_squares"],
        )


class PushedReader(BigReader):
    """Narrows the range by filters on chr, start and end; Spark still applies them to the rows."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chr",):
                self.chrom = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                self.hi = min(self.hi, f.value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute in (("start",), ("end",)):
                self.lo = max(self.lo, f.value)
            yield f


class _BigSource(DataSource):
    magic, suffix, rows = 0, "", ""

    def schema(self):
        view = self.options.get("view", "data")
        return _META[view] if view != "data" else _ZOOM if int(self.options.get("zoom", -1)) >= 0 else self.rows

    def reader(self, schema):
        made = PushedReader if self.options.get("pushdown", "false") == "true" else BigReader
        return made(self.options["path"], self.magic, self.suffix, dict(self.options))

    def writer(self, schema, overwrite):
        from . import bigwriter

        made = bigwriter.BigWigWriter if self.magic == SIGNAL_MAGIC else bigwriter.BigBedWriter
        return made(self.options["path"], self.suffix, overwrite, dict(self.options))


class BigWigSource(_BigSource):
    magic, suffix, rows = SIGNAL_MAGIC, ".bw", _SIGNAL

    @classmethod
    def name(cls):
        return "bigwig"


class BigBedSource(_BigSource):
    magic, suffix, rows = FEATURE_MAGIC, ".bb", _FEATURE

    @classmethod
    def name(cls):
        return "bigbed"
