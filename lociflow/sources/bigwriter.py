"""Writes bigWig and bigBed files by the public layout: a folder of files with zone maps, or one file of a whole genome."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pyramid
from .bigfile import CHROM_MAGIC, FEATURE_MAGIC, INDEX_MAGIC, SIGNAL_MAGIC
from .commit import FolderWriter
from .folders import scratch
from .ranges import storage

SIGNAL, FEATURE = SIGNAL_MAGIC, FEATURE_MAGIC
#: Records of a block, items of a node, and records of a file of a folder.
BLOCK, FAN, ROLL = 1024, 256, 4_000_000
#: From this many records on, a run of equal spans (and steps) is a section of its own kind: it saves more than a section's header and index entry cost.
RUN = 16
_ITEM = {1: [("s", "i4"), ("e", "i4"), ("v", "f4")], 2: [("s", "i4"), ("v", "f4")], 3: [("v", "f4")]}
_ZOOM = [("chrom", "i4"), ("start", "i4"), ("end", "i4"), ("n", "u4"), ("min", "f4"), ("max", "f4"), ("sum", "f4"), ("squares", "f4")]


def _dtype(order: str, fields) -> np.dtype:
    return np.dtype([(name, order + kind) for name, kind in fields])


def section(order, chrom, rows, kind, step=0, span=0):
    """rows: (start, end, value)."""
    start, end, value = (np.array([r[i] for r in rows]) for i in range(3))
    return _section(order, chrom, start, end, value, kind, step, span)


def _section(order, chrom, start, end, value, kind, step=0, span=0):
    items = np.zeros(len(start), _dtype(order, _ITEM[kind]))
    items["v"] = value
    if kind < 3:
        items["s"] = start
    if kind == 1:
        items["e"] = end
    lo, hi = int(start[0]), int(end.max())
    return struct.pack(order + "iiiiiBBH", chrom, lo, hi, step, span, kind, 0, len(items)) + items.tobytes(), (chrom, lo, chrom, hi)


def _runs(same: np.ndarray, least: int) -> np.ndarray:
    """For n items and whether each goes on as the one before (n - 1): the number of the long run that an item is in, or -1."""
    n = len(same) + 1
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(first, n))
    return np.repeat(np.where(size >= least, np.arange(len(first)), -1), size)


def sections_of(order: str, chrom: int, start: np.ndarray, end: np.ndarray, value: np.ndarray, block: int = BLOCK) -> list[tuple[bytes, tuple]]:
    """Sections of sorted records of a chromosome, each in the smallest encoding: fixed steps, equal spans, or whole ranges."""
    span = end - start
    steps = np.diff(start)
    even = np.diff(span) == 0
    # a record is as far from the one before as that from the one before it
    fixed = _runs(even & (steps > 0) & np.concatenate([[True], steps[1:] == steps[:-1]]) if len(steps) else even, RUN)
    # equal spans between fixed runs
    rest = fixed < 0
    variable = _runs(even & rest[1:] & rest[:-1], RUN)
    variable[~rest] = -1
    kind = np.where(fixed >= 0, 3, np.where(variable >= 0, 2, 1))
    run = np.where(fixed >= 0, fixed, variable)
    edges = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (run[1:] != run[:-1]), [True]]))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for at in range(a, b, block):
            some = slice(at, min(b, at + block))
            k = int(kind[at])
            step = int(steps[a]) if k == 3 and b - a > 1 else 0
            out.append(_section(order, chrom, start[some], end[some], value[some], k, step, int(span[a]) if k > 1 else 0))
    return out


def features(order, rows):
    """rows: (chrom, start, end, rest)."""
    body = b"".join(struct.pack(order + "iii", c, s, e) + rest.encode("latin-1") + b"\0" for c, s, e, rest in rows)
    last = max((r[0], r[2]) for r in rows)
    return body, (rows[0][0], rows[0][1], *last)


def zooms(order, rows):
    """rows: (chrom, start, end, count, min, max, sum, squares)."""
    return zoom_block(np.array([tuple(r) for r in rows], _dtype(order, _ZOOM)))


def zoom_block(records: np.ndarray):
    last = max(zip(records["chrom"].tolist(), records["end"].tolist(), strict=True))
    return records.tobytes(), (int(records["chrom"][0]), int(records["start"][0]), *last)


def _nodes(n: int, fan: int) -> list[int]:
    """Items of each level of a tree, from the root's down to the leaves'."""
    levels = [n]
    while levels[-1] > fan:
        levels.append(-(-levels[-1] // fan))
    return levels[::-1]


def index_size(n: int, fan: int) -> int:
    levels = _nodes(n, fan)
    return 48 + sum(4 * max(1, -(-items // fan)) + (32 if k == len(levels) - 1 else 24) * items for k, items in enumerate(levels))


def index(order, at, bounds, offsets, sizes, fan):
    """An R+ tree of any depth over blocks in order: bounds (chrom, base, chrom, base), offsets and sizes. Nodes of a level follow each other, the root first."""
    if not 2 <= fan <= 65_535:
        raise ValueError("a node holds 2 to 65 535 items")
    bounds = np.asarray(bounds, np.int64).reshape(-1, 4)
    n = len(bounds)
    levels = _nodes(n, fan)
    of_level = [bounds]
    for _ in levels[1:]:
        below = of_level[0]
        first = np.arange(0, len(below), fan)
        ends = (below[:, 2] << 32) + below[:, 3]
        most = np.maximum.reduceat(ends, first) if len(first) else ends
        of_level.insert(0, np.column_stack([below[first, :2], most >> 32, most & 0xFFFFFFFF]))
    low, high = (of_level[0][0, :2], (of_level[0][:, 2] << 32) + of_level[0][:, 3]) if n else (np.zeros(2, np.int64), np.zeros(1, np.int64))
    top = int(high.max())
    end = int((np.asarray(offsets) + np.asarray(sizes)).max()) if n else 0
    out = [struct.pack(order + "IIQIIIIQII", INDEX_MAGIC, fan, n, int(low[0]), int(low[1]), top >> 32, top & 0xFFFFFFFF, end, 1, 0)]
    place = at + 48
    for k, items in enumerate(of_level):
        leaf = k == len(of_level) - 1
        width = 32 if leaf else 24
        rows = np.zeros(len(items), _dtype(order, [("c0", "u4"), ("b0", "u4"), ("c1", "u4"), ("b1", "u4"), ("at", "u8"), *([("size", "u8")] if leaf else [])]))
        for name, column in zip(("c0", "b0", "c1", "b1"), items.T, strict=True):
            rows[name] = column
        place += 4 * max(1, -(-len(items) // fan)) + width * len(items)
        if leaf:
            rows["at"], rows["size"] = offsets, sizes
        else:
            below = len(of_level[k + 1])
            each = 32 if k == len(of_level) - 2 else 24
            rows["at"] = place + np.arange(len(items)) * (4 + each * fan)  # all nodes before the last are full
            assert len(items) == -(-below // fan)
        for i in range(0, max(len(items), 1), fan):
            some = rows[i : i + fan]
            out.append(struct.pack(order + "BBH", leaf, 0, len(some)) + some.tobytes())
    return b"".join(out)


def chrom_tree(order, chroms: dict[str, int], at: int, fan: int = FAN) -> bytes:
    """A B+ tree of any depth from names, which are in order, to numbers and sizes."""
    names = list(chroms)
    width = max((len(c.encode()) for c in names), default=0) + 2
    levels = _nodes(len(names), fan)
    out = [struct.pack(order + "IiiiQQ", CHROM_MAGIC, min(fan, max(len(names), 1)), width, 8, len(names), 0)]
    key = [c.encode().ljust(width, b"\0") for c in names]
    place, item = at + 32, width + 8
    for k, items in enumerate(levels):
        leaf = k == len(levels) - 1
        place += 4 * max(1, -(-items // fan)) + item * items
        reach = fan ** (len(levels) - 1 - k)
        for i in range(0, max(items, 1), fan):
            some = range(i, min(items, i + fan))
            if leaf:
                body = b"".join(key[j] + struct.pack(order + "ii", j, chroms[names[j]]) for j in some)
            else:
                body = b"".join(key[j * reach] + struct.pack(order + "Q", place + j * (4 + item * fan)) for j in some)
            out.append(struct.pack(order + "BBH", leaf, 0, len(some)) + body)
    return b"".join(out)


class Layout:
    """Where everything stands in a file, from the number and bytes of the blocks of the data and of each zoom level (from fine to coarse)."""

    def __init__(self, magic, order, chroms, data: tuple[int, int], levels: list[tuple[int, int, int]], compress=True, fan=FAN, summary=(0, 0.0, 0.0, 0.0, 0.0), sql="table x", chrom_fan=FAN):
        sql_at = 64 + 24 * len(levels)
        summary_at = sql_at + len(sql) + 1
        chrom_at = summary_at + 40
        tree = chrom_tree(order, chroms, chrom_at, chrom_fan)
        place = chrom_at + len(tree)
        self.order, self.fan = order, fan
        #: (place of the count, of the blocks and of the index, number of blocks) of the data and of each level.
        self.parts = []
        for n, size in [data, *((n, size) for _, n, size in levels)]:
            self.parts.append((place, place + 4, place + 4 + size, n))
            place += 4 + size + index_size(n, fan)
        heads = b"".join(struct.pack(order + "iiQQ", level[0], 0, at, index_at) for level, (at, _, index_at, _) in zip(levels, self.parts[1:], strict=True))
        head = struct.pack(order + "IHHQQQHHQQiQ", magic, 4, len(levels), chrom_at, self.parts[0][0], self.parts[0][2], 0, 0, sql_at, summary_at, 32768 if compress else 0, 0)
        self.head = head + heads + sql.encode() + b"\0" + struct.pack(order + "Qdddd", *summary) + tree

    def begin(self, part: int) -> bytes:
        return struct.pack(self.order + "I", self.parts[part][3])

    def end(self, part: int, bounds, sizes) -> bytes:
        """The index after a part's blocks."""
        sizes = np.asarray(sizes, np.int64)
        _, at, index_at, _ = self.parts[part]
        return index(self.order, index_at, bounds, at + np.cumsum(sizes) - sizes, sizes, self.fan)


def write(path, magic, order, chroms, blocks, levels=(), compress=True, fan=2, summary=(0, 0.0, 0.0, 0.0, 0.0), sql="table x", chrom_fan=FAN):
    """A file of blocks in memory. blocks: (bytes, bounds); levels: (reduction, blocks)."""
    pack = zlib.compress if compress else bytes
    parts = [[(pack(raw), bounds) for raw, bounds in some] for some in (blocks, *(some for _, some in levels))]
    size = lambda some: sum(len(raw) for raw, _ in some)
    layout = Layout(magic, order, chroms, (len(parts[0]), size(parts[0])), [(r, len(p), size(p)) for (r, _), p in zip(levels, parts[1:], strict=True)], compress, fan, summary, sql, chrom_fan)
    store, base = storage(path)
    with store.open_output_stream(base, compression=None) as f:
        f.write(layout.head)
        for k, some in enumerate(parts):
            f.write(layout.begin(k) + b"".join(raw for raw, _ in some))
            f.write(layout.end(k, [b for _, b in some], [len(raw) for raw, _ in some]))


def zoomed(order: str, chrom: int, start: np.ndarray, end: np.ndarray, value: np.ndarray, reduction: int) -> np.ndarray:
    """Zoom records of a chromosome's sorted records: a record counts in every bin it reaches with the bases it has there."""
    first = start // reduction
    n = (end - 1) // reduction - first + 1
    row = np.repeat(np.arange(len(start)), n)
    at = first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    by = np.argsort(at, kind="stable")
    row, at = row[by], at[by]
    bases = (np.minimum(end[row], (at + 1) * reduction) - np.maximum(start[row], at * reduction)).astype(float)
    v = value[row].astype(float)
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.zeros(len(edge), _dtype(order, _ZOOM))
    out["chrom"], out["start"], out["end"] = chrom, at[edge] * reduction, (at[edge] + 1) * reduction
    for name, of, x in (("n", np.add, bases), ("min", np.minimum, v), ("max", np.maximum, v), ("sum", np.add, v * bases), ("squares", np.add, v * v * bases)):
        out[name] = of.reduceat(x, edge)
    return out


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[str, pa.Table]]]:
    """Sorted rows as lists of (chromosome, its rows), of at most so many rows a list."""
    held: list[tuple[str, list]] = []
    rows = 0
    for whole in batches:
        chrom = np.array(whole.column(0).to_pylist(), object)
        edges = [0, *(np.flatnonzero(chrom[1:] != chrom[:-1]) + 1).tolist(), len(chrom)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            while a < b:
                if rows == most:
                    yield [(c, pa.Table.from_batches(x)) for c, x in held]
                    held, rows = [], 0
                n = min(b - a, most - rows)
                if not held or held[-1][0] != chrom[a]:
                    held.append((chrom[a], []))
                held[-1][1].append(whole.slice(a, n))
                rows, a = rows + n, a + n
    if held:
        yield [(c, pa.Table.from_batches(x)) for c, x in held]


class _BigWriter(FolderWriter):
    magic = 0

    def __init__(self, path: str, suffix: str, overwrite: bool, options: dict):
        super().__init__(path, suffix, overwrite)
        self.reductions = [int(r) for r in options.get("reductions", "").split(",") if r]
        self.fan, self.roll = int(options.get("fan", FAN)), int(options.get("roll", ROLL))

    def files(self, batches):
        for some in _stretches(batches, self.roll):
            chroms = {c: int(t.column(2).combine_chunks().to_numpy().max()) for c, t in some}
            blocks, levels, summary = self.parts(some)
            name = self.fresh()
            write(f"{self.path}/{name}", self.magic, "<", chroms, blocks, levels, fan=self.fan, summary=summary)
            zones = {c: [int(t.column(1)[0].as_py()), chroms[c]] for c, t in some}
            yield {"name": name, "records": sum(len(t) for _, t in some), "zones": zones, "levels": [r for r, _ in levels]}


class BigWigWriter(_BigWriter):
    """Rows (chr, start, end, value), sorted."""

    magic = SIGNAL

    def parts(self, some):
        blocks, sums = [], []
        records: dict[int, list] = {r: [] for r in self.reductions}
        for i, (_, rows) in enumerate(some):
            start, end, value = (rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            start, end = start.astype(np.int64), end.astype(np.int64)
            blocks += sections_of("<", i, start, end, value)
            v, bases = value.astype(float), (end - start).astype(float)
            sums.append((int(bases.sum()), v.min(), v.max(), (v * bases).sum(), (v * v * bases).sum()))
            for r in self.reductions:
                records[r].append(zoomed("<", i, start, end, value, r))
        levels = []
        for r in sorted(self.reductions, reverse=True):
            z = np.concatenate(records[r])
            levels.append((r, [zoom_block(z[k : k + BLOCK]) for k in range(0, len(z), BLOCK)]))
        n, low, high, total, squares = zip(*sums, strict=True)
        return blocks, levels, (sum(n), min(low), max(high), float(sum(total)), float(sum(squares)))


class BigBedWriter(_BigWriter):
    """Rows (chr, start, end, rest), sorted."""

    magic = FEATURE

    def parts(self, some):
        rows = [(i, *r) for i, (_, t) in enumerate(some) for r in zip(*(t.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        bases = sum(e - s for _, s, e, _ in rows)
        return [features("<", rows[k : k + BLOCK]) for k in range(0, len(rows), BLOCK)], [], (bases, 1.0, 1.0, float(bases), float(bases))


def _save(rows: DataFrame, columns: dict[str, str], kind: str, folder: str, options: dict, partitions: int | None) -> None:
    from . import register

    register(rows.sparkSession)
    typed = rows.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items())).where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    by = [*([partitions] if partitions else []), *columns]
    typed.repartitionByRange(*by).sortWithinPartitions(*columns).write.format(kind).options(**options).mode("overwrite").save(folder)


def write_bigwig(signal: DataFrame, folder: str, reductions: list[int] | None = None, partitions: int | None = None, roll: int = ROLL, fan: int = FAN) -> None:
    """Writes (chr, start, end, value) as a folder of bigWig files, each a stretch of the genome in order, which may be of several chromosomes.

    Files hold at most `roll` records and have zoom levels of their own; a bin at
    the border of two files is in both. They count when all are written, and the
    folder's list says what each holds. Empty records and those with nulls are
    left out.
    """
    options = {"reductions": ",".join(map(str, reductions or [])), "roll": roll, "fan": fan}
    _save(signal.where("start < end"), {"chr": "string", "start": "int", "end": "int", "value": "float"}, "bigwig", folder, options, partitions)


def write_bigbed(rows: DataFrame, folder: str, partitions: int | None = None, roll: int = ROLL, fan: int = FAN) -> None:
    """The same for (chr, start, end, rest) as bigBed files; empty records stay."""
    _save(rows, {"chr": "string", "start": "int", "end": "int", "rest": "string"}, "bigbed", folder, {"roll": roll, "fan": fan}, partitions)


_BLOCKS = "part int, chrom0 bigint, base0 bigint, chrom1 bigint, base1 bigint, block binary"


def _packed(rows: list[tuple[int, tuple[bytes, tuple]]]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary()]
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    columns = zip(*((part, *bounds, zlib.compress(raw)) for part, (raw, bounds) in rows), strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def write_one_bigwig(signal: DataFrame, file: str, reductions: list[int] | None = None, fan: int = FAN, chrom_fan: int = FAN, partitions: int | None = None) -> int:
    """Writes (chr, start, end, value) as one bigWig file of the whole genome and returns how many blocks its data has.

    Tasks sort, encode and compress blocks, and a pyramid is the zoom levels, so
    a bin is in the file once. Sizes are summed, which says where everything
    stands; then one task copies the blocks in order, as a file has one end, and
    holds a block and the bounds of all (forty bytes a block) at a time.
    """
    spark = signal.sparkSession
    rows = signal.where("start < end AND chr IS NOT NULL AND value IS NOT NULL").select("chr", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("value").cast("float").alias("value"))
    chroms = {r["chr"]: r["size"] for r in rows.groupBy("chr").agg(F.max("end").alias("size")).orderBy("chr").collect()}  # one row a chromosome
    ids = {c: i for i, c in enumerate(chroms)}
    levels = sorted(reductions or [])
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def data(batches):
        for some in _stretches(batches, ROLL):
            for chrom, t in some:
                start, end, value = (t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                blocks = sections_of("<", ids[chrom], start.astype(np.int64), end.astype(np.int64), value)
                for k in range(0, len(blocks), 256):
                    yield _packed([(0, b) for b in blocks[k : k + 256]])

    def zoom(batches):
        held: list[tuple[int, np.ndarray]] = []
        for b in batches:
            level, chrom = b.column(0).to_numpy(), np.array([ids[c] for c in b.column(1).to_pylist()], np.int64)
            z = np.zeros(len(b), _dtype("<", _ZOOM))
            z["chrom"], z["start"] = chrom, b.column(2).to_numpy()
            z["end"] = z["start"] + level
            for name, k in (("n", 3), ("min", 4), ("max", 5), ("sum", 6), ("squares", 7)):
                z[name] = b.column(k).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(level)) + 1).tolist(), len(level)]
            for a, e in zip(edges[:-1], edges[1:], strict=True):
                for k in range(a, e, BLOCK):
                    held.append((1 + levels.index(int(level[a])), z[k : min(e, k + BLOCK)]))
        yield _packed([(part, zoom_block(z)) for part, z in held])

    key = ["chr", "start", "end", "value"]
    blocks = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(data, _BLOCKS)
    if levels:
        bins = pyramid.build(rows, levels).select("reduction", "chr", F.col("start").cast("bigint").alias("start"), "valid_count", "min_val", "max_val", "sum_data", "sum_squares")
        blocks = blocks.union(bins.repartitionByRange(n, "reduction", "chr", "start").sortWithinPartitions("reduction", "chr", "start").mapInArrow(zoom, _BLOCKS))
    kept = scratch(spark, "blocks")
    blocks.write.parquet(kept)
    stored = spark.read.parquet(kept)
    sizes = {r["part"]: (r["n"], r["size"]) for r in stored.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("block")).alias("size")).collect()}
    v, bases = F.col("value").cast("double"), (F.col("end") - F.col("start")).cast("double")
    total = rows.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)), *(F.coalesce(x, F.lit(0.0)) for x in (F.min(v), F.max(v), F.sum(v * bases), F.sum(v * v * bases)))).first()
    layout = Layout(SIGNAL, "<", chroms, sizes.get(0, (0, 0)), [(r, *sizes.get(1 + i, (0, 0))) for i, r in enumerate(levels)], fan=fan, summary=tuple(total), chrom_fan=chrom_fan)

    if not sizes:
        write(file, SIGNAL, "<", chroms, [], [(r, []) for r in levels], fan=fan, chrom_fan=chrom_fan)
        return 0

    def copy(batches):
        store, base = storage(file)
        done = 0
        with store.open_output_stream(base, compression=None) as out:
            out.write(layout.head + layout.begin(0))
            bounds, lengths, part = [], [], 0
            for b in batches:
                for i in range(len(b)):
                    while part < b.column(0)[i].as_py():
                        out.write(layout.end(part, np.array(bounds), lengths) + layout.begin(part + 1))
                        bounds, lengths, part = [], [], part + 1
                    raw = b.column(5)[i].as_py()
                    bounds.append([b.column(k)[i].as_py() for k in (1, 2, 3, 4)])
                    lengths.append(len(raw))
                    out.write(raw)
                    done += part == 0
            while True:
                out.write(layout.end(part, np.array(bounds), lengths))
                bounds, lengths, part = [], [], part + 1
                if part == len(layout.parts):
                    break
                out.write(layout.begin(part))
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["blocks"])

    order = ["part", "chrom0", "base0", "chrom1", "base1"]
    return stored.repartition(1).sortWithinPartitions(*order).mapInArrow(copy, "blocks bigint").first()["blocks"]
