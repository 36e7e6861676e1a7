"""Dictionaries of a whole corpus, made and looked up block by block.

A block is some megabytes of documents that one task has read. Each block lists
its distinct keys (sorted 64-bit numbers) with counts; the lists are cut by
buckets of keys and only these meet in a shuffle. What is worked out for a key
goes back to just the blocks that hold it, so no task needs a table of all keys
and nothing is broadcast. Lists are packed into rows, as a row a key would cost
many times as much.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import trimmed

#: UTF-8 bytes of a block's texts; rows that are looked at together.
SIZE, ROWS = 16 << 20, 256
#: What all packed rows hold: the block (or -1), what kind of list it is, its bucket, sorted keys and a value or several a key.
SCHEMA = "block long, kind int, bucket int, keys binary, vals binary"
_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned numbers as compressed differences, byte by byte."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack_values(packed: bytes, kind=np.float64, columns: int = 1) -> np.ndarray:
    got = np.frombuffer(zstandard.decompress(packed), kind)
    return got.reshape(columns, -1) if columns > 1 else got


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(29))) * _MIX
    return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def dealt(block: int, kind: int, keys: np.ndarray, values: np.ndarray, bucket: np.ndarray):
    """Packed rows of keys and values (of which the last axis goes with keys), one for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, values = bucket[order], keys[order], values[..., order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield block, kind, int(bucket[a]), pack_keys(keys[a:b]), pack_values(values[..., a:b])


def batch_of(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(whole, kind="stable")
    whole, n = whole[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, np.int64)
    return whole[first], np.add.reduceat(n, first) if len(first) else n


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class Sums:
    """Counts by key that come in lists; memory is that of the distinct keys and of some lists."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.keys, self.counts, self.waiting = most, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > self.most + (len(self.keys[0]) if len(self.keys) > 1 else 0):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        k, n = summed(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [k], [n], 0
        return k, n


class Lookup:
    """Places of known keys in a sorted list, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            stays = self.slots[at] != left
            left, at = left[stays], (at[stays] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero(self.keys[out] != keys)
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.slots[at[todo]]
            if out[todo].min() < 0:
                raise KeyError("a key that its block did not list")
            todo = todo[self.keys[out[todo]] != keys[todo]]
        return out


def in_blocks(docs: DataFrame, text: str, make, size: int = SIZE) -> DataFrame:
    """Packed rows that make(block, record batch of docs) yields for each block of docs."""
    at = docs.columns.index(text)

    def run(batches):
        task, seq, waiting, held = TaskContext.get().partitionId(), 0, [], 0
        for whole in batches:
            for k in range(0, len(whole), ROWS):
                some = whole.slice(k, ROWS)
                waiting.append(some)
                held += pc.sum(pc.binary_length(some.column(at))).as_py() or 0
                if held >= size:
                    yield from make(task << 24 | seq, pa.Table.from_batches(waiting).combine_chunks())
                    seq, waiting, held = seq + 1, [], 0
        if waiting:
            yield from make(task << 24 | seq, pa.Table.from_batches(waiting).combine_chunks())

    return docs.mapInArrow(trimmed(run), SCHEMA)


def ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def rows_of(batches):
    """(block, kind, bucket, keys, vals) of packed batches, one at a time."""
    for batch in batches:
        for i in range(len(batch)):
            yield tuple(c[i].as_py() for c in batch.columns)


def by_bucket(rows: DataFrame, run, n: int, schema: str = SCHEMA) -> DataFrame:
    """run over the packed rows of whole buckets, each task having some, in the order of bucket and kind."""
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(trimmed(run), schema)


def by_block(rows: DataFrame, run, n: int, schema: str) -> DataFrame:
    """The same by block; of a block the rows of the largest kind come last."""
    return rows.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(trimmed(run), schema)


def answered(of: int, batches, values_of=np.float64):
    """Gives blocks back the values of their keys: of each bucket the rows of kind `of` hold the values of all its keys and come first."""
    at, parts, keys, values = None, [], None, None
    for block, kind, bucket, packed, vals in rows_of(batches):
        if kind == of:
            if at != bucket:
                at, parts, keys = bucket, [], None
            parts.append((unpack_keys(packed), unpack_values(vals, values_of)))
            continue
        if keys is None:
            keys, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        yield batch_of([(block, kind, bucket, packed, pack_values(values[np.searchsorted(keys, unpack_keys(packed))]))])
