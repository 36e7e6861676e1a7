"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import functools
import json
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import Scratch, held, parts, pieces_of, read, trimmed

#: How the byte-level vocabulary splits a text before its merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that both libraries split alike; texts with others go to the tokenizers library.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa0-\u024f\u2013\u2014\u2018-\u201d\u2022\u2026]*")


#: Stands for a null doc_id inside.
_NO_ID = -(1 << 63)


class TokenIds:
    """Ids of whole texts under a byte-level tokenizers file.

    Where the file's ids follow its merges, tiktoken gives the same ids several
    times faster; it is built from the same file. The tokenizers library itself
    takes texts that hold a special token's string or unusual characters.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.special = [t["content"] for t in whole["added_tokens"]]
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        vocab = {t: i for t, i in whole["model"]["vocab"].items() if t not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
        self.fast = None
        splits = whole["pre_tokenizer"] or {}
        usual = whole["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        if usual and [vocab[a + b] for a, b in pairs] == list(range(256, 256 + len(pairs))):
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def lib(self):
        """Loaded when it is first needed, as most tasks don't and its memory counts for each worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        if self.fast and not any(s in text for s in self.special) and (text.isascii() or _PLAIN.fullmatch(text)):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()


def token_ids(path: str) -> TokenIds:
    return held(("token_ids", path), lambda: TokenIds(path))


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first of several may be shorter than room."""
    first = n if n <= room else n % room or room
    return [(0, first), *((at, room) for at in range(first, n, room))]


class OpenBins:
    """Open bins by what room they have left, under a segment tree that finds the tightest fit."""

    def __init__(self, room: int):
        self.leaves = 1 << room.bit_length()
        self.has = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def put(self, left: int, first: int, count: int) -> None:
        if left and count:
            self.runs[left].append((first, count))
            self._mark(left)

    def _mark(self, left: int) -> None:
        node = left + self.leaves
        self.has[node] = bool(self.runs[left])
        while node > 1:
            node >>= 1
            self.has[node] = self.has[2 * node] | self.has[2 * node + 1]

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """Takes out a run of bins of the least room that is at least size: (room, first bin, count)."""
        node = size + self.leaves
        if not self.has[node]:
            while node > 1 and (node & 1 or not self.has[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.has[2 * node] else 2 * node + 1
        left = node - self.leaves
        first, count = self.runs[left].pop()
        self._mark(left)
        return left, first, count


def best_fit_plan(sizes: dict[int, int], room: int) -> np.ndarray:
    """Best-fit decreasing over how many pieces have each length.

    Pieces of one length are alike, so bins that were filled alike are kept as
    runs and filled together, which gives the bins that best-fit decreasing
    gives piece by piece. Rows: length, rank of the first piece, pieces, first
    bin, pieces a bin, offset in the bin. Their number depends on room alone.
    """
    bins, rows, opened = OpenBins(room), [], 0
    for size in sorted(sizes, reverse=True):
        rank, todo = 0, sizes[size]
        while todo:
            fit = bins.tightest(size)
            if fit is None:
                count = -(-todo // (room // size))
                fit = (room, opened, count)
                opened += count
            left, first, count = fit
            each = left // size
            take = min(todo, each * count)
            full, rest = divmod(take, each)
            rows.append((size, rank, take, first, each, room - left))
            bins.put(left - each * size, first, full)
            if rest:
                bins.put(left - rest * size, first + full, 1)
            bins.put(left, first + full + (rest > 0), count - full - (rest > 0))
            rank, todo = rank + take, todo - take
    return np.array(rows, np.int64).reshape(-1, 6)


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("mix", pa.int64())])


def tokenised_pieces(docs: DataFrame, vocabulary: str, room: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def cut_all(batches):
        ids = token_ids(vocabulary).ids
        for batch in batches:
            texts, keys = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                rows = []
                for key, text in zip(keys[at : at + 256], texts[at : at + 256], strict=True):
                    got = ids(text) + end
                    for i, (start, length) in enumerate(cut(len(got) // 4, room)):
                        own = got[4 * start : 4 * (start + length)]
                        crc = zlib.crc32(own)
                        rows.append((key, i, start, length, crc, own, zlib.crc32(b"%d %d %d" % (key, i, crc))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(cut_all), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, mix long")


def pack(docs: DataFrame, vocabulary: str, room: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all rows' token sequences into as few sequences of room tokens as best-fit decreasing can.

    A row is its ids and end_id; a null or empty text is end_id alone. Longer
    rows are cut into pieces of room tokens, of which the first may be shorter.
    The plan is made from the number of pieces of each length (room numbers,
    the only thing sent to the driver) and is itself bounded by room; each piece
    then finds its place by its rank among those of its length, which is counted
    in deals by doc_id and piece, so that a length of which there are very many
    pieces (copies of a text) is many tasks' work. Repeated rows are packed each; an empty table gives no
    rows; other columns are ignored.

    Deals are of some thousand pieces, as their ids are with them.

    Returns doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned
    32-bit), sequence_id, offset; sequences() puts the ids of each sequence together.
    """
    spark = docs.sparkSession
    disk = Scratch(spark, "pack")
    cuts = disk.write(tokenised_pieces(docs, vocabulary, room, end_id, doc_id, text), "pieces")
    deals = 4 * max(parts(spark), pieces_of(cuts.count(), 5_000))
    cuts = cuts.withColumn("deal", F.pmod("mix", F.lit(deals)).cast("int")).drop("mix")
    per_deal = cuts.groupBy("length", "deal").agg(F.count("*").alias("n"))
    plan = best_fit_plan({r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}, room)
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_deal.select(F.col("length").alias("of_length"), F.col("deal").alias("of_deal"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    starts = plan[np.lexsort((plan[:, 1], plan[:, 0]))] if len(plan) else plan
    reach = int(starts[:, 1].max(initial=0)) + 1 + int(starts[:, 2].max(initial=0))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def place(deal: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        deal = deal.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        length = deal["length"].to_numpy()
        rank = deal.groupby("length").cumcount().to_numpy() + deal["length"].map(base.set_index("of_length")["base"]).to_numpy()
        row = starts[np.searchsorted(starts[:, 0] * reach + starts[:, 1], length * reach + rank, side="right") - 1]
        nth = rank - row[:, 1]
        return deal[columns].assign(sequence_id=row[:, 3] + nth // row[:, 4], offset=row[:, 5] + nth % row[:, 4] * row[:, 0])

    placed = cuts.groupBy("deal").cogroup(bases.groupBy("of_deal")).applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences of pack(): sequence_id, n_tokens, n_pieces, ids (little-endian unsigned 32-bit, in the order of offsets)."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    got = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), pieces.alias("p"))
    return got.select("sequence_id", "n_tokens", "n_pieces", F.aggregate("p", F.lit(b""), lambda all, x: F.concat(all, x["ids"])).alias("ids"))


def op1_packing(spark, sf_dir):
    import public_tokenizers

    got = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
