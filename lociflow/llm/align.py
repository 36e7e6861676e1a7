"""Alignment of the tokens that two tokenizers make of the same texts, and how often their ids meet."""

from __future__ import annotations

import functools
import hashlib
import json
import pickle
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Sums, answered, batch_of, bucket_of, by_block, by_bucket, counted, dealt, in_blocks, pack_keys, pack_values, rows_of, unpack_keys, unpack_values
from .bpe import byte_symbols
from .common import Scratch, held, parts, read, trimmed
from .packing import _PLAIN, TokenIds

_DOCS, _PAIRS, _EXACT, _ANSWER = 7, 6, 5, 1
#: White space at which a text may be cut, if no token of either vocabulary reaches over it; and what is surely none.
_GAPS = " \n\t"
_SOLID = regex.compile(r"(?<=[\p{L}\p{M}\p{N}\p{P}\p{S}])(?=[ \n\t])")
_OTHER_SPACE = re.compile(r"[^\S \n\t]|᠎")
_UNIT = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
#: Ids of the second vocabulary are below this.
_B = 1 << 20
#: UTF-8 bytes of a block's texts: of the distinct units of so many the tokens are held at a time.
SIZE = 6 << 20
#: Characters from which on a text's units are taken one by one.
LONG = 1 << 22


class TwoVocabularies:
    """Ids of both vocabularies for units of text, and the bytes of all their tokens.

    A unit is white space and what follows it up to the next white space. No
    token reaches over a unit's start, so a text's tokens are those of its units.
    """

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.a = TokenIds(byte_level)
        with open(byte_level, encoding="utf-8") as f:
            whole = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        names = whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in name if c in byte_of)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        #: The B id of the same bytes, or -1; bytes that a piece spells are not those of a byte token.
        same = {b: i for i, b in enumerate(self.b_bytes) if self.b.is_byte(i)} | {b: i for i, b in enumerate(self.b_bytes) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([same.get(b, -1) for b in self.a_bytes], np.int64)
        real = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and len(p) > 1]
        self.cuts = not any("▁" in p.lstrip("▁") for p in real) and not any(c in p for p in real for c in _GAPS[1:])
        self.space = self.b.piece_to_id("▁")
        self.names = list(map(str, range(max(len(self.a_bytes), size))))

    @functools.cached_property
    def lib(self):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(self.a.path)
        lib.encode_special_tokens = True
        return lib

    def units(self, text: str) -> Iterable[str]:
        """The units of a space and a text; one if the vocabularies can't be cut."""
        if not self.cuts:
            return [" " + text]
        if _OTHER_SPACE.search(text):
            return _SOLID.split(" " + text)
        if len(text) > LONG:
            return (m[0] for m in _UNIT.finditer(" " + text))
        return _UNIT.findall(" " + text)

    def encode_a(self, unit: str) -> list[int]:
        if self.a.fast and (unit.isascii() or _PLAIN.fullmatch(unit)):
            return self.a.fast.encode_ordinary(unit)
        return self.lib.encode(unit, add_special_tokens=False).ids

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """The library puts a space before each text: a unit's own, or one that goes again."""
        own = [u[0] == " " for u in units]
        got = self.b.encode([u[o:] for u, o in zip(units, own, strict=True)], num_threads=1)
        return [g or [self.space] if o else g[1:] for g, o in zip(got, own, strict=True)]


def vocabularies(byte_level: str, pieces: str) -> TwoVocabularies:
    return held(("vocabularies", byte_level, pieces), lambda: TwoVocabularies(byte_level, pieces))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    out = array("q")
    for x in lists:
        out.extend(x)
    return np.frombuffer(out, np.int64) if len(out) else np.zeros(0, np.int64), np.array([len(x) for x in lists], np.int64)


class Aligned:
    """Groups and links of distinct units; those whose tokens do not spell the unit are not `good` and have none."""

    def __init__(self, both: TwoVocabularies, units: list[str]):
        a_lists, b_lists = [both.encode_a(u) for u in units], both.encode_b(units)
        raw = [u.encode() for u in units]
        spell_a, spell_b = both.a_bytes.__getitem__, both.b_bytes.__getitem__
        self.good = np.array([b"".join(map(spell_a, a)) == r and b"".join(map(spell_b, b)) == r for a, b, r in zip(a_lists, b_lists, raw, strict=True)], bool)
        a_lists, b_lists = ([x if g else [] for x, g in zip(own, self.good, strict=True)] for own in (a_lists, b_lists))
        (a, n_a), (b, n_b) = _flat(a_lists), _flat(b_lists)
        del a_lists, b_lists, raw
        n = len(units)
        a_end, b_end = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
        unit = np.repeat(np.arange(n), n_a)
        meet = np.searchsorted(b_end, a_end)
        ends = b_end[meet] == a_end if len(a) else np.zeros(0, bool)
        first = np.searchsorted(b_end, a_end - both.a_size[a], side="right")
        links = meet - first + 1
        self.n_a, self.n_b, self.n_groups = n_a, n_b, np.bincount(unit, ends, n).astype(np.int64)
        self.n_links = np.bincount(unit, links, n).astype(np.int64)
        #: Pairs of linked ids, by unit; exact says which join a token to the one of the same bytes.
        of = np.repeat(np.arange(len(a)), links)
        to = np.arange(len(of)) - np.repeat(np.cumsum(links) - links, links) + first[of]
        self.pair_a, pair_b = a[of], b[to]
        self.exact = both.same[self.pair_a] == pair_b
        self.pairs = (self.pair_a * _B + pair_b).astype(np.uint64)
        b_ends = np.zeros(len(b), bool)
        b_ends[meet[ends]] = True
        self.texts = self._texts(both.names.__getitem__, a.tolist(), b.tolist(), n_a, n_b, ends.tolist(), b_ends.tolist())

    @staticmethod
    def _texts(name, a, b, n_a, n_b, a_ends, b_ends) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each unit."""
        out, i, j = [], 0, 0
        for size_a, size_b in zip(n_a.tolist(), n_b.tolist(), strict=True):
            groups, stop = [], i + size_a
            while i < stop:
                i0, j0 = i, j
                while not a_ends[i]:
                    i += 1
                while not b_ends[j]:
                    j += 1
                i, j = i + 1, j + 1
                groups.append(f"{a[i0]}|{b[j0]}" if i - i0 == j - j0 == 1 else f"{','.join(map(name, a[i0:i]))}|{','.join(map(name, b[j0:j]))}")
            out.append(";".join(groups))
        return out


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values, of which some may be empty."""
    ends = np.cumsum(sizes)
    whole = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return whole[ends] - whole[ends - sizes]


def _listed(byte_level: str, pieces: str, buckets: int):
    """Of each block its rows' digests and units, and in how many rows each pair of ids is linked: exact pairs as a vector, others by pair."""

    def make(block: int, rows: pa.Table):
        both = vocabularies(byte_level, pieces)
        numbers: dict[str, int] = {}
        line = array("q")
        sizes = []
        for t in rows.column(1).to_pylist():
            own = [numbers.setdefault(u, len(numbers)) for u in both.units(t)] if t else ()
            line.extend(own)
            sizes.append(len(own))
        found = Aligned(both, list(numbers))
        line, sizes = np.frombuffer(line, np.int64) if len(line) else np.zeros(0, np.int64), np.array(sizes, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        spoiled = np.bincount(doc, ~found.good[line], len(sizes)) > 0
        line, doc, sizes = line[~spoiled[doc]], doc[~spoiled[doc]], np.where(spoiled, 0, sizes)
        # in how many rows each pair is linked
        distinct, place = np.unique(found.pairs, return_inverse=True)
        once, _ = counted((doc * len(numbers) + line).astype(np.uint64))
        unit, doc_of = (once % max(len(numbers), 1)).astype(np.int64), (once // max(len(numbers), 1)).astype(np.int64)
        starts, n = np.cumsum(found.n_links) - found.n_links, found.n_links[unit]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[unit], n)
        linked, _ = counted((np.repeat(doc_of, n) * max(len(distinct), 1) + place[at]).astype(np.uint64))
        rows_with = np.bincount((linked % max(len(distinct), 1)).astype(np.int64), minlength=len(distinct))
        exact = np.zeros(len(distinct), bool)
        exact[place] = found.exact
        used = rows_with > 0
        ids = (distinct[exact & used] // np.uint64(_B)).astype(np.uint64)
        yield batch_of([(block, _EXACT, block % buckets, pack_keys(ids), pack_values(rows_with[exact & used]))])
        keys = distinct[~exact & used]
        yield batch_of(dealt(block, _PAIRS, keys, rows_with[~exact & used], bucket_of(keys, buckets)))
        spell = found.texts.__getitem__
        digests, at = [], 0
        for size in sizes.tolist():
            digests.append(hashlib.sha256(";".join(map(spell, line[at : at + size].tolist())).encode()).hexdigest() if size else "")
            at += size
        columns = [_sums(x[line], sizes) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        whole = rows.column(0).to_pylist(), columns, digests, line.astype(np.int32), sizes, distinct, exact, place.astype(np.int32), found.n_links
        yield batch_of([(block, _DOCS, -1, zstandard.compress(pickle.dumps(whole, protocol=5), 3), None)])

    return make


_COUNTS = "id long, n long"


def _exact_sums(batches):
    sums = Sums()
    for _, _, _, packed, vals in rows_of(batches):
        sums.add(unpack_keys(packed), unpack_values(vals, np.int64))
    ids, n = sums.total()
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n)], names=["id", "n"])


def _pair_sums(buckets: int):
    def run(batches):
        sums = Sums()
        for _, _, _, packed, vals in rows_of(batches):
            sums.add(unpack_keys(packed), unpack_values(vals, np.int64))
        keys, n = sums.total()
        yield batch_of(dealt(-1, _ANSWER, keys, n.astype(np.float64), bucket_of(keys, buckets)))

    return run


def _most(batches):
    """The largest count among the pairs of each A id."""
    for _, _, _, packed, vals in rows_of(batches):
        ids, n = (unpack_keys(packed) // np.uint64(_B)).astype(np.int64), unpack_values(vals)
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(np.maximum.reduceat(n, first).astype(np.int64))], names=["id", "n"])


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _documents(exact: np.ndarray, best: np.ndarray):
    """exact, best: for each A id in how many rows it is linked to its own bytes, and the largest count of its pairs."""

    def of_block(packed: bytes, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ids, columns, digests, line, sizes, distinct, is_exact, place, n_links = pickle.loads(zstandard.decompress(packed))
        a = (distinct // np.uint64(_B)).astype(np.int64)
        n = np.zeros(len(distinct), np.int64)
        n[is_exact] = exact[a[is_exact]]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
            known = ~is_exact & (keys[at] == distinct)  # pairs of texts without tokens are in no row
            n[known] = counts[at[known]]
        unit_sum, unit_best = _sums(n[place], n_links), _sums((n == best[a])[place].astype(np.int64), n_links)
        columns = [*columns, _sums(unit_best[line], sizes), _sums(unit_sum[line], sizes)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns), pa.array(digests, pa.string())], names=[x.split()[0] for x in _ALIGNED.split(", ")])

    def run(batches):
        at, got = None, []
        for block, kind, _, packed, vals in rows_of(batches):
            if at != block:
                at, got = block, []
            if kind == _DOCS:
                keys = np.concatenate([k for k, _ in got]) if got else np.zeros(0, np.uint64)
                counts = np.concatenate([v for _, v in got]) if got else np.zeros(0)
                order = np.argsort(keys, kind="stable")
                yield of_block(packed, keys[order], counts[order].astype(np.int64))
            else:
                got.append((unpack_keys(packed), unpack_values(vals)))

    return run


def align(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Aligns every row's tokens under a byte-level tokenizers file (A) and a sentencepiece model (B).

    Both read a space and the text; strings of special tokens are plain text.
    Places where tokens of both end cut the bytes into groups, and tokens that
    share bytes are linked. A pair of ids counts in how many rows it is linked.
    Most groups are one token each of the same bytes: those pairs are named by
    their A id alone, through a table from each A id to the B id of its bytes,
    and are counted in vectors as long as the vocabulary. Only other pairs are
    shuffled, summed a block of documents before, and their counts go back to
    the blocks that hold them; vectors by A id (counts of exact pairs, and the
    largest count of any pair) go to all tasks.

    A null or empty text, or one whose tokens of A or B do not spell it (one that
    holds U+2581, say), has no tokens. Rows are independent but for the counts,
    in which repeated rows count each; an empty table gives no rows; other
    columns are ignored.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the
    largest of their A id), count_sum (over links), groups_sha256 (of
    `a1,a2|b1;a3|b2`; empty without tokens).
    """
    spark = docs.sparkSession
    disk, n = Scratch(spark, "align"), parts(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["block", "kind", "bucket", "keys", "vals"]
    listed = disk.write(in_blocks(rows, "text", _listed(byte_level, pieces, n), SIZE), "blocks", by="kind").select(order)
    pairs = listed.where(F.col("kind") == _PAIRS)
    answers = disk.write(by_bucket(pairs, _pair_sums(n), n), "pairs").select(order)
    width = len(vocabularies(byte_level, pieces).a_bytes)
    exact, best = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for r in by_bucket(listed.where(F.col("kind") == _EXACT), _exact_sums, n, _COUNTS).groupBy("id").agg(F.sum("n").alias("n")).collect():
        exact[r["id"]] = r["n"]
    for r in answers.mapInArrow(trimmed(_most), _COUNTS).groupBy("id").agg(F.max("n").alias("n")).collect():
        best[r["id"]] = r["n"]
    best = np.maximum(best, exact)
    asked = pairs.withColumn("vals", F.lit(None).cast("binary"))
    back = by_bucket(answers.union(asked), lambda b: answered(_ANSWER, b), n)
    return by_block(back.union(listed.where(F.col("kind") == _DOCS)), _documents(exact, best), n, _ALIGNED)


def op13_align(spark, sf_dir):
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
