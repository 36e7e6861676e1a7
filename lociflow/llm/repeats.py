"""Removal of repeated byte strings by merging sorted suffixes of shards, round by round."""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces_of, read, small, trimmed
from .neardup import _BASE, _UNBASE, _mixed, _power, chunked

#: Bytes of a repeated string, and of the short strings whose smallest hash anchors it.
LENGTH, KERNEL = 100, 20
#: Anchors that a task combines before they are dealt, and that a task merges at once.
COMBINED, MERGED = 400_000, 10_000
#: Contexts of one anchor beyond which they are settled string by string, in as many tasks as need be.
HOT = 20_000
#: Bytes of a long text that are looked at at a time.
PIECE = 1 << 19
_NO_ID = -(1 << 63)
_ANCHORS = pa.schema([("hash", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("body", pa.int64()), ("pos", pa.int64()), ("tail", pa.int32())])


def sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest (or largest) of each `width` neighbours, by running ones within blocks from both sides."""
    op, fill = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    n = len(a) - width + 1
    blocks = np.concatenate([a, np.full(-len(a) % width, fill, np.uint64)]).reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH, kernel: int = KERNEL):
    """(text, position, hash, hash of the context, bytes from the position to the context's end) of every anchor.

    Each string of `length` bytes is anchored at the kernels of smallest hash in
    it, so equal strings are anchored alike. A context is all bytes of those
    strings around one anchor.
    """
    texts_at = np.cumsum([0, *map(len, texts)])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    n, reach = len(joined), length - kernel
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    total = np.concatenate([[np.uint64(0)], np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n))])
    back = _power(_UNBASE, n)
    kernels = _mixed((total[kernel:] - total[:-kernel]) * back[: n - kernel + 1]) | np.uint64(1)
    of = np.repeat(np.arange(len(texts)), np.diff(texts_at))
    ends = texts_at[1:][of]
    kernels[np.arange(len(kernels)) + kernel > ends[: len(kernels)]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    smallest = sliding(kernels, reach + 1, True)
    smallest[np.arange(len(smallest)) + length > ends[: len(smallest)]] = 0
    edge = np.zeros(reach, np.uint64)
    at = np.flatnonzero(kernels == sliding(np.concatenate([edge, smallest, edge]), reach + 1, False))
    first, last = np.maximum(at - reach, texts_at[of[at]]), np.minimum(at + length, ends[at])
    context = _mixed((total[last] - total[first]) * back[first] + ((at - first) * 1024 + last - first).astype(np.uint64) * _BASE)
    return of[at], at - texts_at[of[at]], kernels[at].view(np.int64), context.view(np.int64), last - at


def pieces(raw: bytes, length: int):
    """(offset of the part, bytes, first and last place of its own anchors): a long text comes in parts that overlap, so that each anchor has all around it that it depends on."""
    for at in range(0, max(len(raw), 1), PIECE):
        first, end = max(at - 2 * length, 0), min(at + PIECE + 2 * length, len(raw))
        yield first, raw[first:end], at - first, min(at + PIECE, len(raw)) - first


def _anchored(docs: DataFrame, length: int, kernel: int) -> DataFrame:
    """Anchors of all texts. Of those of one context a task deals out the first; the others are spans (context null). A document is its id and its text's hash (body)."""
    reach = length - kernel

    def combine(found: list) -> pa.RecordBatch:
        doc, body, pos, key, context, tail = (np.concatenate(c) for c in zip(*found, strict=True))
        found.clear()
        order = np.lexsort((pos, body, doc, context, key))
        doc, body, pos, key, context, tail = (c[order] for c in (doc, body, pos, key, context, tail))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        again = (doc != doc[head]) | (body != body[head]) | (pos != pos[head])
        keep = np.flatnonzero(new)
        start, end = np.maximum(pos - reach, 0), pos + tail
        spans = merged(doc[again], body[again], start[again], end[again], length)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key[keep], _mixed(spans[1].view(np.uint64)).view(np.int64)])),
                pa.array(np.concatenate([context[keep], np.zeros(len(spans[0]), np.int64)]), mask=np.concatenate([np.zeros(len(keep), bool), np.ones(len(spans[0]), bool)])),
                pa.array(np.concatenate([doc[keep], spans[0]])),
                pa.array(np.concatenate([body[keep], spans[1]])),
                pa.array(np.concatenate([pos[keep], spans[2]])),
                pa.array(np.concatenate([tail[keep], spans[3] - spans[2]]).astype(np.int32)),
            ],
            schema=_ANCHORS,
        )

    def run(batches):
        held, size = [], 0
        for batch in small(batches):
            ids, bodies = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
            parts = [(i, *part) for i, t in enumerate(batch.column(2).to_pylist()) for part in pieces((t or "").encode("utf-8", "surrogatepass"), length)]
            for at, some in chunked([p[2] for p in parts]):
                of, pos, key, context, tail = anchors(some, length, kernel)
                row, offset, first, last = (np.array([p[k] for p in parts[at : at + len(some)]], np.int64)[of] for k in (0, 1, 3, 4))
                own = (pos >= first) & (pos < last)
                held.append([c[own] for c in (ids[row], bodies[row], pos + offset, key, context, tail)])
                size += int(own.sum())
                if size >= COMBINED:
                    yield combine(held)
                    held, size = [], 0
        if size:
            yield combine(held)

    return docs.mapInArrow(trimmed(run), "hash long, context long, doc long, body long, pos long, tail int")


def merged(doc: np.ndarray, body: np.ndarray, start: np.ndarray, end: np.ndarray, least: int):
    """Spans of at least `least` bytes as maximal runs of their documents."""
    good = end - start >= least
    doc, body, start, end = (c[good] for c in (doc, body, start, end))
    if not len(doc):
        return doc, body, start, end
    order = np.lexsort((start, body, doc))
    doc, body, start, end = (c[order] for c in (doc, body, start, end))
    other = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (body[1:] != body[:-1]))])
    lift = other * (int(end.max()) + 2)  # documents lie one after another
    reached = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], start[1:] + lift[1:] > reached[:-1]])
    first = np.flatnonzero(new)
    return doc[first], body[first], start[first], np.maximum.reduceat(end, first)


def refine(group: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, rounds: int) -> np.ndarray:
    """Interval of each row after 0 to `rounds` rounds (rounds + 1 x rows); -1 where the row is alone or has ended.

    Rows are suffixes of which round k reads symbol k (symbols: rounds x rows).
    They start as they come from their shards, with one interval for each group.
    A round reads the next symbol of every row in the merged order and deals the
    rows of each interval by it, stably: the interleave is then that of the
    suffixes' first k + 1 symbols, and a border that appears in round k stands
    between suffixes whose common prefix is k. Nothing is compared or sorted
    whole, and rows alone in their interval leave.
    """
    out = np.full((rounds + 1, len(group)), -1, np.int64)
    interleave = np.argsort(group, kind="stable")
    interval = group[interleave]
    for k in range(rounds + 1):
        if k:
            live = sizes[interleave] >= k
            interleave = interleave[live]
            key = interval[live] * 256 + symbols[k - 1, interleave]
            order = np.argsort(key, kind="stable")
            interleave, interval = interleave[order], key[order]
        if not len(interleave):
            break
        border = np.concatenate([[True], interval[1:] != interval[:-1]])
        number = np.cumsum(border) - 1
        shared = np.bincount(number)[number] > 1
        interleave, interval = interleave[shared], number[shared]
        out[k, interleave] = interval
    return out


def repeated_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, length: int, kernel: int) -> np.ndarray:
    """Whether the string that starts k bytes before each anchor stands in an earlier row of the group (reach + 1 x rows).

    Rows are in the order of the corpus. Two strings are equal if their rows lie
    in one interval of the suffixes from the anchor on and in one of the
    reversed prefixes before it.
    """
    reach = length - kernel
    ahead, behind = refine(group, right, n_right, length), refine(group, left, n_left, reach)
    out = np.zeros((reach + 1, len(group)), bool)
    for k in range(reach + 1):
        rows = np.flatnonzero((behind[k] >= 0) & (ahead[length - k] >= 0))
        if len(rows):
            _, first, inverse = np.unique(behind[k, rows] * (len(group) + 1) + ahead[length - k, rows], return_index=True, return_inverse=True)
            out[k, rows] = rows > rows[first[inverse]]
    return out


def _merge(length: int, kernel: int):
    reach = length - kernel

    def some(pdf: pd.DataFrame) -> list:
        m = len(pdf)
        grid = np.zeros((reach + length, m), np.uint8)  # symbols before the anchor, nearest first, then from it on
        n_left = np.minimum(pdf["pos"].to_numpy(), reach).astype(np.int64)
        n_right = np.empty(m, np.int64)
        for i, (b, n) in enumerate(zip(pdf["bytes"], n_left, strict=True)):
            row = np.frombuffer(b, np.uint8)
            grid[:n, i] = row[:n][::-1]
            grid[reach : reach + len(row) - n, i] = row[n:]
            n_right[i] = len(row) - n
        group = np.unique(pdf["hash"].to_numpy(), return_inverse=True)[1]
        again = repeated_windows(group, grid[:reach].astype(np.int64), grid[reach:].astype(np.int64), n_left, n_right, length, kernel)
        k, row = np.nonzero(again)
        pos = pdf["pos"].to_numpy()[row] - k
        return list(merged(pdf["doc"].to_numpy()[row], pdf["body"].to_numpy()[row], pos, pos + length, length))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hash", "doc", "body", "pos"]).drop_duplicates(["hash", "doc", "body", "pos"], ignore_index=True)
        new = np.flatnonzero(np.concatenate([[True], np.diff(pdf["hash"].to_numpy()) != 0]))
        cuts = [0]
        for at in [*new[1:], len(pdf)]:
            if at - cuts[-1] > MERGED:
                cuts.append(int(at))
        cuts = [*cuts, len(pdf)] if cuts[-1] < len(pdf) else cuts
        found = [some(pdf.iloc[a:b].reset_index(drop=True)) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("doc", "body", "first", "last"))})

    return merge


def _release(spark) -> None:
    """Lets Spark's cleaner delete shuffle files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_CONTEXTS = pa.schema([("hash", pa.int64()), ("doc", pa.int64()), ("body", pa.int64()), ("pos", pa.int64()), ("bytes", pa.binary())])
_SPAN = "doc long, body long, first long, last long"


def _string_by_string(contexts: DataFrame, length: int, kernel: int) -> DataFrame:
    """Spans of contexts of hot anchors: each string of `length` bytes is a row, and its earliest place is kept by an aggregation that starts in the map tasks."""
    reach = length - kernel

    def strings(batches):
        for batch in batches:
            doc, body, pos = (batch.column(i).to_numpy() for i in (1, 2, 3))
            out: list[tuple] = []
            for i, raw in enumerate(batch.column(4).to_pylist()):
                before = min(int(pos[i]), reach)
                out += [(raw[k : k + length], doc[i], body[i], pos[i] - before + k) for k in range(min(before, len(raw) - length) + 1)]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["string", "doc", "body", "first"])

    rows = contexts.mapInArrow(strings, "string binary, doc long, body long, first long").select(F.md5("string").alias("string"), "doc", "body", "first").distinct()
    earliest = rows.groupBy("string").agg(F.min(F.struct("doc", "body", "first")).alias("earliest"))
    again = rows.join(earliest, "string").where(F.struct("doc", "body", "first") != F.col("earliest"))
    return again.select("doc", "body", "first", (F.col("first") + length).alias("last"))


def repeated_spans(docs: DataFrame, disk: Scratch, length: int = LENGTH, kernel: int = KERNEL) -> DataFrame:
    """(doc, body, first, last) of bytes that stand earlier too; spans of a document may overlap. docs: doc, body, text."""
    spark = docs.sparkSession
    reach = length - kernel
    dealt = _anchored(docs, length, kernel).repartition("hash")
    group, same = Window.partitionBy("hash"), Window.partitionBy("hash", "context")
    place = F.struct("doc", "body", "pos")
    seen = dealt.select("*", F.min(place).over(same).alias("earliest"), (F.min("context").over(group) != F.max("context").over(group)).alias("various"))
    again = F.col("context").isNotNull() & (place != F.col("earliest"))
    span = F.col("context").isNull() | again
    marked = disk.write(
        seen.where(span | F.col("various")).select(
            F.when(~span, F.col("hash")).alias("hash"),
            "doc",
            "body",
            F.when(F.col("context").isNull() | ~span, F.col("pos")).otherwise(F.greatest(F.col("pos") - reach, F.lit(0))).alias("pos"),
            (F.col("pos") + F.col("tail")).alias("last"),
        ),
        "marked",
    )
    _release(spark)
    exact = marked.where("hash IS NULL").select("doc", "body", F.col("pos").alias("first"), "last")
    open_ = marked.where("hash IS NOT NULL")
    buckets = pieces_of(open_.count(), MERGED)
    wanted = open_.groupBy("doc", "body").agg(F.collect_set(F.struct("hash", "pos")).alias("at"))

    def cut(batches):
        for batch in small(batches):
            rows = {name: [] for name in _CONTEXTS.names}
            for doc, body, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for a in at:
                    p = a["pos"]
                    if p + kernel <= len(raw):
                        for name, value in zip(_CONTEXTS.names, (a["hash"], doc, body, p, raw[max(p - reach, 0) : p + length]), strict=True):
                            rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=_CONTEXTS)

    contexts = docs.join(wanted, ["doc", "body"]).select("doc", "body", "text", "at").mapInArrow(trimmed(cut), "hash long, doc long, body long, pos long, bytes binary")
    counts = open_.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash")
    hot = disk.write(counts, "hot")
    if hot.limit(1).count():
        contexts = disk.write(contexts, "contexts")
        cool, heated = contexts.join(hot, "hash", "left_anti"), contexts.join(hot, "hash", "left_semi")
        exact = exact.union(_string_by_string(heated, length, kernel))
    else:
        cool = contexts
    found = cool.groupBy(F.pmod("hash", F.lit(buckets)).alias("bucket")).applyInPandas(_merge(length, kernel), _SPAN)
    return exact.union(disk.write(found, "found"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, kernel: int = KERNEL, as_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the bytes that are left; as_text: what of them is UTF-8, as a string).

    A byte goes if a string of `length` bytes over it starts earlier too: in a
    document of smaller doc_id, or earlier in its own. Strings are judged on the
    input, lie within one document, and overlaps count.

    The suffixes that are merged are those that start at anchors, with the
    prefixes before them; every string of `length` bytes holds an anchor at the
    same place wherever it stands, so no repeat is missed. Each map task is a
    shard: it brings out one row for each context it holds, and what repeats in
    the shard is a span at once, so a passage of which there are very many
    copies is as many rows as there are shards. An anchor with one context is
    settled by its earliest row; the contexts of the others are merged round by
    round (refine), and those of an anchor that has more than HOT of them string
    by string. Two contexts (of at most 180 bytes) are taken as equal where both
    the 64-bit hashes of their anchors and their own are.

    A document is a doc_id and a text: rows with both equal are cut alike, and
    of rows that share a doc_id, or have none, those of other texts are other
    documents, in the order of their texts' hashes. A null text is empty, and a
    null doc_id sorts before all others. An empty table gives no rows. Columns
    of docs stay; those of the four names are replaced.
    """
    spark = docs.sparkSession
    disk = Scratch(spark, "repeats")
    key, body = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)), F.xxhash64(F.col(text))
    spans = repeated_spans(docs.select(key.alias("doc"), body.alias("body"), F.col(text).alias("text")), disk, length, kernel)
    of = [c + "_" * max(map(len, docs.columns)) for c in ("d", "b", "s")]  # longer than any name of docs
    by_doc = disk.write(spans.groupBy("doc", "body").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans").toDF(*of)
    _release(spark)
    kept = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    at = [c.lower() for c in kept.columns].index(text.lower())
    schema = kept.withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": F.lit("" if as_text else b"")}).schema

    def cut(batches):
        for batch in small(batches):
            *columns, spans_of = batch.columns
            out = []
            for text, spans in zip(columns[at].to_pylist(), spans_of.to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if not spans:
                    out.append((len(raw), 0, 0, raw))
                    continue
                _, _, first, last = merged(np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64), np.array([s["first"] for s in spans]), np.minimum([s["last"] for s in spans], len(raw)), 1)
                left = b"".join(raw[a:b] for a, b in zip([0, *last], [*first, len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(left), len(first), left))
            four = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            left = pa.array([x.decode("utf-8", "ignore") for x in four[3]], pa.string()) if as_text else pa.array(four[3], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in four[:3]), left], names=schema.names)

    joined = kept.withColumns({of[0]: key, of[1]: body}).join(by_doc, of[:2], "left").select(*(kept[c] for c in kept.columns), of[2])
    return joined.mapInArrow(trimmed(cut), schema)


def op2_repeats(spark, sf_dir):
    got = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
