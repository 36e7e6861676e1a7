"""Language-model scores by context-tree weighting over byte contexts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Lookup, Sums, answered, batch_of, bucket_of, by_block, by_bucket, counted, dealt, from_ipc, in_blocks, ipc, pack_keys, pack_values, rows_of, summed, unpack_keys, unpack_values
from .common import Scratch, parts, read, trimmed

#: Bytes of context. A context and the byte after it are a key of eight bytes at most, so 7 is the most.
DEPTH = 5
#: The depth at which trees are cut: below it a context's subtree is one task's, above it only nodes move.
CUT = 3
#: Ends every text; no UTF-8 text holds it.
_END = 0xFF
_DOCS, _GRAMS, _WORDS, _TOTALS, _NODES, _CARRY, _ANSWER = 7, 6, 5, 4, 3, 2, 1
#: Keys whose contexts are put together at a time, which bounds a task's memory.
_STEP = 1 << 21
_HALF = math.log(0.5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    n = 1 << 14
    whole = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n)))])
    half = math.lgamma(0.5) + np.concatenate([[0.0], np.cumsum(np.log(np.arange(n - 1) + 0.5))])
    return whole, half


_WHOLE, _HALVES = _tables()


def _log_gamma(n: np.ndarray, add: float, table: np.ndarray) -> np.ndarray:
    """log gamma(n + add) of whole numbers n; table: its values for small n."""
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = n >= len(table)
    if large.any():
        x = n[large] + add
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return _log_gamma(a, 0.5, _HALVES) + _log_gamma(b, 0.5, _HALVES) - math.log(math.pi) - _log_gamma(a + b, 1.0, _WHOLE)


class Level:
    """The nodes of one depth for one of the eight bits of a byte.

    A node is a context (the latest byte first) with the bits before this one of
    the byte that follows. below: the node of each of the deeper level's nodes.
    """

    __slots__ = ("keys", "a", "b", "kt", "stay", "weighted", "below")

    def __init__(self, keys, a, b, deeper: np.ndarray | None, below):
        self.keys, self.a, self.b, self.below = keys, a, b, below
        block = log_kt(a, b)
        self.kt = (a + 0.5) / (a + b + 1)
        self.weighted = block if deeper is None else np.logaddexp(_HALF + block, _HALF + deeper)
        self.stay = np.ones(len(keys)) if deeper is None else np.exp(_HALF + block - self.weighted)


def leaves(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest level of sorted keys (context, next byte), the node of each key, and each key's own bit."""
    nodes = keys >> np.uint64(8 - bit)
    own = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
    first = np.concatenate([[True], nodes[1:] != nodes[:-1]]) if len(nodes) else np.zeros(0, bool)
    of = np.cumsum(first) - 1
    n = int(first.sum())
    a, b = np.bincount(of, counts * ~own, n), np.bincount(of, counts * own, n)
    return Level(nodes[first], a, b, None, None), of, own


def above(level: Level, bit: int) -> Level:
    """The level whose contexts are a byte shorter."""
    low = np.uint64((1 << bit) - 1)
    up = ((level.keys >> np.uint64(bit + 8)) << np.uint64(bit)) | (level.keys & low)
    keys, of = np.unique(up, return_inverse=True)
    a, b, deeper = (np.bincount(of, x, len(keys)) for x in (level.a, level.b, level.weighted))
    return Level(keys, a, b, deeper, of)


def descend(level: Level, carry: np.ndarray) -> np.ndarray:
    """What weighting has gathered on the way down to each node, given what it had above.

    Rows: the weighted estimate (of a 0) of the depths so far, the weight that is
    left, and the estimate of the deepest depth that training has seen, which
    takes what is left where deeper contexts are new.
    """
    seen = level.a + level.b > 0
    done, left, last = carry
    new = np.array([done + left * level.stay * level.kt, left * (1 - level.stay), level.kt])
    return np.where(seen, new, carry)


def bit_scores(carry: np.ndarray, own: np.ndarray) -> np.ndarray:
    zero = np.clip(carry[0] + carry[1] * carry[2], 1e-300, 1.0)
    return np.log10(np.where(own, np.maximum(1 - zero, 1e-300), zero))


def grams(texts: list[bytes], depth: int):
    """Keys of all bytes of the texts and of their ends, in steps: (keys, first key of each piece, text of each piece).

    Before its start a text has `depth` zero bytes. A text longer than a step is
    several pieces, each of which sees the bytes before it.
    """
    pieces: list[tuple[int, bytes, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            body = t[at : at + _STEP]
            last = at + len(body) == len(t)
            before = t[max(0, at - depth) : at]
            pieces.append((i, before.rjust(depth, b"\0"), body + bytes([_END]) if last else body))
            size += len(body)
            at += len(body)
            if size >= _STEP:
                yield _keys(pieces, depth)
                pieces, size = [], 0
            if last:
                break
    if pieces:
        yield _keys(pieces, depth)


def _keys(pieces: list[tuple[int, bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(body) for _, _, body in pieces])
    starts = np.cumsum(lengths) - lengths
    whole = np.frombuffer(b"".join([before + body for _, before, body in pieces]), np.uint8)
    inside = np.ones(len(whole), bool)
    pads = starts + depth * np.arange(len(pieces))
    for d in range(depth):
        inside[pads + d] = False
    places = np.flatnonzero(inside)
    keys = whole[places].astype(np.uint64)
    for d in range(1, depth + 1):
        keys |= whole[places - d].astype(np.uint64) << np.uint64(8 * (depth + 1 - d))
    return keys, starts, np.array([i for i, _, _ in pieces])


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _lower(texts) -> list[bytes]:
    return [(t or "").encode().lower() for t in texts]


def _listed(depth: int, buckets: int):
    """Of each block its rows, its byte contexts and its words, with their counts in the rows to learn from."""

    def make(block: int, rows: pa.Table):
        texts, learn = _lower(rows.column(1).to_pylist()), rows.column(2).to_pylist()
        yield batch_of([(block, _DOCS, -1, ipc(rows), None)])
        sums = Sums()
        words: dict[bytes, int] = {}
        for use in (True, False):
            own = [t for t, k in zip(texts, learn, strict=True) if k == use]
            for keys, _, _ in grams(own, depth):
                got, n = counted(keys)
                sums.add(got, n * use)
            for t in own:
                for w in t.split():
                    words[w] = words.get(w, 0) + use
        keys, counts = sums.total()
        yield batch_of(dealt(block, _GRAMS, keys, counts, bucket_of(keys, buckets)))
        hashed = np.fromiter(map(word_key, words), np.uint64, len(words))
        keys, counts = summed([hashed], [np.fromiter(words.values(), np.int64, len(words))])
        yield batch_of(dealt(block, _WORDS, keys, counts, bucket_of(keys, buckets)))

    return make


def _add_up(depth: int, buckets: int):
    """Sums the blocks' counts: contexts go on to the bucket of their subtree, words are answers; one row of totals a task."""

    def run(batches):
        grams, words = Sums(), Sums()
        for _, kind, _, packed, vals in rows_of(batches):
            (grams if kind == _GRAMS else words).add(unpack_keys(packed), unpack_values(vals, np.int64))
        keys, counts = grams.total()
        yield batch_of(dealt(-1, _GRAMS, keys, counts, _subtree(keys >> np.uint64(8 * (depth + 1 - CUT)), buckets)))
        keys, counts = words.total()
        totals = np.array([counts.sum(), np.count_nonzero(counts)], np.int64)
        yield batch_of([*dealt(-1, _ANSWER, keys, counts.astype(np.float64), bucket_of(keys, buckets)), (-1, _TOTALS, 0, None, totals.tobytes())])

    return run


def _subtree(cut_context: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(cut_context, buckets)


def _gathered(batches, kind: int, values=np.float64, columns: int = 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and values of packed rows, sorted by key, by which block they name (for nodes: the bit)."""
    held: dict[int, list] = {}
    for block, _, _, packed, vals in (r for r in batches if r[1] == kind):
        held.setdefault(block, []).append((unpack_keys(packed), unpack_values(vals, values, columns)))
    out = {}
    for block, some in held.items():
        keys, vals = np.concatenate([k for k, _ in some]), np.concatenate([v for _, v in some], axis=-1)
        order = np.argsort(keys, kind="stable")
        out[block] = keys[order], vals[..., order]
    return out


def _lower_trees(depth: int):
    """The nodes at the cut, each with its counts and its weighted probability, dealt by their latest byte."""

    def run(batches):
        for keys, counts in _gathered(rows_of(batches), _GRAMS, np.int64).values():
            for bit in range(8):
                level = leaves(keys, counts, bit)[0]
                for _ in range(depth - CUT):
                    level = above(level, bit)
                latest = (level.keys >> np.uint64(8 * (CUT - 1) + bit)).astype(np.int32)
                yield batch_of(dealt(bit, _NODES, level.keys, np.array([level.a, level.b, level.weighted]), latest))

    return run


def _cut_level(keys: np.ndarray, vals: np.ndarray) -> Level:
    a, b, weighted = vals
    level = Level(keys, a, b, None, None)
    level.weighted, level.stay = weighted, np.exp(_HALF + log_kt(a, b) - weighted)
    return level


def _first_bytes(batches):
    """The nodes of contexts of one byte: 256 contexts and 255 nodes each at most."""
    for bit, (keys, vals) in _gathered(rows_of(batches), _NODES, columns=3).items():
        level = _cut_level(keys, vals)
        for _ in range(CUT - 1):
            level = above(level, bit)
        yield batch_of([(bit, _NODES, 0, pack_keys(level.keys), pack_values(np.array([level.a, level.b, level.weighted])))])


def _root(rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """What weighting has gathered at each node of the empty context, by bit."""
    out = {}
    for bit, (keys, vals) in _gathered(((r["block"], r["kind"], r["bucket"], r["keys"], r["vals"]) for r in rows), _NODES, columns=3).items():
        top = above(_cut_level(keys, vals), bit)
        out[bit] = top.keys, descend(top, np.array([[0.0], [1.0], [0.5]]).repeat(len(top.keys), axis=1))
    return out


def _down_to_cut(root: dict[int, tuple[np.ndarray, np.ndarray]], buckets: int):
    """What weighting has gathered at the nodes of the cut, dealt to their subtrees."""

    def run(batches):
        for bit, (keys, vals) in _gathered(rows_of(batches), _NODES, columns=3).items():
            levels = [_cut_level(keys, vals)]
            for _ in range(CUT - 1):
                levels.append(above(levels[-1], bit))
            one, (top, carry) = levels[-1], root[bit]
            carry = carry[:, np.searchsorted(top, one.keys & np.uint64((1 << bit) - 1))]
            for k in range(CUT - 1, -1, -1):
                carry = descend(levels[k], carry)
                if k:
                    carry = carry[:, levels[k].below]
            yield batch_of(dealt(bit, _CARRY, keys, carry, _subtree(keys >> np.uint64(bit), buckets)))

    return run


def _scored(depth: int, buckets: int):
    """The log10 probability of each key's byte in its context, dealt as the blocks' lists are."""

    def run(batches):
        rows = list(rows_of(batches))
        carries = _gathered(rows, _CARRY, columns=3)
        for keys, counts in _gathered(rows, _GRAMS, np.int64).values():
            score = np.zeros(len(keys))
            for bit in range(8):
                level, of, own = leaves(keys, counts, bit)
                levels = [level]
                for _ in range(depth - CUT):
                    levels.append(above(levels[-1], bit))
                at, carry = carries[bit]
                carry = carry[:, np.searchsorted(at, levels[-1].keys)]
                for k in range(depth - CUT, 0, -1):
                    carry = descend(levels[k - 1], carry[:, levels[k].below])
                score += bit_scores(carry[:, of], own)
            yield batch_of(dealt(-1, _ANSWER, keys, score.astype(np.float32), bucket_of(keys, buckets)))

    return run


_SCORES = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _documents(depth: int, train_tokens: int, distinct: int, ends: int):
    """Scores of each block's rows from the values of its keys, which come before them."""
    floor = 0.1 / (train_tokens + 0.1 * (distinct + 1))
    end_score = math.log10((ends + 0.1) / 0.1 * floor)

    def of_block(rows: pa.Table, keys: np.ndarray, scores: np.ndarray, word_keys: np.ndarray, counts: np.ndarray):
        texts = _lower(rows.column(1).to_pylist())
        lookup, sums = Lookup(keys), np.zeros(len(texts))
        for own, starts, of in grams(texts, depth):
            np.add.at(sums, of, np.add.reduceat(scores[lookup.places(own)], starts, dtype=np.float64))
        logs = np.log10((counts + 0.1) / 0.1 * floor)
        known: dict[bytes, tuple[float, bool]] = {}
        n_tokens, n_known, base = [], [], []
        for t in texts:
            words = t.split()
            total, old = end_score, int(ends > 0)
            for w in words:
                got = known.get(w)
                if got is None:
                    k = np.searchsorted(word_keys, np.uint64(word_key(w)))
                    got = known[w] = float(logs[k]), bool(counts[k] > 0)
                total += got[0]
                old += got[1]
            n_tokens.append(len(words) + 1)
            n_known.append(old)
            base.append(total)
        learn = rows.column(2).to_pylist()
        columns = [rows.column(0).combine_chunks(), [not k for k in learn], [len(t) for t in texts], n_tokens, n_known, [train_tokens] * len(texts), base, sums]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SCORES.split(", ")])

    def run(batches):
        at, held = None, {}
        for block, kind, _, packed, vals in rows_of(batches):
            if at != block:
                at, held = block, {_GRAMS: [], _WORDS: []}
            if kind == _DOCS:
                lists = []
                for which in (_GRAMS, _WORDS):
                    some = held[which]
                    keys = np.concatenate([k for k, _ in some]) if some else np.zeros(0, np.uint64)
                    values = np.concatenate([v for _, v in some]) if some else np.zeros(0)
                    order = np.argsort(keys, kind="stable")
                    lists += [keys[order], values[order]]
                yield of_block(from_ipc(packed), *lists)
            else:
                held[kind].append((unpack_keys(packed), unpack_values(vals, np.float32 if kind == _GRAMS else np.float64)))

    return run


def held_out(doc_id):
    """Rows that the model does not learn from; those without a doc_id are among them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame, learn, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's log10 probability by a context tree learned from the rows where `learn` holds.

    A text (A-Z in lower case; null is empty) is its UTF-8 bytes and an end. Each
    byte is eight binary decisions and each decision has its own tree over the
    bytes before, up to `depth` of them. A node keeps how often a 0 and a 1
    followed, and weighs half its own Krichevsky-Trofimov estimate and half the
    product of its children's weighted ones. A decision's probability is the
    mixture of the estimates of all depths by these weights, as they stand after
    training; where a context is new to training, the deepest one that is not
    takes what weight is left. For each decision the chances of 0 and 1 add up
    to 1, so those of all texts do. A byte's logarithm is sent to the blocks as a
    32-bit number, so a score is exact to about seven digits.

    Counts are of all rows. Every block of documents lists its distinct contexts
    (with the byte that follows), equal ones are added up, trees are worked out
    below CUT bytes in one task a subtree (what follows one three-byte context:
    2^24 keys at most for five bytes), and
    above it by the latest byte. Only the nodes of one-byte contexts (65 280 at
    most) reach the driver. Each block then gets the probabilities of its own
    contexts. Nothing grows with one key: an entry comes once a block.

    base_score is that of a smoothed count of words (A-Z in lower case, split at
    ASCII white space, one end a text): log10((c + 0.1) / (N + 0.1 (V + 1))). Words
    are told apart by 64-bit hashes. Rows are independent, so repeated ones and
    ties need no care; an empty table gives no rows, and if nothing is learned a
    decision's chance is a half; a null `learn` is false; other columns are ignored.

    Returns doc_id, held_out (not learned from), n_bytes, n_tokens, n_known,
    train_tokens, base_score, score, bits_per_byte (code length over the bytes and the end).
    """
    if not CUT <= depth <= 7:
        raise ValueError(f"depth is {CUT} to 7")
    spark = docs.sparkSession
    disk, n = Scratch(spark, "lm"), parts(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    ends = rows.where("learn").count()
    listed = disk.write(in_blocks(rows, "text", _listed(depth, n)), "blocks", by="kind").select("block", "kind", "bucket", "keys", "vals")
    lists = listed.where(F.col("kind").isin(_GRAMS, _WORDS))
    added = disk.write(by_bucket(lists, _add_up(depth, n), n), "added", by="kind").select("block", "kind", "bucket", "keys", "vals")
    totals = [np.frombuffer(r["vals"], np.int64).tolist() for r in added.where(F.col("kind") == _TOTALS).collect()]
    words, distinct = (sum(t[i] for t in totals) for i in (0, 1))
    nodes = disk.write(by_bucket(added.where(F.col("kind") == _GRAMS), _lower_trees(depth), n), "nodes")
    root = _root(nodes.repartition(min(n, 256), "bucket").mapInArrow(trimmed(_first_bytes), nodes.schema).collect())
    carry = by_bucket(nodes, _down_to_cut(root, n), min(n, 256))
    answers = by_bucket(added.where(F.col("kind") == _GRAMS).union(carry), _scored(depth, n), n)
    asked = lists.withColumn("vals", F.lit(None).cast("binary"))
    grams_back = by_bucket(answers.union(asked.where(F.col("kind") == _GRAMS)), lambda b: answered(_ANSWER, b, np.float32), n)
    words_back = by_bucket(added.where(F.col("kind") == _ANSWER).union(asked.where(F.col("kind") == _WORDS)), lambda b: answered(_ANSWER, b), n)
    whole = grams_back.union(words_back).union(listed.where(F.col("kind") == _DOCS))
    return by_block(whole, _documents(depth, words + ends, distinct + (ends > 0), ends), n, _SCORES).withColumn("bits_per_byte", -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1))


def op11_lm(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score(docs, ~held_out(F.col("doc_id")))
