"""Similarity join on word shingles: MinHash LSH forest, then exact verification."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held, read, small, trimmed
from .graph import components

WORDS, THRESHOLD = 5, 0.8
#: Tries of the forest, levels of each, and the recall that is wanted of pairs at the threshold.
TREES, LEVELS, RECALL = 32, 8, 0.999
#: Texts of a candidate component that one task compares.
BLOCK = 512
#: Stands for a null doc_id, after all others.
_NO_ID = (1 << 63) - 1
#: Bytes of text that are hashed at a time.
_CHUNK = 1 << 19

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz_", *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_PLACES = _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _rng.integers(0, 1 << 31, TREES * LEVELS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, TREES * LEVELS, np.uint32)


def _power(base: np.uint64, n: int) -> np.ndarray:
    powers = held(("powers",), dict)
    have = powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, _CHUNK + (1 << 16))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many each text has.

    A word is a run of ASCII letters, digits, low lines and characters beyond
    ASCII of the text in lower case. Its hash is the part of a running
    polynomial over the bytes that lies in it, moved to position 0.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\n".join([*raw, b""]) if raw else b"", np.uint8)
    inside = _IS_WORD[joined]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(joined)))])
    words = _mixed((total[end] - total[first]) * _power(_UNBASE, max(len(joined), 1))[first] + (end - first).astype(np.uint64) * _BASE)
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return words, np.diff(np.searchsorted(first, starts))


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and how many each text has; a text of fewer words is one shingle."""
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    at = np.repeat(np.cumsum(counts) - counts - np.cumsum(n) + n, n) + np.arange(n.sum())
    short = np.repeat(counts, n)
    out = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        have = short > k
        out += np.where(have, words[np.minimum(at + k, max(len(words) - 1, 0))] * _PLACES[k] if len(words) else out, np.uint64(0))
    return _mixed(out), n


def text_keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order; texts must have words.

    Every word is mixed with its place before the sum, so that texts of the same
    words in another order don't cancel out as they may in a polynomial.
    """
    first = np.cumsum(counts) - counts
    local = (np.arange(len(words)) - np.repeat(first, counts)).astype(np.uint64)
    sums = np.add.reduceat(_mixed(words ^ _mixed(local * _BASE + np.uint64(1))), first)
    return _mixed(sums + counts.astype(np.uint64)).view(np.int64)


def paths(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The way of each text through each trie: texts x TREES x LEVELS of 16 bits, each from one MinHash."""
    first = np.cumsum(counts) - counts
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.empty((TREES * LEVELS, len(counts)), np.uint32)
    for k in range(TREES * LEVELS):
        low[k] = np.minimum.reduceat(x * _TIMES[k] + _PLUS[k], first)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x2C1B3C6D)
    low ^= low >> np.uint32(13)
    return low.astype(">u2").T.reshape(len(counts), TREES, LEVELS)


def chance(similarity, level: int, trees: int = TREES):
    """That two texts share a prefix of `level` in some trie."""
    return 1 - (1 - similarity**level) ** trees


def stop_level(trees: int = TREES, levels: int = LEVELS, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The level at which prefixes need not be shortened further, as even pairs at the threshold are found with this chance."""
    return next((d for d in range(levels, 1, -1) if chance(threshold, d, trees) >= recall), 1)


def chunked(texts: list[str]):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("body"))


def forest(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, body (hash of the whole text), key (null without words) and the path through all tries, one after another."""

    def run(batches):
        for batch in small(batches):
            ids, bodies, texts = batch.column(0), batch.column(2), [t or "" for t in batch.column(1).to_pylist()]
            for at, some in chunked(texts):
                words, counts = word_hashes(some)
                has = np.flatnonzero(counts)
                keys, ways = [None] * len(some), [None] * len(some)
                if len(has):
                    hashes, n = shingles(words, counts[has])
                    for i, key, way in zip(has, text_keys(words, counts[has]).tolist(), paths(hashes, n), strict=True):
                        keys[i], ways[i] = key, way.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), bodies.slice(at, len(some)), pa.array(keys, pa.int64()), pa.array(ways, pa.binary())], names=["doc_id", "body", "key", "way"])

    return _bodies(docs, doc_id, text).mapInArrow(trimmed(run), "doc_id long, body long, key long, way binary")


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """The part of their MinHashes that two paths share, which estimates the similarity of the texts."""
    x, y = (np.frombuffer(b"".join(p), ">u2").reshape(len(p), TREES * LEVELS) for p in (a, b))
    return pd.Series((x == y).mean(axis=1))


def alike(pairs: DataFrame, ways: DataFrame, threshold: float) -> DataFrame:
    """The agreement s of all pairs in which it is at or above the threshold.

    Spark would push the filter through the selection and work out s twice, in
    two Python workers a task that live on, were it not told that s may change.
    """
    sides = [ways.select(F.col("key").alias(c), F.col("way").alias("w" + c)) for c in ("a", "b")]
    s = F.pandas_udf(agreement, "double").asNondeterministic()("wa", "wb")
    return pairs.join(sides[0], "a").join(sides[1], "b").select(s.alias("s")).where(F.col("s") >= threshold)


def measured_recall(pairs: DataFrame, ways: DataFrame, level: int, threshold: float) -> float:
    """The part of the pairs at or above the threshold that is found at a level, by all the pairs that are: one of chance p stands for 1/p of its kind."""
    found, all_ = alike(pairs, ways, threshold).agg(F.count("*"), F.sum(1 / (1 - F.pow(1 - F.pow("s", F.lit(level)), F.lit(TREES))))).first()
    return found / all_ if found else 1.0


def candidates(walked: DataFrame, threshold: float, recall: float, disk: Scratch) -> DataFrame:
    """Pairs (a, b) of texts that share a node of some trie, each text with the smallest of its node.

    Prefixes start at full depth, where nodes are smallest, and are shortened
    level by level until the recall that is measured on all pairs so found, or
    that of pairs at the threshold itself, is as wanted.
    """
    ways = disk.write(walked.where("key IS NOT NULL").groupBy("key").agg(F.first("way").alias("way")), "ways")
    least = stop_level(threshold=threshold, recall=recall)
    for level in range(LEVELS, 0, -1):
        node = F.xxhash64("tree", F.expr(f"substring(way, 1 + {2 * LEVELS} * tree, {2 * level})"))
        stops = ways.select("key", "way", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("key", node.alias("stop"))
        shared = stops.groupBy("stop").agg(F.min("key").alias("first"), F.max("key").alias("other")).where("first <> other").select("stop", "first")
        pairs = disk.write(stops.join(shared, "stop").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct(), f"pairs{level}")
        if level <= least:
            return pairs
        reached = measured_recall(pairs, ways, level, threshold)
        logging.getLogger(__name__).info("prefixes of %d: recall %.5f", level, reached)
        if reached >= recall:
            return pairs
        disk.drop(f"pairs{level}")
    return pairs


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share. Shingles of many sets go through a matrix product, others by their pairs."""
    n = len(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner = owner[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0]))
    held = np.diff(np.append(first, len(every)))
    out = np.zeros((n, n), np.float32)
    many = np.flatnonzero(held > 16)
    for at in range(0, len(many), 4096):
        some = many[at : at + 4096]
        grid = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), held[some])
        row = owner[np.repeat(first[some] - np.cumsum(held[some]) + held[some], held[some]) + np.arange(held[some].sum())]
        grid[row, column] = 1
        out += grid @ grid.T
    for p in range(2, 17):
        same = first[held == p]
        for at in range(0, len(same), (1 << 20) // (p * p)):
            who = owner[same[at : at + (1 << 20) // (p * p), None] + np.arange(p)].astype(np.int64)
            out += np.bincount((who[:, :, None] * n + who[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    np.fill_diagonal(out, 0)
    return out


_VERIFIED = "key long, root long, links long, split boolean"


def _verify(threshold: float):
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        """Compares the texts of a block, or of two blocks with each other."""
        pdf = pdf.drop_duplicates("key", ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        sizes = np.array([len(s) for s in sets], np.float64)
        same = overlaps(sets).astype(np.float64)
        union = sizes[:, None] + sizes[None, :] - same
        linked = same >= threshold * union - 1e-9
        np.fill_diagonal(linked, False)
        side = pdf["side"].to_numpy()
        if pdf["left"][0] != pdf["right"][0]:
            linked &= side[:, None] != side[None, :]
        keys = pdf["key"].to_numpy()
        root = keys.copy()
        while True:
            low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"key": keys, "root": root, "links": linked.sum(axis=1), "split": pdf["blocks"] > 1})

    return verify


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of texts that are alike, and each row's number of links.

    Two texts are linked if the Jaccard similarity of their sets of WORDS-word
    shingles is at least threshold; classes are what links connect. Rows of the
    same words are one text, so copies are never paired. Each text walks through
    TREES tries by its MinHashes; texts that share a prefix are candidates, and
    prefixes are shortened until the measured `recall` is reached (candidates()).
    Every candidate component is then compared whole and exactly by the texts'
    shingles, in blocks of BLOCK texts if it is larger.

    A text without words (null, empty, symbols) is alone in its class. A null
    doc_id comes after all others. Repeated rows are copies. An empty table gives no rows; other columns are ignored.

    Returns doc_id, class_id (smallest doc_id of the class), n_links (different
    texts that are linked with this one), n_copies (rows of the same words),
    body (xxhash64 of the text) and class_key, which tells classes apart even
    where no row of theirs has a doc_id.
    """
    spark = docs.sparkSession
    disk = Scratch(spark, "neardup")
    walked = disk.write(forest(docs, doc_id, text), "forest")
    pairs = candidates(walked, threshold, recall, disk)
    texts = disk.write(walked.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")), "texts")
    ids = disk.write(walked.select("doc_id", "body", "key"), "ids")
    disk.drop("forest")

    near = components(pairs, disk, "near")
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = near.join(sizes, "root").select(F.col("node").alias("key"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    # one row of each member's text is known by its doc_id; others that share the doc_id fall out by their key
    known = texts.join(near, texts["key"] == near["node"], "left_semi").select("doc_id").distinct()
    # a merge join whatever the size: members grow with the corpus, so a broadcast would not last
    sets = _shingled(_bodies(docs, doc_id, text).join(known.hint("merge"), "doc_id", "left_semi")).groupBy("key").agg(F.first("shingles").alias("shingles"))
    held = members.join(sets, "key").select("root", "blocks", "key", "shingles", F.col("block").alias("side"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("met"))
    met = held.select("root", "blocks", "key", "shingles", "side", F.least("side", "met").alias("left"), F.greatest("side", "met").alias("right"))
    verified = disk.write(met.groupBy("root", "left", "right").applyInPandas(_verify(threshold), _VERIFIED), "verified")

    links = verified.groupBy("key").agg(F.sum("links").alias("n_links"))
    whole = verified.where("NOT split").select("key", "root")
    cut = components(verified.where("split").select(F.col("key").alias("a"), F.col("root").alias("b")), disk, "cut")
    rooted = whole.union(cut.select(F.col("node").alias("key"), "root"))
    lowest = rooted.join(texts, "key").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = texts.join(rooted, "key", "left").join(lowest, "root", "left").join(links, "key", "left")
    told = classes.select("key", F.coalesce("root", "key").alias("class_key"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    shown = lambda c: F.when(c != _NO_ID, c)
    return ids.join(told, "key", "left").select(shown(F.col("doc_id")).alias("doc_id"), shown(F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), "body", F.coalesce("class_key", F.xxhash64("doc_id", "body")).alias("class_key"))


def _shingled(bodies: DataFrame) -> DataFrame:
    """(key, shingles) of texts with words: the hashes of their different shingles, sorted, 64 bits each."""

    def run(batches):
        for batch in small(batches):
            for _, some in chunked([t or "" for t in batch.column(1).to_pylist()]):
                words, counts = word_hashes(some)
                counts = counts[counts > 0]
                if len(counts):
                    hashes, n = shingles(words, counts)
                    sets = [np.unique(h).tobytes() for h in np.split(hashes, np.cumsum(n)[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(text_keys(words, counts)), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return bodies.mapInArrow(trimmed(run), "key long, shingles binary")


def op4_neardup(spark, sf_dir):
    return join(read(spark, sf_dir, "documents")).drop("body", "class_key")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
t AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min(doc_id) AS id, count(*) AS n_copies FROM d WHERE len(w) > 0 GROUP BY ALL),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t)),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
e AS (SELECT o.a, o.b FROM o JOIN z x ON x.id = o.a JOIN z y ON y.id = o.b WHERE o.n >= 0.8 * (x.n + y.n - o.n) - 1e-9),
c AS (SELECT id AS a, id AS b FROM t UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
cls AS (SELECT t.k, min(c.b) AS class_id, any_value(t.n_copies) AS n_copies, any_value(coalesce(l.n, 0)) AS n_links
  FROM t JOIN c ON c.a = t.id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = t.id GROUP BY t.k)
SELECT d.doc_id, coalesce(cls.class_id, d.doc_id) AS class_id, coalesce(cls.n_links, 0)::BIGINT AS n_links, coalesce(cls.n_copies, 1)::BIGINT AS n_copies
FROM d LEFT JOIN cls ON len(d.w) > 0 AND cls.k = array_to_string(d.w, ' ')
"""
