"""Periodic runs of words, found by recursive frequency splitting and a scan of lags."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, trimmed

#: A run has so many words at least, and twice its period.
LEAST = 12
#: Lags below LEAST are each tried; in a run of any period this many words in a row equal those a period on.
PHRASE = 6
#: Words that are looked at together.
WORDS = 300_000


def stretches(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of True that are at least so long."""
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - start >= least
    return start[long], end[long]


def positions(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the segments, and the segment of each."""
    size = end - start
    of = np.repeat(np.arange(len(start)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of], of


def named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each different pair of whole numbers, the same for equal pairs."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


class Phrases:
    """Names of the phrases of 1, 2, 4, ... words at each place; a longer phrase is two that overlap. Equal names are equal words."""

    def __init__(self, words: np.ndarray):
        self.by_power = [words.astype(np.int64)]

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        power = size.bit_length() - 1
        while len(self.by_power) <= power:
            last = self.by_power[-1]
            half = 1 << (len(self.by_power) - 1)
            shifted = np.concatenate([last[half:], np.zeros(min(half, len(last)), np.int64)])
            self.by_power.append(named(last, shifted))
        names = self.by_power[power]
        return names[places] if size == 1 << power else named(names[places], names[places + size - (1 << power)])


def split(phrases: Phrases, start: np.ndarray, end: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What is left of segments when words go that no phrase of `size` words covers that comes twice in the segment.

    Such words are too rare to be in a run of which the segment holds all, so
    they split it; the parts are split again until nothing changes.
    """
    out_start, out_end = [], []
    while len(start):
        places, of = positions(start, end)
        n, stop = len(places), np.cumsum(end - start)
        begin = np.flatnonzero(stop[of] - np.arange(n) >= size)
        key = named(of[begin], phrases.at(places[begin], size))
        often = begin[np.bincount(key)[key] >= 2] if len(begin) else begin
        covered = np.cumsum(np.bincount(often, minlength=n) - np.bincount(often + size, minlength=n + 1)[:n]) > 0
        border = np.concatenate([[True], of[1:] != of[:-1], [True]])
        both = np.concatenate([[False], covered, [False]])
        a = np.flatnonzero(covered & (border[:-1] | ~both[:-2]))
        b = np.flatnonzero(covered & (border[1:] | ~both[2:])) + 1
        whole = b - a == (end - start)[of[a]]
        out_start.append(places[a[whole]])
        out_end.append(places[b[whole] - 1] + 1)
        again = ~whole & (b - a >= least)
        start, end = places[a[again]], places[b[again] - 1] + 1
    if not out_start:
        return start, end
    s, e = np.concatenate(out_start), np.concatenate(out_end)
    order = np.argsort(s)
    s, e = s[order], e[order]
    return s[e - s >= least], e[e - s >= least]


class Found:
    """The runs found so far, by start; they are added in the order of periods."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Adds runs but for those inside one of a smaller period, of which theirs is a multiple."""
        if len(self.start):
            reach = np.maximum.accumulate(self.end)
            before = np.searchsorted(self.start, start, side="right") - 1
            new = (before < 0) | (reach[before] < end)
            start, end, period = start[new], end[new], period[new]
        whole = np.unique(np.array([np.append(self.start, start), np.append(self.end, end), np.append(self.period, period)]), axis=1)
        self.start, self.end, self.period = whole

    def inside(self, places: np.ndarray, size: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of `size` words: a run of at most this period that holds all of it (-1: none), and whether it is neither in the run's first nor in its last period."""
        some = np.flatnonzero(self.period <= period)
        of, deep = np.full(len(places), -1), np.zeros(len(places), bool)
        if len(some):
            # two such runs that both hold the phrase would be one
            long = some[self.end[some] - self.start[some] >= size]
            for_start = self.start[long]
            at = np.searchsorted(for_start, places, side="right") - 1
            # runs may begin inside others: the one that reaches farthest counts
            best = np.maximum.accumulate(self.end[long] * (len(long) + 1) + np.arange(len(long))) % (len(long) + 1) if len(long) else long
            ok = at >= 0
            run = long[best[at[ok]]]
            holds = self.end[run] >= places[ok] + size
            of[np.flatnonzero(ok)[holds]] = run[holds]
            held = of >= 0
            r = of[held]
            deep[held] = (places[held] >= self.start[r] + self.period[r]) & (places[held] + size <= self.end[r] - self.period[r])
        return of, deep


def _lags(phrases: Phrases, start: np.ndarray, end: np.ndarray, size: int, found: Found) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (segment, lag), size <= lag < 2 size, at which a phrase of `size` words comes again.

    Phrases deep inside a run of a period up to half their size are only paired
    with those that are not, as a run of a larger period that holds some of that
    run must also hold one of its ends. What is left are few pairs a phrase.
    """
    places, of = positions(start, end - size + 1)
    key = named(of, phrases.at(places, size))
    order = np.lexsort((places, key))
    places, key, of = places[order], key[order], of[order]
    run, deep = found.inside(places, size, size // 2)
    step = int(places.max(initial=0)) + 2 * size + 1
    line = key * step + places
    seg, lag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    shallow = np.flatnonzero(~deep)
    for low, high in ((size, 2 * size), (1 - 2 * size, 1 - size)):
        a, b = np.searchsorted(line, line[shallow] + low), np.searchsorted(line, line[shallow] + high)
        for at in range(0, len(shallow), 1 << 16):
            n = (b - a)[at : at + (1 << 16)]
            me = np.repeat(shallow[at : at + (1 << 16)], n)
            other = np.arange(len(me)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[at : at + (1 << 16)], n)
            apart = (run[me] != run[other]) | (run[me] < 0)
            pairs = np.unique(of[me[apart]] * step + np.abs(places[me[apart]] - places[other[apart]]))
            seg.append(pairs // step)
            lag.append(pairs % step)
    both = np.unique(np.concatenate(seg) * step + np.concatenate(lag))
    return both // step, both % step


def runs_of(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) inside given segments of a list of word numbers, by start and period.

    First words that come once in a segment split it, then words in no phrase of
    PHRASE words that comes twice, both until nothing changes: a run holds each
    of its words and such phrases twice at least. Lags below LEAST are tried on
    what survives. For lags from 12, 24, 48 and so on up to their double the
    segments are split by phrases of so many words, and the lags tried are those
    at which such a phrase comes again. A lag is tried by comparing each word
    with the one a lag on.
    """
    phrases, found = Phrases(words), Found()
    long = end - start >= LEAST
    start, end = split(phrases, start[long], end[long], 1, LEAST)
    start, end = split(phrases, start, end, PHRASE, LEAST)
    if not len(start):
        return np.zeros((0, 3), np.int64)
    places, of = positions(start, end)
    own = phrases.by_power[0][places]
    for lag in range(1, LEAST):
        same = (own[lag:] == own[:-lag]) & (of[lag:] == of[:-lag])
        a, b = stretches(same, max(LEAST, 2 * lag) - lag)
        found.add(places[a], places[b - 1] + lag + 1, np.full(len(a), lag))
    size = LEAST
    while len(start):
        start, end = split(phrases, start, end, size, 2 * size)
        got = []
        for s, lag in zip(*_lags(phrases, start, end, size, found), strict=True) if len(start) else ():
            part = words[start[s] : end[s]]
            a, b = stretches(part[lag:] == part[:-lag], lag)
            got.append(np.array([a + start[s], b + start[s] + lag, np.full(len(a), lag)]))
        if got:
            found.add(*np.concatenate(got, axis=1))
        size *= 2
    order = np.lexsort((found.period, found.start))
    return np.array([found.start, found.end, found.period]).T[order]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a repetition planted in a tenth of the documents, by the checksum of the id (none without an id)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    stays = np.cumsum(gone)[:-1] == 0
    return [words[i] for i in np.flatnonzero(stays)]


_RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, change=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's periodic runs of words, and its text without their repeats.

    Words are what ASCII white space separates; a null text has none. A run is a
    stretch of LEAST words or more, and of two periods or more, in which words a
    smallest period apart are equal and that no neighbouring word extends; runs
    may overlap. change(words, doc_id) may alter a row's words before. Texts are
    looked at together, some WORDS words at a time. Rows are independent, so repeated ones need
    no care; an empty table gives no rows; other columns are ignored.

    Returns doc_id, n_words, runs (start, length, period; by start, then
    period), collapsed (the words that no run holds after its first period,
    joined by one space).
    """

    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        line = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
        runs = runs_of(line, starts, ends)
        at = np.searchsorted(runs[:, 0], np.append(starts, len(line)))
        lists, left = [], []
        for i, t in enumerate(texts):
            own = runs[at[i] : at[i + 1]] - np.array([starts[i], starts[i], 0])
            lists.append([{"start": s, "length": e - s, "period": p} for s, e, p in own.tolist()])
            left.append(b" ".join(collapsed(t, own)).decode())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(lists, _RUN), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (text or "").encode().split()
                ids.append(key)
                texts.append(change(own, key) if change else own)
                held += len(own)
                if held >= WORDS:
                    yield answer(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield answer(ids, texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), _RUNS)


def op12_runs(spark, sf_dir):
    got = periodic_runs(read(spark, sf_dir, "documents"), planted)
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    some = F.size("runs") > 0
    return got.withColumn("best", F.when(some, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(F.when(some, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )

