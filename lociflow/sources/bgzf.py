"""Block-gzip text with a tabix index: its layout, and the parts of both that tasks write.

A file is gzip members of at most 64 KiB, so it can be read from any of them. A
virtual offset is a member's place in the file and a place in its text. The
index has, for each chromosome, the stretches of virtual offsets of the records
in each bin of a fixed hierarchy, and for each 16 KiB of positions the first
offset of a record that reaches it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .ranges import read_range

#: The end mark, the most text of a member, and the index's magic (fixed values).
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MEMBER = 65280
MAGIC = b"TBI\1"
#: The smallest bin's width as a power of two, the levels above it, and the columns of chromosome, start and end in GTF (fixed values).
SHIFT, LEVELS = 14, 5
COLUMNS = (1, 4, 5)


def member(text: bytes) -> bytes:
    """One gzip member whose header says how long it is."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    return struct.pack("<4BIBBH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def member_size(head: bytes, at: int = 0) -> int:
    """Bytes of the member that begins there, from the extra field of its header."""
    if head[at : at + 4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not block-gzip")
    extra, i = struct.unpack_from("<H", head, at + 10)[0], at + 12
    stop = i + extra
    while i < stop:
        one, two, size = struct.unpack_from("<BBH", head, i)
        if (one, two) == (66, 67):
            return struct.unpack_from("<H", head, i + 4)[0] + 1
        i += 4 + size
    raise ValueError("not block-gzip")


def inflate(data: bytes, at: int, size: int) -> bytes:
    extra = struct.unpack_from("<H", data, at + 10)[0]
    return zlib.decompress(data[at + 12 + extra : at + size - 8], -15)


def bin_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin that holds the whole 0-based half-open range."""
    out, done = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    last = end - 1
    for level in range(LEVELS, 0, -1):
        shift = SHIFT + 3 * (LEVELS - level)
        same = ~done & (start >> shift == last >> shift)
        out[same] = ((1 << 3 * level) - 1) // 7 + (start[same] >> shift)
        done |= same
    return out


def bins_over(start: int, end: int) -> list[int]:
    """All bins that may hold records which meet the range."""
    last = min(end, 1 << (SHIFT + 3 * LEVELS)) - 1
    out = [0]
    for level in range(1, LEVELS + 1):
        shift, first = SHIFT + 3 * (LEVELS - level), ((1 << 3 * level) - 1) // 7
        out += range(first + (start >> shift), first + (last >> shift) + 1)
    return out


class Index:
    """Bins {chromosome: {bin: [(from, to)]}} and first offsets {chromosome: [offset a window]}, in virtual offsets."""

    def __init__(self, names: list[str] | None = None):
        self.bins: dict[str, dict[int, list[tuple[int, int]]]] = {n: {} for n in names or ()}
        self.linear: dict[str, list[int]] = {n: [] for n in names or ()}

    def add(self, chrom: str, start: np.ndarray, end: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> None:
        """Records of a chromosome in file order: 0-based half-open ranges and their virtual offsets."""
        bins, linear = self.bins.setdefault(chrom, {}), self.linear.setdefault(chrom, [])
        which = bin_of(start, end)
        edges = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self._chunk(bins.setdefault(int(which[a]), []), int(begins[a]), int(stops[b - 1]))
        first, last = start >> SHIFT, (end - 1) >> SHIFT
        linear += [0] * (int(last.max()) + 1 - len(linear))
        # a window's first record is the first in the file that reaches it; what lies before was first already
        reach = np.maximum.accumulate(last)
        before = np.concatenate([[-1], reach[:-1]])
        for i in np.flatnonzero((last > before) | (first > before)).tolist():
            for w in range(int(first[i]), int(last[i]) + 1):
                if not linear[w]:
                    linear[w] = int(begins[i]) + 1

    @staticmethod
    def _chunk(chunks: list[tuple[int, int]], begin: int, stop: int) -> None:
        """Chunks that end in the member where the next begins are one."""
        if chunks and chunks[-1][1] >> 16 >= begin >> 16:
            chunks[-1] = (chunks[-1][0], stop)
        else:
            chunks.append((begin, stop))

    def append(self, other: Index, base: int) -> None:
        """Adds the index of a part that follows `base` bytes into the file."""
        move = base << 16
        for chrom, bins in other.bins.items():
            own = self.bins.setdefault(chrom, {})
            for b, chunks in bins.items():
                for begin, stop in chunks:
                    self._chunk(own.setdefault(b, []), begin + move, stop + move)
            mine, theirs = self.linear.setdefault(chrom, []), other.linear.get(chrom, [])
            mine += [0] * (len(theirs) - len(mine))
            for w, at in enumerate(theirs):
                if at and not mine[w]:
                    mine[w] = at + move

    def packed(self) -> bytes:
        """The index file: block-gzip itself."""
        names = list(self.bins)
        text = b"".join(n.encode() + b"\0" for n in names)
        out = [MAGIC, struct.pack("<8i", len(names), 0, *COLUMNS, ord("#"), 0, len(text)), text]
        for n in names:
            out.append(struct.pack("<i", len(self.bins[n])))
            for b, chunks in sorted(self.bins[n].items()):
                out.append(struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            filled, last = [], 0
            for at in self.linear[n]:
                last = at - 1 if at else last
                filled.append(last)
            out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        whole = b"".join(out)
        return b"".join(member(whole[i : i + MEMBER]) for i in range(0, len(whole), MEMBER)) + END

    @classmethod
    def parse(cls, data: bytes) -> Index:
        whole, at = b"", 0
        while at < len(data):
            size = member_size(data, at)
            whole += inflate(data, at, size)
            at += size
        if whole[:4] != MAGIC:
            raise ValueError("not a tabix index")
        n, *_, length = struct.unpack_from("<8i", whole, 4)
        names = whole[36 : 36 + length].split(b"\0")[:n]
        out, at = cls(), 36 + length
        for name in (x.decode() for x in names):
            bins: dict[int, list[tuple[int, int]]] = {}
            (count,) = struct.unpack_from("<i", whole, at)
            at += 4
            for _ in range(count):
                b, chunks = struct.unpack_from("<Ii", whole, at)
                flat = struct.unpack_from(f"<{2 * chunks}Q", whole, at + 8)
                bins[b] = list(zip(flat[::2], flat[1::2], strict=True))
                at += 8 + 16 * chunks
            (count,) = struct.unpack_from("<i", whole, at)
            out.bins[name] = bins
            out.linear[name] = [x + 1 for x in struct.unpack_from(f"<{count}Q", whole, at + 4)]
            at += 4 + 8 * count
        return out

    def chunks(self, chrom: str, lo: int, hi: int) -> list[tuple[int, int]]:
        """Stretches of virtual offsets that hold all records which meet the 0-based half-open range, in order."""
        bins, linear = self.bins.get(chrom), self.linear.get(chrom) or [1]
        if bins is None or hi <= lo:
            return []
        window = lo >> SHIFT
        least = linear[min(window, len(linear) - 1)] - 1
        found = sorted(c for b in bins_over(lo, hi) for c in bins.get(b, ()) if c[1] > least)
        out: list[tuple[int, int]] = []
        for begin, stop in found:
            begin = max(begin, least)
            if out and begin >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(out[-1][1], stop))
            else:
                out.append((begin, stop))
        return out

    def cuts(self, size: int) -> list[tuple[int, int | None]]:
        """The whole file in stretches of about `size` compressed bytes that begin with a record; the first with the file, the last (to None) ends it."""
        starts = sorted({at - 1 for own in self.linear.values() for at in own if at} | {c[0] for own in self.bins.values() for chunks in own.values() for c in chunks})
        edges = [0]
        for at in starts:
            if (at >> 16) - (edges[-1] >> 16) >= size:
                edges.append(at)
        return list(zip(edges, [*edges[1:], None], strict=True))


#: Compressed bytes of one request.
_AHEAD = 1 << 20


def lines_between(path: str, begin: int, stop: int | None):
    """(virtual offset, line) of the lines that begin in a stretch; members are read some at a time and only as far as the last line goes."""
    place, skip = begin >> 16, begin & 0xFFFF
    data, base, tail, tail_at = b"", place, b"", None
    end = None if stop is None else stop >> 16
    while True:
        at = place - base
        if len(data) - at < 18 or len(data) - at < member_size(data, at):
            want = _AHEAD if end is None or place > end else min(_AHEAD, max(end - place, 0) + (1 << 16))
            data, base, at = read_range(path, place, want, short=True), place, 0
            if not data:
                break
        size = member_size(data, at)
        text = inflate(data, at, size)
        pos, skip = skip, 0
        if tail_at is not None:
            cut = text.find(b"\n")
            if cut < 0:
                tail += text
                pos = len(text)
            else:
                yield tail_at, tail + text[:cut]
                pos, tail, tail_at = cut + 1, b"", None
        while pos < len(text):
            here = place << 16 | pos
            if stop is not None and here >= stop:
                return
            cut = text.find(b"\n", pos)
            if cut < 0:
                tail, tail_at = text[pos:], here
                break
            yield here, text[pos:cut]
            pos = cut + 1
        place += size
        if stop is not None and tail_at is None and place << 16 >= stop:
            return
    if tail_at is not None:
        yield tail_at, tail


def parted(lines: list[bytes], chroms: list[str], start: np.ndarray, end: np.ndarray) -> tuple[bytes, Index]:
    """Members that hold whole lines, as far as one fits, and their index from the part's own beginning."""
    index, out, place = Index(), [], 0
    begins, stops = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    at = 0
    while at < len(lines):
        size, to = len(lines[at]) + 1, at + 1
        while to < len(lines) and size + len(lines[to]) + 1 <= MEMBER:
            size += len(lines[to]) + 1
            to += 1
        text = b"".join(x + b"\n" for x in lines[at:to])
        pos = 0
        for i in range(at, to):
            begins[i] = place << 16 | pos
            pos += len(lines[i]) + 1
        for k in range(0, len(text), MEMBER):
            packed = member(text[k : k + MEMBER])
            out.append(packed)
            place += len(packed)
        stops[at:to] = np.append(begins[at + 1 : to], place << 16)
        at = to
    edges = [0, *(i for i in range(1, len(chroms)) if chroms[i] != chroms[i - 1]), len(chroms)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            index.add(chroms[a], start[a:b], end[a:b], begins[a:b], stops[a:b])
    return b"".join(out), index
