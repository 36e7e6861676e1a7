"""Byte-pair encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import functools
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, read

#: Distinct words, and pairs of tokens, that a Python worker remembers.
WORDS, PAIRS = 400_000, 1_000_000
#: How the word vocabulary splits a normalised text (fixed value).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_END = "\0"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Bpe:
    """A vocabulary with ordered merges and, if it has one, a mark for the end of a word.

    The encoding of a word ends in one certain token for every prefix of it.
    For each end position the tokens that end there come from an automaton over
    the vocabulary whose suffix links lead from a match to the shorter ones; a
    token is the last one of the prefix if the last token before it is
    compatible with it, that is, if the merges of the two side by side never
    cross the border. Back-pointers then give the word's ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.path = path
        # other files' texts all go through the library's normaliser and splitter
        splits = [p.get("pattern", {}).get("Regex") for p in (whole["pre_tokenizer"] or {}).get("pretokenizers", [])]
        steps = [n["type"] for n in (whole["normalizer"] or {}).get("normalizers", [])]
        self.plain = splits == [WORD.pattern, None] and steps == ["NFC", "Replace", "Lowercase"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # rank and halves of each token that a merge makes; the earliest merge of a pair holds
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            made.setdefault(both, (r, a, b))
        self.made = made
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.symbols = byte_symbols()
        self.texts = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        self.automaton = ahocorasick.Automaton()
        self.edges: dict[int, tuple] = {}
        for token, i in vocab.items():
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            self.texts[i] = token
            if len(body) == 1 or i in made and self.compatible_until(made[i][1], made[i][2], made[i][0]):
                self.automaton.add_word(body + _END * ends, (i, len(body) + ends))
        for t, i in self.special.items():
            self.texts[i] = t
        self.automaton.make_automaton()

    @functools.cached_property
    def lib(self):
        """The library's normaliser and splitter, for unusual characters only; loaded when first needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _right(self, token: int) -> list[tuple[int, float]]:
        """The tokens at the right border of one, as they follow each other, and the rank that ends each."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.made:
                return out
            ends, _, token = self.made[token]

    def _left(self, token: int) -> list[tuple[int, float]]:
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.made:
                return out
            ends, token, _ = self.made[token]

    def edge(self, token: int) -> tuple:
        got = self.edges.get(token)
        if got is None:
            got = self.edges[token] = (self._right(token)[::-1], self._left(token)[::-1])
        return got

    def compatible_until(self, a: int, b: int, rank: float) -> bool:
        """Whether no merge of a rank below this one crosses the border between a and b."""
        right, left = self.edge(a)[0], self.edge(b)[1]
        i = j = 0
        while True:
            x, x_ends = right[i]
            y, y_ends = left[j]
            m = self.rank.get((x, y))
            # equal pairs merge from the left, so a merge inside a goes before one across the border, which goes before one inside b
            if m is not None and m < rank and m < x_ends and m <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def word(self, text: str) -> list[int]:
        """Ids of one word, given as byte symbols."""
        full = text + _END if self.suffix else text
        n = len(full)
        last: list[int] = [-1] * (n + 1)
        back = [0] * (n + 1)
        pair_of = self.pairs.get
        for at, (token, size) in self.automaton.iter(full):
            if last[at + 1] >= 0:
                continue
            start = at + 1 - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pair_of((before, token))
                if ok is None:
                    ok = self.pairs[before, token] = self.compatible_until(before, token, float("inf"))
                if not ok:
                    continue
            last[at + 1], back[at + 1] = token, start
        ids, at = [], n
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"the vocabulary can't spell {text!r}")
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _learn(self, run: str) -> bytes:
        """Ids of a run without white space, which is one word or several."""
        s, words = self.symbols, self.words
        out = b""
        for w in WORD.findall(run):
            got = words.get(w)
            if got is None:
                got = words[w] = self.spelt("".join([s[b] for b in w.encode()]))
            out += got
        self.known[run] = out
        return out

    def spelt(self, symbols: str) -> bytes:
        return array("I", self.word(symbols)).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if len(self.known) > WORDS:
            self.known.clear()
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known, learn, out = self.known, self._learn, []
        known_of = known.get
        for part in self.split_special.split(text) if any(t in text for t in self.special) else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif self.plain and (part.isascii() and not _CONTROL.search(part) or _PLAIN.fullmatch(part)):
                out += [known_of(w) or learn(w) for w in part.lower().split()]
            else:
                lib = self.lib
                out += [self.spelt(w) for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(part) if lib.normalizer else part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids as the library gives it where the file names no decoder: tokens joined by spaces."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Characters that Python and the library normalise and split alike; other texts are normalised and split by the library.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa0-\u024f\u2013\u2014\u2018-\u201d\u2022\u2026]*")
#: ASCII that they do not: to Python, some of these separate words.
_CONTROL = regex.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def loaded(path: str) -> Bpe:
    return held(("bpe", path), lambda: Bpe(path))


def tokenised(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every row's whole text and decodes the ids again, as the tokenizers library does.

    A null text counts as empty: no tokens and an empty text. The strings of special tokens are special tokens. Rows are independent, so
    repeated rows and an empty table need no care; other columns are ignored.
    A worker keeps at most WORDS words and PAIRS pairs.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.
    """

    def run(batches):
        bpe = loaded(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.slice(at, 1000)
                ids = [bpe.encode(t or "") for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def encode_decode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of tokenised(): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    got = tokenised(docs, vocabulary, doc_id, text)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark, sf_dir):
    import public_tokenizers

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
