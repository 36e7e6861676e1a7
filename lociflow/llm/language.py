"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, read, trimmed

#: The bound of the sample that the automata are made from: texts a language that are looked at, shorter ones than
#: the second number first, and UTF-8 bytes of whole texts that are learned.
TEXTS, SHORT, BYTES = 64, 2048, 16_384
#: The most labels that are learned, those of most labelled rows.
LANGUAGES = 512
#: Symbols of a lane; lanes that step together; entries of a table that is spread out at a time.
LANE, LANES, ENTRIES = 512, 1024, 1 << 24
_FOREIGN, _SPACE, _PAD = 0, 1, 2
_BREAK = 1 << 30


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    tip = 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        longest.append(longest[tip] + 1)
        link.append(0)
        at = tip
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if longest[to] != longest[at] + 1:
                copy = len(moves)
                moves.append(dict(moves[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                link[to] = copy
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
                to = copy
            link[new] = to
        tip = new
    return moves


class Alphabet:
    """UTF-8 bytes of the labelled texts' letters; all that is not a letter is one space, and other bytes of letters are foreign."""

    letters: np.ndarray | None = None

    def __init__(self, texts: list[str]):
        cls = type(self)
        if cls.letters is None:
            cls.letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
            cls.ascii = bytes(c if cls.letters[c] else 32 for c in range(128)) + bytes(range(128, 256))
        known = sorted(set(b"".join(map(self._raw, texts))) - {32})
        self.size = len(known) + 3
        self.of = np.full(256, _FOREIGN, np.int32)
        self.of[32] = _SPACE
        self.of[known] = np.arange(3, self.size)

    def _raw(self, text: str) -> bytes:
        if text.isascii():
            return text.encode().translate(self.ascii)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(self.letters[code], code, 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """The text's symbols, runs of spaces as one; whether it holds a letter."""
        s = self.of[np.frombuffer(self._raw(text), np.uint8)]
        space = s == _SPACE
        keep = ~space
        keep[1:] |= ~space[:-1]
        return s[keep], not space.all()


class Moves:
    """An automaton's transitions as three arrays (from, symbol, to), the root's moves, and its number of states: some ten bytes a transition."""

    def __init__(self, text: np.ndarray):
        moves = suffix_automaton(text.tolist())
        self.states = len(moves)
        size = [len(m) for m in moves]
        self.at = np.repeat(np.arange(self.states, dtype=np.int32), size)
        self.symbol = np.fromiter((c for m in moves for c in m), np.int16, len(self.at))
        self.to = np.fromiter((t for m in moves for t in m.values()), np.int32, len(self.at))
        inside = self.symbol != _FOREIGN  # no match goes across the end of a labelled text
        self.at, self.symbol, self.to = self.at[inside], self.symbol[inside], self.to[inside]

    def table(self, width: int) -> np.ndarray:
        """Rows of states; missing moves lead on from the root and are marked. The last row is before the first phrase, and after a letter that no phrase holds."""
        dead = self.states
        root = np.full(width, dead, np.int32)
        first = self.at == 0
        root[self.symbol[first]] = self.to[first]
        out = np.tile(root | _BREAK, (dead + 1, 1))
        out[self.at, self.symbol] = self.to
        out[:, _PAD] = np.arange(dead + 1)
        return out


class CrossParser:
    """Counts the phrases in which each language's automaton reads a text.

    A phrase is the longest match that starts where the one before it ended, or
    one byte of a letter that the automaton doesn't know. An automaton becomes a
    table whose missing moves lead on from the root and carry a mark that counts
    a phrase, so that many lanes of text step together. A table has a column
    for each byte that letters of the samples hold. Languages are parsed in
    groups whose tables have ENTRIES entries at most; where one group is not
    enough, automata are kept as lists of transitions and spread out by turns.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        lowered = {lang: [t.lower() for t in samples[lang]] for lang in self.langs}
        self.alphabet = Alphabet([t for texts in lowered.values() for t in texts])
        self.moves, sizes = [], []
        for lang in self.langs:
            text = np.concatenate([np.zeros(0, np.int32), *(np.append(self.alphabet.symbols(t)[0], _FOREIGN) for t in lowered[lang])])
            sizes.append(len(text))
            self.moves.append(Moves(text))
        #: First language of each group, and one beyond the last.
        self.groups, held = [0], 0
        for i, m in enumerate(self.moves):
            own = (m.states + 1) * self.alphabet.size
            if held and held + own > ENTRIES:
                self.groups.append(i)
                held = 0
            held += own
        self.groups.append(len(self.langs))
        self.spread = None
        #: A phrase of a larger sample says where it stands in more bits.
        self.bits = np.log2(np.array(sizes, np.float64) + 2)

    def _spread(self, group: int) -> None:
        """Lays out the tables of a group one after another."""
        if self.spread == group:
            return
        self.table = None
        a, states, tables, self.roots = self.alphabet.size, 0, [], []
        for m in self.moves[self.groups[group] : self.groups[group + 1]]:
            own = m.table(a)
            mark = own & np.int32(_BREAK)
            own ^= mark
            own += np.int32(states)
            own *= np.int32(a)
            own |= mark
            tables.append(own)
            self.roots.append((states + m.states) * a)
            states += m.states + 1
        self.table, self.spread = np.concatenate([np.zeros((0, a), np.int32), *tables]).ravel(), group

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        """Phrases of each whole row (rows x languages).

        Long rows are parsed in lanes side by side, each as if a phrase began
        with it. Lanes are then parsed again from the state in which the lane
        before ended, up to where both ways meet (longest matches soon end at
        the same place), so the counts are those of one pass over the row.
        """
        out = np.zeros((len(rows), len(self.langs)), np.int64)
        if not self.langs:
            return out
        by_size = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        lanes = [(i, rows[i][at : at + LANE]) for i in by_size for at in range(0, len(rows[i]), LANE)]
        for group, (first, last) in enumerate(zip(self.groups[:-1], self.groups[1:], strict=True)):
            self._spread(group)
            carried = None
            for at in range(0, len(lanes), LANES):
                some = lanes[at : at + LANES]
                owner = np.array([i for i, _ in some])
                goes_on = at > 0 and lanes[at - 1][0] == owner[0]
                count, carried = self._lanes([r for _, r in some], owner, carried if goes_on else None)
                np.add.at(out[:, first:last], owner, count.T)
        return out

    def _lanes(self, some: list[np.ndarray], owner: np.ndarray, carried: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each lane (languages x lanes), and the last lane's states. carried: states before the first lane."""
        width, n = max(map(len, some)), len(some)
        grid = np.full((width, n), _PAD, np.int32)
        for j, r in enumerate(some):
            grid[: len(r), j] = r
        start = np.repeat(np.array(self.roots, np.int32)[:, None], n, axis=1)
        if carried is not None:
            start[:, 0] = carried
        reached = np.empty((width, *start.shape), np.int32)
        ended = np.empty((width, *start.shape), np.uint8)
        state = start.copy()
        for t in range(width):
            state += grid[t]
            step = self.table[state]
            np.right_shift(step, 30, out=ended[t], casting="unsafe")
            state = np.bitwise_and(step, _BREAK - 1, out=reached[t]).copy()
        follows = np.concatenate([[False], owner[1:] == owner[:-1]])
        lang, lane = np.nonzero(follows[None, :] & (np.roll(reached[-1], 1, axis=1) != start))
        while len(lane):
            now = reached[-1][lang, lane - 1]
            start[lang, lane] = now
            le, la = lang, lane
            for t in range(width):
                step = self.table[now + grid[t, la]]
                now = step & (_BREAK - 1)
                apart = now != reached[t, le, la]
                ended[t, le, la] = step >> 30
                reached[t, le, la] = now
                if not apart.all():
                    le, la, now = le[apart], la[apart], now[apart]
                    if not len(la):
                        break
            # lanes that never met the first parse end elsewhere, so the next ones start elsewhere
            more = (la + 1 < n) & follows[np.minimum(la + 1, n - 1)]
            lang, lane = le[more], la[more] + 1
            moved = reached[-1][lang, lane - 1] != start[lang, lane]
            lang, lane = lang[moved], lane[moved]
        return ended.sum(axis=0, dtype=np.int64), reached[-1][:, -1].copy()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language or und, score, phrases a symbol of the best language) of each text."""
        read_as = [self.alphabet.symbols((t or "").lower()) for t in texts]
        out = []
        for (row, has_letter), n in zip(read_as, self.phrases([r for r, _ in read_as]), strict=True):
            if not has_letter or not len(n):
                out.append(("und", 0.0, 1.0))
                continue
            bits = n * self.bits
            order = np.argsort(bits, kind="stable")
            best = bits[order[0]]
            other = bits[order[1]] if len(n) > 1 else (len(row) + 1) * self.bits[0]
            out.append((self.langs[order[0]], float(other / (best + other)), float(n[order[0]] / len(row))))
        return out


def parser_of(samples: dict[str, list[str]]) -> CrossParser:
    key = hash(tuple((k, tuple(v)) for k, v in sorted(samples.items())))
    return held(("language", key), lambda: CrossParser(samples))


def labelled_sample(labelled: DataFrame, doc_id: str, text: str, lang: str, texts: int = TEXTS, short: int = SHORT, size: int = BYTES, languages: int = LANGUAGES) -> dict[str, list[str]]:
    """For each language (of at most `languages`, those of most labelled rows, then by name) whole texts of at most `size` UTF-8 bytes in all, from the `texts` rows that come first: those of up to `short` characters, then by a hash.

    A text that does not fit into what is left is passed over; where not even one fits, the first is cut.
    """
    h = F.xxhash64(F.col(doc_id), F.col(text))
    first = Window.partitionBy("lang").orderBy("long", "h", "text")
    usable = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    known = [r["lang"] for r in usable.groupBy(F.col(lang).alias("lang")).count().orderBy(F.col("count").desc(), "lang").limit(languages).collect()]
    rows = (
        usable.where(F.col(lang).isin(known))
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"), (F.length(text) > short).alias("long"))
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= texts)
        .select("lang", "n", F.substring("text", 1, size + 1).alias("text"))  # more characters than bytes: too long to be learned whole
        .orderBy("lang", "n")
        .collect()
    )
    out: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for r in rows:
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if n <= left.setdefault(r["lang"], size):
            out.setdefault(r["lang"], []).append(r["text"])
            left[r["lang"]] -= n
    for r in rows:
        if r["lang"] not in out:
            out[r["lang"]] = [r["text"].encode("utf-8", "surrogatepass")[:size].decode("utf-8", "ignore")]
    return out


def identify(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with lang_pred, score and phrase_rate.

    Learns from labelled (a sample of whole texts of BYTES bytes a language; the
    only thing sent to the driver and to the tasks). The language wins that
    needs the fewest phrases, each weighed by the bits that say where in the
    language's sample it stands. A text that is null or has
    no letter is `und` with score 0, as is every text where nothing is labelled.
    Equal sums go to the language that sorts first. score: the second-best
    sum over the sum of the best two, from 0.5 (tie) towards 1. docs' own
    columns stay, but columns of those three names are replaced; rows are
    independent, so repeated rows and empty tables need no care.
    """
    samples = labelled_sample(labelled, doc_id, text, lang)
    kept = docs.drop("lang_pred", "score", "phrase_rate")
    schema = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "phrase_rate": F.lit(0.0)}).schema
    at = [f.lower() for f in kept.columns].index(text.lower())

    def run(batches):
        parser = parser_of(samples)
        for whole in batches:
            for k in range(0, len(whole), 1024):
                batch = whole.slice(k, 1024)
                lang_pred, score, rate = zip(*parser.predict(batch.column(at).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang_pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=schema.names)

    return kept.mapInArrow(trimmed(run), schema)


def held_out(doc_id):
    """Rows that no classifier here learns from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op9_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = identify(docs.select("doc_id", "text"), docs.where(~held_out(F.col("doc_id"))))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
