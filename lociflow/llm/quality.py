"""Quality rules: per-document statistics and cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

#: White space of the rules (fixed value): space and code points 9 to 13.
_RUN = r"[\x20\x09-\x0D]+"
#: Characters counted as symbols (fixed value).
SYMBOL = r"[#*$%&|<>]"
#: A line of a host is removed if more of its distinct documents hold it than both of these.
LEAST_DOCUMENTS, SHARE = 20, 0.02
#: A document is depleted if less than this part of its words is left.
LEFT = 0.5


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def up(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def down(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _RUN), lambda w: w != "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more.

    A window is one long: its hash above its position, with as many bits for
    positions as the text needs. Sorted, equal windows are neighbours, and
    neighbours of equal hash are compared word by word. Where two neighbours
    share a hash but not their words, which the fewer bits of a very long text
    make likelier, the windows are sorted by their words instead.
    """
    last = F.size(words) - 3

    def of(hashes: Column) -> Column:
        bits = F.ceil(F.log2(F.size(words) + 1)).cast("int")
        low = up(F.lit(1).cast("long"), bits) - 1
        packed = F.transform(F.sequence(F.lit(0), last), lambda i: up(F.xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]), bits).bitwiseOR(i.cast("long")))
        return let(F.sort_array(packed), lambda s: let(bits, lambda b: let(low, lambda m: doubles(s, b, m))))

    def alike(p: Column, q: Column) -> Column:
        return (words[p] == words[q]) & (words[p + 1] == words[q + 1]) & (words[p + 2] == words[q + 2])

    def doubles(s: Column, bits: Column, low: Column) -> Column:
        place = lambda j: s[j].bitwiseAND(low).cast("int")
        # of each window and the one before it: 1 if they are equal, 2 if only their hashes are
        kinds = F.transform(F.sequence(F.lit(1), last), lambda j: F.when(down(s[j], bits) != down(s[j - 1], bits), 0).when(alike(place(j), place(j - 1)), 1).otherwise(2))
        return let(
            kinds,
            lambda k: F.when(F.array_contains(k, 2), by_words())
            .when(F.array_contains(k, 1), covered(F.transform(both(k), place)))
            .otherwise(F.lit(0).cast("long")),
        )

    def both(kinds: Column) -> Column:
        """Which of the sorted windows equal a neighbour."""
        return F.filter(F.sequence(F.lit(0), last), lambda j: (F.get(kinds, j - 1) == 1) | (F.get(kinds, j) == 1))

    def by_words() -> Column:
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.slice(words, i + 1, F.lit(3)).alias("w"), i.alias("i"))))
        return let(windows, lambda s: let(F.transform(F.sequence(F.lit(1), last), lambda j: (s[j]["w"] == s[j - 1]["w"]).cast("int")), lambda k: covered(F.transform(both(k), lambda j: s[j]["i"]))))

    def covered(places: Column) -> Column:
        return let(
            F.sort_array(places),
            lambda p: F.when(
                F.size(p) > 0,
                F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3).cast("long"), lambda n, x: n + x),
            ).otherwise(F.lit(0).cast("long")),
        )

    return F.when(last > 0, let(F.transform(words, lambda w: F.xxhash64(w)), of)).otherwise(F.lit(0).cast("long"))


def base_rules(text: Column) -> Column:
    """The statistics of one text as a struct."""
    lines = F.filter(F.split(text, "\n"), has_word)
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    return F.struct(
        counts.alias("c"),
        (F.size(F.split(text, SYMBOL)) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.when(line.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(line, _RUN, " ")).otherwise(line)))


def document_number(text: Column) -> Column:
    """Sixty bits of a text's checksum, the same in SQL."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def apply_rules(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, share: float = SHARE, left: float = LEFT, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Statistics, the verdict and the cleaned text of every row.

    Lines are compared without case and with runs of white space as one space.
    A line is removed where more than least_documents and more than `share` of
    its host's distinct documents hold it; a document of which there are copies
    counts once, and the host's first document with the line keeps it: that of the
    smallest doc_id, rows without one coming last, then of the smallest checksum
    of its text. The text is what the other lines, blank ones too, give when joined
    again. A document of which less than `left` of the words are left is
    depleted. A null text has no words; a null host is a host of its own;
    repeated rows get the same verdict each; an empty table gives no rows.

    Each line is counted by its 64-bit hash with sixty bits of the document's, first by
    (host, line, document) and then by (host, line), so that no line's documents
    meet in one task before they are one row a task. A caller that doesn't read
    the cleaned text shuffles no text.

    Returns doc_id, row_key (hash of doc_id, host and text), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, text (cleaned; the statistics are of
    the whole text), removed_words, base_failed, kept.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(F.col(doc_id), F.col(host), body)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("host"), body.alias("text"), document_number(body).alias("document"), key.alias("row_key"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "document")
    lines = rows.select(rank.alias("rank"), "host", "document", "row_key", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(has_word(F.col("line"))).select(
        "rank", "host", "document", "row_key", "at", F.size(words_of(F.col("line"))).alias("words"), F.xxhash64(normal_line(F.col("line"))).alias("line")
    )
    held = lines.groupBy("host", "line", "document").agg(F.min("rank").alias("first"))
    often = held.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") > least_documents)
    hosts = rows.groupBy("host", "document").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("documents"))
    limits = often.join(hosts, "host").where(F.col("n") > F.col("documents") * share).select("host", "line", "first")
    gone = (
        lines.join(limits, ["host", "line"])
        .where(F.col("rank") != F.col("first"))
        .groupBy("row_key")
        .agg(F.collect_set(F.struct("at", "words")).alias("gone"))
    )
    told = rows.select("doc_id", "row_key", "text", base_rules(F.col("text")).alias("b")).select(
        "doc_id", "row_key", "text", "b.c.n_words", "b.c.word_chars", "b.n_symbols", "b.n_dup_lines", "b.c.n_repeat_words"
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    cleaned = F.array_join(F.filter(F.split("text", "\n"), lambda x, at: ~F.array_contains("gone.at", at)), "\n")
    return (
        told.join(gone, "row_key", "left")
        .withColumn("text", F.when(F.col("gone").isNotNull(), cleaned).otherwise(F.col("text")))
        .withColumn("removed_words", F.when(F.col("gone").isNotNull(), F.aggregate("gone.words", F.lit(0).cast("long"), lambda n, x: n + x)).otherwise(F.lit(0).cast("long")))
        .drop("gone")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~(F.col("n_words") - F.col("removed_words") < left * F.col("n_words")))
    )


def op3_quality(spark, sf_dir):
    got = apply_rules(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text,
  {'none': doc_id IS NULL, 'id': coalesce(doc_id, 0), 'document': ('0x' || md5(coalesce(text, ''))[:15])::BIGINT} AS rank FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, rank, host, text, line FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ln AS (SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
lim AS (SELECT host, norm, min(rank) AS first FROM ln JOIN (SELECT host, count(DISTINCT text) AS documents FROM d GROUP BY host) USING (host)
  GROUP BY host, norm, documents HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > documents * 0.02),
gone AS (SELECT r, sum(words) AS n FROM ln JOIN lim USING (host, norm) WHERE rank <> first GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_words - removed_words < 0.5 * n_words) AS kept FROM s
"""
