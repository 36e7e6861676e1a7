"""First-fit packing of intervals into rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Padding where none is asked for (fixed value).
PADDING = 100


class Rows:
    """Rows that intervals are put into in the order of their starts: each into the lowest whose last end is not beyond its start.

    A tree over the rows keeps the least end below each node, so the lowest row
    that is free is found in as many steps as the tree is deep.
    """

    _FREE = float("-inf")  # of rows that are not open yet

    def __init__(self, rows=(), ends=()):
        """rows, ends: those that are taken already."""
        self.leaves = 1
        while self.leaves <= max(rows, default=0):
            self.leaves *= 2
        self.least = [self._FREE] * (2 * self.leaves)
        for r, e in zip(rows, ends, strict=True):
            self.least[self.leaves + r] = e
        self._sum_up()

    def _sum_up(self) -> None:
        for node in range(self.leaves - 1, 0, -1):
            self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])

    def put(self, start, end) -> int:
        if self.least[1] > start:
            ends, self.leaves = self.least[self.leaves :] + [self._FREE] * self.leaves, 2 * self.leaves
            self.least = [self._FREE] * self.leaves + ends
            self._sum_up()
        least, leaves, node = self.least, self.leaves, 1
        while node < leaves:
            node *= 2
            if least[node] > start:
                node += 1
        found = node - leaves
        least[node] = end
        while node > 1:
            node >>= 1
            least[node] = min(least[2 * node], least[2 * node + 1])
        return found

    def taken(self, at) -> tuple[list[int], list[int]]:
        """The rows that are not free at a position, and their ends."""
        held = [(r, e) for r, e in enumerate(self.least[self.leaves :]) if e > at]
        return [r for r, _ in held], [e for _, e in held]


def first_fit(starts, ends) -> list[int]:
    """Row of each interval, in the given order: the lowest row whose last end is not beyond its start."""
    rows = Rows()
    return [rows.put(s, e) for s, e in zip(starts, ends, strict=True)]


def pack_rows(df: DataFrame, keys: list[str], id: str = "id", start: str = "start", end: str = "end", padding: int = PADDING, pieces: int | None = None) -> DataFrame:
    """(keys, id, row): the lowest row in which each padded interval fits, in the order of padded start, padded end and id.

    Intervals are cut into pieces by ranges of that order, so that a line that
    holds very many, or a position at which very many start, is several pieces.
    What a piece needs of the one before, if that ends in the same line, is which
    rows are taken where it ends. Pieces are packed as if nothing were taken,
    then again those for which something else was, until no piece leaves other
    rows taken than before: packing tends to the same rows whatever it begins
    with, as rows fall free, so that is few rounds; each touches fewer pieces,
    and none more than the pieces of a line. Then all are packed once for their
    rows. An id that comes more than once gets the row of its last interval.
    """
    from ..sources.folders import scratch

    spark = df.sparkSession
    pad = padding if padding > 0 else PADDING
    own = keys or ["__line"]
    laid = (df if keys else df.withColumn("__line", F.lit(0))).select(*own, F.col(id).cast("string").alias("id"), (F.col(start) - pad).cast("bigint").alias("ls"), (F.col(end) + pad).cast("bigint").alias("le"))
    folder = scratch(spark, "pack")
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid.repartitionByRange(n, *own, "ls", "le", "id").withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/laid")
    kept = spark.read.parquet(f"{folder}/laid")
    fields = ", ".join(f"`{k}` {laid.schema[k].dataType.simpleString()}" for k in own)
    state = "part int, rows array<int>, ends array<bigint>"

    def lines(pdf: pd.DataFrame):
        """A piece's intervals in order, and where each line begins."""
        pdf = pdf.sort_values([*own, "ls", "le", "id"], ignore_index=True, na_position="first")
        edge = np.zeros(len(pdf), bool)
        for c in own:
            code = pd.factorize(pdf[c], use_na_sentinel=True)[0]
            edge[1:] |= code[1:] != code[:-1]
        return pdf, [0, *np.flatnonzero(edge).tolist(), len(pdf)]

    def begun(begin: pd.DataFrame) -> Rows:
        return Rows(*(([int(x) for x in begin[c].iloc[0]]) for c in ("rows", "ends"))) if len(begin) and begin["rows"].iloc[0] is not None else Rows()

    def leave(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"part": [], "rows": [], "ends": []})
        pdf, cuts = lines(pdf)
        rows = begun(begin) if len(cuts) == 2 else Rows()
        last = pdf.iloc[cuts[-2] :]
        for s, e in zip(last["ls"].tolist(), last["le"].tolist(), strict=True):
            rows.put(s, e)
        taken, ends = rows.taken(last["ls"].iloc[-1])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "rows": [taken], "ends": [ends]})

    def pack(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in [*own, "id", "row", "ls", "le"]})
        pdf, cuts = lines(pdf)
        starts, ends, out = pdf["ls"].tolist(), pdf["le"].tolist(), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = begun(begin) if a == 0 else Rows()
            out += [rows.put(s, e) for s, e in zip(starts[a:b], ends[a:b], strict=True)]
        return pdf.assign(row=pd.Series(out, dtype="int32"))[[*own, "id", "row", "ls", "le"]]

    # a row a piece, which is what the driver sees: its number, first and last line
    line = F.struct(*own)
    edges = kept.groupBy("part").agg(F.min(line).alias("first"), F.max(line).alias("last")).orderBy("part").collect()
    follows = {b["part"]: a["part"] for a, b in zip(edges, edges[1:], strict=False) if a["last"] == b["first"]}
    alone = {e["part"] for e in edges if e["first"] == e["last"]}
    before = spark.createDataFrame(list(follows.items()), "part int, before int")
    begins = states = spark.createDataFrame([], state)
    todo, turn = sorted(set(follows.values())), 0
    while todo:
        # the states that these pieces leave, and what their followers begin with then
        own_begins = begins.where(F.col("part").isin(todo)).groupBy("part")
        made = kept.where(F.col("part").isin(todo)).groupBy("part").cogroup(own_begins).applyInPandas(leave, state)
        made.unionByName(states.where(~F.col("part").isin(todo))).write.parquet(f"{folder}/states-{turn}")
        states = spark.read.parquet(f"{folder}/states-{turn}")
        new = states.withColumnRenamed("part", "before").join(before, "before").select("part", "rows", "ends")
        old = begins.select("part", F.col("rows").alias("old_rows"), F.col("ends").alias("old_ends"))
        same = [F.coalesce(f"old_{c}", F.array().cast(t)) == F.col(c) for c, t in (("rows", "array<int>"), ("ends", "array<bigint>"))]
        # only a piece of one line that others follow leaves something else then
        matters = sorted(alone & set(follows) & set(follows.values()))
        todo = [r["part"] for r in new.where(F.col("part").isin(matters)).join(old, "part", "left").where(~(same[0] & same[1])).select("part").collect()] if matters else []
        begins, turn = new, turn + 1
    packed = kept.groupBy("part").cogroup(begins.groupBy("part")).applyInPandas(pack, f"{fields}, id string, row int, ls bigint, le bigint")
    return packed.groupBy(*own, "id").agg(F.max(F.struct("ls", "le", "row")).alias("last")).select(*keys, "id", F.col("last.row").alias("row"))


def in_order(df: DataFrame, keys: list[str], order: str, id: str = "id", start: str = "start", end: str = "end", padding: int = PADDING, pieces: int | None = None) -> DataFrame:
    """(keys, order, id, row, total_rows): each interval's row in pack_rows, to be read in the input's order, and how many rows its keys need."""
    packed = pack_rows(df, keys, id, start, end, padding, pieces)
    totals = total_rows(packed, keys)
    placed = df.select(*keys, order, F.col(id).cast("string").alias("id")).join(packed, [*keys, "id"])
    if keys:
        return placed.join(totals, keys)
    return placed.withColumn("__all", F.lit(0)).join(F.broadcast(totals.withColumn("__all", F.lit(0))), "__all").drop("__all")  # one row


def total_rows(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.groupBy(*keys).agg((F.max("row") + 1).alias("total_rows"))
