"""Byte-balanced sharding by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts, pieces_of, read, utf8

#: Groups that one task combines, and partial partitions that one task combines.
GROUPS, FAN = 20_000, 2_000


def difference(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines m partial partitions of k parts into one.

    start: m rows of k sums. The two rows with the largest spread are added in
    opposite order until one is left. Returns where each part of each row went
    (m x k), and the k sums of the last row.
    """
    m, k = start.shape
    first = np.argsort(-start, axis=1, kind="stable")
    sums = list(np.take_along_axis(start, first, axis=1))
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        sums.append(both)
        joined.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sums) - 1))
    goes: list = [None] * len(sums)
    goes[-1] = np.arange(k)
    for node in range(len(sums) - 1, m - 1, -1):
        a, b, order = joined[node - m]
        to = goes[node]
        goes[node] = None
        goes[a], goes[b] = np.empty(k, int), np.empty(k, int)
        goes[a][order], goes[b][k - 1 - order] = to, to
    out = np.empty((m, k), int)
    np.put_along_axis(out, first, np.array(goes[:m]), axis=1)
    return out, sums[-1]


def _place_groups(k: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        start = np.zeros((len(pdf), k), np.int64)
        start[:, 0] = pdf["bytes"]
        goes, _ = difference(start)
        return pdf.assign(part=goes[:, 0].astype("int32"))[["key", "unit", "part", "bytes"]]

    return place


def _combine_units(k: int):
    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        units, row = np.unique(pdf["unit"].to_numpy(), return_inverse=True)
        start = np.zeros((len(units), k), np.int64)
        start[row, pdf["part"].to_numpy()] = pdf["bytes"].to_numpy()
        goes, _ = difference(start)
        return pd.DataFrame({"unit": pdf["unit"], "part": pdf["part"], "bytes": pdf["bytes"], "above": pdf["unit"] // FAN, "above_part": goes[row, pdf["part"].to_numpy()].astype("int32")})

    return combine


def shard(docs: DataFrame, n_shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row in one of n_shards so that their bytes are as near equal as whole groups allow.

    Rows with equal texts are one group and stay together. Groups are dealt
    into units of about GROUPS by a hash of their text; each unit is differenced
    into one partial partition of n_shards parts, and these are differenced in
    turn, FAN at a time, until one is left. No task holds more than GROUPS
    groups (expected) or FAN partial partitions, however many rows there are.

    A null text has the size of an empty one, and is equal to no text but that
    of rows of the same doc_id. Repeated rows stay rows. An empty table gives an
    empty result. Other columns of docs are ignored.

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32, law ("bytes"), shard,
    slot (gapless from 0 in a shard), grown_shard (null).
    """
    spark = docs.sparkSession
    disk = Scratch(spark, "shard")
    body = F.col(text)
    n = docs.count()
    keyed = disk.write(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(F.coalesce(body, F.lit(""))).cast("long") + 8).alias("size"),
            F.crc32(utf8(body)).alias("text_crc32"),
            F.unhex(F.coalesce(F.sha2(body, 256), F.sha2(F.concat(F.lit("null "), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 224))).alias("key"),
        ),
        "keyed",
    )
    units = pieces_of(n, GROUPS)
    groups = keyed.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("unit", F.pmod(F.xxhash64("key"), F.lit(units)))
    placed = disk.write(groups.groupBy("unit").applyInPandas(_place_groups(n_shards), "key binary, unit long, part int, bytes long"), "placed")

    sums = placed.groupBy("unit", "part").agg(F.sum("bytes").alias("bytes"))
    where = placed.select("key", "unit", "part")
    level = 0
    while True:
        step = disk.write(sums.groupBy(F.floor(F.col("unit") / FAN).alias("over")).applyInPandas(_combine_units(n_shards), "unit long, part int, bytes long, above long, above_part int"), f"level{level}")
        where = where.join(step.select("unit", "part", "above", "above_part"), ["unit", "part"]).select("key", F.col("above").alias("unit"), F.col("above_part").alias("part"))
        units = pieces_of(units, FAN)
        if units == 1:
            break
        sums = step.groupBy(F.col("above").alias("unit"), F.col("above_part").alias("part")).agg(F.sum("bytes").alias("bytes"))
        level += 1

    deals = 4 * pieces_of(n, n_shards * 50_000)
    dealt = disk.write(
        keyed.join(where, "key").select("doc_id", "size", "text_crc32", F.col("part").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(deals)).alias("deal")), "dealt"
    )
    disk.drop("keyed")
    disk.drop("placed")
    before = Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "deal").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "deal").orderBy("doc_id", "text_crc32")) - 1
    return (
        dealt.withColumn("rank", rank)
        .join(offsets, ["shard", "deal"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op8_sharding(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents"))
