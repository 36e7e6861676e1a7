"""A cache of ranges: what was fetched is kept as segments, and only what is missing is fetched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, signal

_COVERAGE = "key string, start bigint, end bigint, at bigint"


class RangeCache:
    """Segments and coverage as append-only Parquet under a folder.

    A range's rows are written before its coverage, so a fetch that fails leaves
    nothing that counts. Rows at the seam of two fetches come twice and are
    dropped by value on reading, which gives what an empty cache gives.
    most: keys kept; the least recently used go first.
    """

    def __init__(self, spark: SparkSession, path: str, schema, most: int = 250):
        self.spark, self.path, self.schema, self.most = spark, path.rstrip("/"), schema, most
        self.clock = 0
        self.used: dict[str, int] = {}

    def _table(self, name: str, schema) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def coverage(self) -> DataFrame:
        return self._table("coverage", _COVERAGE).where(F.col("key").isin(list(self.used)))

    def missing(self, key: str, start: int, end: int) -> list[tuple[int, int]]:
        """The parts of a range that are not kept. Sent to the driver: the gaps of one request."""
        asked = self.spark.createDataFrame([(0, key, start, end)], "request int, key string, start bigint, end bigint")
        return [(r["start"], r["end"]) for r in intervals.remainder(asked, self.coverage(), ["key"], "request").orderBy("start").collect()]

    def read(self, key: str, chrom: str, start: int, end: int, fetch: Callable[[int, int], DataFrame]) -> DataFrame:
        """Records that begin in the range, fetching what is missing. fetch gives the records that overlap or touch a range."""
        self.clock += 1
        self.used[key] = self.clock
        while len(self.used) > self.most:
            self.used.pop(min(self.used, key=self.used.get))
        for lo, hi in self.missing(key, start, end):
            rows = fetch(lo, hi).withColumn("key", F.lit(key))
            rows.write.mode("append").partitionBy("key").parquet(f"{self.path}/segments")
            self.spark.createDataFrame([(key, lo, hi, self.clock)], _COVERAGE).write.mode("append").parquet(f"{self.path}/coverage")
        kept = self._table("segments", f"{self.schema}, key string").where(F.col("key") == key).drop("key")
        return signal.region(kept, chrom, start, end).dropDuplicates()

    def forget(self, key: str) -> None:
        self.used.pop(key, None)

    def stats(self, rows: DataFrame | None = None) -> DataFrame:
        kept = self._table("segments", f"{self.schema}, key string").where(F.col("key").isin(list(self.used))) if rows is None else rows
        return cache_stats(self.coverage().join(kept.groupBy("key").agg(F.count("*").alias("rows")), "key", "left"))


#: Bytes that a key, a range and a record of fixed size count for (fixed values).
KEY_BYTES, RANGE_BYTES, LIST_BYTES, ROW_BYTES = 16, 40, 24, 32


def cache_stats(ranges: DataFrame) -> DataFrame:
    """Entries and approximate bytes of each key and of all (key null), from (key, start, end, rows)."""
    each = ranges.groupBy("key").agg(F.count("*").alias("ranges"), F.coalesce(F.max("rows"), F.lit(0)).alias("rows"))
    size = F.octet_length("key") + KEY_BYTES + LIST_BYTES + F.col("ranges") * RANGE_BYTES + F.col("rows") * ROW_BYTES
    sized = each.withColumn("bytes", size.cast("bigint"))
    return sized.rollup("key").agg(F.count("*").alias("entries"), F.sum("ranges").alias("ranges"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
