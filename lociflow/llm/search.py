"""Exact top-k inner-product search by pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces_of, read

#: Pivots; rows among which they are chosen (the bound of the sample); rows of a block of queries and of candidates.
PIVOTS, SAMPLE, QUERY_BLOCK, ROW_BLOCK = 16, 1024, 1024, 8192
_FOUND = "query_id long, vec_id long, score long"


def _matrix(column, width: int = 0) -> np.ndarray:
    """Rows of float64; shorter ones are filled with zeros, which leaves inner products as they are."""
    rows = list(column)
    width = max([width, *map(len, rows)])
    if all(len(r) == width for r in rows):
        return np.array(rows, np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(rows.shape[1], pivots.shape[1])
    rows, pivots = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, pivots))
    return np.sqrt(np.stack([((rows - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each new pivot is the row farthest from those chosen."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


_NONE = np.iinfo(np.int64).min


def floors(ids: np.ndarray, rows: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample's rows; no row below it is among the k best of all."""
    out = np.full(len(ids), _NONE)
    width = max(rows.shape[1], sample.shape[1])
    rows, sample = (np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(np.int64) for x in (rows, sample))
    for i in range(len(ids)):
        score = (sample * rows[i]).sum(axis=1)[sample_ids != ids[i]]
        if len(score) >= k:
            out[i] = np.partition(score, len(score) - k)[len(score) - k]
    return out


def eliminate(q_ids, q_rows, q_table, c_ids, c_rows, c_table, k: int, floor=None):
    """The k best of a block for each query, in the order of their bounds.

    |d(q,p) - d(c,p)| <= d(q,c) for any pivot p, and q.c = (|q|^2 + |c|^2 -
    d(q,c)^2) / 2, so the largest such difference bounds the score from above.
    A query stops once the next bound is below its k-th score, or below the
    floor that it brings along from elsewhere.
    """
    floor = np.full(len(q_ids), _NONE) if floor is None else floor
    width = max(q_rows.shape[1], c_rows.shape[1])
    q_rows, c_rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q_rows, c_rows))
    peak = max(np.abs(q_rows).max(initial=0), np.abs(c_rows).max(initial=0))
    if peak * peak * max(width, 1) >= 2.0**52:
        q_rows, c_rows = q_rows.astype(np.int64), c_rows.astype(np.int64)
    q_norm, c_norm = ((x.astype(float) ** 2).sum(axis=1) for x in (q_rows, c_rows))
    found = []
    for at in range(0, len(q_ids), 128):
        ids, rows = q_ids[at : at + 128], q_rows[at : at + 128]
        apart = np.zeros((len(ids), len(c_ids)))
        for p in range(q_table.shape[1]):
            np.maximum(apart, np.abs(q_table[at : at + 128, p, None] - c_table[None, :, p]), out=apart)
        both = q_norm[at : at + 128, None] + c_norm[None, :]
        bound = (both - apart**2) / 2 + 1e-9 * both + 0.5
        bound[ids[:, None] == c_ids[None, :]] = -np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        best = np.full((len(ids), k), np.iinfo(np.int64).min)
        who = np.full((len(ids), k), np.iinfo(np.int64).max)
        least = floor[at : at + 128]
        live, pos, step = np.flatnonzero(bound[:, 0] >= least) if len(c_ids) else np.arange(0), 0, 64
        while len(live) and pos < len(c_ids):
            take = order[live, pos : pos + step]
            score = np.einsum("qd,qcd->qc", rows[live], c_rows[take]).astype(np.int64)
            score[np.isneginf(bound[live, pos : pos + step])] = np.iinfo(np.int64).min
            score, ident = np.hstack([best[live], score]), np.hstack([who[live], c_ids[take]])
            ident[score == np.iinfo(np.int64).min] = np.iinfo(np.int64).max
            top = np.lexsort((ident, ~score), axis=1)[:, :k]
            best[live], who[live] = np.take_along_axis(score, top, axis=1), np.take_along_axis(ident, top, axis=1)
            pos += step
            step = min(2 * step, 1024)
            if pos < len(c_ids):
                live = live[bound[live, pos] >= np.maximum(best[live, -1], least[live])]
        real = best > np.iinfo(np.int64).min
        found.append(pd.DataFrame({"query_id": np.repeat(ids, real.sum(axis=1)), "vec_id": who[real], "score": best[real]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """The k rows of largest integer inner product for each query row, exactly.

    Components become floor(scale * x). A vector that is null, has a null id, or
    holds null or non-finite components takes no part. Equal scores rank by the
    smaller id. A row is never found by a query of its own id; of rows that
    share an id, each may be found by others, and the first in the order of
    their vectors is the query. Vectors of other lengths count as filled with
    zeros. Empty tables give no rows.

    Queries and rows meet block by block (QUERY_BLOCK x ROW_BLOCK); what is sent
    to each task is two blocks, and to the driver the SAMPLE rows among which
    the PIVOTS are chosen. A query's k-th score among the sample is a floor that
    all its blocks share from the start. Components beyond 2**55 saturate.
    """
    spark = vectors.sparkSession
    disk = Scratch(spark, "topk")
    good = F.col("e").isNotNull() & F.col("vec_id").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
        .where(F.coalesce(good, F.lit(False)))
        .select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))
    )
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    pivots = choose_pivots(_matrix([r["v"] for r in sample]), PIVOTS) if sample else np.zeros((0, 0))

    def with_table(batches):
        for pdf in batches:
            yield pdf.assign(t=list(_distances(_matrix(pdf["v"]), pivots))) if len(pdf) else pdf.assign(t=[])

    table = disk.write(clean.mapInPandas(with_table, "vec_id long, v array<long>, t array<double>"), "table")
    sample_ids, sample_rows = np.array([r["vec_id"] for r in sample], np.int64), _matrix([r["v"] for r in sample]) if sample else np.zeros((0, 0))

    def with_floor(batches):
        for pdf in batches:
            yield pdf.assign(f=floors(pdf["vec_id"].to_numpy(), _matrix(pdf["v"]), sample_ids, sample_rows, k) if len(pdf) else pd.Series([], dtype="int64"))

    first = table.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("v", "t")).alias("s")).select("vec_id", "s.v", "s.t")
    queries = disk.write(first.mapInPandas(with_floor, "vec_id long, v array<long>, t array<double>, f long"), "queries")
    n, n_queries = table.count(), queries.count()
    row_blocks, query_blocks = pieces_of(n, ROW_BLOCK), pieces_of(n_queries, QUERY_BLOCK)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("row_block"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"), "vec_id", "v", "t", "f")
    held = table.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), F.pmod(F.xxhash64("vec_id", F.xxhash64("v")), F.lit(row_blocks)).cast("int").alias("row_block"), "vec_id", "v", "t")

    def block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return eliminate(q["vec_id"].to_numpy(), _matrix(q["v"]), np.stack(q["t"]), c["vec_id"].to_numpy(), _matrix(c["v"]), np.stack(c["t"]), k, q["f"].to_numpy())

    met = asked.groupBy("query_block", "row_block").cogroup(held.groupBy("query_block", "row_block")).applyInPandas(block, _FOUND)
    best = met.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.vec_id", (-F.col("col.neg")).alias("score"))


def op7_topk(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
