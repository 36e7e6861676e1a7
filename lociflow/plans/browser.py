"""Requests on tracks: signal, features, transcripts, and several tracks of one region."""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validation as V
from ..functions.parsing import with_ccre_columns
from ..operators import annotations, layout, pyramid, resample, signal
from . import errors

#: Rows of a track that may wait until those of the tracks before it are taken.
AHEAD = 1000

Opener = Callable[[SparkSession, str], DataFrame]


def _parquet(spark: SparkSession, url: str) -> DataFrame:
    return spark.read.parquet(url)


@dataclass
class Browser:
    """Answers requests from tables. open_* turn a track's url into a DataFrame of its schema.

    pyramids: url to (path of its pyramid, reductions); a signal request with a
    width is then read from the coarsest level that is no coarser than a pixel.
    """

    spark: SparkSession
    annotation_path: str | None = None
    open_signal: Opener = _parquet
    open_features: Opener = _parquet
    open_records: Opener = _parquet
    pyramids: dict[str, tuple[str, list[int]]] = field(default_factory=dict)

    def _check(self, made) -> None:
        """Evaluates a validation column on one row; requests are literals, so this is no job over data."""
        found = self.spark.range(1).select(made.alias("e")).first()["e"]
        if found is not None:
            raise errors.RequestError(found["code"], found["message"], found["field"])

    def signal(self, url: str, chrom: str, start: int, end: int, width: int = 0, mode: str = "start") -> DataFrame:
        """Records of the region, or `width` pixels of it."""
        lit = F.lit
        self._check(V.signal_error(lit(url), lit(chrom), lit(start), lit(end), lit(width)))
        source = None
        if width > 0 and url in self.pyramids:
            path, reductions = self.pyramids[url]
            level = pyramid.select_level(start, end, width, reductions)
            if level >= 0:
                rows = pyramid.read_level(self.spark, path, reductions[level])
                source = rows.select("chr", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("reduction")).cast("int").alias("end"), F.col("value").cast("float").alias("value"))
        rows = signal.region(self.open_signal(self.spark, url) if source is None else source, chrom, start, end, mode)
        return resample.to_width(rows, width) if width > 0 else rows

    def features(self, url: str, chrom: str, start: int, end: int, parse: str | None = None, mode: str = "start") -> DataFrame:
        """Features of the region; parse="ccre" gives typed columns."""
        self._check(V.feature_error(F.lit(url), F.lit(chrom), F.lit(start), F.lit(end)))
        rows = signal.region(self.open_features(self.spark, url), chrom, start, end, mode)
        return with_ccre_columns(rows) if parse == "ccre" else rows

    def genes(self, chrom: str, start: int, end: int) -> DataFrame:
        self._check(V.transcript_error(F.lit(chrom), F.lit(start), F.lit(end)))
        return annotations.fold_genes(annotations.in_region(self.open_records(self.spark, self.annotation_path), chrom, start, end))

    def transcripts(self, chrom: str, start: int, end: int, padding: int = layout.PADDING) -> str:
        """The region's genes as the JSON envelope that clients get (a region's answer, not a table)."""
        genes = self.genes(chrom, start, end)
        rows = annotations.transcript_layout(genes, padding)
        found = [json.loads(r["json"]) for r in annotations.wire_genes(genes, rows).orderBy("name").collect()]
        total = max((t["row"] + 1 for g in found for t in g["transcripts"] if "row" in t), default=0)
        return json.dumps({"gene": found} | ({"totalRows": total} if total else {}) | {"paddingBp": padding if padding > 0 else layout.PADDING})

    def track(self, chrom: str, start: int, end: int, kind: str, config: str | None) -> DataFrame | str:
        try:
            told = json.loads(config or "{}")
        except ValueError as e:
            raise errors.RequestError(errors.INVALID_JSON, str(e), "config") from e
        if kind == "bigwig":
            return self.signal(told.get("url", ""), chrom, start, end, int(told.get("preRenderedWidth", 0)))
        if kind == "bigbed":
            return self.features(told.get("url", ""), chrom, start, end, told.get("type"))
        if kind == "transcript":
            return self.transcripts(chrom, start, end, int(told.get("paddingBp", 0)))
        raise errors.RequestError(errors.VALIDATION, f"unknown track type: {kind}", "type")

    def browse(self, request: dict | str) -> list[dict]:
        """All tracks of a request, each as {id, type, data} or {id, type, error}."""
        return json.loads("".join(self.stream(request)))

    def stream(self, request: dict | str) -> Iterator[str]:
        """The same as pieces of JSON text, a row at a time.

        Tracks run as jobs side by side and come in the request's order; of each
        the driver holds a partition and at most AHEAD rows. A track that fails
        before its first row has an error in place of data; one that fails later
        ends the answer.
        """
        try:
            request = json.loads(request) if isinstance(request, str) else request
        except ValueError as e:
            raise errors.RequestError(errors.INVALID_JSON, str(e)) from e
        tracks = request.get("tracks") or []
        chrom, start, end = request.get("chrom", ""), int(request.get("start", 0)), int(request.get("end", 0))
        self._check(V.browser_error(F.lit(chrom), F.lit(start), F.lit(end), F.array(*(F.lit(i) for i in range(len(tracks)))) if tracks else F.array().cast("array<int>")))
        waiting = [queue.Queue(AHEAD) for _ in tracks]
        over = threading.Event()

        def put(to: queue.Queue, piece) -> None:
            while not over.is_set():
                try:
                    return to.put(piece, timeout=0.1)
                except queue.Full:
                    continue

        def produce(t: dict, to: queue.Queue) -> None:
            try:
                for piece in self._pieces(chrom, start, end, t):
                    put(to, piece)
                    if over.is_set():
                        return
                put(to, None)
            except Exception as e:  # handed to the one who takes the pieces
                put(to, e)

        with ThreadPoolExecutor(max_workers=min(8, len(tracks))) as pool:
            for t, q in zip(tracks, waiting, strict=True):
                pool.submit(produce, t, q)
            try:
                yield "["
                for i, q in enumerate(waiting):
                    if i:
                        yield ","
                    while (piece := q.get()) is not None:
                        if isinstance(piece, Exception):
                            raise piece
                        yield piece
                yield "]"
            finally:
                over.set()

    def _pieces(self, chrom: str, start: int, end: int, t: dict) -> Iterator[str]:
        out = {"id": t.get("id"), "type": t.get("type")}
        config = t.get("config")
        try:
            got = self.track(chrom, start, end, t.get("type", ""), config if isinstance(config, str) else json.dumps(config or {}))
            if isinstance(got, str):
                yield json.dumps(out)[:-1] + f', "data": {got}}}'
                return
            rows = lines(got)
            first = next(rows, None)
        except errors.RequestError as e:
            yield json.dumps(out | {"data": None, "error": e.message})
            return
        yield json.dumps(out)[:-1] + ', "data": [' + (first or "")
        for row in rows:
            yield "," + row
        yield "]}"


def lines(answer: DataFrame):
    """The rows of a large answer as JSON, partition by partition, so that the driver holds one of them and the next."""
    for row in answer.select(F.to_json(F.struct(*answer.columns)).alias("j")).toLocalIterator(prefetchPartitions=True):
        yield row["j"]


def union_tracks(tracks: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Rows of unlike tracks as one table: (track, type, data as JSON)."""
    out = None
    for (name, kind), df in tracks.items():
        one = df.select(F.lit(name).alias("track"), F.lit(kind).alias("type"), F.to_json(F.struct(*df.columns)).alias("data"))
        out = one if out is None else out.unionByName(one)
    return out
