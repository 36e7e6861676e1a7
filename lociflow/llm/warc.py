"""Deterministic sharded WARC writer and reader, as a Spark data source."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .common import Scratch, read, utf8

#: Raw bytes that a shard holds about, compressed bytes after which a file is closed, and the least payload that is revisited.
SHARD_BYTES, FILE_BYTES, REVISIT_BYTES = 16 << 20, 4 << 20, 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a null page_id inside.
_NO_ID = -(1 << 63)
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def _storage(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _packed(head: list[str], block: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _block_digest(block: bytes) -> str:
    return f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"


def file_info(name: str, date: str) -> bytes:
    """The record that begins a file, as a gzip member."""
    block = b"format: WARC File Format 1.1\r\n"
    return _packed(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Filename: {name}", f"WARC-Date: {date}", _block_digest(block), "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"], block)


def record(page_id, url, payload: bytes, refers_to, date: str, mark: str = "") -> bytes:
    """One record as a gzip member. A revisit (refers_to given) holds the HTTP header but not the payload. mark tells records of one page_id apart."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}{mark}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", _block_digest(block), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _packed(head, block)


def members(stream, size: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    left = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            left = left or stream.read(size)
            if not left:
                if out:
                    raise ValueError("a record is cut off")
                return
            out.append(unpack.decompress(left))
            left = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def parse(member: bytes) -> tuple | None:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of a record, None of a file's own; its digests must hold."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "warcinfo":
        return None
    sha = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    http, _, payload = block.partition(b"\r\n\r\n")
    told = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    size = int(told["Content-Length"])
    kind = fields["WARC-Type"]
    if lines[0] != "WARC/1.1" or base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError("a record's block digest doesn't hold")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != sha):
        raise ValueError("a record's payload digest doesn't hold")
    number = lambda x: x.removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    page = lambda x: None if x is None or number(x) == "none" else int(number(x))
    return page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, sha.hex(), kind, page(fields.get("WARC-Refers-To"))


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    """Writes rows (shard, page_id, url, payload, refers_to, mark) in the order in which they come.

    A task writes under temporary names of its own; the commit gives the files
    of the tasks that count their lasting names, then writes the manifest, then
    drops what is left of the temporary folder, such as files of lost tasks.
    """

    def __init__(self, path: str, file_bytes: int, date: str):
        self.path, self.file_bytes, self.date = path, file_bytes, date
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows):
        store, base = _storage(self.path)
        store.create_dir(f"{base}/{self.temporary}", recursive=True)
        files, out, shard, seq = [], None, None, 0

        def close():
            out.close()
            files.append(state | {"sha256": state.pop("hash").hexdigest()})

        def put(done):
            out.write(done)
            state["hash"].update(done)
            state["bytes"] += len(done)

        state: dict = {}
        for row in rows:
            if out is not None and (row["shard"] != shard or state["bytes"] >= self.file_bytes):
                close()
                out = None
            if out is None:
                seq = seq + 1 if row["shard"] == shard else 0
                shard = row["shard"]
                state = {"name": f"part-{shard:06d}-{seq:04d}.warc.gz", "temporary": f"{self.temporary}/{uuid.uuid4().hex}", "bytes": 0, "records": 0, "hash": hashlib.sha256()}
                out = store.open_output_stream(f"{base}/{state['temporary']}", compression=None)
                put(file_info(state["name"], self.date))
            put(record(row["page_id"], row["url"], bytes(row["payload"]), row["refers_to"], self.date, row["mark"]))
            state["records"] += 1
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages):
        store, base = _storage(self.path)
        store.create_dir(base, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        for f in files:
            store.move(f"{base}/{f.pop('temporary')}", f"{base}/{f['name']}")
        with store.open_output_stream(f"{base}/{self.temporary}-manifest", compression=None) as out:
            out.write(json.dumps({"files": files}, indent=1).encode())
        store.move(f"{base}/{self.temporary}-manifest", f"{base}/manifest.json")
        self.abort(messages)

    def abort(self, messages):
        store, base = _storage(self.path)
        if store.get_file_info(f"{base}/{self.temporary}").type.name == "Directory":
            store.delete_dir(f"{base}/{self.temporary}")


class WarcReader(DataSourceReader):
    """Reads the files that the manifest names, one partition each."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        store, base = _storage(self.path)
        with store.open_input_stream(f"{base}/manifest.json", compression=None) as f:
            return [InputPartition(x["name"]) for x in json.loads(f.read())["files"]]

    def read(self, partition):
        if partition is None or partition.value is None:
            return
        store, base = _storage(self.path)
        with store.open_input_stream(f"{base}/{partition.value}", compression=None) as f:
            for member in members(f):
                if found := parse(member):
                    yield (*found, partition.value)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return _READ

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)), self.options.get("date", "1970-01-01T00:00:00Z"))

    def reader(self, schema):
        return WarcReader(self.options["path"])


def cut_points(facts: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(first id of each shard, number of shards that share this id), by exact byte counts of id ranges.

    Ids are counted in at most 4096 equal ranges; a range of more than a
    shard's bytes is counted again in 64 finer ones, down to single ids, so
    the cuts depend on the data alone. Sent to the driver: a few numbers a shard.
    """
    low, high = facts.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return np.zeros(1, np.int64), np.ones(1, np.int64)
    shift = max(0, int(high - low).bit_length() - 12)
    done: list[tuple[int, int, int]] = []  # first id, log2 of its width, bytes
    todo = facts
    while True:
        counted = todo.groupBy(F.shiftright(F.col("page_id") - low, shift).alias("r")).agg(F.sum("bytes").alias("bytes")).collect()
        heavy = [r["r"] for r in counted if r["bytes"] > shard_bytes and shift > 0]
        skip = set(heavy)
        done += [(low + (r["r"] << shift), shift, r["bytes"]) for r in counted if r["r"] not in skip]
        if not heavy:
            break
        spark = facts.sparkSession
        chosen = spark.createDataFrame([(h,) for h in heavy], "r long")
        todo = todo.withColumn("r", F.shiftright(F.col("page_id") - low, shift)).join(chosen, "r", "left_semi").drop("r")
        shift = max(0, shift - 6)
    firsts, subs, held = [low], [1], 0
    for first, width, size in sorted(done):
        if held and held + size > shard_bytes:
            firsts.append(first)
            subs.append(1)
            held = 0
        held += size
        if width == 0 and size > shard_bytes:
            subs[-1] = math.ceil(size / shard_bytes)
            held = shard_bytes
    return np.array(firsts, np.int64), np.array(subs, np.int64)


def write_archive(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes one record per row under path, sorted by page_id over shards and files.

    The bytes of every file depend on the rows alone: shards are cut by exact
    byte counts of page_id ranges, rows of a shard are sorted by page_id, digest
    and url, files are rolled by compressed size, and headers and digests are
    made anew. A null html is an empty payload. Of equal payloads of at least
    revisit_bytes the rows of the largest page_id are responses and the others
    revisits; a record that repeats a page_id in its shard, or may do so in
    another, has a mark behind it in its record id. Rows without a page_id come
    first, in as many shards of their own as they fill; an id of which there are
    more bytes than a shard's is spread likewise, by digest and url. An empty
    table gives an empty manifest.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    disk = Scratch(spark, "warc")
    body = F.coalesce(F.col("html"), F.lit(""))
    spread = F.crc32(F.concat(F.sha1(utf8(F.col("html"))), F.coalesce(F.col("url"), F.lit("")).cast("binary")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", utf8(F.col("html")).alias("payload"), F.sha1(utf8(F.col("html"))).alias("digest"), spread.alias("spread"))
    facts = disk.write(pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(utf8(F.col("html"))).alias("digest"), spread.alias("spread")), "facts")
    counted = facts.select("page_id", (F.col("bytes") + 400).alias("bytes"))
    firsts, subs = cut_points(counted.where(F.col("page_id").isNotNull()), shard_bytes)
    unnamed = math.ceil((counted.where(F.col("page_id").isNull()).agg(F.sum("bytes")).first()[0] or 0) / shard_bytes)
    base = unnamed + np.concatenate([[0], np.cumsum(subs)[:-1]])

    @F.pandas_udf("shard long, alone boolean")
    def shard_of(page_id: pd.Series, spread: pd.Series) -> pd.DataFrame:
        null, spread = page_id.isna().to_numpy(), spread.to_numpy()
        at = np.maximum(np.searchsorted(firsts, page_id.fillna(firsts[0]).to_numpy().astype(np.int64), side="right") - 1, 0)
        return pd.DataFrame({"shard": np.where(null, spread % max(unnamed, 1), base[at] + spread % subs[at]), "alone": ~null & (subs[at] == 1)})

    known, of = F.coalesce("page_id", F.lit(_NO_ID)).alias("page_id"), shard_of(F.col("page_id"), F.col("spread")).alias("of")
    keeper = facts.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    verdict = facts.select("page_id", "digest", "spread").distinct().join(keeper, "digest").where("page_id IS NULL OR page_id <> keeper").select(of, known, "digest", "keeper").select("of.shard", "page_id", "digest", "keeper")
    placed = rows.select(of, known, "url", "payload", "digest").select("of.*", "page_id", "url", "payload", "digest")

    def order(page: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        refers = {(p, d): k for p, d, k in zip(told["page_id"].tolist(), told["digest"], told["keeper"].tolist(), strict=True)}
        page = page.sort_values(["page_id", "digest", "url"], na_position="first", kind="stable", ignore_index=True)
        ids, nth = page["page_id"].tolist(), page.groupby("page_id").cumcount().tolist()
        page["refers_to"] = pd.array([refers.get((p, d)) for p, d in zip(ids, page["digest"], strict=True)], "Int64")
        page["mark"] = ["" if alone and n == 0 else f":{shard}-{n}" for alone, n, shard in zip(page["alone"], nth, page["shard"], strict=True)]
        page["page_id"] = pd.array([None if p == _NO_ID else p for p in ids], "Int64")
        return page[["shard", "page_id", "url", "payload", "refers_to", "mark"]]

    ready = placed.groupBy("shard").cogroup(verdict.groupBy("shard")).applyInPandas(order, "shard long, page_id long, url string, payload binary, refers_to long, mark string")
    ready.write.format("warc").mode("append").option("fileBytes", file_bytes).save(path)
    disk.drop("facts")


def read_archive(spark, path: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def op6_warc(spark, sf_dir):
    disk = Scratch(spark, "archive")
    write_archive(read(spark, sf_dir, "pages"), disk.path)
    return read_archive(spark, disk.path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN k.keeper IS NULL OR k.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k USING (d)
"""
