"""Folders of files that tasks write and a manifest makes valid.

A task writes under a name of its own, which no other attempt has. When all
tasks are done the driver writes the list of the files that count, in one step;
what killed or repeated attempts left is deleted. Readers trust the list alone,
and it says of each file which part of the genome it holds, so that a query
opens no other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import RecordBatch
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .ranges import is_web, storage

MANIFEST = "_manifest.json"


def listed(path: str) -> list[dict] | None:
    """The files of a folder with a manifest: name, records and zones ({chrom: [lo, hi]}). None where there is none."""
    from pyarrow import fs

    if is_web(path):
        return None
    store, base = storage(path)
    at = f"{base.rstrip('/')}/{MANIFEST}"
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at, compression=None) as f:
        return json.loads(f.read())["files"]


def holding(files: list[dict], chrom: str | None, lo: int, hi: int) -> list[dict]:
    """Those of a manifest's files whose zone meets or touches the range."""
    met = lambda zone: zone is not None and zone[0] < hi and zone[1] >= lo
    return [f for f in files if chrom is None or met(f["zones"].get(chrom))]


def write_manifest(path: str, files: list[dict]) -> None:
    store, base = storage(path)
    base = base.rstrip("/")
    fresh = f"{base}/_{uuid.uuid4().hex}"
    with store.open_output_stream(fresh, compression=None) as f:
        f.write(json.dumps({"files": files}, separators=(",", ":")).encode())
    store.move(fresh, f"{base}/{MANIFEST}")


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class FolderWriter(DataSourceArrowWriter):
    """Writes a folder; a subclass makes files of one partition's rows."""

    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.job = path.rstrip("/"), suffix, overwrite, uuid.uuid4().hex[:12]
        store, base = storage(self.path)
        store.create_dir(base, recursive=True)

    def fresh(self) -> str:
        return f"{self.job}-{uuid.uuid4().hex}{self.suffix}"

    def files(self, batches: Iterator[RecordBatch]) -> Iterator[dict]:
        """Writes files under self.path, each named by fresh(), and yields their entries."""
        raise NotImplementedError

    def write(self, iterator: Iterator[RecordBatch]) -> WriterCommitMessage:
        return Written(list(self.files(iterator)))

    def _delete(self, keep: set[str], old: set[str] = frozenset()) -> None:
        """Deletes files of this job that do not count, and those of the list before."""
        from pyarrow import fs

        store, base = storage(self.path)
        for f in store.get_file_info(fs.FileSelector(base)):
            own = f.base_name.startswith(self.job) or f.base_name.removesuffix(".tbi") in old
            if own and f.base_name.removesuffix(".tbi") not in keep:
                store.delete_file(f.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        new = [f for m in messages if m is not None for f in m.files]
        old = listed(self.path) or []
        kept = new if self.overwrite else old + new
        write_manifest(self.path, sorted(kept, key=lambda f: (f.get("unit", 0), min(f["zones"], default=""), min(f["zones"].values(), default=[0]), f["name"])))
        self._delete({f["name"] for f in kept}, {f["name"] for f in old})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete(set())
