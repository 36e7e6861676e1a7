"""Byte ranges of files, in any storage that pyarrow opens or on servers that honour ranges.

A worker keeps its connections and open files, so that many small reads of a
file cost one connection; ranges that lie near each other come in one request;
a request that fails is made again.
"""

from __future__ import annotations

import http.client
import time
from collections import OrderedDict
from urllib.parse import urlsplit

#: Seconds until a request is given up, how often it is made, and seconds before the second time (doubled each time).
TIMEOUT, TRIES, PAUSE = 30, 4, 0.1
#: Bytes between two ranges that are read along rather than asked for apart, and the most bytes of one request.
GAP, MOST = 64 << 10, 16 << 20
#: Connections and open files that a worker keeps.
KEPT = 20
#: Answers after which asking again may help (fixed values).
_AGAIN = frozenset((408, 425, 429, 500, 502, 503, 504))


def is_web(path: str) -> bool:
    return str(path).startswith(("http://", "https://"))


def storage(path: str):
    """(file system, path in it) of a path or URI that pyarrow knows."""
    from pyarrow import fs

    path = str(path)
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class _Kept(OrderedDict):
    """Open things by name; the one used longest ago is closed when there are too many."""

    def take(self, name, make):
        found = self.pop(name, None)
        if found is None:
            found = make()
        self[name] = found
        while len(self) > KEPT:
            self.popitem(last=False)[1].close()
        return found

    def drop(self, name) -> None:
        found = self.pop(name, None)
        if found is not None:
            found.close()


_servers, _files = _Kept(), _Kept()


def _connect(scheme: str, server: str):
    return (http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection)(server, timeout=TIMEOUT)


def request(path: str, method: str, headers: dict[str, str]) -> tuple[int, http.client.HTTPMessage, bytes]:
    """(status, headers, body), over the worker's connection to the server; tried again where that may help."""
    at = urlsplit(str(path))
    target = (at.path or "/") + (f"?{at.query}" if at.query else "")
    why: Exception | str = ""
    for n in range(TRIES):
        if n:
            time.sleep(PAUSE * 2 ** (n - 1))
        line = _servers.take((at.scheme, at.netloc), lambda: _connect(at.scheme, at.netloc))
        try:
            line.request(method, target, headers=headers)
            got = line.getresponse()
            # a server that ignores ranges would send the whole file
            body = got.read() if method != "GET" or got.status == 206 or got.status >= 300 else b""
            if got.will_close or method == "GET" and 200 <= got.status < 300 and got.status != 206:
                _servers.drop((at.scheme, at.netloc))
            if got.status not in _AGAIN:
                return got.status, got.headers, body
            why = f"status {got.status}"
        except (OSError, http.client.HTTPException) as e:
            _servers.drop((at.scheme, at.netloc))
            why = e
    raise OSError(f"{path}: {why} after {TRIES} requests")


def read_range(path: str, offset: int, size: int, short: bool = False) -> bytes:
    """Bytes of a file. Fewer than size bytes raise unless short."""
    if is_web(path):
        status, _, data = request(path, "GET", {"Range": f"bytes={offset}-{offset + size - 1}"})
        if status == 416 and short:
            return b""
        if status != 206:
            raise OSError(f"{path}: the server ignores ranges" if status < 300 else f"{path}: status {status}")
    else:
        data = _read_stored(str(path), offset, size)
    if len(data) < size and not short:
        raise OSError(f"{path}: {len(data)} of {size} bytes at {offset}")
    return data


def _read_stored(path: str, offset: int, size: int) -> bytes:
    store, base = storage(path)
    stamp = store.get_file_info(base)
    name = (path, stamp.size, stamp.mtime_ns)  # a file that is written anew is opened anew
    f = _files.take(name, lambda: store.open_input_file(base))
    return f.read_at(min(size, max(stamp.size - offset, 0)), offset)


def joined(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, list[int]]]:
    """(offset, size, which ranges it holds) of the requests that bring all ranges (offset, size); near ones come together."""
    out: list[list] = []
    for i in sorted(range(len(ranges)), key=lambda i: ranges[i]):
        at, size = ranges[i]
        if out and at <= out[-1][1] + gap and max(out[-1][1], at + size) - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + size)
            out[-1][2].append(i)
        else:
            out.append([at, at + size, [i]])
    return [(a, b - a, held) for a, b, held in out]


def read_many(path: str, ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST, short: bool = False):
    """(place in ranges, bytes) of many ranges of a file, in the order of their offsets; short: those at its end may be cut off."""
    for at, size, held in joined(ranges, gap, most):
        data = read_range(path, at, size, short)
        for i in held:
            yield i, data[ranges[i][0] - at : ranges[i][0] - at + ranges[i][1]]


def stamp(path: str) -> str:
    """What changes when a file does: the server's tag or date, else size and time."""
    if is_web(path):
        _, headers, _ = request(path, "HEAD", {})
        return headers.get("ETag") or headers.get("Last-Modified") or ""
    store, base = storage(path)
    info = store.get_file_info(base)
    return f"{info.size} {info.mtime_ns}"
