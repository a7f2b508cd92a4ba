"""URL filtering with a sorted digest array.

List entries are strings ``host/path-prefix``.  Their 64-bit xxhash keys form one sorted
array; the entries' strings, in the same order, are stored beside it.  The file goes to
executors as a broadcast of checked size, is unpacked once per executor into its working
folder (and again on a new executor if one is lost), and memory-mapped by all workers.
A batch's candidates (each parent domain of each host, with each listed path length) are
hashed and probed in one vectorised binary search; hits are confirmed against the stored
full strings, so digest collisions change nothing.

The longest rule that fits decides; without one, a host on the block list (or below one)
is blocked, else allowed.

Defined results: null urls and urls without ``://`` have empty host and path and are
allowed; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest index that is broadcast; a larger one is refused.
MAX_INDEX_BYTES = 1 << 30
LISTED, ALLOW, BLOCK = 0, 1, 2
_OPEN: dict[str, Digests] = {}
_HOST, _PATH = r"^.*?://([^/?#]*)", r"^.*?://[^/?#]*([^?#]*)"


def build(entries: Iterable[tuple[str, int]]) -> bytes:
    """The index file: count, number of path lengths, those lengths, then keys, offsets, kinds, strings."""
    unique = {}
    for text, kind in entries:
        host, _, path = text.partition("/")
        unique[f"{host.lower()}/{path}".encode(), min(kind, 1)] = kind
    rows = sorted((xxhash.xxh64_intdigest(s), s, kind) for (s, _), kind in unique.items())
    lengths = sorted({len(s.partition(b"/")[2].decode()) for _, s, _ in rows})
    ends = np.cumsum([0, *(len(s) for _, s, _ in rows)], dtype="<i8")
    out = struct.pack("<qq", len(rows), len(lengths)) + np.array(lengths, "<i8").tobytes() + np.array([h for h, _, _ in rows], "<u8").tobytes() + ends.tobytes() + bytes(k for _, _, k in rows) + b"".join(s for _, s, _ in rows)
    if len(out) > MAX_INDEX_BYTES:
        raise ValueError(f"the index takes {len(out)} bytes; at most {MAX_INDEX_BYTES} are broadcast")
    return out


class Digests:
    """A memory-mapped index."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, k = struct.unpack_from("<qq", self.map)
        at = 16
        self.lengths = np.frombuffer(self.map, "<i8", k, at).tolist()
        self.keys = np.frombuffer(self.map, "<u8", n, at := at + 8 * k)
        self.ends = np.frombuffer(self.map, "<i8", n + 1, at := at + 8 * n)
        self.kinds = np.frombuffer(self.map, np.uint8, n, at := at + 8 * (n + 1))
        self.strings = at + n

    @staticmethod
    def of(data: bytes) -> Digests:
        key = hashlib.sha256(data).hexdigest()
        if key not in _OPEN:
            path = os.path.join(tempfile.gettempdir(), f"url-digests-{key}")
            if not os.path.exists(path):
                with open(mine := f"{path}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(mine, path)
            _OPEN[key] = Digests(path)
        return _OPEN[key]

    def entry(self, i: int) -> bytes:
        return self.map[self.strings + self.ends[i] : self.strings + self.ends[i + 1]]

    def find(self, candidates: list[bytes]) -> list[list[int]]:
        """For each candidate the kinds stored under exactly that string."""
        if not len(self.keys) or not candidates:
            return [[] for _ in candidates]
        h = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        low, high = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        out: list[list[int]] = [[] for _ in candidates]
        for c in np.flatnonzero(high > low):
            out[c] = [int(self.kinds[i]) for i in range(low[c], high[c]) if self.entry(i) == candidates[c]]
        return out

    def judge(self, sites: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
        """(rule, verdict) of each (host, path)."""
        candidates: dict[bytes, int] = {}
        wanted: list[list[int]] = []
        for host, path in sites:
            parts = host.split(".") if host else []
            mine = [f"{'.'.join(parts[i:])}/{path[1 : 1 + n]}" for n in self.lengths if n <= max(0, len(path) - 1) for i in range(len(parts)) if n == 0 or path.startswith("/")]
            wanted.append([candidates.setdefault(c.encode("utf-8", "surrogatepass"), len(candidates)) for c in mine])
        names = list(candidates)
        kinds = self.find(names)
        out = []
        for mine in wanted:
            rules = [(len(names[c]), names[c].decode(), k) for c in mine for k in kinds[c] if k != LISTED]
            if rules:
                _, rule, k = max(rules)
                out.append((rule, "allow" if k == ALLOW else "block"))
            else:
                out.append((None, "block" if any(LISTED in kinds[c] for c in mine) else "allow"))
        return out


def judge_urls(df: DataFrame, index: bytes, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.regexp_extract(url, f"(?s){_HOST}", 1)
    upper = "".join(map(chr, range(65, 91)))
    rows = df.select(id_col, F.translate(host, upper, upper.lower()).alias("host"), F.regexp_extract(url, f"(?s){_PATH}", 1).alias("path"))
    shipped = df.sparkSession.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests.of(shipped.value)
        for batch in batches:
            found = digests.judge(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [id_col, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(probe, f"`{id_col}` {dict(rows.dtypes)[id_col]}, host string, path string, rule string, verdict string")
