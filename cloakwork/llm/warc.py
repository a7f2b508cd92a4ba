"""WARC archives and their index, merged from sorted runs.

Records are written by Spark's own text writer with the WARC record separator as line
separator, gzip-compressed, a bounded number of records a file, so archives can live in
any store Spark reaches.  Of records with equal payloads of REVISIT_BYTES or more, the
one of smallest id is a response and the others revisit it.

Reading parses archives by Content-Length and checks payloads against their digests.
Each task sorts its captures by URL key and timestamp: a run.  Runs are cut into key
ranges, and each range merges its slices of all runs with a loser tree, which gives
globally ordered capture histories: ranges are ordered, and so is each within.  Ranges
are cut on (key, timestamp, id, digest), so captures of a single URL can fill many ranges.

Defined results: null payloads are empty; null urls have an empty key; rows that
repeat the smallest id of their payload are responses as well; a null id is never the
smallest; further columns
are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import scratch_path, stored

REVISIT_BYTES, EPOCH = 100, 1_704_067_200
#: Records of an archive at most, and the bytes of payloads that it should hold at most on average.
RECORDS_A_FILE, BYTES_A_FILE = 500, 128 << 20
#: Digests of repeated payloads that are broadcast at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Rows that a run hands to the merge at once.
MERGE_ROWS = 1000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for null.  Control characters would end it and are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None) -> None:
    """Write one record per row.  date: capture time; by default EPOCH plus the id in seconds, within a year."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), (date if date is not None else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(31_536_000)))).alias("date"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload")})
    keys = stored(rows.select("digest", "id", "size"), "payload_keys")
    firsts = stored(keys.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "repeated_payloads")
    mean = keys.agg(F.coalesce(F.avg("size"), F.lit(0))).first()[0]
    few = firsts.count() <= BROADCAST_DIGESTS  # a plain table otherwise, so that Spark can split hot digests of the other side
    rows = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name(F.col("id"))),
        _line("WARC-Date", F.expr("concat(replace(cast(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(date)) as string), ' ', 'T'), 'Z')")),  # UTC, whatever the session's zone
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", name(F.col("first"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(F.col("block")).cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, min(RECORDS_A_FILE, int(BYTES_A_FILE / max(mean, 1))))).text(path)


def records(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an uncompressed archive, one at a time."""
    at = 0
    while line := stream.readline():
        size, headers = len(line), {}
        while (line := stream.readline()).strip():
            size += len(line)
            name, _, value = line.decode("utf-8").removesuffix("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if len(block) < int(headers["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at {at} is not followed by its separator")
        yield at, headers, block
        at += size + len(line) + len(block) + 4


def url_key(url: str | None) -> str:
    """Host with reversed labels, then path and query, in lower case, so that captures of a site sort together."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    m = re.match(r"([^/?#]*)([^#]*)", rest.lower(), re.S)
    return ",".join(reversed(m[1].split("."))) + ")" + (m[2] or "/")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives: url_key, ts, id, payload_bytes, payload_digest, record_type, refers_to, file, offset."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: None if s == "null" else int(s)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out = []
                for at, h, block in records(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: the payload at {at} does not have its digest")
                    i = h["WARC-Record-ID"].split(":")[2]
                    to = h.get("WARC-Refers-To")
                    out.append((url_key(h.get("WARC-Target-URI")), h["WARC-Date"], number(i), size, digest, h["WARC-Type"], number(to.split(":")[2]) if to else None, name.rsplit("/", 1)[-1], at))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_TYPES.values())], list(_TYPES))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, _SCHEMA)


_TYPES = {"url_key": pa.string(), "ts": pa.string(), "id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "file": pa.string(), "offset": pa.int64()}
_SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in _TYPES.items())


def loser_merge(runs: list[Iterable], key) -> Iterator:
    """Merge sorted runs with a tree of losers: each output costs one match per level, and one row of each run is held."""
    k = len(runs)
    if k == 0:
        return
    runs, done = [iter(r) for r in runs], object()
    rows = [next(r, done) for r in runs]
    heads = [r if r is done else key(r) for r in rows]
    beats = lambda a, b: heads[b] is done or (heads[a] is not done and (heads[a], a) < (heads[b], b))
    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = winners[1] if k > 1 else 0
    while heads[winner] is not done:
        yield rows[winner]
        rows[winner] = next(runs[winner], done)
        heads[winner] = done if rows[winner] is done else key(rows[winner])
        node = (winner + k) // 2
        while node >= 1:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def _rows(table: pa.Table) -> Iterator[tuple]:
    for batch in table.to_batches(max_chunksize=MERGE_ROWS):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _order(r: tuple) -> tuple:
    return r[0], r[1], r[2] is not None, r[2] or 0, r[4]


def index(captures: DataFrame) -> DataFrame:
    """Captures in the global order of (url_key, ts, id, payload_digest), null ids first: partition by partition, and within each."""
    order = ["url_key", "ts", "id", "payload_digest"]
    runs = stored(captures.sortWithinPartitions(*order), "capture_runs")
    ranged = runs.repartitionByRange(*order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)  # columns of one key range; rows become Python objects MERGE_ROWS at a time
        cuts, last = [0], None
        for i, r in enumerate(_rows(table)):  # slices of runs arrive one after another
            if last is not None and _order(r) < last:
                cuts.append(i)
            last = _order(r)
        merged = loser_merge([_rows(table.slice(a, b - a)) for a, b in zip(cuts, [*cuts[1:], table.num_rows], strict=True)], _order)
        while part := list(islice(merged, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(_TYPES.values())], list(_TYPES))

    return ranged.mapInArrow(merge, _SCHEMA)


def archive_and_index(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Write archives, read them back and index them."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "warc")
    write(df, path, id_col, url_col, html_col)
    return index(read(spark, path)).withColumnRenamed("id", id_col)
