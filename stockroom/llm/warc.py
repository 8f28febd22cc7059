"""WARC archives with a two-level capture index.

``write_archives`` writes one record for each page: a response, or a revisit where an equal payload belongs to a page
with a larger id. Records are gzip members, written by Spark's own text writer (the record as the line, the closing
blank lines as the separator, both gzipped), so any store that Spark reaches will do.
``build_index`` scans the archives and sorts the captures by reversed-host URL key and page id; every sorted part is
cut into compressed blocks, and the first key of each block is its entry in the sparse directory.
``read_captures`` finds keys: the part by its first keys, the block by binary search in the part's directory, the
capture by binary search in the unpacked block; then it unpacks just the captures' byte ranges of each archive. What is
loaded is not restricted by that: Spark reads and shuffles all index blocks and all archives whole, however few captures
are asked for.

Defined results. Null html: empty payload. Null url: an empty target, key "-". Null page_id: a record without a page,
that never is the one others revisit. Rows that repeat a page_id with the same payload are all kept with one type
(a page does not revisit itself). Payloads under ``least`` bytes are always responses. Other columns are ignored.
An empty table gives an empty result. Very long payloads are compressed and hashed whole.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import map_batches

#: Records in an archive at most: bounds the memory of a task that reads one.
RECORDS_A_FILE = 4096
#: Captures in an index block, and in an index part.
CAPTURES_A_BLOCK = 512
CAPTURES_A_PART = 200_000
DATE = "2024-01-01T00:00:00Z"
_END = gzip.compress(b"\r\n\r\n", mtime=0)
_PAGE, _NO_PAGE = 0x77617263 << 96, 0x6E6F6E65 << 96
_NONE = -(2**63)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target(url: str | None) -> str:
    """A url as a header can hold it."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def url_key(url: str | None) -> str:
    """Host read from the right, then port, path and query: captures of a site stand together. No blanks."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        host, port, parts = "", None, None
    if not host:
        return quote(url.strip().lower(), safe="/:?=&%#,;+~.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key, safe="/:?=&%,;+~.)@!$'(*")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NO_PAGE if page_id is None else _PAGE | (page_id & (2**64 - 1)))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.removeprefix("<urn:uuid:").rstrip(">")).int
    if n >> 96 != _PAGE >> 96:
        return None
    low = n & (2**64 - 1)
    return low - 2**64 if low >> 63 else low


def record_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record but for the blank lines that close it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def parse(record: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the payload's full length as the HTTP header has it."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, payload, int(http.rsplit(b"Content-Length: ", 1)[1])


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record of an archive; its length includes the closing member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, parts, fed = zlib.decompressobj(31), [], at
        while not z.eof:
            if fed >= len(data):
                raise ValueError("an archive ends inside a record")
            parts.append(z.decompress(view[fed : fed + 16384]))
            fed += 16384
        end = min(fed, len(data)) - len(z.unused_data)
        if data[end : end + len(_END)] != _END:
            raise ValueError("a record is not closed")
        end += len(_END)
        yield at, end - at, b"".join(parts)
        at = end


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write one record for each row of ``pages`` (page_id, url, html) as archives under ``path``."""

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = [v.as_py() or b"" for v in batch.column("html").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([payload_digest(r) for r in raw], pa.string()), pa.array([len(r) for r in raw], pa.int64()), pa.array([zlib.compress(r, 3) for r in raw], pa.binary())],
                names=["page_id", "url", "digest", "bytes", "packed"],
            )

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [gzip.compress(record_of(p, u, zlib.decompress(z), d, r), 6, mtime=0) for p, u, d, z, r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "packed", "refers_to")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = map_batches(pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html"), packed, "page_id long, url string, digest string, bytes long, packed binary")
    newest = rows.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("newest"))
    joined = rows.join(newest.hint("shuffle_merge"), (rows.digest == newest.of) & (rows.bytes >= least), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("newest") > F.col("page_id")), F.col("newest"))
    lines = map_batches(joined.select("page_id", "url", "digest", "packed", refers.alias("refers_to")), records, "record binary")
    writer = lines.select(F.col("record").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1"))
    writer.option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


CAPTURE = "key string, id long, path string, offset long, length long"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(key, id, path, offset, length) of all records, in the archives' order."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = []
                for offset, length, record in members(content.as_py()):
                    fields = parse(record)[0]
                    page = page_of(fields["WARC-Record-ID"])
                    found.append((url_key(fields.get("WARC-Target-URI")), _NONE if page is None else page, name, offset, length))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["key", "id", "path", "offset", "length"])

    out = archives(spark, path)
    out = map_batches(out, scan, CAPTURE)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is an archive
    return out


def build_index(spark: SparkSession, path: str, index: str) -> None:
    """Sorted captures as compressed blocks: (part, block, first_key, first_id, lines) under ``index``."""
    raw = f"{index}/captures"
    captures(spark, path).write.parquet(raw)
    rows = spark.read.parquet(raw)
    parts = max(1, -(-rows.count() // CAPTURES_A_PART), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, []

        def block(lines: list[tuple]) -> pa.RecordBatch:
            text = "\n".join("\t".join(map(str, x)) for x in lines)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([lines[0][0]]), pa.array([lines[0][1]]), pa.array([zlib.compress(text.encode(), 6)], pa.binary())], names=["part", "block", "first_key", "first_id", "lines"])

        for batch in it:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "id", "path", "offset", "length")), strict=True)
            while len(held) >= CAPTURES_A_BLOCK:
                yield block(held[:CAPTURES_A_BLOCK])
                held, n = held[CAPTURES_A_BLOCK:], n + 1
        if held:
            yield block(held)

    dealt = rows.repartitionByRange(parts, "key", "id", "path", "offset").sortWithinPartitions("key", "id", "path", "offset")
    map_batches(dealt, blocks, "part long, block long, first_key string, first_id long, lines binary").write.parquet(f"{index}/blocks")


def find_captures(wanted: DataFrame, index: str) -> DataFrame:
    """Captures of the different (url, page_id) of ``wanted``."""
    spark = wanted.sparkSession
    blocks = spark.read.parquet(f"{index}/blocks")
    # the first key of each part: as many rows as the index was dealt to parts
    firsts = sorted((r.k[0].encode(), r.k[1], r.part) for r in blocks.groupBy("part").agg(F.min(F.struct("first_key", "first_id")).alias("k")).collect())
    keys, numbers = [x[:2] for x in firsts], [x[2] for x in firsts]

    def part_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = [url_key(target(u)) for u in batch.column("url").to_pylist()]
            ids = [_NONE if i is None else i for i in batch.column("page_id").to_pylist()]
            # equal keys may go on in the next part, so the part before the first larger key and those that start with the key itself
            found = []
            for k, i in zip(own, ids, strict=True):
                hi = bisect.bisect_right(keys, (k.encode(), i))
                lo = max(0, bisect.bisect_left(keys, (k.encode(), i)) - 1)
                found += [(numbers[p], k, i) for p in range(lo, hi)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["part", "key", "id"])

    def search(probes: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        part = part.sort_values("block")
        directory = [(k.encode(), i) for k, i in zip(part.first_key, part.first_id, strict=True)]
        packed, at, lines, have = list(part["lines"]), -1, [], []
        for key, i in sorted((k.encode(), i) for k, i in zip(probes.key, probes.id, strict=True)):
            b = max(0, bisect.bisect_left(directory, (key, i)) - 1)
            while b < len(directory) and directory[b] <= (key, i):
                if b != at:
                    lines = [x.split("\t") for x in zlib.decompress(packed[b]).decode().split("\n")]
                    have, at = [(x[0].encode(), int(x[1])) for x in lines], b
                for n in range(bisect.bisect_left(have, (key, i)), bisect.bisect_right(have, (key, i))):
                    out.append((lines[n][0], int(lines[n][1]), lines[n][2], int(lines[n][3]), int(lines[n][4])))
                b += 1
        return pd.DataFrame(out, columns=["key", "id", "path", "offset", "length"])

    probes = map_batches(wanted.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url"), part_of, "part long, key string, id long").distinct()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return probes.groupBy("part").cogroup(blocks.groupBy("part")).applyInPandas(search, CAPTURE)


def read_captures(found: DataFrame, path: str) -> DataFrame:
    """The records at the captures' byte ranges: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit)."""
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def ranges(wanted: pd.DataFrame, archive: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(wanted):
            content = archive.content.iloc[0]
            for offset, length in sorted(zip(wanted.offset, wanted.length, strict=True)):
                fields, payload, n = parse(zlib.decompressobj(31).decompress(content[offset : offset + length]))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and (payload_digest(payload) != digest or len(payload) != n):
                    raise ValueError(f"{archive.path.iloc[0]} at {offset}: the payload does not have its digest")
                out.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], n, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload if kind == "response" else None))
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return found.groupBy("path").cogroup(archives(found.sparkSession, path).groupBy("path")).applyInPandas(ranges, schema)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``folder`` (by default a new one in the shared folder), index them, and read every page back through the index."""
    spark = pages.sparkSession
    folder = folder or os.path.join(ensure_checkpoint_dir(spark), "tables", f"warc-{uuid.uuid4().hex}")
    write_archives(pages, f"{folder}/archives", least)
    build_index(spark, f"{folder}/archives", f"{folder}/index")
    return read_captures(find_captures(pages, f"{folder}/index"), f"{folder}/archives")
