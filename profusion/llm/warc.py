"""WARC: archives with an index that is read first, and coalesced byte-range reads of selected records.

Records are gzip members in archives of bounded size. Archives are rows of a table in the shared folder, since executors
can write files only through Spark. A row is a block of an archive: whole records of about ``BLOCK_BYTES``,
and entries, the index of offset, length, URL and digest per record. The table is written in small row
groups with a key that rises within a file. A selection first reads the entries alone, without any content;
then only the row groups that may hold the blocks of the selected records; then, within a block, it sorts the
byte ranges, joins ranges with small gaps and reads each joined range once. The same reader serves
files: ``export`` writes archives to a folder, ``read_ranges`` takes any seekable file.

Of pages with equal payloads the one with the smallest page_id is a response record, the others are
revisit records that carry the HTTP header (and so the payload's length) but not the payload. Only
digests that occur more than once are looked up; they are broadcast up to ``BROADCAST_ROWS`` rows and
joined by a shuffle beyond.

Defined cases: a null html is an empty payload; a null URL is written as ``urn:page:ID``; control
characters and spaces in URLs are percent-encoded; pages without page_id come after all others (the first
of a group without any id is every one of them: all are responses); rows that repeat a page_id and its payload
are all responses; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profusion.llm.common import slices, task
from profusion.session import written

ARCHIVE_BYTES, BLOCK_BYTES, GAP, LEVEL = 4 << 20, 256 << 10, 64 << 10, 6
#: Keys that a selection hands to the scan as a filter; more are joined.
PUSHED_KEYS = 500
#: Row groups of about a megabyte, looked at after each row.
ROW_GROUPS = {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size": 64 << 10}
BROADCAST_ROWS = 1_000_000
DATE = "2000-01-01T00:00:00Z"
ENTRY = "struct<page_id:long,offset:long,length:long,url:string,digest:string,record_type:string>"
_BAD = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(url: str | None, page_id: int | None) -> str:
    return _BAD.sub(lambda m: f"%{ord(m.group()):02X}", url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit if ``refers_to`` is given."""
    digest, revisit = payload_digest(payload), refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_target(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}", *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, record_type, refers_to, url, payload (None for revisits), payload_bytes, digest of a record; checks the digest."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(head["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    number = lambda k: int(head[k]) if k in head else None
    out = {"page_id": number("x-page-id"), "record_type": head["warc-type"], "refers_to": number("x-refers-to-page-id"), "url": head["warc-target-uri"], "payload": None, "payload_bytes": size, "payload_digest": digest}
    if head["warc-type"] == "response":
        if len(body) != size or payload_digest(body) != digest:
            raise ValueError(f"the payload of page {out['page_id']} does not have its digest")
        out["payload"] = body
    return out


def coalesced(ranges: Iterable[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges joined over gaps: (start, end, ranges)."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in sorted(ranges):
        if out and offset - out[-1][1] <= gap:
            start, end, own = out[-1]
            own.append((offset, length))
            out[-1] = start, max(end, offset + length), own
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read_ranges(file, ranges: Iterable[tuple[int, int]], gap: int = GAP) -> Iterator[bytes]:
    """The records at the ranges of a seekable file, in offset order; each joined range is read once."""
    for start, end, own in coalesced(ranges, gap):
        file.seek(start)
        data = file.read(end - start)
        for offset, length in own:
            yield zlib.decompress(data[offset - start : offset - start + length], 31)


@task
def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    kind = pa.struct([("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
    part, archive, number, start, size, members, entries = TaskContext.get().partitionId(), 0, 0, 0, 0, [], []

    def block() -> pa.RecordBatch:
        name = f"{part:08d}-{archive:06d}.warc.gz"
        return pa.RecordBatch.from_arrays([pa.array([f"{name}/{number:08d}"]), pa.array([name]), pa.array([start], pa.int64()), pa.array([b"".join(members)], pa.binary()), pa.array([entries], pa.list_(kind))], names=["key", "archive", "start", "content", "entries"])

    for whole in batches:
        for batch in slices(whole, "html"):
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                raw = record(page_id, url, payload, refers_to)
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = pack.compress(raw) + pack.flush()
                entries.append({"page_id": page_id, "offset": size, "length": len(member), "url": url, "digest": payload_digest(payload), "record_type": "response" if refers_to is None else "revisit"})
                members.append(member)
                size += len(member)
                if size - start >= BLOCK_BYTES or size >= ARCHIVE_BYTES:
                    yield block()
                    number, start, members, entries = number + 1, size, [], []
                    if size >= ARCHIVE_BYTES:
                        archive, number, start, size = archive + 1, 0, 0, 0
    if members:
        yield block()


def write_archives(pages: DataFrame) -> DataFrame:
    """The archives of the pages, written to the shared folder as blocks: key, archive, start, content, entries."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"))
    often = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    often = written(often, "repeated-payloads")
    small = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    known = rows.join(small, "sha1", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return written(known.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_write, f"key string, archive string, start long, content binary, entries array<{ENTRY}>"), "archives", **ROW_GROUPS)


def index_of(archives: DataFrame) -> DataFrame:
    """The index: key and archive of the block, page_id, offset (in the archive), length, url, digest, record_type. Reads no content."""
    return archives.select("key", "archive", F.explode("entries").alias("e")).select("key", "archive", "e.*")


RECORD = "archive string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def read_records(archives: DataFrame, select: Callable[[Column], Column] | None = None, payload: bool = True) -> DataFrame:
    """The records whose index entry ``select`` picks (all by default), parsed and checked.

    A selection reads the index first, then the blocks that hold its records. ``payload`` False leaves the payload
    column null, once its digest has been checked.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    names = RECORD.replace(" string", "").replace(" long", "").replace(" binary", "").split(", ")
    kinds = {"long": T.LongType(), "string": T.StringType(), "binary": T.BinaryType()}
    schema = T.StructType([T.StructField(*(n, kinds[k])) for n, k in (x.split(" ") for x in RECORD.split(", "))])
    arrow = to_arrow_schema(schema)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "content"):
                rows = []
                for name, start, content, entries in zip(*(batch.column(c).to_pylist() for c in ("archive", "start", "content", "entries")), strict=True):
                    for raw in read_ranges(io.BytesIO(content), [(e["offset"] - start, e["length"]) for e in entries]):
                        got = parse(raw) | {"archive": name}
                        rows.append(got if payload else got | {"payload": None})
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in zip(names, arrow, strict=True)], schema=arrow)

    picked = archives if select is None else selected(archives, select)
    return picked.select("archive", "start", "content", "entries").mapInArrow(run, schema)


def selected(archives: DataFrame, select: Callable[[Column], Column]) -> DataFrame:
    """The blocks that hold records whose entry ``select`` picks, with the entries of these records."""
    own = F.filter("entries", select)
    keys = written(archives.select("key", F.size(own).alias("n")).filter("n > 0").select("key"), "selected-blocks")  # no content is read
    n = keys.count()
    if n <= PUSHED_KEYS:
        blocks = archives.filter(F.col("key").isin([r["key"] for r in keys.collect()]))
    else:
        blocks = archives.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, "key", "left_semi")
    return blocks.withColumn("entries", own)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write the archives as .warc.gz files to a folder of the driver; a few blocks are held at a time."""
    os.makedirs(folder, exist_ok=True)
    out: list[str] = []
    for r in archives.select("key", "archive", "content").orderBy("key").toLocalIterator():
        path = os.path.join(folder, r["archive"])
        with open(path, "ab" if out and out[-1] == path else "wb") as f:
            f.write(r["content"])
        if not out or out[-1] != path:
            out.append(path)
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's query: write all pages, read the index, then the ranges of the records it lists, here all of them."""
    return read_records(write_archives(pages), lambda entry: entry["length"] > 0, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no SHA-1 in base 32, so the digest is made from its hexadecimal form, five bits at a time.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages),
b AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(h, CAST(i AS INT) + 1, 1)) - 1) AS nib FROM p),
bits AS (SELECT *, list_reduce(list_transform(nib, lambda n: right(CAST(CAST(n AS BIT) AS VARCHAR), 4)), lambda x, y: x || y) AS s FROM b)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(s, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(s, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(s, CAST(5 * i + 3 AS INT), 1) AS INT)
           + 2 * CAST(substr(s, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(s, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""
