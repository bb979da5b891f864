"""WARC archives: a deduplicating writer and a salvage reader.

The writer makes one record per page, a gzip member each: the page with the smallest id of those with equal payloads
is a ``response``, the others are ``revisit`` records that name it and carry no payload. The reader takes members one
by one. Where a check fails (gzip data, version line, header, length or digest) it searches for the next valid member
or, in plain archives, the next version line, goes on from there, and logs the byte range that it left out.

Defined results: a null payload is an empty one; pages that share an id and a payload are records of the same kind; pages that share
an id but not the payload are told apart by it; a null url is written as an empty one, and characters that would break a header line are
percent-encoded; a null page_id comes before all others; an empty table makes no archive and an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialise, pick, pieces, publish, scratch

#: Bytes that the reader asks for at once. A header may be of any length: a url has no bound.
READ_BYTES = 1 << 20
VERSION = b"WARC/1."
_MEMBER = b"\x1f\x8b\x08"
_DATE = "2000-01-01T00:00:00Z"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def kinds(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, first): first is the page that holds the payload. Only ids and digests are shuffled.

    The group of a payload is aggregated before the shuffle, so one that a third of all pages share is one row a task;
    joined back it meets a single row, and adaptive execution can split the pages of a large group.
    """
    ids = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    ids = materialise(ids, "warc-ids")
    firsts = ids.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min(F.struct(F.col("page_id").isNotNull(), "page_id"))["page_id"].alias("first"))
    return ids.distinct().join(firsts, "sha1", "left").select("page_id", "sha1", F.when(F.col("n") >= least_bytes, F.col("first")).otherwise(F.col("page_id")).alias("first"))


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record, without compression. ``first``: the page with the same payload that is stored in full."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    revisit = first != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{uri}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {'' if first is None else first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write(pages: DataFrame, folder: str, compress: bool = True, least_bytes: int = 0) -> DataFrame:
    """Writes archives to ``folder``, one per partition of the join that tells the kinds of records; returns their names as (archive).

    The pages are shuffled once, by that join; a task streams its partition to its archive.
    """
    spark = pages.sparkSession
    p = pick(pages, page_id="long", url="string", html="string")
    kind = kinds(p, least_bytes)
    p = p.withColumn("sha1", F.sha1(F.coalesce("html", F.lit(""))))
    both = p.alias("p").join(kind.alias("k"), F.col("p.page_id").eqNullSafe(F.col("k.page_id")) & (F.col("p.sha1") == F.col("k.sha1")))
    dealt = both.select("p.page_id", "url", "html", "first")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = iter(batches)
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        name = f"pages-{TaskContext.get().partitionId():05d}.warc" + ".gz" * compress

        def body(out) -> None:
            for b in pieces((x for part in ([first], batches) for x in part), text="html"):
                for r in b.to_pylist():
                    data = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["first"])
                    out.write(member(data) if compress else data)

        publish(f"{folder}/{name}", body)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])

    made = sorted(r.archive for r in dealt.mapInArrow(save, "archive string").collect())
    return spark.createDataFrame([(x,) for x in made], "archive string")


class Window:
    """A stretch of a stream that is read once, forwards; ``at`` is the offset of its first byte. ``size``: bytes of the whole stream, if known."""

    def __init__(self, stream, size: int | None = None):
        self.stream, self.size, self.data, self.at, self.ended = stream, size, b"", 0, False

    def more(self) -> bool:
        got = b"" if self.ended else self.stream.read(READ_BYTES)
        self.ended = not got
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


class Damaged(ValueError):
    """What lies at the offset is not a whole, valid record."""


def _parsed(data: bytes) -> tuple[dict[str, str], int, int]:
    """(header, start and length of the block) of a record that begins ``data``; raises if its header is not valid."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or end < 0:
        raise Damaged("no version line or header")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    header = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    if not header.get("content-length", "").isdigit():
        raise Damaged("no length")
    return header, end + 4, int(header["content-length"])


def _checked(header: dict[str, str], block: bytes) -> dict[str, str]:
    if header.get("warc-block-digest", "sha1:" + _digest(block)) != "sha1:" + _digest(block):
        raise Damaged("the block's digest differs")
    if header.get("warc-type") == "response" and "warc-payload-digest" in header:
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        if header["warc-payload-digest"] != "sha1:" + _digest(payload):
            raise Damaged("the payload's digest differs")
    return header


def _from_member(w: Window) -> tuple[dict[str, str], bytes, int]:
    """(header, block, bytes taken) of the gzip member at the start of the window.

    It is inflated step by step, and no further than its record's header says.
    """
    z, data, used, most = zlib.decompressobj(31), bytearray(), 0, None
    try:
        while not z.eof:
            if used == len(w.data) and not w.more():
                raise Damaged("the member is cut off")
            part = w.data[used : used + READ_BYTES]
            used += len(part)
            while part and not z.eof:
                data += z.decompress(part, READ_BYTES)
                part = z.unconsumed_tail
                if most is None and data.find(b"\r\n\r\n") >= 0:
                    _, start, length = _parsed(bytes(data))
                    most = start + length + 4
                if most is not None and len(data) > most or most is None and not data.startswith(VERSION[: len(data)]):
                    raise Damaged("the member holds something else than its header says")
        used -= len(z.unused_data)
    except zlib.error as e:
        raise Damaged(str(e)) from e
    header, start, length = _parsed(bytes(data))
    if len(data) < start + length:
        raise Damaged("the block is cut off")
    block = bytes(data[start : start + length])
    return _checked(header, block), block, used


def _from_plain(w: Window) -> tuple[dict[str, str], bytes, int]:
    seen = 0
    while w.data.find(b"\r\n\r\n", seen) < 0:
        seen = max(0, len(w.data) - 3)  # the end of the header may lie across two reads
        if not w.more():
            break
    header, start, length = _parsed(w.data)
    if w.size is not None and w.at + start + length + 4 > w.size:
        raise Damaged("the length goes beyond the archive")
    while len(w.data) < start + length + 4 and w.more():
        pass
    if w.data[start + length : start + length + 4] != b"\r\n\r\n":
        raise Damaged("the record does not end where its length says")
    block = w.data[start : start + length]
    return _checked(header, block), block, start + length + 4


def salvage(stream, size: int | None = None) -> Iterator[tuple[str, int, object]]:
    """Yields ("record", offset, (header, block)) and ("gap", offset, bytes left out), in the order of the archive.

    A failed check costs the bytes up to the next place that begins a valid record, no more. With the ``size`` of the stream, a
    damaged length that goes beyond it is seen without reading on.
    """
    w, gap = Window(stream, size), None
    while w.data or w.more():
        while len(w.data) < len(VERSION) and w.more():
            pass
        try:
            if w.data.startswith(_MEMBER):
                header, block, used = _from_member(w)
            elif w.data.startswith(VERSION):
                header, block, used = _from_plain(w)
            else:
                raise Damaged("neither a member nor a version line")
        except Damaged:
            gap = w.at if gap is None else gap
            step = 1
            while True:  # the next place that could begin a record
                found = [x for x in (w.data.find(_MEMBER, step), w.data.find(VERSION, step)) if x >= 0]
                if found:
                    w.drop(min(found))
                    break
                w.drop(max(len(w.data) - len(VERSION) + 1, min(step, len(w.data))))
                step = 0
                if not w.more():
                    w.drop(len(w.data))
                    break
            continue
        if gap is not None:
            yield "gap", gap, w.at - gap
            gap = None
        yield "record", w.at, (header, block)
        w.drop(used)
    if gap is not None:
        yield "gap", gap, w.at - gap


def read(spark: SparkSession, folder: str, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records and gaps of the archives: the fields of a page, archive, offset, gap_bytes (null for records) and, if asked for, payload.

    An archive is a task's unit of work and is streamed; a task holds one record at a time.
    """
    n = max(1, archives.count())
    schema = FIELDS + ", archive string, offset long, gap_bytes long" + ", payload binary" * with_payload
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()][: len(names)]

    def rows(archive: str) -> Iterator[tuple]:
        system, path = filesystem(f"{folder}/{archive}")
        number = lambda x: int(x) if x else None
        with system.open_input_file(path) as f:
            for what, at, x in salvage(f, f.size()):
                if what == "gap":
                    yield (None, None, None, None, None, archive, at, x, None)[: len(names)]
                    continue
                h, block = x
                payload = block[block.find(b"\r\n\r\n") + 4 :] if with_payload and h.get("warc-type") == "response" else None
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                yield (number(h.get("x-page-id")), number(h.get("x-payload-length")), digest, h.get("warc-type"), number(h.get("x-refers-to-page-id")), archive, at, None, payload)[: len(names)]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in (a for b in batches for a in b.column("archive").to_pylist()):
            held, size = [], 0
            for r in rows(archive):
                held.append(r)
                size += len(r[-1] or b"") if with_payload else 0
                if len(held) >= 1000 or size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return archives.select("archive").repartition(n).mapInArrow(load, schema)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives and reads every record's fields back from them."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    back = read(spark, folder, write(pages, folder))
    return back.where("gap_bytes is null").select(*[x.split(" ")[0] for x in FIELDS.split(", ")])


#: SHA-1 in base 32: five hexadecimal digits are four letters.
QUERY_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p
"""
