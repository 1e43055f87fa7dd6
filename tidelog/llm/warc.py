"""WARC archives: a writer with revisit records, and a salvage reader.

``write_archives`` puts one record per row into gzip members of their own and
gathers members into archives of bounded size, which Spark's text sink writes
(with its commit protocol) wherever the path leads.  The sink's separator is
an empty gzip member, or the blank line that ends a record where archives are
not compressed.

``read_archives`` checks every record: the gzip checksum, the version line,
the header lines, the block length, the blank line behind the block and the
block digest.  Where a check fails it searches for the next place that holds a
valid member (or version line), goes on from there and logs the bytes between
as quarantined.  It searches inside a member's content in the same way; of a
member that is cut or fails its checksum it takes the records that come out
whole and carry a block digest that holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Emitter, columns, staged

ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_GZIP = b"\x1f\x8b\x08"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_SLICE = 1 << 14
_COPIES = 1024
HEADER_BYTES = 1 << 20
_EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "path string, start long, length long, record_id string, record_type string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, refers_to string, payload binary, gap_reason string"
)
_RECORD = pa.schema(
    [
        *((n, pa.string() if n == "path" else pa.int64()) for n in ("path", "start", "length")),
        *((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "date", "payload_digest")),
        ("payload_bytes", pa.int64()),
        ("refers_to", pa.string()),
        ("payload", pa.binary()),
        ("gap_reason", pa.string()),
    ]
)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, as in WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """A value on one line: controls are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(
    record_id: str, payload: bytes, uri: str | None = None, refers_to: str | None = None, date: str = DATE, known: tuple[str, int] | None = None
) -> bytes:
    """A resource as a response, or as a revisit of ``refers_to`` whose block is empty.

    A revisit can do without the payload if its digest and size are ``known``.
    """
    kind = "revisit" if refers_to else "response"
    block = b"" if refers_to else payload
    sha, size = known or (digest(payload), len(payload))
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_header_value(uri)}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {size}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []),
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_originals(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """name, url, payload, sha1, size and, for rows that repeat another row's payload, that row's name as ``original``.

    Of equal payloads of at least ``least`` bytes, the row with the smallest id
    (nulls last), then url (nulls first), is the original.  Equal means an
    equal SHA-256.  A name is the id, a dot and a hash of payload, url and id;
    rows that agree in all three are numbered behind the first of them, and of
    ``least`` bytes or more they come without payload.

    Payloads are shuffled once, by name, so that no payload's rows meet in one
    task, be they a third of all; all else is done on rows without payloads.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.col(f"`{url_col}`") if url_col else F.lit(None)).cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"),
    )
    mark = F.concat("sha", F.when(F.col("id").isNull(), "0").otherwise("1"), F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("u"), "url")))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    rows = rows.withColumn("name", F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("."), F.md5(mark)))
    size = F.octet_length("payload").cast("long")
    kinds = rows.groupBy("name", "sha", "id", "url", size.alias("size"), F.sha1("payload").alias("sha1"), F.when(size < least, F.col("payload")).alias("small"))
    kinds = staged(kinds.agg(F.count(F.lit(1)).alias("n")), "warc-rows")
    first = kinds.where(F.col("size") >= least).groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url", "name"))["name"].alias("first"))
    kinds = kinds.join(first, "sha", "left").drop("sha", "id")
    whole = rows.groupBy("name").agg(F.first("payload").alias("payload")).join(kinds, "name")
    whole = whole.select("name", "url", "payload", "sha1", "size", F.when(F.col("first") != F.col("name"), F.col("first")).alias("original"))
    chunks = kinds.where("n > 1").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {_COPIES})"))).repartition("name", "chunk")
    copies = chunks.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {_COPIES}, least(n, (chunk + 1) * {_COPIES}) - 1)"))).where("copy > 0")
    numbered = F.concat("name", F.lit("."), F.col("copy").cast("string"))
    return whole.unionByName(copies.select(numbered.alias("name"), "url", F.col("small").alias("payload"), "sha1", "size", F.col("first").alias("original")))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str | None = "url",
    payload_col: str = "html",
    prefix: str = "urn:page:",
    least: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    compress: bool = True,
) -> None:
    """Write a record per row; record ids are ``prefix`` and the row's name.

    Names keep records apart where ids are repeated or null (see
    ``with_originals``; a null id is written as nothing).  A null payload is
    empty, a null url is left out.  Repeated rows are records of their own: one
    is the response, the others revisit it.  An empty table gives archives without records.  Other columns
    are ignored, whatever their names.  An archive ends once it holds
    ``archive_bytes``.
    """
    rows = with_originals(pages, id_col, url_col, payload_col, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for name, url, payload, sha, n, original in columns(batch, "name", "url", "payload", "sha1", "size", "original"):
                known = base64.b32encode(bytes.fromhex(sha)).decode(), n
                raw = record(prefix + name, (payload or "").encode(), url, prefix + original if original else None, known=known)
                if compress:
                    raw = zlib.compress(raw, 6, 31)
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    archives = rows.mapInArrow(run, "archive binary")
    if not compress:  # the sink's separator is the blank line that ends the last record
        archives = archives.select(F.expr("substring(archive, 1, octet_length(archive) - 4)").alias("archive"))
    sink = archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).mode("overwrite")
    sink = sink.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1") if compress else "\r\n\r\n")
    sink.text(path)


@dataclass
class Found:
    """A record, or a gap (without ``head``) with the bytes that were left out.

    ``start`` and ``length`` are places in the archive.  What shares a member
    with an earlier record or gap has the member's start and length 0.
    """

    start: int
    length: int
    head: dict[str, str] | None
    payload: bytes
    reason: str | None = None


class Damaged(Exception):
    """A check failed."""


def parse(raw: bytes, at: int = 0, proven: bool = False) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case), block and end of the record at ``at``; ``proven``: only with a block digest."""
    if not _VERSION.match(raw, at):
        raise Damaged("version line")
    end = raw.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if end < 0:
        raise Damaged("header without end")
    head: dict[str, str] = {}
    last = ""
    for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            head[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line")
        last = name.strip().lower()
        head[last] = value.strip()
    if not re.fullmatch(r"\d+", head.get("content-length", "")):
        raise Damaged("content length")
    stop = end + 4 + int(head["content-length"])
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block length")
    block = raw[end + 4 : stop]
    named = head.get("warc-block-digest", "")
    if (proven or named.startswith("sha1:")) and named[5:] != digest(block):
        raise Damaged("block digest")
    return head, block, stop + 4


def _member(raw: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at ``at``, and what is wrong with it; then the content is what could be read.

    The archive is fed slice by slice, so that a member costs its own size.
    """
    reader, view, parts, end = zlib.decompressobj(31), memoryview(raw), [], at
    while not reader.eof:
        if end == len(raw):
            return b"".join(parts), end, "gzip member without end"
        part = view[end : end + _SLICE]
        end += len(part)
        try:
            parts.append(reader.decompress(part))
        except zlib.error:
            return b"".join(parts), end, "gzip data"
    return b"".join(parts), end - len(reader.unused_data), None


def _inside(content: bytes, proven: bool) -> Iterator[tuple[dict[str, str] | None, bytes, str | None]]:
    """Records and gaps of a member's content: header, block or bytes, reason."""
    at, gap, reason = 0, None, None
    while at < len(content):
        try:
            head, block, end = parse(content, at, proven)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = content.find(b"WARC/1.", at + 1)
            at = len(content) if at < 0 else at
            continue
        if gap is not None:
            yield None, content[gap:at], reason
            gap = None
        yield head, block, None
        at = end
    if gap is not None:
        yield None, content[gap:], reason


def salvage(raw: bytes) -> Iterator[Found]:
    """Records and gaps of an archive; their bytes add up to the archive.

    They come in order, but for records out of a broken member, which come
    before the gap that holds its bytes.
    """
    at, gap, reason = 0, None, ""
    while at < len(raw):
        if raw.startswith(_GZIP, at):
            content, end, wrong = _member(raw, at)
            found = [x for x in _inside(content, wrong is not None) if wrong is None or x[0]]
        else:
            wrong, found, end = None, [], at
            try:
                head, block, end = parse(raw, at)
                found = [(head, block, None)]
            except Damaged as e:
                wrong = str(e)
        if wrong is None and found and not any(head for head, _, _ in found):
            wrong = found[0][2]  # a member without any record, as a chance match of its first bytes
            found = []
        if wrong is not None:
            for head, block, _ in found:
                yield Found(at, 0, head, block)
            if gap is None:
                gap, reason = at, wrong
            spot = _NEXT.search(raw, at + 1)  # the next place that may hold a member or a version line
            at = spot.start() if spot else len(raw)
            continue
        if gap is not None:
            yield Found(gap, at - gap, None, raw[gap:at], reason)
            gap = None
        for i, (head, block, inner) in enumerate(found):
            yield Found(at, (end - at) if i == 0 else 0, head, block, inner)
        at = end
    if gap is not None:
        yield Found(gap, len(raw) - gap, None, raw[gap:], reason)


def _bare(identifier: str | None) -> str | None:
    return identifier.strip().removeprefix("<").removesuffix(">") if identifier else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record and per gap of all archives below ``path``.

    A gap has ``gap_reason`` (the first check that failed), its bytes as
    ``payload`` and nulls in the record's columns.  A revisit's payload is
    null; ``payload_bytes`` and ``payload_digest`` are those of the full
    payload, for a response taken from its bytes.  Archives are read whole:
    they should be of bounded size, as the writer's are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(_RECORD)
        for batch in batches:
            for i in range(batch.num_rows):
                where, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for x in salvage(raw):
                    if x.head is None:
                        row = (where, x.start, x.length, None, None, None, None, None, None, None, x.payload, x.reason)
                    else:
                        revisit = x.head.get("warc-type") == "revisit"
                        sha = x.head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(x.payload)
                        size = int(n) if revisit and (n := x.head.get("x-payload-length", "")).isdigit() else None if revisit else len(x.payload)
                        row = (
                            *(where, x.start, x.length, _bare(x.head.get("warc-record-id")), x.head.get("warc-type"), x.head.get("warc-target-uri")),
                            *(x.head.get("warc-date"), sha, size, _bare(x.head.get("warc-refers-to")), None if revisit else x.payload, None),
                        )
                    out.add(row, len(x.payload))
                    if out.full():
                        yield out.take()
        if out.rows:
            yield out.take()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD_SCHEMA)
