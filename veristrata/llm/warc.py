"""WARC archives: a writer with payload deduplication, and a reader that salvages what follows damage.

The reader checks each gzip member (checksum and length) and each record (version line, content length, closing blank lines, block
digest). After a failed check it searches for the next member or version line that passes, goes on from there, and logs the bytes
between as a quarantined gap, inside a member too. Archives are rows of a table, which Spark's own writers commit, so no task touches a file system.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _shared

#: Shorter payloads are always stored.
LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 4 << 20
#: Rows of repeated payloads that are sent to every task; a longer table is joined by a shuffle.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r?\n")
_BLANK = re.compile(rb"\r?\n\r?\n")
#: Longer headers are damage; so a search for their end costs no more.
HEADER_BYTES = 1 << 20


@dataclass
class Found:
    """A record, or a gap (type "gap", with the reason and no headers), and where it stands in the archive."""

    offset: int
    length: int
    type: str
    headers: dict[str, str]
    block: bytes
    reason: str = ""


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = [(k, "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in v)) for k, v in headers]
    lines = [("WARC-Type", kind), *clean, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _parse(data: bytes, at: int) -> tuple[Found | None, str]:
    """The record at a position, or what is wrong with it."""
    m = _VERSION.match(data, at)
    if not m:
        return None, "no version line"
    end = _BLANK.search(data, m.end() - 1, m.end() + HEADER_BYTES)
    if not end:
        return None, "no end of headers"
    headers: dict[str, str] = {}
    last = ""
    for line in data[m.end() : end.start()].decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            headers[last] = value.strip()
        else:
            return None, "bad header line"
    size = headers.get("content-length", "")
    if not size.isdigit():
        return None, "no content length"
    stop = end.end() + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, "no blank lines behind the block"
    block = data[end.end() : stop]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        return None, "block digest differs"
    return Found(at, stop + 4 - at, headers.get("warc-type", ""), headers, block), ""


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at a position holds, as far as it can be read; where it ends, or -1 and what is wrong with it."""
    z, out, i = zlib.decompressobj(31), [], at
    while i < len(data) and not z.eof:
        before, part = z.copy(), data[i : i + (16 << 10)]
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            # once more by single bytes, to keep what stands before the error
            for j in range(len(part)):
                try:
                    out.append(before.decompress(part[j : j + 1]))
                except zlib.error:
                    break
            return b"".join(out), -1, str(e)
        i += len(part)
    return (b"".join(out), i - len(z.unused_data), "") if z.eof else (b"".join(out), -1, "member is cut short")


def _member(data: bytes, at: int) -> tuple[list[Found], int, str]:
    """Records of the gzip member at a position, gaps between them, and where it ends; -1 and the reason if the member itself is damaged.

    After a record that fails, the next version line inside the member is tried. In a member with an error in its data or checksum, only
    records with a SHA-256 block digest that agrees count. What comes from a damaged member, and each gap inside one, has the
    member's offset and no length: the bytes are counted with the member. Without any record the list is empty.
    """
    plain, end, reason = _inflated(data, at)
    sure, length = end >= 0 or reason == "member is cut short", max(end - at, 0)
    inner, gap, why, out = 0, -1, "", []
    while inner < len(plain):
        got, wrong = _parse(plain, inner)
        if got and not sure and not got.headers.get("warc-block-digest", "").startswith("sha256:"):
            got, wrong = None, "no digest in a damaged member"
        if got:
            if gap >= 0:
                out.append(Found(at, 0, "gap", {}, b"", f"{why}, bytes {gap} to {inner} of the member"))
                gap = -1
            inner += got.length
            out.append(Found(at, length, got.type, got.headers, got.block))
            continue
        if gap < 0:
            gap, why = inner, wrong
        line = _VERSION.search(plain, inner + 1)
        inner = line.start() if line else len(plain)
    if not any(f.type != "gap" for f in out):
        return [], end, reason or why or "empty member"
    if gap >= 0:
        out.append(Found(at, 0, "gap", {}, b"", f"{why}, bytes {gap} to {len(plain)} of the member"))
    return out, end, reason


def read(data: bytes) -> Iterator[Found]:
    """Records of an archive, plain or in gzip members of one or several, and the gaps between them, in order. Every byte is in one of both."""
    at, gap, why = 0, -1, ""
    while at < len(data):
        if data[at : at + 3] == _MAGIC:
            got, end, reason = _member(data, at)
        else:
            one, reason = _parse(data, at)
            got, end = ([one], at + one.length) if one else ([], at)
        if got:
            if gap >= 0:
                yield Found(gap, at - gap, "gap", {}, b"", why)
                gap = -1
            yield from got
            if end >= 0:
                at = end
                continue
        if gap < 0:
            gap, why = at, reason
        line = _VERSION.search(data, at + 1)
        at = min((x for x in (data.find(_MAGIC, at + 1), line.start() if line else -1) if x >= 0), default=len(data))
    if gap >= 0:
        yield Found(gap, len(data) - gap, "gap", {}, b"", why)


ARCHIVE = "archive string, content binary"


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content) rows with a gzip member for each row of pages(page_id, url, payload binary, digest, payload_bytes, refers_to).

    A row whose refers_to isn't null becomes a revisit of that page without the payload, any other a response. Members fill archives
    of about 4 MB. Null urls become empty, control characters in urls are escaped, a null page_id is kept as null.
    """

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            content = b"".join(pending)
            pending.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:16]]), pa.array([content], pa.binary())], ["archive", "content"])

        for part in batches:
            for i in range(part.num_rows):
                row = {n: part[n][i].as_py() for n in ("page_id", "url", "payload", "digest", "payload_bytes", "refers_to")}
                name = lambda x: f"<urn:page:{'' if x is None else x}>"
                headers = [("WARC-Record-ID", name(row["page_id"])), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", row["url"] or ""), ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("WARC-Payload-Length", str(row["payload_bytes"]))]
                if row["refers_to"] is None:
                    made = record("response", headers, row["payload"] or b"")
                else:
                    made = record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(row["refers_to"]))], b"")
                pending.append(member(made))
                size += len(pending[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if pending:
            yield flush()

    _shared.small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "payload", "digest", "payload_bytes", "refers_to").mapInArrow(archived, ARCHIVE)


RECORD = "archive string, offset long, length long, type string, reason string, page_id {0}, url string, payload_bytes long, payload_digest string, refers_to {0}, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True, page_id: str = "long") -> DataFrame:
    """A row for each record and each quarantined gap (type `gap`) of archives(archive, content).

    A response's payload length and digest are those of its block as read; a revisit's are those that its headers state. Null and
    empty archives have no rows. payloads=False leaves the payload column null. page_id names the type of the pages' ids; an id that
    isn't of it is read as null.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ids(headers: dict[str, str], key: str) -> int | str | None:
            name = headers.get(key, "").removeprefix("<urn:page:").removesuffix(">")
            return (name or None) if page_id == "string" else int(name) if name.removeprefix("-").isdigit() else None

        kind = pa.string() if page_id == "string" else pa.int64()
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind, pa.string(), pa.int64(), pa.string(), kind, pa.binary()]
        for part in batches:
            for archive, content in zip(part["archive"].to_pylist(), part["content"], strict=True):
                rows = []
                for f in read(content.as_py() or b""):
                    h = f.headers
                    full = f.type == "response"
                    size = len(f.block) if full else int(x) if (x := h.get("warc-payload-length", "")).isdigit() else None
                    digest = hashlib.sha256(f.block).hexdigest() if full else h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    rows.append((archive, f.offset, f.length, f.type, f.reason or None, ids(h, "warc-record-id"), h.get("warc-target-uri"), size, digest, ids(h, "warc-refers-to"), f.block if payloads and f.type != "gap" else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    _shared.small_batches(archives.sparkSession)
    return archives.select("archive", "content").mapInArrow(scanned, RECORD.format(page_id))


def deduplicated(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload, payload_bytes, digest and refers_to: the smallest page_id with an equal payload of 100
    bytes or more, null for that page itself (and for all its rows, should its id be repeated).

    A null html is an empty payload. Rows without a page_id count as the largest. Only ids and digests are grouped, with partial
    minima on the map side, so that a payload that very many pages share is one row for each task.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    shared = rows.filter(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    shared = _shared.settle(shared, "warc-shared")
    few = shared.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(shared) if few else shared, "digest", "left")
    own = F.col("__first").isNull() | F.col("page_id").eqNullSafe(F.col("__first"))
    return rows.withColumn("refers_to", F.when(~own, F.col("__first"))).drop("__first")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = _shared.settle(write_archives(deduplicated(pages)), "warc-archives", compression="none")
    found = read_archives(archives, payloads=False, page_id="string" if pages.schema["page_id"].dataType.simpleString() == "string" else "long").filter(F.col("type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
