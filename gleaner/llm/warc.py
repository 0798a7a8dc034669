"""WARC archives: one gzip member per record, written by Spark's file writer and read by byte ranges.

Writer: each record becomes one gzip member; a task's members stand one after
another in one file. The files go through Spark's own writer and its commit, so
a lost executor leaves no half archive. That writer ends every row with a
separator byte; a gzip member ends with the high byte of its length, which is 0
below 16 MiB, so this byte is left to the separator and the file is a plain
sequence of members. A longer member is followed by one zero byte, which gzip
readers skip as padding.

Reader: files are cut into byte ranges. A task looks for the gzip magic from the
start of its range, takes a place for a member only if its header and first bytes
decode to a record header, and owns the records that start inside its range, also where
they end in a later one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import maybe_broadcast, short_batches
from gleaner.session import fresh_dir, stage

#: Payloads below this size are never replaced by a revisit record.
REVISIT_BYTES = 0

#: Bytes of a range, and of one read.
RANGE_BYTES, READ_BYTES = 64 << 20, 1 << 20

# Fixed values of the archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """SHA-1 in bare upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """One gzip member; no time stamp, so equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return MAGIC + b"\x00\x00\x00\x00\x00\x00\xff" + body + tail


def _line(value) -> str:
    """A header value on one line."""
    return "" if value is None else " ".join(str(value).split())


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with its payload, or a revisit that names the response."""
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = STATUS + (b"" if refers_to is not None else payload)
    fields.append(("Content-Length", str(len(block))))
    head = "\r\n".join([VERSION, *[f"{k}: {v}" for k, v in fields]]).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [(v.as_py() or "").encode() for v in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()),
                pa.array([len(p) for p in payloads], pa.int64()),
            ],
            ["page_id", "same", "bytes"],
        )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = []
        for page_id, url, html, keeper in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keeper")]):
            payload = (html or "").encode()
            data = member(record(page_id, url, payload, digest_of(payload), keeper))
            lines.append(data[:-1] if data[-1] == 0 else data)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])


def write(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives of ``pages`` (``page_id``, ``url``, ``html``) below ``path``, one record per row.

    Of equal payloads of at least ``revisit_bytes`` bytes the record with the
    largest ``page_id`` is a response and the others revisit it; rows that repeat
    that id are all responses, and so is every row without an id. Null html is
    an empty payload. Payloads meet by length and SHA-256; only ids and digests
    are shuffled, pages go straight from the scan to the archive.
    """
    short_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    facts = stage(rows.mapInArrow(_summaries, "page_id long, same binary, bytes long"), "warc-facts")
    groups = facts.filter(F.col("bytes") >= revisit_bytes).groupBy("same", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    seen = facts.join(groups.filter("n > 1 AND keeper IS NOT NULL"), ["same", "bytes"])
    # One id may stand in rows with different pages: the payload's own digest goes with it.
    links = stage(seen.filter("page_id < keeper").select(F.col("page_id").alias("_id"), "same", "keeper").distinct(), "warc-links")
    links = maybe_broadcast(links, links.count())
    own = F.unhex(F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256))
    linked = rows.withColumn("_same", own).join(links, (F.col("page_id") == F.col("_id")) & (F.col("_same") == F.col("same")), "left")
    data = linked.select("page_id", "url", "html", "keeper").mapInArrow(_members, "value binary")
    data.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


def opened(path: str):
    """A readable, seekable file: a local or mounted path, or any scheme that Arrow's file systems know."""
    place = urlparse(path)
    if place.scheme in ("", "file"):
        return open(unquote(place.path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class _Window:
    """Bytes of a file from a position on, read as needed."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _inflated(window: _Window) -> tuple[bytes, int] | None:
    """The member at the window's start and its compressed length, or nothing if it is none.

    The first bytes that come out must open a record header; a chance magic in
    the middle of a member is refused there, after a few bytes.
    """
    unpacker, out, used, opening = zlib.decompressobj(31), [], 0, VERSION.split("/")[0].encode() + b"/"
    while True:
        if used == len(window.data) and not window.more():
            return None
        chunk = window.data[used:]
        try:
            out.append(unpacker.decompress(chunk))
        except zlib.error:
            return None
        if len(out) > 1 and len(out[0]) < len(opening):
            out = [b"".join(out)]
        if out[0] and not out[0].startswith(opening[: len(out[0])]):
            return None
        used = len(window.data) - len(unpacker.unused_data)
        if unpacker.eof:
            whole = b"".join(out)
            return (whole, used) if whole.startswith(opening) else None


def records_in(path: str, start: int, end: int) -> Iterator[tuple[int, dict, bytes]]:
    """(position, header fields, block) of the records that start in ``[start, end)``."""
    with opened(path) as file:
        window = _Window(file, start)
        while window.at < end:
            found = window.data.find(MAGIC)
            if found < 0:
                keep = min(len(window.data), len(MAGIC) - 1)
                window.skip(len(window.data) - keep)
                if not window.more():
                    return
                continue
            window.skip(found)
            if window.at >= end:
                return
            got = _inflated(window)
            if got is None:
                window.skip(1)
                continue
            whole, used = got
            head, _, block = whole.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
            yield window.at, fields, block[: int(fields.get("Content-Length", len(block)))]
            window.skip(used)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "position", "record_type", "record_id", "url", "payload_digest", "refers_to", "payload"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for path, start, end in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "end")]):
            rows, held = [], 0
            for position, fields, block in records_in(path, start, end):
                payload = block.partition(b"\r\n\r\n")[2]
                rows.append((
                    path, position, fields.get("WARC-Type"), fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI"),
                    fields.get("WARC-Payload-Digest"), fields.get("WARC-Refers-To"), payload,
                ))
                held += len(payload)
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all archives below ``path``: ``path, position, record_type, record_id, url, payload_digest, refers_to, payload``.

    The listing holds names and lengths only; ranges of ``range_bytes`` are dealt
    out one to a task. Bytes that belong to no record are skipped.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.select("path", F.explode(starts).alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    n = max(1, ranges.count())
    return ranges.repartition(n).mapInArrow(
        _read,
        "path string, position long, record_type string, record_id string, url string, payload_digest string, refers_to string, payload binary",
    )


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch.column("payload").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("record_id", "record_type", "refers_to", "payload_digest")],
                pa.array([len(p) for p in payloads], pa.int64()), pa.array([digest_of(p) for p in payloads], pa.string()),
            ],
            ["record_id", "record_type", "refers_to", "payload_digest", "bytes", "own"],
        )


def page_number(column: str):
    return F.regexp_extract(F.col(column), r"^<urn:page:(-?\d+)>$", 1)


def round_trip(pages: DataFrame, path: str | None = None, revisit_bytes: int = REVISIT_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record, as read back from the archives of ``pages``.

    A response's length and digest are those of the payload read; a revisit has
    those of the response it names.
    """
    spark = pages.sparkSession
    path = path or fresh_dir(spark, "warc")
    write(pages, path, revisit_bytes)
    got = read(spark, path, range_bytes).select("record_id", "record_type", "refers_to", "payload_digest", "payload")
    types = "record_id string, record_type string, refers_to string, payload_digest string, bytes long, own string"
    facts = got.mapInArrow(_facts, types).withColumn("page_id", F.nullif(page_number("record_id"), F.lit("")).cast("long"))
    facts = stage(facts.withColumn("refers_to", F.nullif(page_number("refers_to"), F.lit("")).cast("long")), "warc-read")
    bare = F.regexp_replace("payload_digest", "^sha1:", "")
    responses = facts.filter("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    revisits = facts.filter("record_type = 'revisit'").select("page_id", bare.alias("payload_digest"), "record_type", "refers_to")
    named = responses.select(F.col("page_id").alias("_to"), "payload_bytes", F.col("payload_digest").alias("_digest")).distinct()
    told = revisits.join(named, (F.col("refers_to") == F.col("_to")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return responses.unionByName(told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
