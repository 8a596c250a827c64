"""WARC archives: a writer with revisits, and a reader that salvages what a damaged archive still holds.

`write` makes one record per page, each a gzip member of its own, so that a damaged byte costs its record alone. Equal
payloads are told by SHA-1: the smallest page_id holds the payload, the others revisit it. Only (page_id, digest) pairs are
shuffled for that; payloads move only if the table of revisits is too large for Spark to broadcast. Members travel in
segments of about `SEGMENT_BYTES` through Spark's text writer, at most `PER_FILE` segments a file, so any store that Spark
writes will do, and the commit protocol covers lost executors. A member ends in the high byte of its length, a zero, which
is left to the writer as its line separator; behind a member of 16 MiB and more, whose length ends otherwise, stands an
empty one.

`read` takes plain and gzipped archives, with one record or many in a member, and records that go on in the next. A record
counts if its version line, header, lengths, closing blank lines and payload digest hold. A member is inflated in steps, and
what comes out before the byte that breaks it is read too. After a failed check the reader searches for the next valid
member or version line, goes on from there, and logs the bytes between as a gap with the reason. An archive is one row of
Spark's binaryFile source, so it has 2 GB at most; of its inflated bytes only the records in hand are kept.

Null html is an empty payload; a null page_id is written as such and is a revisit if others have its payload; rows that
repeat a page_id and its html have the same type. An empty table gives no archive rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm._arrow import frugal, slices
from briarlake.llm._store import Scratch, deleted, fresh_path, written

#: Bytes of gzip members that are written at once, and how many such segments a file has.
SEGMENT_BYTES, PER_FILE = 1 << 20, 64
LEVEL = 4
#: Compressed bytes that are inflated at once.
STEP = 1 << 16
#: Rows, and bytes of payloads, that the reader hands on at once.
ROWS, PAYLOAD_BYTES = 5000, 4 << 20
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, position long"
GAPS = "archive string, first_byte long, end_byte long, reason string"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_BEGIN = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/1\.[01]\r\n")
_EMPTY_HTTP = b"HTTP/"
#: The longest start of a version line that may stand at the end of what has arrived.
_TAIL = 9


def base32_sha1(text):
    """A column's SHA-1 in base 32: five hexadecimal digits are four of base 32."""
    digest = F.sha1(F.encode(text, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def member(data: bytes) -> bytes:
    """The data as a gzip member."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _segment(members: list[bytes]) -> bytes:
    """Members one after another without the last byte, a zero that the text writer adds."""
    data = b"".join(members)
    return data[:-1] if data.endswith(b"\0") else (data + member(b""))[:-1]


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the gzip members of records."""
    held, size = [], 0
    for batch in slices(batches, "record"):
        out = []
        for record in batch.column("record"):
            held.append(member(record.as_buffer()))
            size += len(held[-1])
            if size >= SEGMENT_BYTES:
                out.append(_segment(held))
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([_segment(held)], pa.binary())], ["value"])


def write(pages: DataFrame, path: str, at_least: int = 0) -> None:
    """Writes a record per page under path; payloads shorter than at_least bytes never become revisits."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", base32_sha1(F.col("html")))
    size = F.octet_length(F.encode("html", "UTF-8"))
    narrow = own.select("page_id", "digest", size.alias("n"))
    first = narrow.where(F.col("n") >= at_least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first"))),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(F.encode(block, "UTF-8")).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r\n"),
    )
    with Scratch(pages.sparkSession) as work:
        # the repeated digests are few rows a digest: written, so that Spark may split the join of a digest of many pages
        later = narrow.where(F.col("n") >= at_least).join(work.written(first, "warc-repeated"), "digest").where("page_id is null or page_id <> first")
        later = work.written(later.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct(), "warc-revisits")
        both = own.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
        members = both.select(F.encode(record, "UTF-8").alias("record")).mapInArrow(frugal(_zipped), "value binary")
        members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", PER_FILE).text(path)


@dataclass
class Record:
    position: int
    header: dict[str, str]
    block: bytes = field(repr=False)

    def http(self) -> tuple[bytes, bytes]:
        """Head and body of the HTTP message."""
        head, mark, body = self.block.partition(b"\r\n\r\n")
        return (head, body) if mark and head.startswith(_EMPTY_HTTP) else (b"", self.block)


@dataclass
class Gap:
    first: int
    end: int
    reason: str


#: What is wrong with a record that may yet become whole.
_SHORT = ("unfinished header", "truncated block", "unfinished record")


def _record(data: bytes | bytearray, at: int) -> tuple[Record | None, int, str]:
    """The record at a place, the place behind it (or how many bytes it needs at least), and what is wrong with it."""
    m = _VERSION.match(data, at)
    if not m:
        return None, at, "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None, len(data) + 1, "unfinished header"
    header = {}
    for line in bytes(data[m.end() : end]).split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None, at, "broken header line"
        header[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not header.get("content-length", "").isdigit() or "warc-type" not in header or "warc-record-id" not in header:
        return None, at, "missing header"
    begin = end + 4
    behind = begin + int(header["content-length"])
    if behind > len(data):
        return None, behind + 4, "truncated block"
    if data[behind : behind + 4] != b"\r\n\r\n":
        rest = bytes(data[behind : behind + 4])
        return None, behind + 4, "unfinished record" if len(rest) < 4 and b"\r\n\r\n".startswith(rest) else "no end of record"
    record = Record(at, header, bytes(data[begin:behind]))
    stated = header.get("warc-payload-digest", "")
    if header["warc-type"] == "response" and stated.startswith("sha1:") and base64.b32encode(hashlib.sha1(record.http()[1]).digest()).decode() != stated[5:].upper():
        return None, at, "payload digest differs"
    return record, behind + 4, ""


class Run:
    """Unbroken bytes that arrive in parts, read as soon as their records are whole.

    Of the bytes only those from the first unread record on are held. Places count in the archive: each part has the place
    where it begins or, if it is inflated, that of its member and the one behind what was inflated.
    """

    def __init__(self):
        self.held, self.need = bytearray(), 0
        self.parts: list[tuple[int, int, int]] = []  # (where a part begins in held, its place, the place behind it or -1)

    def _place(self, at: int, end: bool = False) -> int:
        begin, place, behind = next(p for p in reversed(self.parts) if p[0] <= max(at - end, 0))
        return place + at - begin if behind < 0 else behind if end else place

    def feed(self, part: bytes, place: int, behind: int = -1) -> Iterator[Record | Gap]:
        self.parts.append((len(self.held), place, behind))
        self.held += part
        if len(self.held) >= self.need:
            yield from self._read(False)

    def close(self) -> Iterator[Record | Gap]:
        yield from self._read(True)

    def _read(self, closed: bool) -> Iterator[Record | Gap]:
        data, at, self.need = self.held, 0, 0
        while at < len(data):
            record, behind, reason = _record(data, at)
            if record:
                record.position = self._place(at)
                yield record
                at = behind
                continue
            if not closed and (reason in _SHORT or reason == "no version line" and len(data) - at < _TAIL + 1):
                self.need = behind - at if reason in _SHORT else _TAIL + 1
                break
            search = at + 1
            while m := _VERSION.search(data, search):
                found, _, why = _record(data, m.start())
                if found or not closed and why in _SHORT:
                    break
                search = m.start() + 1
            end = m.start() if m else len(data) if closed else max(at + 1, len(data) - _TAIL)
            yield Gap(self._place(at), self._place(end, True), reason)
            at = end
        del self.held[:at]
        keep = max((i for i, p in enumerate(self.parts) if p[0] <= at), default=0)
        self.parts = [(max(0, b - at), p + (at - b if behind < 0 and b < at else 0), behind) for b, p, behind in self.parts[keep:]]


def records(data: bytes, base: int = 0) -> Iterator[Record | Gap]:
    """The records of an uncompressed stream, and gaps; places count from base."""
    run = Run()
    yield from run.feed(data, base)
    yield from run.close()


def _inflated(data: bytes, at: int) -> Generator[tuple[bytes, int], None, tuple[int, str]]:
    """The parts that a gzip member holds, each with the place behind it; the place where it ends or breaks, and the error."""
    unpack, view, place, done = zlib.decompressobj(31), memoryview(data), at, 0
    try:
        while place < len(data) and not unpack.eof:
            out = unpack.decompress(view[place : place + STEP])
            place = min(place + STEP, len(data)) - len(unpack.unused_data)
            done += len(out)
            yield out, place
    except zlib.error as e:
        broken = at
        for out, place in _before_error(view[at : place + STEP], done):
            broken = at + place
            yield out, broken
        return broken, str(e)
    return place, "" if unpack.eof else "truncated member"


def _before_error(view: memoryview, skip: int) -> Iterator[tuple[bytes, int]]:
    """What comes out of a broken member before its error, but for the first skip bytes: steps are halved where they fail."""
    unpack, place, step = zlib.decompressobj(31), 0, STEP
    while step:
        before = unpack.copy()
        try:
            out = unpack.decompress(view[place : place + step])
        except zlib.error:
            unpack, step = before, step // 2
            continue
        place += step
        yield out[skip:], min(place, len(view))
        skip = max(0, skip - len(out))


def _begins(data: bytes, at: int) -> bool:
    """Whether a record, or a member that holds records or is whole, begins at the place."""
    if not data.startswith(_MEMBER, at):
        return _record(data, at)[0] is not None
    try:
        unpack, place = zlib.decompressobj(31), at
        head = unpack.decompress(data[at : at + 4096], 64)
        if head.startswith(b"WARC/1."):
            return True
        unpack = zlib.decompressobj(31)
        while place < len(data) and not unpack.eof:
            unpack.decompress(data[place : place + STEP])
            place += STEP
        return unpack.eof
    except zlib.error:
        return False


def _merged(found: Iterator[Record | Gap]) -> Iterator[Record | Gap]:
    """Gaps that touch are one."""
    gap = None
    for x in found:
        if isinstance(x, Gap) and gap and x.first <= gap.end:
            gap.end = max(gap.end, x.end)
            continue
        if gap and not (isinstance(x, Record) and gap.first <= x.position < gap.end):
            yield gap
            gap = None
        if isinstance(x, Gap):
            gap = x
        else:
            yield x
    if gap:
        yield gap


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of a plain or gzipped archive. Records of a member carry the member's place, gaps whole members."""
    plain = not data.startswith(_MEMBER) and (_VERSION.match(data) or data.find(_MEMBER) < 0)
    yield from _merged(records(data) if plain else _members(data))


def _members(data: bytes) -> Iterator[Record | Gap]:
    at, n, run = 0, len(data), Run()
    while at < n:
        reason, behind = "no gzip member", at
        if data.startswith(_MEMBER, at):
            parts, first = _inflated(data, at), True
            while True:
                try:
                    part, end = next(parts)
                except StopIteration as stop:
                    behind, reason = stop.value
                    break
                if first and part.startswith(b"WARC/1.") and run.held:
                    # a record begins here, so the one before it was cut
                    yield from run.close()
                    run = Run()
                first = first and not part
                yield from run.feed(part, at, end)
        else:
            found, end, _ = _record(data, at)
            if found:
                yield from run.close()
                run, behind, reason = Run(), end, ""
                yield found
        if not reason:
            at = behind
            continue
        yield from run.close()
        run = Run()
        # a broken member may have been read into the next one; plain records are looked for behind what was inflated only
        begins = (m.start() for m in _BEGIN.finditer(data, at + 1) if data[m.start()] == 0x1F or m.start() >= behind)
        end = next((place for place in begins if _begins(data, place)), n)
        yield Gap(at, end, reason)
        at = end
    yield from run.close()


def _page(name: str) -> int | None:
    m = re.search(r"page:(-?\d+)>?$", name)
    return int(m[1]) if m else None


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _row(r: Record, archive: str) -> tuple:
    head, body = r.http()
    kind, size = r.header["warc-type"], len(body)
    digest = r.header.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        m = re.search(rb"\r\ncontent-length:\s*(\d+)", head, re.I)
        size = int(m[1]) if m else None
    else:
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    refers = _page(r.header.get("warc-refers-to", "")) if kind == "revisit" else None
    return _page(r.header["warc-record-id"]), size, digest, kind, refers, r.header.get("warc-target-uri"), archive, r.position


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per recovered response or revisit record, with its payload if wanted. A revisit's size is that stated in its HTTP head."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payloads

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for r in read_archive(content.as_py()):
                    if isinstance(r, Gap) or r.header["warc-type"] not in ("response", "revisit"):
                        continue
                    row = _row(r, name.as_py())
                    rows.append((*row, r.http()[1]) if payloads else row)
                    held += len(r.block) * payloads
                    if len(rows) >= ROWS or held >= PAYLOAD_BYTES:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    return _archives(spark, path).mapInArrow(frugal(run), RECORDS + ", payload binary" * payloads)


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """A row per byte gap that `read` passed over."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                gaps = [g for g in read_archive(content.as_py()) if isinstance(g, Gap)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.as_py()] * len(gaps), pa.string()),
                        pa.array([g.first for g in gaps], pa.int64()),
                        pa.array([g.end for g in gaps], pa.int64()),
                        pa.array([g.reason for g in gaps], pa.string()),
                    ],
                    ["archive", "first_byte", "end_byte", "reason"],
                )

    return _archives(spark, path).mapInArrow(frugal(run), GAPS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = written(read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    deleted(spark, path)
    return found
