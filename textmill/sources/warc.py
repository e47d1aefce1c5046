"""Web archives as tables: WARC, WET and ARC-like record files, plain or gzip with any number of members."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import decode_bytes, decode_page
from textmill.sources.ranges import RANGE, Part, file_ranges, opened

SCHEMA = "file string, rec_no long, rec_type string, uri string, headers map<string,string>, payload binary"
_VERSION = re.compile(rb"^WARC/\d", re.M)
_BLANK = re.compile(rb"\r?\n\r?\n")
_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)
_MAGIC = b"\x1f\x8b\x08"
#: Bytes that are read, unpacked and handed on at a time; the longest header that is looked through.
READ, UNPACK, BATCH, HEADER = 1 << 20, 1 << 14, 16 << 20, 1 << 20
#: Bytes of a gzip member that wait for its checksum; a longer member is handed on as it comes.
HOLD = 64 << 20


class Lost:
    """What a reader could not read: records and members of an archive that were passed over."""

    def __init__(self):
        self.n = 0


def member_at(raw: BinaryIO, begin: int, size: int) -> int:
    """Where the first gzip member with a record begins, at ``begin`` or later; ``size`` if there is none.

    The mark of a member may also stand in compressed data: what follows must unpack to the head of a record.
    """
    if begin <= 0:
        return 0
    at, carry = begin, b""
    raw.seek(begin)
    while at < size:
        data = raw.read(READ)
        if not data:
            return size
        block, base, found = carry + data, at - len(carry), -1
        while (found := block.find(_MAGIC, found + 1)) >= 0:
            back = raw.tell()
            raw.seek(base + found)
            try:
                head = zlib.decompressobj(31).decompress(raw.read(UNPACK), 64)
            except zlib.error:
                head = b""
            raw.seek(back)
            if head.lstrip(b"\r\n").startswith(b"WARC/"):
                return base + found
        at += len(data)
        carry = block[-2:]
    return size


def plain_chunks(raw: BinaryIO, lost: Lost | None = None) -> Iterator[bytes]:
    """The content of a stream, unpacked if it is gzip: all members, in pieces.

    A cut last member gives what it holds. A corrupt one gives nothing: up to ``HOLD`` bytes
    are held back until the member's end is checked. Reading resumes at the next member.
    Members are fed in small pieces, so that what is left over behind one is never more
    than such a piece.
    """
    data = raw.read(READ)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = raw.read(READ)
        return
    lost = lost or Lost()
    member, astray, carry = zlib.decompressobj(31), False, b""
    held: list[bytes] = []
    size = 0
    while data:
        view, at = memoryview(data), 0
        while at < len(data):
            if astray:
                found = (carry + data[at : at + 2]).find(_MAGIC) if carry else -1
                if found >= 0:  # the mark of a member lies across two reads
                    member, astray, head = zlib.decompressobj(31), False, carry[found:]
                    member.decompress(head)
                    carry = b""
                    continue
                carry, found = b"", data.find(_MAGIC, at)
                if found < 0:
                    carry = data[max(at, len(data) - 2) :]
                    break
                member, astray, at = zlib.decompressobj(31), False, found
            piece = view[at : at + UNPACK]
            try:
                out = member.decompress(piece, READ)
                while out:
                    held.append(out)
                    size += len(out)
                    if size > HOLD:
                        yield from held
                        held = []
                    out = member.decompress(member.unconsumed_tail, READ) if member.unconsumed_tail else b""
            except zlib.error:
                # The next member begins behind the place where this piece began.
                astray, at, held, size = True, at + 1, [], 0
                lost.n += 1
                continue
            at += len(piece) - len(member.unused_data)
            if member.eof:
                yield from held
                member, held, size = zlib.decompressobj(31), [], 0
                while at < len(data) and data[at] == 0:  # padding between members
                    at += 1
                if data[at : at + 2] not in (b"\x1f\x8b", b"\x1f", b""):
                    astray = True
        data = raw.read(READ)
    yield from held


class _Buffer:
    """What was read and is not yet used of a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.data, self.at = pieces, bytearray(), 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > READ:
            del self.data[: self.at]
            self.at = 0
        self.data += piece
        return True

    def find(self, mark: re.Pattern | bytes, start: int, most: int | None = None) -> tuple[int, int] | None:
        """Begin and end of a mark at ``start`` or later from here, reading on until it comes, or ``most`` bytes are seen."""
        from_ = start
        while True:
            if isinstance(mark, bytes):
                at = self.data.find(mark, self.at + from_)
                hit = (at - self.at, at - self.at + len(mark)) if at >= 0 else None
            else:
                m = mark.search(self.data, self.at + from_)
                hit = (m.start() - self.at, m.end() - self.at) if m else None
            have = len(self.data) - self.at
            if hit or (most is not None and have > start + most):
                return hit
            from_ = max(start, have - 8)  # a mark may lie across two pieces
            if not self.more():
                return None

    def take(self, size: int) -> bytes:
        while len(self.data) - self.at < size and self.more():
            pass
        got = bytes(memoryview(self.data)[self.at : self.at + size])
        self.at += len(got)
        return got

    def skip(self, size: int) -> None:
        while size > 0:
            step = min(size, len(self.data) - self.at)
            self.at += step
            size -= step
            if size and not self.more():
                return


def records(raw: BinaryIO | bytes, types: tuple[str, ...] | None = None) -> Iterator[tuple[str, str | None, dict[str, str], bytes]]:
    """``rec_type, uri, headers, payload`` of each record of an archive, of some types only if they are named."""
    return (row[1:] for row in numbered_records(raw, types))


def numbered_records(raw: BinaryIO | bytes, types: tuple[str, ...] | None = None, lost: Lost | None = None) -> Iterator[tuple[int, str, str | None, dict[str, str], bytes]]:
    """``rec_no, rec_type, uri, headers, payload``; numbers count the records of all types.

    Memory is bounded by a record and a piece of the file; payloads of other types are
    passed over. After a broken record reading resumes at the next version line.
    """
    lost = lost or Lost()
    b = _Buffer(plain_chunks(io.BytesIO(raw) if isinstance(raw, bytes) else raw, lost))
    number = 0
    while mark := b.find(b"WARC/", 0):
        b.at += mark[0]
        end = b.find(_BLANK, 0, HEADER)
        if not end:
            b.at += 5
            lost.n += 1
            continue
        head = bytes(b.data[b.at : b.at + end[0]])
        if later := _VERSION.search(head, 5):
            b.at += later.start()  # this header was cut off
            lost.n += 1
            continue
        headers = {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace").strip() for k, v in _HEADER.findall(head)}
        length = headers.get("content-length", "")
        b.at += end[1]
        if not re.fullmatch("[0-9]+", length):
            lost.n += 1
            later = b.find(_VERSION, 0)
            if not later:
                return
            b.at += later[0]
            continue
        kind = headers.get("warc-type", "")
        if types is None or kind in types:
            yield number, kind, headers.get("warc-target-uri"), headers, b.take(int(length))
        else:
            b.skip(int(length))
        number += 1


#: Numbers of records count on from this times the number of a range within its file.
NUMBERS = 1 << 40


def _frames(file: str, raw: BinaryIO | bytes, types: tuple[str, ...] | None, first: int = 0) -> Iterator[pd.DataFrame]:
    """The records of a stream, and at its end a row without a type whose number is what was lost, if anything was."""
    columns, lost = ["file", "rec_no", "rec_type", "uri", "headers", "payload"], Lost()
    rows, size = [], 0
    for number, *row in numbered_records(raw, types, lost):
        rows.append((file, first + number, *row))
        size += len(row[-1]) + 1000
        if size >= BATCH:
            yield pd.DataFrame(rows, columns=columns)
            rows, size = [], 0
    if lost.n:
        rows.append((file, lost.n, None, None, None, None))
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def read_warc(spark: SparkSession, path: str, types: tuple[str, ...] | None = None, stream: bool = True, size: int = RANGE, lost: Observation | None = None) -> DataFrame:
    """Records of all files that a path or glob names, a task for each ``size`` bytes of a packed file.

    Spark lists the files. With ``stream`` the workers open them by themselves, in
    any store that Arrow knows, and read them record by record. A range begins with the first
    gzip member that begins in it and ends with its last one, so each member is read by one
    task; files that are not named ``.gz`` are one range, since a record's text may look like another
    record. Without ``stream`` Spark's own reader hands over each file as a whole, from any store that Spark
    knows, up to 2 GB. With ``types`` other records never leave the reader. Numbers of records grow
    within a file. ``lost`` observes ``records``, the number of records, and ``lost``, that of broken records and members that were passed over,
    by an action that reads the rows once: a sort samples them before, and counts them twice.
    """

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, begin, end in zip(batch["path"], batch["begin"], batch["end"], strict=True):
                with opened(file) as raw:
                    length = raw.size()
                    if begin == 0 and end >= length:
                        yield from _frames(file, Part(raw, 0, length), types)
                        continue
                    first, last = member_at(raw, begin, length), member_at(raw, end, length) if end < length else length
                    if first < min(last, end):
                        yield from _frames(file, Part(raw, first, last), types, begin // size * NUMBERS)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                yield from _frames(file, bytes(content), types)

    if stream:
        rows = file_ranges(spark, path, size, r"(?<!\.gz)$").mapInPandas(streamed, SCHEMA)
    else:
        rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(whole, SCHEMA)
    if lost is not None:
        rows = rows.observe(lost, F.count("rec_type").alias("records"), F.coalesce(F.sum(F.when(F.col("rec_type").isNull(), F.col("rec_no"))), F.lit(0)).alias("lost"))
    return rows.where("rec_type is not null")


def wet_documents(spark: SparkSession, path: str, errors: str = "replace", lost: Observation | None = None, bad: Observation | None = None) -> DataFrame:
    """Texts of ``conversion`` records: bad bytes are replaced, or with ``strict`` the record is dropped.

    ``lost`` is as for ``read_warc``; ``bad`` observes ``undecodable``, the number of records that were dropped for their bytes.
    """
    rows = read_warc(spark, path, ("conversion",), lost=lost).select("file", "rec_no", "uri", decode_bytes(F.col("payload"), errors).alias("text"))
    if bad is not None:
        rows = rows.observe(bad, F.count_if(F.col("text").isNull()).alias("undecodable"))
    return rows.where("text is not null")


def response_pages(spark: SparkSession, path: str) -> DataFrame:
    """Bodies of ``response`` records without their HTTP header, as text in the encoding that they name or show."""
    rows = read_warc(spark, path, ("response",))
    # The header is ASCII: where it ends is found in a text that has a character for each byte.
    byte = F.decode("payload", "ISO-8859-1")
    head = F.length(F.regexp_extract(byte, r"(?s)\A(HTTP/.*?\r?\n\r?\n)", 1))
    return rows.withColumn("_body", F.substring(F.col("payload"), head + 1, F.length("payload"))).select("file", "rec_no", "uri", decode_page(F.col("_body")).alias("html"))
