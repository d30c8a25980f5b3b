"""Classic packet captures as rows. Files come in through Spark's own binary reader, so any store that Spark reads will do."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from framescope.functions.batches import map_batches

IEEE802_11, RADIOTAP = 105, 127
PACKET_SCHEMA = "path string, frame long, linktype int, ts_ns long, captured_len long, original_len long, data binary, scan_error string"
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
#: Magic number as read little-endian -> (byte order, nanoseconds per fraction) (fixed values).
_MAGIC = {0xA1B2C3D4: ("<", 1000), 0xA1B23C4D: ("<", 1), 0xD4C3B2A1: (">", 1000), 0x4D3CB2A1: (">", 1)}


@dataclass(frozen=True)
class Header:
    """What a capture's first 24 bytes tell: byte order (of struct), nanoseconds per unit of a fraction, greatest captured length, link type."""

    order: str
    unit: int
    snaplen: int
    link: int


HEADER_BYTES, RECORD_BYTES = 24, 16


def read_header(data: bytes | memoryview, linktypes: tuple[int, ...] | None = None) -> Header | str:
    """A capture's header, or what is wrong with it."""
    if len(data) < HEADER_BYTES:
        return "truncated input"
    order, unit = _MAGIC.get(struct.unpack_from("<I", data)[0], (None, 0))
    if order is None:
        return "unsupported format"
    major, minor, _, _, snaplen, link = struct.unpack_from(order + "HHiIII", data, 4)
    if (major, minor) != (2, 4) or snaplen and linktypes is not None and link not in linktypes:
        return "unsupported format"
    return Header(order, unit, snaplen, link) if snaplen else "malformed input"


def record_head(head: Header, data: bytes | memoryview, at: int, room: int, most: int) -> tuple[int, int, int] | str:
    """(ts_ns, captured, original) of the record at a place with `room` bytes from there to the capture's end, or what is wrong with it."""
    if room < RECORD_BYTES:
        return "truncated input"
    seconds, fraction, captured, original = struct.unpack_from(head.order + "IIII", data, at)
    if fraction * head.unit >= 1_000_000_000 or captured > head.snaplen or captured > original:
        return "malformed input"
    if captured > most:
        return "fixed capacity exceeded"
    return (seconds * 1_000_000_000 + fraction * head.unit, captured, original) if RECORD_BYTES + captured <= room else "truncated input"


def walk(head: Header, data: bytes | memoryview, most: int, at: int = HEADER_BYTES, frame: int = 0) -> Iterator[tuple[int, int, tuple[int, int, int] | str]]:
    """(frame, place, its head) of each record from a place on that a record begins at; frame: the number of the one before. An error is the last."""
    while at < len(data):
        frame += 1
        found = record_head(head, data, at, len(data) - at, most)
        yield frame, at, found
        if isinstance(found, str):
            return
        at += RECORD_BYTES + found[1]


def records(data: bytes | memoryview, linktypes: tuple[int, ...] | None, most: int) -> Iterator[tuple]:
    """(frame, linktype, ts_ns, captured_len, original_len, data, error) of each record; an error is the last."""
    head = read_header(data, linktypes)
    if isinstance(head, str):
        yield 0, None, None, None, None, None, head
        return
    for frame, at, found in walk(head, data, most):
        if isinstance(found, str):
            yield frame, head.link, None, None, None, None, found
        else:
            yield frame, head.link, *found, bytes(data[at + RECORD_BYTES : at + RECORD_BYTES + found[1]]), None


def read_packets(spark: SparkSession, path: str | list[str], linktypes: tuple[int, ...] | None = (IEEE802_11, RADIOTAP), most: int = 1 << 20) -> DataFrame:
    """One row per record of each capture, numbered from 1 in capture order.

    A file that can't be read on ends with a row that has scan_error (frame 0 for its header); the rows before it stand. linktypes None takes any.
    A capture has no sync marks, so each file is one task's; rotate captures, or write the rows as Parquet once and read those.
    """
    return packets_of(spark.read.format("binaryFile").load(path).select("path", "content"), linktypes, most)


def packets_of(captures: DataFrame, linktypes: tuple[int, ...] | None = (IEEE802_11, RADIOTAP), most: int = 1 << 20) -> DataFrame:
    """The records of captures that are rows already: (path, content). A capture is read where Arrow holds it, without a copy of the whole."""
    names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        every = ((name.as_py(), *r) for batch in batches for name, content in zip(batch.column("path"), batch.column("content")) for r in records(memoryview(content.as_buffer() if content.is_valid else b""), linktypes, most))
        yield from batched(every, names, _TYPES, 6)

    return map_batches(captures.select("path", "content"), run, PACKET_SCHEMA)


RAW_SCHEMA = "path string, frame long, ts_ns long, record binary, scan_error string"
_RAW_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]


def raw_records(captures: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(path, frame, ts_ns, record, scan_error) of captures (path, content), of any link type: frame 0 is the file's header, the others are records with
    their own headers, so that their bytes end to end are the file's. A capture that can't be read on ends with a row that has scan_error."""
    names = [c.split()[0] for c in RAW_SCHEMA.split(", ")]

    def rows_of(name: str, data: memoryview) -> Iterator[tuple]:
        head = read_header(data)
        if isinstance(head, str):
            yield name, 0, None, None, head
            return
        yield name, 0, None, bytes(data[:HEADER_BYTES]), None
        for frame, at, found in walk(head, data, most):
            yield (name, frame, None, None, found) if isinstance(found, str) else (name, frame, found[0], bytes(data[at : at + RECORD_BYTES + found[1]]), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        every = (row for batch in batches for name, content in zip(batch.column("path"), batch.column("content")) for row in rows_of(name.as_py(), memoryview(content.as_buffer() if content.is_valid else b"")))
        yield from batched(every, names, _RAW_TYPES, 3)

    return map_batches(captures.select("path", "content"), run, RAW_SCHEMA)


def batched(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], sized: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of 4,096 rows, or of 4 MB of their binary value at place `sized`."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or b"")
        if len(held) == 4096 or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def capture_bytes(rows: list[tuple[int, bytes]], linktype: int = IEEE802_11, snaplen: int = 65535) -> bytes:
    """A little-endian microsecond capture of (ts_ns, data) records."""
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, linktype)
    return head + b"".join(struct.pack("<IIII", ts // 1_000_000_000, ts % 1_000_000_000 // 1000, len(d), len(d)) + d for ts, d in rows)
