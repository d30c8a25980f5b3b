"""Large captures in slices: an index of record borders, built in one pass and kept, by which any number of tasks read one capture.

A capture has no sync marks, so where a record begins is only known from the one before. One pass over the heads of a file's records notes a border every
so many bytes, with the number of the frame before it. Later scans read the slices between borders side by side, each by its range of the file: frames
keep their numbers, and no row and no task holds a whole capture.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import NativeFile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.sources.pcap import _TYPES, HEADER_BYTES, IEEE802_11, PACKET_SCHEMA, RADIOTAP, RECORD_BYTES, Header, batched, read_header, record_head
from framescope.sources.stores import store_of

INDEX_SCHEMA = "path string, begins long, ends long, frame_before long, byte_order string, unit int, snaplen long, linktype int, scan_error string"
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
#: Bytes of a slice, and of one read.
SLICE_BYTES, READ_BYTES = 64 << 20, 1 << 20


class Window:
    """Bytes of a file by place, read a block at a time; what is skipped between two records is not read."""

    def __init__(self, file: NativeFile, size: int, block: int = READ_BYTES):
        self.file, self.size, self.block = file, size, block
        self.begins, self.held = 0, b""

    def bytes_at(self, at: int, length: int) -> bytes:
        if at < self.begins or at + length > self.begins + len(self.held):
            self.file.seek(at)
            self.begins, self.held = at, self.file.read(min(max(length, self.block), self.size - at))
        return self.held[at - self.begins : at - self.begins + length]


def heads(window: Window, head: Header, at: int, until: int, frame: int, most: int) -> Iterator[tuple[int, int, tuple[int, int, int] | str]]:
    """(frame, place, its head) of each record from a border up to another (or the end of what is there); an error is the last."""
    while at < until:
        frame += 1
        found = record_head(head, window.bytes_at(at, min(RECORD_BYTES, window.size - at)), 0, window.size - at, most)
        yield frame, at, found
        if isinstance(found, str):
            return
        at += RECORD_BYTES + found[1]


def slices_of(path: str, slice_bytes: int, linktypes: tuple[int, ...] | None, most: int) -> Iterator[tuple]:
    """The index's rows of one capture."""
    store, place = store_of(path)
    size = store.get_file_info(place).size
    with store.open_input_file(place) as file:
        head = read_header(file.read(min(HEADER_BYTES, size)), linktypes)
        if isinstance(head, str):
            yield path, 0, 0, 0, None, None, None, None, head
            return
        told = (head.order, head.unit, head.snaplen, head.link)
        begins, before, at, frame = HEADER_BYTES, 0, HEADER_BYTES, 0
        for frame, at, found in heads(Window(file, size), head, HEADER_BYTES, size, 0, most):
            if isinstance(found, str):
                yield path, begins, at, before, *told, found
                return
            if at - begins >= slice_bytes:
                yield path, begins, at, before, *told, None
                begins, before = at, frame - 1
        yield path, begins, size, before, *told, None


def index_captures(spark: SparkSession, path: str | list[str], slice_bytes: int = SLICE_BYTES, linktypes: tuple[int, ...] | None = (IEEE802_11, RADIOTAP), most: int = 1 << 20) -> DataFrame:
    """A row for each slice of each capture: from border to border, the number of the frame before it, and what the file's header told.

    Write it as a table: `index.write.parquet(..)`. A file is one task's here, which reads record heads only and keeps nothing. A capture that can't be
    read on has scan_error in its last row; one whose header is wrong has one row with nothing else. An index of a file that has changed since is void."""
    files = spark.read.format("binaryFile").load(path).select("path").where("length > 0")
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows = list(slices_of(name, slice_bytes, linktypes, most))  # one for each slice_bytes
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)], names)

    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, INDEX_SCHEMA)


def read_slices(index: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Packets as read_packets gives them, from an index that has been written: slices are dealt over all tasks."""
    spark = index.sparkSession
    names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]

    def rows_of(r: dict) -> Iterator[tuple]:
        frame, link = r["frame_before"], r["linktype"]
        if r["begins"] < r["ends"]:
            head = Header(r["byte_order"], r["unit"], r["snaplen"], link)
            store, place = store_of(r["path"])
            with store.open_input_file(place) as file:
                window = Window(file, r["ends"])
                for frame, at, (ts_ns, captured, original) in heads(window, head, r["begins"], r["ends"], frame, most):
                    yield r["path"], frame, link, ts_ns, captured, original, window.bytes_at(at + RECORD_BYTES, captured), None
        if r["scan_error"]:
            yield r["path"], 0 if link is None else frame + 1, link, None, None, None, None, r["scan_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from batched((row for batch in batches for r in batch.to_pylist() for row in rows_of(r)), names, _TYPES, 6)

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return index.repartition(parts, F.xxhash64("path", "begins")).mapInArrow(run, PACKET_SCHEMA)
