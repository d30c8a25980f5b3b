"""Captures that are still being written, as a stream: each record comes once, when all of its bytes are there.

An offset is the size of each file of the folder, so the driver lists and reads nothing. A record belongs to the batch in whose range its last byte lies;
a task walks the heads of its file's records from the beginning, so it finds borders and frame numbers without a state, and a batch that runs again gives
the same rows. Rotate captures: each batch walks the heads of the files that have grown, and an offset names every file in the folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from framescope.sources.capture_index import Window, heads
from framescope.sources.pcap import _TYPES, HEADER_BYTES, PACKET_SCHEMA, RECORD_BYTES, batched, read_header
from framescope.sources.stores import store_of


@dataclass
class Grown(InputPartition):
    """Bytes of a file that have come since the last batch."""

    path: str
    begins: int
    ends: int


def grown_rows(path: str, begins: int, ends: int, linktypes: tuple[int, ...] | None, most: int) -> Iterator[tuple]:
    """The records whose last byte lies after begins and not after ends. A header or record that can't be right is a row with scan_error, once; what is
    not all there yet is not wrong."""
    if ends < HEADER_BYTES:
        return
    store, place = store_of(path)
    with store.open_input_file(place) as file:
        window = Window(file, ends)
        head = read_header(window.bytes_at(0, HEADER_BYTES), linktypes)
        if isinstance(head, str):
            if begins < HEADER_BYTES:
                yield path, 0, None, None, None, None, None, head
            return
        for frame, at, found in heads(window, head, HEADER_BYTES, ends, 0, most):
            if isinstance(found, str):
                if found != "truncated input" and begins < at + RECORD_BYTES:
                    yield path, frame, head.link, None, None, None, None, found
                return
            ts_ns, captured, original = found
            if at + RECORD_BYTES + captured > begins:
                yield path, frame, head.link, ts_ns, captured, original, window.bytes_at(at + RECORD_BYTES, captured), None


class CaptureReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("most", 1 << 20))
        told = options.get("linktypes", "105,127")
        self.linktypes = None if told == "any" else tuple(map(int, told.split(",")))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, place = store_of(self.folder)
        found = store.get_file_info(arrow_fs.FileSelector(place, allow_not_found=True))
        return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.type == arrow_fs.FileType.File and not f.base_name.startswith(("_", "."))}

    def partitions(self, start: dict, end: dict) -> list[Grown]:
        return [Grown(f"{self.folder.rstrip('/')}/{name}", start.get(name, 0), size) for name, size in sorted(end.items()) if size > start.get(name, 0)]

    def read(self, partition: Grown) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]
        return batched(grown_rows(partition.path, partition.begins, partition.ends, self.linktypes, self.most), names, _TYPES, 6)


class CaptureStream(DataSource):
    """spark.readStream.format("capture_stream").load(folder). Options: most (bytes of a record), linktypes (numbers by comma, or any)."""

    @classmethod
    def name(cls) -> str:
        return "capture_stream"

    def schema(self) -> str:
        return PACKET_SCHEMA

    def streamReader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(dict(self.options))


def stream_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets, as read_packets gives them, of all captures in a folder, those being written among them."""
    spark.dataSource.register(CaptureStream)
    return spark.readStream.format("capture_stream").load(folder)
