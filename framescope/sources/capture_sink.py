"""Captures written back, byte for byte: a data source whose tasks write files beside the target, which its commit alone makes visible.

Rows are (path, frame, record): frame 0 is a capture's file header, the others its records with their headers, in order. Each task streams its rows into
files of its own under a hidden folder; a task that fails, or runs twice, leaves files that no commit names. The commit moves each task's folder
to its place and writes `_SUCCESS` last. Files go through pyarrow's file systems, so any store that both know will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from framescope.sources.stores import store_of

SINK_SCHEMA = "path string, frame long, record binary"
#: What commit adds beside the captures: a line for each, and the mark that all is there.
LISTING, DONE = "captures.jsonl", "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its folder, and how many captures. The captures are listed in the folder, so that the message stays small."""

    folder: str
    captures: int


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, target: str, overwrite: bool, suffix: str):
        self.target, self.overwrite, self.suffix = target.rstrip("/"), overwrite, suffix
        self.run = uuid.uuid4().hex
        self.staging = f"{self.target}/_temporary-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = store_of(self.staging)
        context = TaskContext.get()
        folder = f"{base}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        listed: list[dict] = []
        name, file, stream, digest, frames, size, last = None, "", None, None, 0, 0, -1

        def end() -> None:
            if stream is not None:
                stream.close()
                listed.append({"path": name, "file": file, "frames": frames, "bytes": size, "sha256": digest.hexdigest()})

        try:
            for batch in iterator:
                for path, frame, record in zip(*(batch.column(c) for c in ("path", "frame", "record"))):
                    if path.as_py() != name:
                        end()
                        name, digest, frames, size, last = path.as_py(), hashlib.sha256(), -1, 0, -1
                        file = "/".join(quote(part, safe="") for part in name.split("/")) + self.suffix
                        if "/" in file:
                            store.create_dir(f"{folder}/{file}".rsplit("/", 1)[0], recursive=True)
                        stream = store.open_output_stream(f"{folder}/{file}")
                    if frame.as_py() <= last or last < 0 and frame.as_py() != 0:
                        raise ValueError(f"records of {name!r} must begin with frame 0 and ascend")
                    last, data = frame.as_py(), memoryview(record.as_buffer())
                    stream.write(data)
                    digest.update(data)
                    frames, size = frames + 1, size + len(data)
            end()
            stream = None
        finally:
            if stream is not None:
                stream.close()
        with store.open_output_stream(f"{folder}/{LISTING}") as out:
            out.write("".join(json.dumps(x, sort_keys=True) + "\n" for x in listed).encode())
        return Written(folder, len(listed))

    def commit(self, messages: list[Written | None]) -> None:
        store, target = store_of(self.target)
        if self.overwrite:
            for old in store.get_file_info(arrow_fs.FileSelector(target, allow_not_found=True)):
                if old.path.rsplit("/", 1)[-1] != self.staging.rsplit("/", 1)[-1]:
                    store.delete_dir(old.path) if old.type == arrow_fs.FileType.Directory else store.delete_file(old.path)
        for message in messages:
            if message is not None and message.captures:
                part = message.folder.rsplit("/", 1)[-1].rsplit("-", 1)[0]
                store.move(message.folder, f"{target}/{part}-{self.run}")
        self._clear(store)
        store.create_dir(target, recursive=True)
        with store.open_output_stream(f"{target}/{DONE}"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(store_of(self.target)[0])

    def _clear(self, store: arrow_fs.FileSystem) -> None:
        _, staging = store_of(self.staging)
        if store.get_file_info(staging).type == arrow_fs.FileType.Directory:
            store.delete_dir(staging)


class CaptureFiles(DataSource):
    """df.write.format("capture_files").mode("append" or "overwrite").save(folder); see write_captures, which orders the rows."""

    @classmethod
    def name(cls) -> str:
        return "capture_files"

    def schema(self) -> str:
        return SINK_SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], overwrite, self.options.get("suffix", ".pcap"))


def write_captures(records: DataFrame, folder: str, mode: str = "append", suffix: str = ".pcap") -> None:
    """Writes each capture (path, frame, record; frame 0 is its header) as one file under folder; nothing is visible there before all tasks have ended.

    A capture's records meet in one task, which streams them; captures are dealt by path. A capture without a header, or with a frame twice, fails the
    write. mode: append adds files, overwrite replaces what is there, in the commit. A path's parts are folders; its last part gets the suffix."""
    spark = records.sparkSession
    spark.dataSource.register(CaptureFiles)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = records.select("path", F.col("frame").cast("bigint").alias("frame"), "record").repartition(parts, "path").sortWithinPartitions("path", "frame")
    dealt.write.format("capture_files").mode(mode).option("suffix", suffix).save(folder)


def write_files(files: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes whole files (path, content) in the same way; they stand in folders of the tasks that wrote them: folder/part-*/path."""
    write_captures(files.select("path", F.lit(0).alias("frame"), F.col("content").cast("binary").alias("record")), folder, mode, "")


def written_captures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, frames, bytes, sha256) of each capture that write_captures has put there; file is below folder. Only what is committed counts."""
    lines = spark.read.schema("path string, file string, frames long, bytes long, sha256 string").json(f"{folder.rstrip('/')}/part-*/{LISTING}")
    return lines.withColumn("file", F.concat_ws("/", F.element_at(F.split(F.input_file_name(), "/"), -2), "file"))
