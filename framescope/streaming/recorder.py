"""Logs recorded as streams: lines are kept or left out by both clocks of their bundle's end, late ones are counted, and what has been written up to a
version can be read while the stream goes on."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from framescope.operators.integrity import embedded_ns
from framescope.sources.stores import store_of

RECORDED = "bundle_id string, source string, line long, text string, unix_ns long, monotonic_ns long, kept long, omitted long, goes_back long"
_ROW = Row(*(c.split()[0] for c in RECORDED.split(", ")))
#: State of a log: its end, its counts, and lines that wait for the end.
_LONGS = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
_END = _LONGS("unix_ns", "monotonic_ns")
_COUNTS = _LONGS("kept", "omitted", "goes_back", "last_ns")
_LINE = T.StructType([T.StructField("line", T.LongType()), T.StructField("text", T.StringType()), *_LONGS("unix_ns", "monotonic_ns", "own_ns").fields])
#: The state store that keyed state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recorder(StatefulProcessor):
    """One log: rows with `ends` set tell its end, the others are lines."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", _END)
        self.counts = handle.getValueState("counts", _COUNTS)
        self.waiting = handle.getListState("waiting", _LINE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        end = self.end.get() if self.end.exists() else None
        kept, omitted, back, last = self.counts.get() if self.counts.exists() else (0, 0, 0, None)
        lines: list[tuple] = []
        opened = end is None
        for r in rows:
            if r["ends"]:
                end = end or (r["unix_ns"], r["monotonic_ns"])  # the first end stands
            else:
                lines.append((r["line"], r["text"], r["unix_ns"], r["monotonic_ns"], r["own_ns"]))
        if end is None:
            self.waiting.appendList(lines)
            return
        if opened:
            self.end.update(tuple(end))
            if self.waiting.exists():
                lines = [*map(tuple, self.waiting.get()), *lines]
            self.waiting.clear()
        for line, text, unix_ns, monotonic_ns, own_ns in sorted(lines, key=lambda x: (x[0] is None, x[0] or 0)):
            inside = unix_ns is not None and monotonic_ns is not None and unix_ns <= end[0] and monotonic_ns <= end[1] and (own_ns is None or own_ns <= end[0])
            if not inside:
                omitted += 1
                continue
            kept += 1
            back += last is not None and monotonic_ns < last
            last = monotonic_ns
            yield _ROW(*key, line, text, unix_ns, monotonic_ns, None, None, None)
        self.counts.update((kept, omitted, back, last))
        yield _ROW(*key, None, None, None, None, kept, omitted, back)

    def close(self) -> None:
        pass


def record_lines(stream: DataFrame) -> DataFrame:
    """What a recorder keeps of log lines that stream in: bundle_id, source, line, text, unix_ns, monotonic_ns, and ends (true for a row that tells the
    log's end by both clocks; its line and text are null).

    Two kinds of rows come out (RECORDED): lines inside the window, once their log's end is known, and rows of counts (line is null) after each batch
    that held lines of a log: kept, omitted (after either end, with an own time after the end, or without a receipt), and goes_back (kept lines whose
    monotonic receipt is before that of the line before them, as they came). Until its end is told, a log's lines wait in the state, so a window's
    lines are what the state holds at most; later lines are judged at once, however late or out of order. The first end of a log stands."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    told = stream.select("bundle_id", "source", "line", "text", "unix_ns", "monotonic_ns", F.coalesce("ends", F.lit(False)).alias("ends"), embedded_ns(F.col("text")).alias("own_ns"))
    return told.groupBy("bundle_id", "source").transformWithState(Recorder(), RECORDED, "append", "none")


def write_versions(stream: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts a query that writes each batch as a version (its batch number) of a table. A batch that runs again after a failure replaces its version."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def versions(folder: str) -> list[int]:
    """The versions that are whole, in order: a version counts once all before it do."""
    store, place = store_of(folder)
    names = store.get_file_info(arrow_fs.FileSelector(place, allow_not_found=True))
    found = sorted(int(m[1]) for f in names if (m := re.fullmatch(r"version=(\d+)", f.base_name)) and store.get_file_info(f"{f.path}/_SUCCESS").type == arrow_fs.FileType.File)
    return [v for k, v in enumerate(found) if v == k]


def snapshot(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The rows of a table of versions up to one; they stay the same whatever is written later. An error if that version isn't whole yet."""
    if version not in versions(folder):
        raise LookupError(f"no version {version}")
    base = folder.rstrip("/")
    return spark.read.option("basePath", base).parquet(*(f"{base}/version={v}" for v in range(version + 1)))


def log_counts(recorded: DataFrame) -> DataFrame:
    """(bundle_id, source, kept, omitted, goes_back) of each log as of a snapshot: counts only grow, so the greatest are the last."""
    return recorded.where("line is null and kept is not null").groupBy("bundle_id", "source").agg(*(F.max(c).alias(c) for c in ("kept", "omitted", "goes_back")))
