"""Helpers that the training-data operators share: stage tables, text slices, flat words, small-side joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions.batches import BATCH_BYTES, BATCH_ROWS, bound_batches, give_back, map_batches  # noqa: F401  (operators take them from here)

#: White space of the word contracts: blank and the six controls from tab to carriage return (fixed values).
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_BLANK = np.zeros(256, bool)
_BLANK[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names in spark.checkpoint.dir.

    Only a session on local threads gets a temporary folder of its own; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="framescope-"))
    return sc.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(base: str, *frames: DataFrame) -> str:
    """base, or base with underscores behind it: a name that no column of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Largest side that is broadcast, in bytes of its values and 16 more for each row.
BROADCAST_BYTES = 32 << 20


def join_small(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Joins a side that is usually small: broadcast only if its measured size is within most_bytes, else a shuffled join whose skewed partitions AQE splits.

    small should be cheap to measure (a stage table)."""
    sized = [F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in small.schema]
    if (small.agg(F.sum(sum((F.coalesce(x, F.lit(0)) for x in sized), F.lit(16)))).first()[0] or 0) <= most_bytes:
        small = F.broadcast(small)
    return left.join(small, on, how)


def keep_where(df: DataFrame, column: str, judge: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows of df whose value of one column `judge` finds true, batch by batch. Only that column goes to Python; the rows are filtered by Spark."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("boolean")
    def verdict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield judge(part)
        give_back()

    return df.where(verdict(F.col(f"`{column}`")))


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def drawn_below(share: float) -> int:
    """The bound that a share of all 64-bit hashes does not pass: hash <= bound draws it, however small it is."""
    return min(1 << 64, max(1, int(share * (1 << 64)))) - (1 << 63) - 1


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of each slice hold about `most` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets_of(batch.column(text)))
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch for each run of rows with equal keys (integers), of batches that are sorted by them; cheaper by far than a call for each group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.concat_batches([*held, batch]) if held else batch
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        held = [batch.slice(cuts[-1])]
    yield from held


def offsets_of(column: pa.Array) -> np.ndarray:
    """Offsets of a string column's rows in its data buffer; nulls have length 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if column.buffers()[1] else np.zeros(len(column) + 1, np.int64)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and len + 1 offsets from 0; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = offsets_of(column)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def flat_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run without SPACES, never across rows) and the index of each row's first word."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < data.size]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words' bytes as an array of strings, from what flat_words tells."""
    sizes = ends - starts
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())) if sizes.size else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_string(), sizes.size, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64)


_POWERS: dict[np.uint64, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept, as every slice of texts needs about as many."""
    found = _POWERS.get(base)
    if found is None or found.size < n:
        found = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 1 << 20), base)]), dtype=np.uint64)
        if found.size <= 1 << 23:
            _POWERS[base] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte codes taken from one running sum, then mixed with the length."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    powers = _powers(_BASE, data.size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_CODES[data] * powers, dtype=np.uint64)])
    # dividing by the power at the start makes the value independent of the word's place
    value = (sums[ends] - sums[starts]) * _powers(_INVERSE, data.size)[starts]
    return mix(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
