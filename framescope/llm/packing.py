"""Packing of tokenised documents into sequences: minimum bin slack, by subset-sum over a bitset.

Each task packs its own documents as they stream by: no shuffle, and only a bounded pool of remainders in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framescope.llm import word_tokens
from framescope.llm.common import map_batches, slices


def fill_window(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Lengths and how many of each fill a window closest to its capacity, by whole items.

    The longest item that fits goes in first (short ones are easier to place later). The rest is a bounded subset-sum: bit s of an integer says
    that sum s can be had; each length joins in groups of 1, 2, 4, .. of its count, longest first, until the capacity is met; then the groups
    taken are traced back through the integers kept.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True)
    if not lengths:
        return []
    taken = {lengths[0]: 1}
    room = capacity - lengths[0]
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for n in lengths:
        left = counts[n] - (n == lengths[0])
        if n > room:
            continue
        left, group = min(left, room // n), 1
        while left and not reach >> room & 1:
            group = min(group, left)
            trail.append((n, group, reach))
            reach |= reach << n * group & mask
            left, group = left - group, group * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for n, group, before in reversed(trail):
        if not before >> at & 1:
            taken[n] = taken.get(n, 0) + group
            at -= n * group
    return list(taken.items())


class WindowPacker:
    """Collects items (length, payload) and yields sequences: lists of (payload, from, to) of tokens within the item.

    While more come, windows are filled as soon as the pool holds `pool` tokens, down to three quarters of it. At the end the windows that whole items
    fill to the brim come first; what is left is laid end to end and cut, the last stretch into powers of two, which need no padding.
    """

    def __init__(self, capacity: int, pool: int):
        self.capacity, self.pool = capacity, pool
        self.items: dict[int, list] = {}
        self.counts: dict[int, int] = {}
        self.tokens = 0

    def add(self, length: int, payload: object) -> Iterator[list]:
        self.items.setdefault(length, []).append(payload)
        self.counts[length] = self.counts.get(length, 0) + 1
        self.tokens += length
        if self.tokens > self.pool:
            while self.tokens > self.pool * 3 // 4:
                yield [(p, 0, n) for n, p in self._take()]

    def _take(self) -> list:
        out = []
        for n, k in fill_window(self.counts, self.capacity):
            held = self.items[n]
            out += [(n, held.pop()) for _ in range(k)]
            self.counts[n] -= k
            self.tokens -= n * k
            if not held:
                del self.items[n], self.counts[n]
        return out

    def finish(self) -> Iterator[list]:
        rest: list = []
        while self.counts:
            window = self._take()
            if sum(n for n, _ in window) == self.capacity:
                yield [(p, 0, n) for n, p in window]
            else:
                rest += window
        left = sum(n for n, _ in rest)
        sizes = [self.capacity] * (left // self.capacity) + [1 << k for k in range(left.bit_length(), -1, -1) if (left % self.capacity) >> k & 1]
        at, k = 0, 0
        for size in sizes:
            out = []
            while size:
                n, p = rest[k]
                step = min(size, n - at)
                out.append((p, at, at + step))
                size, at = size - step, at + step
                if at == n:
                    at, k = 0, k + 1
            yield out


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, pool: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the documents of df into sequences of at most `capacity` tokens; one row per piece of a document.

    A document is its ids by the tokenizer file, then end_id. Whole capacities are cut off in front and are sequences of their own; remainders are
    packed by WindowPacker. Columns: id, start, length, ids (binary: the piece's ids as little-endian unsigned 32-bit), doc_tokens, sequence_id
    (task number * 2 ** 32 + count), offset (place in its sequence, gapless from 0). Every id lies in exactly one piece. A null or empty text is
    the end id alone; repeated rows and ids are packed one by one; an empty table has no sequences. Only the two columns are read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        tokenizer = word_tokens.load(tokenizer_path)
        packer = WindowPacker(capacity, pool)
        number = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        id_type: pa.DataType = pa.int64()

        def put(sequence: list) -> None:
            nonlocal number
            offset = 0
            for (doc, start, ids, total), a, b in sequence:
                out.append((doc, start + a, b - a, ids[a:b].tobytes(), total, number, offset))
                offset += b - a
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            out.clear()
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

        for batch in slices(batches):
            id_type = batch.schema.field("id").type
            flat, offsets = tokenizer.encode_batch(batch.column("text"))
            for doc, a, b in zip(batch.column("id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                ids = np.append(flat[a:b], np.int32(end_id)).astype("<u4")
                whole = ids.size // capacity * capacity
                for at in range(0, whole, capacity):
                    put([((doc, at, ids[at : at + capacity], ids.size), 0, capacity)])
                if whole < ids.size:
                    for sequence in packer.add(ids.size - whole, (doc, whole, ids[whole:], ids.size)):
                        put(sequence)
            yield flush()
        for sequence in packer.finish():
            put(sequence)
            if len(out) >= 1000:
                yield flush()
        yield flush()

    return map_batches(rows, run, schema)
