"""SentencePiece BPE encoding and decoding over flat numpy arrays.

Encoding: texts are cut where no merge can reach across, equal segments of a batch are encoded once, and all segments are merged together in
rounds: find every adjacent pair's rank, take each segment's least rank, merge its leftmost places that don't overlap in all segments at once,
compact. The places are those that the library's agenda would pick one after the other, so the ids are the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framescope.llm.common import map_batches, slices
from framescope.llm.merges import MergeTable, SegmentStore, ranges

MARK = "▁"  # stands for a blank inside pieces


class PieceModel:
    """Pieces, ranks and text rules of a BPE model file.

    Characters without a piece of their own get ids beyond the vocabulary while segments are merged.
    """

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = lib.get_piece_size()
        self.unk = lib.unk_id()
        self.pieces = [lib.id_to_piece(i) for i in range(self.size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(self.size)]
        scores = [lib.get_score(i) for i in range(self.size)]
        self.normalize = lib.normalize
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_ids = np.full(256, self.unk, np.int64)
        raw = [b""] * self.size
        for i, piece in enumerate(self.pieces):
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                raw[i] = bytes([int(piece[3:5], 16)])
            elif not lib.is_control(i):
                raw[i] = " ⁇ ".encode() if lib.is_unknown(i) else piece.replace(MARK, " ").encode()
        self.falls_back = any(lib.is_byte(i) for i in range(self.size))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        order = sorted((-scores[i], i) for i in self.ids.values())
        rank = {i: k for k, (_, i) in enumerate(order)}
        pairs = {}
        self.joined: set[str] = set()
        for piece, i in self.ids.items():
            self.joined.update(a + b for a, b in zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank[i], i)
        self.char_ids = np.full(0x110000, -1, np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        self.merges = MergeTable(pairs)
        self._cut = self._cut_pattern()

    def _cut_pattern(self) -> bool:
        """Whether blanks only ever begin pieces (after other blanks): then texts can be cut before each run of blanks."""
        return not any(x[1] == MARK and x[0] != MARK for x in self.joined)

    def segments(self, text: str) -> list[str]:
        """Cuts normalised text before runs of the blank mark, if no piece reaches across; else the whole is one segment."""
        if not self._cut or not text:
            return [text] if text else []
        out, blanks = [], 0
        for k, part in enumerate(text.split(MARK)):
            blanks += k > 0
            if part:
                out.append(MARK * blanks + part)
                blanks = 0
        return [*out, MARK * blanks] if blanks else out

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments end to end, and their counts."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.char_ids[codes]
        out = np.flatnonzero(symbols < 0)
        loose, which = np.unique(codes[out], return_inverse=True)
        symbols[out] = self.size + which
        ids, counts = self.merges.merge(symbols, np.fromiter(map(len, segments), np.int64, len(segments)))
        return self._fall_back(ids, counts, [chr(c) for c in loose.tolist()])

    def _fall_back(self, ids: np.ndarray, counts: np.ndarray, loose: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes' pieces, or the unknown id if the model has none."""
        if not loose:
            return ids, counts
        bytes_of = [self.byte_ids[list(c.encode("utf-8", "replace"))] if self.falls_back else np.array([self.unk]) for c in loose]
        out = np.flatnonzero(ids >= self.size)
        which = ids[out] - self.size
        spans = np.ones(ids.size, np.int64)
        spans[out] = np.array([b.size for b in bytes_of])[which]
        spread, starts = np.repeat(ids, spans), np.cumsum(spans) - spans
        spread[ranges(starts[out], spans[out])] = np.concatenate([bytes_of[k] for k in which.tolist()]) if out.size else 0
        ends = np.concatenate([[0], np.cumsum(spans)])[np.concatenate([[0], np.cumsum(counts)])]
        return spread, np.diff(ends)

    def encode_batch(self, texts: list[str | None], store: SegmentStore) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and len + 1 offsets.

        store keeps segments encoded before. The key of a segment with one blank mark in front is the rest of it; of any other, a mark and the
        whole of it.
        """
        if len(store.rows) > store.most:
            store.clear()
        normal = [self.normalize(t) if t else "" for t in texts]
        plain = [k for k, t in enumerate(normal) if t and self._cut and t[0] == MARK and t[-1] != MARK and MARK * 2 not in t]
        words = pc.split_pattern(pa.array([normal[k][1:] for k in plain], pa.large_string()), MARK)
        coded = words.values.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place, bounds = coded.indices.to_numpy(), words.offsets.to_numpy()
        number = dict(zip(keys, range(len(keys)))) if len(plain) < len(texts) else {}
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for k, a, b in zip(plain, bounds.tolist(), bounds[1:].tolist()):
            parts[k] = place[a:b]
        for k in set(range(len(texts))) - set(plain):
            parts[k] = np.array([number.setdefault(s[1:] if s[0] == MARK and self._cut and MARK not in s[1:] and len(s) > 1 else MARK + s, len(number)) for s in self.segments(normal[k])], np.int64)
        keys += list(number)[len(keys) :]
        rows = list(map(store.rows.get, keys))
        if None in rows:
            new = [k for k, row in zip(keys, rows) if row is None]
            store.add(new, *self.encode_segments([k[1:] if k[0] == MARK else MARK + k for k in new]))
            rows = list(map(store.rows.get, keys))
        flat, sizes = store.take(np.array(rows, np.int64)[np.concatenate(parts).astype(np.int64)] if rows else np.zeros(0, np.int64))
        return flat, np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, parts)])]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id rows: pieces' bytes end to end, marks as blanks, without the blank that encoding put first; stray bytes become U+FFFD."""
        if ids.size and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("id outside the vocabulary")
        sizes = self.raw_at[ids + 1] - self.raw_at[ids]
        data = self.raw[ranges(self.raw_at[ids], sizes)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        return [data[a + (data[a : a + 1] == b" " and b > a) : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


#: A worker's store of encoded segments starts anew beyond so many.
STORE_SEGMENTS = 400_000


@lru_cache(maxsize=2)
def load(path: str) -> tuple[PieceModel, SegmentStore]:
    """The model and its store; both stay with the Python worker from task to task."""
    return PieceModel(path), SegmentStore(STORE_SEGMENTS)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id and `ids` (array<int>), the text's pieces without begin or end ids.

    A null text counts as empty and has no ids; repeated rows are encoded one by one. model_path is read on each executor. Only the two columns
    are read. No shuffle.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model, store = load(model_path)
        for batch in slices(batches):
            flat, offsets = model.encode_batch(batch.column("text").to_numpy(zero_copy_only=False).tolist(), store)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], [id_col, "ids"])

    return map_batches(rows, run, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with `text_col`, the text of its id rows (null ids: null; no ids: empty); a column of that name, in any case, is replaced. An id outside the
    vocabulary is an error. Repeated rows are decoded one by one; an empty table stays empty. No shuffle."""
    kept = [c for c in df.columns if c.lower() != text_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model, _ = load(model_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = part.column(ids_col)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
                texts = model.decode_batch(ids, offsets - offsets[0])
                if lists.null_count:
                    texts = [None if null else t for t, null in zip(texts, lists.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text_col])

    return map_batches(df.select(*kept), run, T.StructType([*df.select(*kept).schema.fields, T.StructField(text_col, T.StringType())]))
