"""Ids of a byte-level BPE tokenizer file with word ends, for whole texts, by way of the distinct words of a batch.

White space always parts words there, so a text's ids are its words' ids end to end. Words of plain Latin characters are cut and merged here, all
new ones at once; any other word (and those that hold a special token) goes through the tokenizers library by itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from framescope.llm.common import flat_bytes, flat_words, word_array
from framescope.llm.merges import MergeTable, SegmentStore

#: Characters whose case, normal form and class are beyond doubt; the tokenizer's cut into words (fixed values).
_PLAIN = regex.compile("[!-~¡-įı-ɏ]+")
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
STORE_WORDS = 400_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next free character from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b, chr(b)) for b in range(256)]


class WordTokenizer:
    """Reads a tokenizer file: lower-casing byte-level BPE whose words' last symbols carry an end mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        # the rules that encode_words follows; a file with others is left to the library altogether
        self.plain = [n["type"] for n in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in spec["pre_tokenizer"].get("pretokenizers", [])] == ["Split", "ByteLevel"]
        vocab = model["vocab"]
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.merges = MergeTable(pairs)
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + self.end, -1) for c in letters], np.int64)
        self.chunks, self.words = SegmentStore(STORE_WORDS), SegmentStore(STORE_WORDS)

    def _merge_words(self, words: list[str]) -> None:
        """Adds new words to the store."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        self.words.add(words, *self.merges.merge(symbols, sizes))

    def _add_chunks(self, chunks: list[str]) -> None:
        """Adds new chunks (texts without white space) to the store."""
        plain, odd = [], []
        for c in chunks:
            (plain if self.plain and _PLAIN.fullmatch(c) and not any(s in c for s in self.special) else odd).append(c)
        cut = [_CUT.findall(c.lower()) for c in plain]
        if len(self.words.rows) > self.words.most:
            self.words.clear()
        new = list({w: None for words in cut for w in words if w not in self.words.rows})
        if new:
            self._merge_words(new)
        row = np.fromiter((self.words.rows[w] for words in cut for w in words), np.int64)
        ids, sizes = self.words.take(row)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, cut)])]
        if plain:
            self.chunks.add(plain, ids, np.diff(ends))
        if odd:
            found = [e.ids for e in self.library.encode_batch(odd, add_special_tokens=False)]
            self.chunks.add(odd, np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found]))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and len + 1 offsets; a null text is empty."""
        data, offsets = flat_bytes(texts)
        starts, ends, first = flat_words(data, offsets)
        coded = word_array(data, starts, ends).dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.chunks.rows) > self.chunks.most:
            self.chunks.clear()
        new = [c for c in chunks if c not in self.chunks.rows]
        if new:
            self._add_chunks(new)
        row = np.fromiter(map(self.chunks.rows.__getitem__, chunks), np.int64, len(chunks))
        ids, sizes = self.chunks.take(row[coded.indices.to_numpy()] if chunks else np.zeros(0, np.int64))
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)
