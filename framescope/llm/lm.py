"""Language-model scores by deleted interpolation: bigram, unigram and uniform estimates, mixed by buckets of the context's frequency.

The mixture weights of each bucket come from expectation-maximisation on held-out counts: the documents of the tuning part are scored with counts
that leave them out. All counts cover the whole corpus. Texts are cut into blocks of documents, and each block asks for the counts of its own
distinct words and bigrams: what is shuffled is packed arrays of distinct keys, not tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import LOWER, flat_bytes, flat_words, hash_words, map_batches, mix, slices, stage

REST, TUNE, OTHER = 0, 1, 2  # parts: trained on, trained on and tuned with, only scored
BLOCK_TOKENS = 1_000_000
BUCKET_KEYS = 1_000_000
FREQUENCY_BUCKETS = 24
#: The hash that stands for the end of a text.
END = np.uint64(0x5A17C0DE5A17C0DE)
_STEP = np.uint64(0xD1342543DE82EF95)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as planes of bytes, lowest first, without the empty high ones: close values compress well so."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


@dataclass
class Block:
    """Some documents' tokens as indices into their sorted distinct word hashes; every document ends with END."""

    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, sizes: np.ndarray) -> Block:
        words, tokens = np.unique(hashes, return_inverse=True)
        return cls(words, tokens.astype(np.int64), sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, key, of): words of each distinct bigram in the order of its 48-bit key, and the bigram that ends at each token.

        A document's first token follows END."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.words, END)
        codes, of = np.unique(before * self.words.size + self.tokens, return_inverse=True)
        left, right = np.divmod(codes, self.words.size)
        key = mix(self.words[left] * _STEP + self.words[right]) >> np.uint64(16)
        order = np.argsort(key, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        return left[order], right[order], key[order], place[of]


def _blocks(docs: DataFrame, id_type: str) -> DataFrame:
    """(block, part, ids, sizes, words, tokens, n_keys): one row per block of documents of one part; about BLOCK_TOKENS tokens each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {p: [[], [], []] for p in (REST, TUNE, OTHER)}
        total = dict.fromkeys(held, 0)
        kind: pa.DataType = pa.int64()

        def close(part: int) -> pa.RecordBatch:
            nonlocal number
            ids, sizes, hashes = held[part]
            block = Block.of(np.concatenate(hashes), np.array(sizes))
            keys = block.words.size + np.unique(block.tokens[:-1] * block.words.size + block.tokens[1:]).size
            held[part], total[part] = [[], [], []], 0
            number += 1
            row = [pa.array([number], pa.int64()), pa.array([part], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([pack(block.sizes)], pa.binary()), pa.array([pack_sorted(block.words)], pa.binary()), pa.array([pack(block.tokens)], pa.binary()), pa.array([keys], pa.int64())]
            return pa.RecordBatch.from_arrays(row, ["block", "part", "ids", "sizes", "words", "tokens", "n_keys"])

        for batch in slices(batches):
            kind = batch.schema.field("id").type
            data, offsets = flat_bytes(batch.column("text"))
            data = LOWER[data]
            starts, ends, first = flat_words(data, offsets)
            hashes = hash_words(data, starts, ends)
            for doc, part, a, b in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist(), first.tolist(), first[1:].tolist()):
                ids, sizes, parts = held[part]
                ids.append(doc)
                sizes.append(b - a + 1)
                parts.append(np.append(hashes[a:b], END))
                total[part] += b - a + 1
                if total[part] >= BLOCK_TOKENS:
                    yield close(part)
        for part in held:
            if held[part][0]:
                yield close(part)

    return map_batches(docs, run, f"block long, part int, ids array<{id_type}>, sizes binary, words binary, tokens binary, n_keys long")


def _block_of(words: bytes, tokens: bytes, sizes: bytes) -> Block:
    return Block(unpack_sorted(words), unpack(tokens).astype(np.int64), unpack(sizes).astype(np.int64))


def _bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bucket of each key: an equal range of its top 20 bits, or of its top 32 where there are more buckets than that could tell apart."""
    top = 20 if buckets <= 1 << 16 else 32
    return ((keys >> np.uint64(bits - top)) * np.uint64(buckets) >> np.uint64(top)).astype(np.int64)


def _requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, part, uni, uni_n, bi, bi_n): the block's distinct keys in a bucket and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, part, *packed = (batch.column(c)[k].as_py() for c in ("block", "part", "words", "tokens", "sizes"))
                block = _block_of(*packed)
                _, _, keys, of = block.pairs()
                uni_n, bi_n = np.bincount(block.tokens, minlength=block.words.size), np.bincount(of, minlength=keys.size)
                wb, kb = _bucket_of(block.words, 64, buckets), _bucket_of(keys, 48, buckets)
                filled = np.union1d(wb, kb)  # only buckets that the block has keys of, so a block's work doesn't grow with the corpus
                spans = [np.searchsorted(of_, filled, side).tolist() for of_ in (wb, kb) for side in ("left", "right")]
                rows = [(i, number, part, pack_sorted(block.words[a:b]), pack(uni_n[a:b]), pack_sorted(keys[c:d]), pack(bi_n[c:d])) for i, a, b, c, d in zip(filled.tolist(), *spans)]
                types = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "block", "part", "uni", "uni_n", "bi", "bi_n"])

    return map_batches(blocks.select("block", "part", "words", "tokens", "sizes"), run, "bucket int, block long, part int, uni binary, uni_n binary, bi binary, bi_n binary")


def _totals(keys: list[np.ndarray], counts: list[np.ndarray], parts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """For each request the corpus counts of its keys (all training parts; REST alone), and both over distinct keys."""
    sizes = np.array([k.size for k in keys])
    distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
    n, part = np.concatenate(counts), np.repeat(parts, sizes)
    rest = np.bincount(of, np.where(part == REST, n, 0), distinct.size).astype(np.int64)
    every = rest + np.bincount(of, np.where(part == TUNE, n, 0), distinct.size).astype(np.int64)
    cuts = np.cumsum(sizes)[:-1]
    return np.split(every[of], cuts), np.split(rest[of], cuts), every, rest


def _answers(requests: DataFrame) -> DataFrame:
    """(block, bucket, part, uni, bi, uni_rest, bi_rest, stats): corpus counts for each request, in the order of its keys.

    The rows with a null block hold a bucket's share of [tokens, distinct words, tokens of REST, distinct words of REST]."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = group.part.to_numpy()
        uni, uni_rest, every, rest = _totals([unpack_sorted(x) for x in group.uni], [unpack(x) for x in group.uni_n], parts)
        bi, bi_rest, _, _ = _totals([unpack_sorted(x) for x in group.bi], [unpack(x) for x in group.bi_n], parts)
        bucket = group.bucket.iloc[0]
        tuned = parts == TUNE
        out = pd.DataFrame({
            "block": group.block.astype("Int64").to_numpy(), "bucket": bucket, "part": parts, "uni": [pack(x) for x in uni], "bi": [pack(x) for x in bi],
            "uni_rest": [pack(x) if t else None for x, t in zip(uni_rest, tuned)], "bi_rest": [pack(x) if t else None for x, t in zip(bi_rest, tuned)], "stats": None,
        })
        sums = pd.DataFrame({"block": [None], "bucket": [bucket], "part": [-1], "uni": [None], "bi": [None], "uni_rest": [None], "bi_rest": [None], "stats": [[int(every.sum()), int((every > 0).sum()), int(rest.sum()), int((rest > 0).sum())]]})
        return pd.concat([out.astype({"block": "object"}), sums], ignore_index=True)

    return requests.groupBy("bucket").applyInPandas(run, "block long, bucket int, part int, uni binary, bi binary, uni_rest binary, bi_rest binary, stats array<long>")


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the whole part of the count's binary logarithm."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], FREQUENCY_BUCKETS - 1)


def fit_weights(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """(FREQUENCY_BUCKETS, 3) weights of bigram, unigram and uniform estimates by expectation-maximisation; a bucket without counts keeps the start."""
    weights = np.tile([0.3, 0.5, 0.2], (FREQUENCY_BUCKETS, 1))
    p = np.stack([p2, p1, np.full(p2.size, p0)], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], FREQUENCY_BUCKETS) for k in range(3)], axis=1)
        seen = sums.sum(axis=1) > 0
        weights[seen] = (sums[seen] + 1e-3) / (sums[seen] + 1e-3).sum(axis=1, keepdims=True)
    return weights


#: Cells of a held-out estimate per power of ten. Estimates lie above 1e-15, so there are at most FREQUENCY_BUCKETS * 91 ** 2 cells, of six numbers each.
_STEPS = 6


def _held_out(blocks: DataFrame, answers: DataFrame, tokens: int) -> DataFrame:
    """(bucket, q2, q1, n, s2, s1): tokens of the tuning part by frequency bucket and cells of their bigram and unigram estimates from REST alone,
    with sums of the logarithms. A bounded number of cells."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cells = []
        for row in left.itertuples():
            block = _block_of(row.words, row.tokens, row.sizes)
            a, b, keys, of = block.pairs()
            right = right.sort_values("bucket")
            c1 = np.concatenate([unpack(x) for x in right.uni_rest]).astype(np.float64)
            c2 = np.concatenate([unpack(x) for x in right.bi_rest]).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                l2, l1 = np.log10(c2 / c1[a]), np.log10(c1[b] / tokens)
            l2, l1 = np.where(c2 > 0, l2, -99), np.where(c1[b] > 0, l1, -99)
            cells.append(pd.DataFrame({"bucket": frequency_bucket(c1[a]), "q2": np.round(l2 * _STEPS).astype(np.int64), "q1": np.round(l1 * _STEPS).astype(np.int64), "n": np.bincount(of, minlength=keys.size), "l2": l2, "l1": l1}))
        if not cells:
            return pd.DataFrame(columns=["bucket", "q2", "q1", "n", "s2", "s1"])
        all_ = pd.concat(cells)
        all_["s2"], all_["s1"] = all_.l2 * all_.n, all_.l1 * all_.n
        return all_.groupby(["bucket", "q2", "q1"], as_index=False)[["n", "s2", "s1"]].sum()

    tuned = blocks.where(f"part = {TUNE}").select("block", "words", "tokens", "sizes")
    found = answers.where(f"part = {TUNE}").select("block", "bucket", "uni_rest", "bi_rest")
    cells = tuned.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(run, "bucket int, q2 long, q1 long, n double, s2 double, s1 double")
    return cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1"))


def lm_scores(df: DataFrame, train: Column, tune: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, trained (whether `train` holds), n_tokens, n_known, train_tokens, train_words, base_score, score.

    Tokens are the words (runs without blanks, A-Z lower-cased) and one end of text. Learns from the rows where `train` holds; those where `tune`
    holds, too, fix the mixture weights. base_score is the add-one unigram log10 probability over the training counts; score is the model's.
    Words count by 64-bit hashes, bigrams by 48-bit ones. A null text is empty: its end alone. Repeated rows count each. An empty table has no rows;
    without training rows all counts are 0 and the model is uniform. Only the named columns are read.
    """
    part = F.when(~F.coalesce(train, F.lit(False)), OTHER).when(F.coalesce(tune, F.lit(False)), TUNE).otherwise(REST)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"), part.alias("part"))
    id_type = docs.schema["id"].dataType.simpleString()
    blocks = stage(_blocks(docs, id_type), "lm-blocks")
    keys = blocks.agg(F.sum("n_keys")).first()[0] or 0
    answers = stage(_answers(_requests(blocks, max(16, -(-keys // BUCKET_KEYS)))), "lm-counts")
    sums = answers.where("block is null").agg(*(F.sum(F.col("stats")[k]) for k in range(4))).first()
    tokens, words, rest_tokens, rest_words = (int(x or 0) for x in sums)
    cells = _held_out(blocks, answers, max(1, rest_tokens)).toPandas()
    n = cells.n.to_numpy(np.float64)
    means = [np.where(cells[q] > -50 * _STEPS, 10 ** (cells[s] / np.maximum(n, 1)), 0.0) for q, s in (("q2", "s2"), ("q1", "s1"))]
    weights = fit_weights(cells.bucket.to_numpy(np.int64), *means, 1 / (rest_words + 1), n)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            block = _block_of(row.words, row.tokens, row.sizes)
            a, b, _, of = block.pairs()
            right = right.sort_values("bucket")
            c1 = np.concatenate([unpack(x) for x in right.uni]).astype(np.float64)
            c2 = np.concatenate([unpack(x) for x in right.bi]).astype(np.float64)
            w = weights[frequency_bucket(c1[a])]
            p = w[:, 0] * (c2 / np.maximum(c1[a], 1)) + w[:, 1] * (c1[b] / max(1, tokens)) + w[:, 2] / (words + 1)
            base = np.log10((c1 + 1) / (tokens + words + 1))
            first = np.cumsum(block.sizes) - block.sizes
            out.append(pd.DataFrame({
                id_col: row.ids, "trained": row.part != OTHER, "n_tokens": block.sizes, "n_known": np.add.reduceat((c1 > 0)[block.tokens].astype(np.int64), first), "train_tokens": tokens, "train_words": words,
                "base_score": np.add.reduceat(base[block.tokens], first), "score": np.add.reduceat(np.log10(p)[of], first),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=[id_col, "trained", "n_tokens", "n_known", "train_tokens", "train_words", "base_score", "score"])

    sides = blocks.select("block", "part", "ids", "words", "tokens", "sizes"), answers.where("block is not null").select("block", "bucket", "uni", "bi")
    return sides[0].groupBy("block").cogroup(sides[1].groupBy("block")).applyInPandas(run, f"`{id_col}` {id_type}, trained boolean, n_tokens long, n_known long, train_tokens long, train_words long, base_score double, score double")
