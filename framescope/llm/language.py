"""Language identification by a bidirectional gated recurrent network over bytes.

`train` fits the network in numpy by backpropagation through time on byte windows of labelled texts; `label_languages` runs it over whole texts,
labels every byte position and pools the positions' probabilities to the document's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import drawn_below, flat_bytes, keep_where, map_batches, slices

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LONGEST = 12  # bounds are told for lengths up to 2 ** 12 bytes


@dataclass
class Network:
    """Weights of both directions (first axis: forward, backward) and of the output layer.

    For a byte x and state h: z, r = sigmoid(inp[x] + h @ rec) of the first two thirds; n = tanh(inp[x] + r * (h @ rec)) of the last;
    the next h is (1 - z) * n + z * h. A position's class scores are fwd @ out[0] + bwd @ out[1] + bias.
    """

    langs: list[str]
    inp: np.ndarray  # 2, 256, 3 * hidden
    rec: np.ndarray  # 2, hidden, 3 * hidden
    out: np.ndarray  # 2, hidden, classes
    bias: np.ndarray  # classes

    @classmethod
    def start(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        f = np.float32
        return cls(langs, rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f), rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(f), rng.normal(0, 0.3, (2, hidden, len(langs))).astype(f), np.zeros(len(langs), f))

    def states(self, codes: np.ndarray, side: int, trace: list | None = None) -> np.ndarray:
        """(steps, hidden, rows) states over codes (steps, rows); side 1 reads from the end. trace gets what backpropagation needs, in reading order.

        Rows come last, so that every elementwise step runs over contiguous memory.
        """
        steps, rows = codes.shape
        hidden = self.rec.shape[1]
        inp, rec = self.inp[side].T.copy(), self.rec[side].T.copy()
        inp[: 2 * hidden] *= 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        rec[: 2 * hidden] *= 0.5
        out = np.empty((steps, hidden, rows), np.float32)
        h = np.zeros((hidden, rows), np.float32)
        x, g, gates, cand = (np.empty((k * hidden, rows), np.float32) for k in (3, 3, 2, 1))
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            np.take(inp, codes[t], axis=1, out=x, mode="clip")
            np.matmul(rec, h, out=g)
            np.add(x[: 2 * hidden], g[: 2 * hidden], out=gates)
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:hidden], gates[hidden:]
            np.multiply(r, g[2 * hidden :], out=cand)
            cand += x[2 * hidden :]
            np.tanh(cand, out=cand)
            if trace is not None:
                trace.append((t, h.copy(), z.copy(), r.copy(), cand.copy(), g[2 * hidden :].copy()))
            new = out[t]
            np.subtract(h, cand, out=new)
            new *= z
            new += cand
            h = new
        return out

    def position_scores(self, codes: np.ndarray) -> np.ndarray:
        """(steps, classes, rows) probabilities of every position."""
        scores = np.matmul(self.out[0].T, self.states(codes, 0))
        scores += np.matmul(self.out[1].T, self.states(codes, 1))
        scores += self.bias[:, None]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def gradients(self, codes: np.ndarray, target: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over valid positions, and its gradient by backpropagation through time, both directions."""
        hidden, (steps, rows) = self.rec.shape[1], codes.shape
        traces: list[list] = [[], []]
        states = [self.states(codes, side, traces[side]) for side in (0, 1)]
        p = np.matmul(self.out[0].T, states[0]) + np.matmul(self.out[1].T, states[1]) + self.bias[:, None]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        n = max(1.0, float(valid.sum()))
        each = np.arange(rows)
        loss = -float((np.log(p[:, target, each] + 1e-9) * valid).sum()) / n
        p[:, target, each] -= 1
        p *= (valid / n)[:, None, :]
        grad = {"inp": np.zeros_like(self.inp), "rec": np.zeros_like(self.rec), "out": np.zeros_like(self.out), "bias": p.sum(axis=(0, 2))}
        place = codes[:, None, :] + 256 * np.arange(3 * hidden)[None, :, None]
        for side in (0, 1):
            grad["out"][side] = np.einsum("thr,tcr->hc", states[side], p, optimize=True)
            above = np.matmul(self.out[side], p)
            dh = np.zeros((hidden, rows), np.float32)
            dg, dx = np.empty((steps, 3 * hidden, rows), np.float32), np.empty((steps, 3 * hidden, rows), np.float32)
            before = np.empty((steps, hidden, rows), np.float32)
            for t, h, z, r, cand, g in reversed(traces[side]):
                dh += above[t]
                dn = dh * (1 - z) * (1 - cand * cand)
                dx[t, :hidden] = dh * (h - cand) * z * (1 - z)
                dx[t, hidden : 2 * hidden] = dn * g * r * (1 - r)
                dx[t, 2 * hidden :] = dn
                dg[t] = dx[t]
                dg[t, 2 * hidden :] *= r
                before[t] = h
                dh = dh * z + self.rec[side] @ dg[t]
            grad["rec"][side] = np.einsum("thr,tgr->hg", before, dg, optimize=True)
            grad["inp"][side] = np.bincount(place.ravel(), dx.ravel(), 256 * 3 * hidden).reshape(3 * hidden, 256).T
        return loss, grad


def train(windows: np.ndarray, target: np.ndarray, langs: list[str], hidden: int = 8, steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam with a decaying rate over shuffled batches of byte windows (rows, width; 0 pads a window's end). Without windows the network stays as it starts."""
    rng = np.random.default_rng(seed)
    net = Network.start(langs, hidden, rng)
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("inp", "rec", "out", "bias")}
    by_class = [np.flatnonzero(target == k) for k in range(len(langs))]
    for step in range(1, steps + 1 if len(windows) else 1):
        pick = np.concatenate([rng.choice(rows, max(1, batch // len(langs))) for rows in by_class if rows.size])
        codes = windows[pick].T.astype(np.int64)
        _, grad = net.gradients(codes, target[pick], (codes > 0).astype(np.float32))
        pace = rate * (1 - step / (steps + 1)) ** 0.5
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grad.values()))))
        for k, g in grad.items():
            m, v = moments[k]
            m *= 0.9
            m += 0.1 * g / norm
            v *= 0.999
            v += 0.001 * (g / norm) ** 2
            getattr(net, k)[...] -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _drawn_texts(known: DataFrame, text: str, lang: str, most_docs: int, seed: str) -> tuple[DataFrame, list[str]]:
    """((lang, text) of about most_docs distinct texts of each language, picked by a seeded hash of the text; the languages).

    Copies of a text count once: they are put together before anything leaves a task, so a text that fills the corpus is one row."""
    rows = known.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).withColumn("h", F.xxhash64("text", F.lit(seed)))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}  # a row for each language
    if not sizes:
        return rows.select("lang", "text"), []
    share = F.create_map(*(F.lit(x) for k in sorted(sizes) for x in (k, drawn_below(most_docs / max(1, sizes[k])))))
    drawn = rows.where(F.col("h") <= share[F.col("lang")])
    return drawn.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text"), sorted(sizes)


def training_windows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_docs: int = 400, most_windows: int = 400_000, per_doc: int = 8, width: int = 48) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(windows, class of each, languages): per_doc byte windows, evenly spread, of about most_docs distinct texts of each language; fewer texts (but 8
    at least) where there are so many languages that most_windows would be passed. A bounded sample; every language that occurs is learnt. Rows without
    text or language do not count; an empty table gives no windows."""
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    n_langs = known.select(F.col(f"`{lang_col}`").cast("string")).distinct().count()
    each = max(8, min(most_docs, most_windows // (per_doc * max(1, n_langs))))
    sample, langs = _drawn_texts(known, text_col, lang_col, each, "train")
    if not langs:
        return np.zeros((0, width), np.uint8), np.zeros(0, np.int64), []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode("utf-8", "replace")
                starts = {max(0, (len(data) - width) * k // max(1, per_doc - 1)) for k in range(per_doc)}
                out += [(lang, data[s : s + width]) for s in starts if data]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], ["lang", "data"])

    rows = sorted((r["lang"], bytes(r["data"])) for r in map_batches(sample, cut, "lang string, data binary").collect())
    windows = np.frombuffer(b"".join(data.ljust(width, b"\0") for _, data in rows), np.uint8).reshape(-1, width)
    place = {x: k for k, x in enumerate(langs)}
    return windows, np.array([place[x] for x, _ in rows], np.int64), langs


def _window_sums(net: Network, texts: pa.Array, width: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, classes) sums of the position probabilities of each window; the bytes and the windows of each text."""
    data, offsets = flat_bytes(texts)
    sizes = np.diff(offsets)
    windows = -(-sizes // width)
    first = np.cumsum(windows) - windows
    codes = np.zeros(int(windows.sum()) * width, np.uint8)
    shift = np.repeat(first * width - offsets[:-1], sizes)
    codes[np.arange(data.size) + shift] = data
    filled = np.zeros(codes.size, bool)
    filled[np.arange(data.size) + shift] = True
    codes, filled = codes.reshape(-1, width), filled.reshape(-1, width)
    sums = np.zeros((codes.shape[0], len(net.langs)))
    for a in range(0, codes.shape[0], block):
        part = net.position_scores(np.ascontiguousarray(codes[a : a + block].T))
        if not filled[a : a + block, -1].all():
            part *= filled[a : a + block].T[:, None, :]
        sums[a : a + block] = part.sum(axis=0).T
    return sums, sizes, windows


def text_scores(net: Network, texts: pa.Array, width: int = 64, block: int = 2048) -> np.ndarray:
    """(rows, classes) means of the position probabilities of each whole text; rows of an empty text are 0.

    Texts are laid into windows of `width` bytes, which the network reads each by itself.
    """
    return _means(*_window_sums(net, texts, width, block))


def text_sureness(net: Network, texts: pa.Array, width: int = 64, block: int = 2048) -> np.ndarray:
    """(rows,) means over each whole text of its windows' greatest probability: 1 if every window is surely of some language, be it not the same one."""
    sums, sizes, windows = _window_sums(net, texts, width, block)
    return _means(sums.max(axis=1, keepdims=True), sizes, windows)[:, 0]


def _means(sums: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), sums.shape[1]))
    some = windows > 0
    if some.any():
        out[some] = np.add.reduceat(sums, (np.cumsum(windows) - windows)[some], axis=0) / sizes[some][:, None]
    return out


def label_languages(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, lang_pred, score (the pooled probability of lang_pred, 0 to 1).

    A null text, one without a letter, or a network without languages gives `und` with score 0. Of languages with equal probability the first by name
    wins. Long texts are read whole, window by window. Only the two columns are read, whatever others are called; a language column plays no part.
    Repeated rows and ids are labelled one by one; an empty table gives no rows. No shuffle.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            lettered = [bool(t) and _LETTER.search(t) is not None for t in texts.to_numpy(zero_copy_only=False).tolist()]
            scores = text_scores(net, texts) if net.langs else np.zeros((len(texts), 1))
            best = scores.argmax(axis=1)
            langs = [net.langs[k] if ok and net.langs else UNKNOWN for k, ok in zip(best.tolist(), lettered)]
            score = np.where([x != UNKNOWN for x in langs], np.clip(scores.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return map_batches(rows, run, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def position_labels(net: Network, text: str, width: int = 64) -> list[str]:
    """The language of every byte position of one text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    codes = np.zeros(-(-data.size // width) * width, np.uint8)
    codes[: data.size] = data
    best = net.position_scores(np.ascontiguousarray(codes.reshape(-1, width).T)).argmax(axis=1).T.ravel()[: data.size]
    return [net.langs[k] for k in best.tolist()]


def _beginnings(text: str) -> tuple[list[int], list[str]]:
    """The beginnings of 2 ** k bytes of a text that have letters, for k from 0 on: each k, and the beginning without a character that it cuts."""
    data = text.encode("utf-8", "replace")
    cuts = [(k, data[: 1 << k].decode("utf-8", "ignore")) for k in range(_LONGEST + 1) if len(data) >= 1 << k]
    found = [(k, x) for k, x in cuts if _LETTER.search(x)]
    return [k for k, _ in found], [x for _, x in found]


#: Steps of a sureness of 1 by which length_bounds counts.
_STEPS = 10_000


def length_bounds(net: Network, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = 0.005, slack: float = 0.1, full: int = 256) -> np.ndarray:
    """The least sureness by which a text of 2**k to 2**(k+1) - 1 bytes counts as one of a learnt language, for k from 0 on; longer texts have the last.

    Beginnings of all such lengths of every labelled text are scored, a text once whatever its copies: the bound of a length is the sureness that all but
    `share` of them reach, less `slack` of its distance from chance, 1 / languages. As short texts tell little, the bound falls to chance in proportion to
    the length below `full` bytes. It never falls with the length. A network of less than two languages cannot tell unlike texts: its bounds are 0.

    Surenesses are counted by ten-thousandths, rounded down, so that what is shuffled is a row for each text, and what reaches the driver a row for each
    length and ten-thousandth, however many texts there are.
    """
    bounds = np.zeros(_LONGEST + 1)
    if len(net.langs) < 2:
        return bounds
    known = docs.where(F.col(f"`{lang_col}`").cast("string").isin(net.langs) & F.col(f"`{text_col}`").isNotNull())
    rows = known.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{text_col}`"), F.lit("bounds")).alias("h"), F.col(f"`{text_col}`").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches):
            cuts = [_beginnings(t) for t in batch.column("text").to_pylist()]
            found = np.floor(text_sureness(net, pa.array([x for _, texts in cuts for x in texts], pa.string())) * _STEPS).astype(np.int32)
            ends = np.cumsum([len(ks) for ks, _ in cuts])
            told = [[k * (_STEPS + 1) + int(x) for k, x in zip(ks, found[end - len(ks) : end])] for (ks, _), end in zip(cuts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(told, pa.list_(pa.int32()))], ["lang", "h", "told"])

    each = map_batches(rows, score, "lang string, h bigint, told array<int>").groupBy("lang", "h").agg(F.first("told").alias("told"))
    counts: dict[int, list[tuple[int, int]]] = {}
    for cell, n in sorted(each.select(F.explode("told").alias("cell")).groupBy("cell").count().collect()):
        counts.setdefault(cell // (_STEPS + 1), []).append((cell % (_STEPS + 1), n))
    if not counts:
        return bounds
    chance = at = 1 / len(net.langs)
    for k in range(_LONGEST + 1):
        if k in counts:
            values, n = zip(*counts[k])
            place = share * (sum(n) - 1)
            low, high = np.searchsorted(np.cumsum(n), [int(place), int(np.ceil(place))], side="right")
            at = max(at, (values[low] + (values[high] - values[low]) * (place - int(place))) / _STEPS)
        bounds[k] = chance + (1 - slack) * (at - chance) * min(1.0, (1 << k) / full)
    return bounds


def keep_known(df: DataFrame, net: Network, bounds: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text has letters and a sureness that reaches the bound of its length (see length_bounds). No shuffle.

    With no language learnt, every text with letters stays. Null and empty texts go; a text just at the bound stays; repeated rows are judged alike; an
    empty table stays empty; no column is added, so none clashes."""

    def known(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
            column = part.column("text")
            lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in column.to_numpy(zero_copy_only=False).tolist()])
            sizes = np.diff(flat_bytes(column)[1])
            least = bounds[np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), len(bounds) - 1)]
            out.append(lettered & (text_sureness(net, column) >= least) if net.langs else lettered)
        return pa.array(np.concatenate(out))

    return keep_where(df, text_col, known)
