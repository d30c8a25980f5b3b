"""Toxicity: a weighted lexicon, matched by Aho-Corasick after folding homoglyphs and digit substitutions, normalised by length.

`learn_lexicon` weighs words by labelled rows; `score_toxicity` applies a lexicon to any texts.
"""

from __future__ import annotations

import bisect
import itertools
import math
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import drawn_below, join_small, keep_where, map_batches, slices, stage

#: Letters of other scripts that look like Latin ones (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
#: Digits and signs that stand for letters inside a word (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Ends a lexicon entry that stands for all words which begin so; stems have STEM_SIZES letters.
STEM, STEM_SIZES = "~", (4, 5, 6)
#: Powers of the length that learning may divide by.
POWERS = (0.1, 0.25, 0.5, 1.0)


class _Fold(dict):
    """For str.translate: a letter's base letter, a homoglyph's or substitute's letter, else a blank. Filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = char.lower()
        base = HOMOGLYPHS.get(low) or unicodedata.normalize("NFKD", low)[:1]
        base = HOMOGLYPHS.get(base, base)
        if unicodedata.combining(char) or 0x200B <= code <= 0x200D or code in (0xAD, 0xFEFF):
            out = ""
        elif "a" <= base <= "z":
            out = base
        else:
            out = char if char in SUBSTITUTES or base.isalpha() else " "
        if len(self) < 1 << 16:
            self[code] = out
        return out


_FOLD = _Fold()
_SUBSTITUTE = {ord(k): v for k, v in SUBSTITUTES.items()}


def fold(text: str) -> list[str]:
    """A text's folded words: lower case, without marks, homoglyphs and substitutes replaced; signs at a word's ends are punctuation, and a word of digits alone stays."""
    words = text.translate(_FOLD).split()
    if not any(c in text for c in SUBSTITUTES):
        return words
    out = []
    for word in words:
        core = word.strip("!")  # signs at the ends are punctuation
        if any("a" <= c <= "z" for c in core):
            core = core.translate(_SUBSTITUTE)
        core = "".join(c for c in core if c not in "@$!")
        if core:
            out.append(core)
    return out


@dataclass
class Lexicon:
    """Words and their weights, and how a text's score comes of them: logistic(bias + slope * log1p(sum of weights / n_words ** power)).

    exceptions: phrases of folded words; a lexicon word inside one of them does not count."""

    weights: dict[str, float]
    bias: float = -4.0
    slope: float = 6.0
    power: float = 0.1
    exceptions: tuple[str, ...] = ()
    _automaton: object = field(default=None, repr=False)

    def automaton(self) -> ahocorasick.Automaton | None:
        if self._automaton is None and self.weights:
            built = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                if word.endswith(STEM):
                    built.add_word(f" {word[:-1]}", (len(word), weight))
                    continue
                built.add_word(f" {word} ", (len(word) + 2, weight))
            for phrase in self.exceptions:
                built.add_word(f" {phrase} ", (len(phrase) + 2, None))
            built.make_automaton()
            self._automaton = built
        return self._automaton

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def finds(self, words: list[str]) -> tuple[str, list[tuple[int, int, float | None]]]:
        """The words with blanks around them, and (from, to, weight) of every find there; the weight of an exception is None."""
        text, built = f" {' '.join(words)} ", self.automaton()
        return text, [(end + 1 - size, end + 1, weight) for end, (size, weight) in built.iter(text)] if built is not None and words else []

    def score(self, words: list[str]) -> tuple[float, int, float]:
        """(score, lexicon words found outside exception phrases, sum of their weights) of folded words."""
        _, found = self.finds(words)
        # exceptions by where they begin, with how far any that begin so early reach: a find lies in one if one that begins no later ends no earlier
        begins, reach = [], []
        for a, b in sorted((a, b) for a, b, weight in found if weight is None):
            begins.append(a)
            reach.append(max(b, reach[-1] if reach else b))
        inside = lambda a, b: (k := bisect.bisect_right(begins, a)) > 0 and reach[k - 1] >= b
        weights = [weight for a, b, weight in found if weight is not None and not inside(a, b)]
        total = sum(weights)
        dense = total / max(1, len(words)) ** self.power
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + self.slope * math.log1p(dense))))), len(weights), float(total)


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", most_rows: int = 20_000) -> DataFrame:
    """(id, toxic) of about most_rows label rows of each class (0, 1), picked by a hash of the id; all of them where there are fewer. Null ids and other labels do not count."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bound = {k: drawn_below(most_rows / max(1, sizes.get(k, 0))) for k in (0, 1)}
    return rows.where(F.xxhash64("id") <= F.when(F.col("toxic") == 1, bound[1]).otherwise(bound[0]))


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, least_docs: int = 4, least_weight: float = 2.0, least_g: float = 25.0) -> Lexicon:
    """Learns words, weights, exception phrases and the scale from the documents that labels cover (1 toxic, 0 not; null texts do not count).

    About most_rows labelled rows of each class take part (see sample_labels), a bounded sample; all of their words do. A word's weight is the log-odds
    of its document frequency in toxic against other rows, each smoothed by a half; words in at least least_docs toxic rows, of at least least_weight
    and a likelihood ratio of least_g enter. Two or three words that hold a lexicon word are an exception if they stand in at least least_docs clean
    rows and their own log-odds are below 0. The length's power and the scale are fitted by logistic regression on the same rows' sums. Without toxic
    rows, or on an empty table, the lexicon is empty and every score is low. Repeated rows count each. Ties cannot arise: no word is left out for another.
    """
    picked = stage(sample_labels(labels, id_col, label_col, most_rows), "toxic-labels")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = stage(join_small(texts, picked, ["id"]).select("text", "toxic"), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Lexicon({})
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 0.5 - F.col("toxic"))) - F.log((F.col("clean") + 0.5) / (n_clean + 0.5 - F.col("clean")))
    share, seen = n_toxic / (n_toxic + n_clean), F.col("toxic") + F.col("clean")
    g = 2 * (F.col("toxic") * F.log(F.col("toxic") / (seen * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (seen * max(1 - share, 1e-9)))).otherwise(0.0))
    words = _counted(sample, lambda found: found | {w[:k] + STEM for w in found for k in STEM_SIZES if len(w) > k}, None)
    best = words.where(f"toxic >= {least_docs}").select("term", odds.alias("weight"), g.alias("g")).where((F.col("weight") >= least_weight) & (F.col("g") >= least_g))
    lexicon = Lexicon({r["term"]: r["weight"] for r in best.collect()})
    if not lexicon.weights:
        return lexicon
    phrases = _counted(sample, None, lexicon).where((F.col("clean") >= least_docs) & (odds < 0))
    lexicon = Lexicon(lexicon.weights, exceptions=tuple(sorted(r["term"] for r in phrases.collect())))

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(p, round(math.log1p(total / max(1, len(words)) ** p), 2), toxic) for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()) for words in [fold(text)] for total in [lexicon.score(words)[2]] for p in POWERS]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int32()))], ["p", "x", "toxic"])

    points: dict[float, list[tuple[float, int, int]]] = {}
    for r in map_batches(sample, sums_of, "p double, x double, toxic int").groupBy("p", "x").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect():
        points.setdefault(r["p"], []).append((r["x"], r["n"], r["toxic"]))
    _, lexicon.power, lexicon.bias, lexicon.slope = min((_loss(found, *fit), p, *fit) for p, found in points.items() for fit in [_logistic(found)])
    return lexicon


def _counted(sample: DataFrame, widen: Callable[[set[str]], set[str]] | None, lexicon: Lexicon | None) -> DataFrame:
    """(term, clean, toxic): rows of either label that hold a term: folded words, widened; or phrases around the finds of a lexicon."""

    def terms(text: str) -> set[str]:
        return widen(set(fold(text))) if lexicon is None else _phrases(lexicon, fold(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for term in terms(text):
                    counts.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])

    return map_batches(sample, run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _phrases(lexicon: Lexicon, words: list[str]) -> set[str]:
    """Each find's word with the one or two words before it, and with the one behind it."""
    _, found = lexicon.finds(words)
    begins = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    out = set()
    for at in {bisect.bisect_left(begins, a) for a, _, _ in found}:
        out |= {" ".join(words[max(0, at - k) : at + 1]) for k in (1, 2) if at >= k} | {" ".join(words[at : at + 2])}
    return {x for x in out if " " in x}


def _loss(points: list[tuple[float, int, int]], bias: float, slope: float) -> float:
    return sum(n * math.log1p(math.exp(min(60.0, z))) - y * z for x, n, y in points for z in [bias + slope * x])


def _logistic(points: list[tuple[float, int, int]], steps: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Bias and slope by Newton's method, lightly regularised, on (x, rows, label-1 rows)."""
    bias, slope = -2.0, 1.0
    for _ in range(steps):
        g0, g1, h00, h01, h11 = ridge * bias, ridge * slope, ridge, 0.0, ridge
        for x, n, y in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + slope * x))))
            g0, g1, v = g0 + n * p - y, g1 + (n * p - y) * x, n * p * (1 - p)
            h00, h01, h11 = h00 + v, h01 + v * x, h11 + v * x * x
        det = h00 * h11 - h01 * h01
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 3.0 / max(abs(d0), abs(d1), 1e-9))
        bias, slope = bias - step * d0, slope - step * d1
        if max(abs(d0), abs(d1)) < 1e-9:
            break
    return bias, slope


def score_toxicity(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, score (0 to 1), hits (lexicon words outside exception phrases), weight (their sum), n_words (folded words).

    A null text counts as empty and gets the score of no find; long texts are scored whole, in slices of about a MB; repeated rows and ids are scored
    one by one; an empty table gives no rows. Only the two columns are read, whatever others are called. No shuffle.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = fold(text or "")
                out.append((*lexicon.score(words), len(words)))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.float64(), pa.int64())))], [id_col, "score", "hits", "weight", "n_words"])

    return map_batches(rows, score, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("hits", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("n_words", T.LongType())]))


def drop_toxic(df: DataFrame, lexicon: Lexicon, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text scores below `least`; one that reaches it goes.

    Null texts score as empty ones; repeated rows are judged alike; an empty table stays empty; no column is added, so none clashes. No shuffle."""
    return keep_where(df, text_col, lambda texts: pa.array([lexicon.score(fold(t or ""))[0] < least for t in texts.to_pylist()], pa.bool_()))
