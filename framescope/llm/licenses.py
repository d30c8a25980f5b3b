"""Licence scan: Aho-Corasick over normalised words finds notice phrases and identifier tags; a shunting-yard parser reads tag expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framescope.llm.common import map_batches, slices

#: Notice phrases and their labels (fixed values).
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases, their labels and how surely each tells of a licence (fixed values).
MORE_PHRASES = {
    "permission is hereby granted free of charge": ("mit", 0.9),
    "released under mit": ("mit", 0.8),
    "licensed under the apache license": ("apache-2", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl-2", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd 2 clause": ("bsd-2-clause", 0.8),
    "bsd 3 clause": ("bsd-3-clause", 0.8),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "creative commons attribution sharealike": ("cc-by-sa", 0.9),
    "cc by sa": ("cc-by-sa", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.5),
}

#: Tags that a licence expression follows, as normalised words (fixed values).
TAGS = ("spdx license identifier", "license expression")

#: Identifiers as they stand in expressions, lower case, and their labels (fixed values); others keep their own name.
IDENTIFIERS = {"mit": "mit", "apache-2.0": "apache-2", "apache-2": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc": "cc-by-nc", "bsd-3-clause": "bsd-3-clause", "bsd-2-clause": "bsd-2-clause", "mpl-2.0": "mpl-2"}

#: Labels that a permitted expression may rest on, unless a caller says otherwise.
PERMITTED = ("mit", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "zlib")

BASE_WEIGHT, TAG_WEIGHT = 0.9, 0.95
_BINDING = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"\n|\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: What counts as an identifier where prose may go on as well.
_NAME = re.compile(
    r"[a-z0-9.+:-]*[0-9.+-][a-z0-9.+:-]*|mit|isc|zlib|unlicense|wtfpl|gpl|lgpl|agpl|bsd|mpl|apache|postgresql|ruby|curl|ncsa|openssl|vim|libpng|libtiff|ntp|hpnd|ftl|ijg|icu"
    r"|smlnj|qhull|imagemagick|sleepycat|beerware|netcdf|fsfap|fsful|fsfullr|gnuplot|php|tcl|upl|x11"
)
_STATED = re.compile(rb"[ \t\"']*[:=]")
#: Letters and digits stay (A-Z lower-cased), as do all bytes of characters beyond ASCII; all else parts words.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def to_postfix(expression: str | bytes, at: int = 0, stated: bool = True) -> list[str] | None:
    """Shunting-yard: a licence expression in postfix order ('with' binds tighter than 'and', 'and' tighter than 'or').

    It begins at byte `at` and ends with its line, or goes on over line ends while a bracket is open. Any identifier counts at the beginning if that is
    `stated`, after '(' and after upper-case operators; elsewhere, where prose may follow, only names with a digit or sign and well-known ones do. The
    longest well-formed beginning counts, so prose after an expression does no harm; None if there is none.
    """
    data = expression.encode("utf-8", "surrogatepass") if isinstance(expression, str) else expression
    out: list[str] = []
    held: list[str] = []
    operand_next, depth, good, free = True, 0, None, stated

    for match in _TOKEN.finditer(data, at):
        said = match[0].decode().rstrip(".:")
        token = said.lower()
        if token == "\n":
            if not depth:
                break
            continue
        if token == "(":
            if not operand_next:
                break
            held.append(token)
            depth += 1
            free = True
        elif token == ")":
            if operand_next or not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        elif token in _BINDING:
            if operand_next:
                break
            while held and held[-1] != "(" and _BINDING[held[-1]] >= _BINDING[token]:
                out.append(held.pop())
            held.append(token)
            operand_next, free = True, said.isupper()
            continue
        else:
            if not operand_next or not free and not _NAME.fullmatch(token) and not (held and held[-1] == "with"):
                break
            out.append(token)
            operand_next = False
        if not operand_next and not depth:
            good = len(out), held[::-1]  # at this depth three operators wait at most
    return out[: good[0]] + good[1] if good else None


def evaluate(postfix: list[str], permitted: Iterable[str] = PERMITTED) -> tuple[set[str], bool]:
    """The labels that an expression names, and whether permitted labels alone can meet it: 'or' needs either side, 'and' both; an exception
    ('with') only widens what its licence allows, and becomes part of the label. Each operator takes one step, so long expressions are no burden."""
    allowed = set(permitted)
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in _BINDING:
            label = IDENTIFIERS.get(token, token)
            stack.append(({label}, label in allowed))
            continue
        (right, right_met), (left, left_met) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{x} with {y}" for x in left for y in right}, left_met))
        else:
            stack.append((left | right, left_met and right_met if token == "and" else left_met or right_met))
    return stack[0]


@lru_cache(maxsize=4)
def _automaton(base: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, str, float]]] = {}
    for kind, phrases in (("base", [(p, x, BASE_WEIGHT) for p, x in base]), ("more", [(p, *x) for p, x in MORE_PHRASES.items()]), ("tag", [(p, "", TAG_WEIGHT) for p in TAGS])):
        for phrase, label, weight in phrases:
            key = " ".join(phrase.encode().translate(_NORMAL).decode("latin-1").split())
            found.setdefault(f" {key} ", []).append((kind, label, weight))
    out = ahocorasick.Automaton()
    for key, values in found.items():
        out.add_word(key, (len(key), values))
    out.make_automaton()
    return out


def scan_text(text: str, base: tuple[tuple[str, str], ...], permitted: tuple[str, ...] = PERMITTED) -> tuple:
    """One text's row: n_words, base starts, phrase starts, base labels, all labels, expressions, whether all of them are permitted, score."""
    raw = text.encode("utf-8", "surrogatepass").translate(_NORMAL)
    words = raw.split()
    normal = f" {b' '.join(words).decode('latin-1')} "
    base_at: list[int] = []
    more_at: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    expressions: list[str] = []
    met: bool | None = None
    doubt, seen, at, tagged = 1.0, 0, 0, []
    for end, (length, values) in _automaton(base).iter(normal):
        start = end - length + 1
        if start < at:  # a longer phrase that began earlier ends now
            seen, at = 0, 0
        seen, at = seen + normal.count(" ", at, start), start
        for kind, label, weight in values:
            if kind == "tag":
                tagged.append(seen + length_in_words(length, normal, start))
                continue
            (base_at if kind == "base" else more_at).append(seen)
            (base_labels if kind == "base" else labels).add(label)
            doubt *= 1 - weight
    if tagged:
        spans = [m.end() for m in _WORD.finditer(raw)]
        data = text.encode("utf-8", "surrogatepass")
        for k in tagged:
            if postfix := to_postfix(data, spans[k - 1], _STATED.match(data, spans[k - 1]) is not None):
                expressions.append(" ".join(postfix))
                named, this = evaluate(postfix, permitted)
                labels |= named
                met = this and met is not False
                doubt *= 1 - TAG_WEIGHT
    return len(words), base_at, more_at, sorted(base_labels), sorted(labels | base_labels), expressions, met, 1 - doubt


_WORD = re.compile(rb"[^ ]+")


def length_in_words(length: int, normal: str, start: int) -> int:
    return normal.count(" ", start + 1, start + length)


SCAN_SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("base_starts", T.ArrayType(T.LongType())),
        T.StructField("phrase_starts", T.ArrayType(T.LongType())),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("expressions", T.ArrayType(T.StringType())),
        T.StructField("permitted", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE_PHRASES, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row per row of df: its id and what the scan found.

    n_words; base_starts (word index of every place of a base phrase, ascending), phrase_starts (of further phrases); base_labels and labels
    (sorted, distinct; labels holds the base ones too); expressions (in postfix order) that follow identifier tags; permitted, whether
    the permitted labels alone can meet all of these (null without any); score, 1 minus the product of the doubts of all finds (0: nothing found).
    A null text counts as empty; repeated rows and ids are scanned one by one. Only the two columns are read. No shuffle.
    """
    phrases = tuple(base.items())
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    names = [f.name for f in SCAN_SCHEMA]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.float64()]
        for batch in slices(batches):
            found = [scan_text(x or "", phrases, permitted) for x in batch.column("text").to_pylist()]
            columns = zip(*found) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types))], [id_col, *names])

    return map_batches(rows, scan, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *SCAN_SCHEMA.fields]))
