"""Text forms: canonical JSON and its fingerprint, network names in logs and dumps, key-value files, quotes of whole members, plain addresses."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What logs write after a backslash for some octets, and what such letters mean where a name is read back (fixed values).
SHORT_ESCAPES = {34: '"', 92: "\\", 10: "n", 13: "r", 9: "t", 27: "e"}
LETTERS = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "e": "\x1b", '"': '"', "'": "'", "\\": "\\"}

#: How an octet is written in each style of text, given the form of its two digits; the octets of a style are joined by the second part.
_BYTE_STYLES = {
    "dump": (lambda b, digits: digits(b), ""),
    "spaced dump": (lambda b, digits: digits(b), " "),
    "escapes": (lambda b, digits: "\\x" + digits(b), ""),
    "log": (lambda b, digits: "\\" + SHORT_ESCAPES[b] if b in SHORT_ESCAPES else chr(b) if 32 <= b <= 126 else "\\x" + digits(b), ""),
}


def name_variants(name: str) -> set[str]:
    """The ways in which a network name may stand in JSON, text logs and byte dumps; the digits of dumps and escapes in either case."""
    octets = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("ascii", "backslashreplace") for c in name)
    out = {name}
    for digits in ("{:02x}".format, "{:02X}".format):
        out |= {between.join(one(b, digits) for b in octets) for one, between in _BYTE_STYLES.values()}
    spelt = [json.dumps(c)[1:-1] for c in name]
    return out | {"".join(spelt), "".join("\\u" + x[2:].upper() if x.startswith("\\u") else x for x in spelt)}


def unescape_name(value: str) -> str:
    """A name from its escaped form in a quoted log value; a backslash that begins no known escape stays."""
    head, *rest = value.split("\\")
    out, skip = [head], False
    for k, part in enumerate(rest):
        if skip:  # this piece follows an escaped backslash
            out.append(part)
            skip = False
            continue
        sign, size = part[:1], {"x": 2, "u": 4}.get(part[:1], 0)
        digits = part[1 : 1 + size]
        if size and len(digits) == size and all(c in "0123456789abcdefABCDEF" for c in digits) and (size == 2 or digits.startswith("00")):
            out.append(chr(int(digits, 16)) + part[1 + size :])
        elif sign in LETTERS:
            out.append(LETTERS[sign] + part[1:])
        elif not part and k + 1 < len(rest):  # two backslashes in a row
            out.append("\\")
            skip = True
        else:
            out.append("\\" + part)
    return "".join(out)


def canonical_json(text: Column, compact: bool = False) -> Column:
    """JSON texts with sorted keys and ASCII escapes; null where a text is no JSON."""
    marks = (",", ":") if compact else (", ", ": ")

    def one(value: str) -> str | None:
        try:
            return json.dumps(json.loads(value), sort_keys=True, ensure_ascii=True, separators=marks)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore").astype(object)

    return run(text)


def fingerprint(text: Column) -> Column:
    """Hex digest of a JSON text's compact canonical form."""
    return F.sha2(canonical_json(text, compact=True).cast("binary"), 256)


def members(record: str) -> list[tuple[str, int]]:
    """The top-level members of a record as they stand in its canonical JSON, in order, and where each begins there."""
    out, at = [], 1
    for name, value in sorted(json.loads(record).items()):
        out.append((f"{json.dumps(name)}: {json.dumps(value, sort_keys=True)}", at))
        at += len(out[-1][0]) + len(", ")
    return out


def quotes_member(record: str, quote: str) -> bool:
    """Whether a quote is a stretch of a record's canonical JSON that holds a whole top-level member.

    Each member is looked for inside the quote; where it stands there, the rest of the quote must be what surrounds that very member."""
    held = members(record)
    text = "{" + ", ".join(x for x, _ in held) + "}"
    for member, begins in held:
        at = quote.find(member)
        while at >= 0:
            if begins >= at and text.startswith(quote, begins - at):
                return True
            at = quote.find(member, at + 1)
    return False


def quotes_whole_member(record: Column, quote: Column) -> Column:
    """quotes_member by row; null where either is."""

    @F.pandas_udf("boolean")
    def run(records: pd.Series, quotes: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or q is None else quotes_member(r, q) for r, q in zip(records, quotes)], dtype=object)

    return run(record, quote)


def first_member(record: str, most: int) -> str | None:
    """The first sorted top-level member, as it stands in a record's canonical JSON, of at most `most` characters; null if none fits."""
    return next((x for x, _ in members(record) if len(x) <= most), None)


def fitting_member(record: Column, most: int) -> Column:
    """first_member by row; null where the record is."""

    @F.pandas_udf("string")
    def run(records: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else first_member(r, most) for r in records], dtype=object)

    return run(record)


def config_values(text: Column) -> Column:
    """map of a text's key=value lines, trimmed; the last line of a key counts, other lines don't. The lines are sorted by key, the last first, once."""
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(F.reverse(lines), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x)).alias("value")))
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value"))))
    first = lambda rows: F.filter(rows, lambda p, i: (i == 0) | (F.get(rows, i - 1)["key"] != p["key"]))
    entries = F.transform(F.array(keyed), lambda rows: F.transform(first(rows), lambda p: F.struct(p["key"], p["value"])))  # rows stands for the sorted array: it is made once
    return F.map_from_entries(F.get(entries, F.lit(0)))


def assigned_ipv4(address: Column) -> Column:
    """Whether a dotted address is one that an interface may have been given: not loopback, not unspecified; null where it is no address."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(address.rlike(rf"^{octet}(\.{octet}){{3}}$"), ~address.startswith("127.") & (address != "0.0.0.0"))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
