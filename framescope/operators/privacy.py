"""Keyed pseudonyms in text: hardware addresses, network names in all their written forms, secrets and paths, in one pass, longest first."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.functions.batches import map_batches
from framescope.functions.texts import name_variants, unescape_name
from framescope.operators.bundles import visible

#: Six octets joined by colons or hyphens, not inside a longer run of digits; a network name in quotes (fixed values).
ADDRESS = r"(?<![0-9a-fA-F])(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}(?![0-9a-fA-F])"
QUOTED_NAME = r"""(?i)\bssid\s*[=:]\s*(?:"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)')"""
#: What stands for a secret and a path (fixed values).
SECRET, PATH = "<redacted-secret>", "<bundle>"


def keyed_digest(key: bytes, kind: str, value: str) -> str:
    if len(key) < 16:
        raise ValueError("the key needs 16 bytes")
    return hmac.new(key, f"{kind}\0{value}".encode(), hashlib.sha256).hexdigest()


def name_alias(key: bytes, name: str) -> str:
    return "ssid-" + keyed_digest(key, "ssid", name)[:8]


def address_alias(key: bytes, digits: str) -> str:
    """Twelve hexadecimal digits that stand for an address (given by its own twelve, lower case): locally administered, unicast."""
    drawn = int(keyed_digest(key, "mac", _in_pairs(digits, ":"))[:12], 16)
    return f"{drawn & ~(1 << 40) | 1 << 41:012x}"


def _in_pairs(digits: str, between: str) -> str:
    return between.join(map("".join, zip(digits[::2], digits[1::2])))


def pseudonym(key: bytes, kind: str, value: str) -> str:
    """What stands for an identifier (mac, ssid, secret, path), always the same under a key."""
    aliases = {"ssid": lambda: name_alias(key, value), "mac": lambda: _in_pairs(address_alias(key, _NO_DIGITS.sub("", value).lower()), ":"), "secret": lambda: SECRET, "path": lambda: PATH}
    return aliases[kind]()


#: Six pairs of digits with blanks between; as lookahead, so that every place in a longer dump is seen.
_SPACED = re.compile(r"(?<![0-9a-fA-F])(?=((?:[0-9a-fA-F]{2}[ \t]+){5}[0-9a-fA-F]{2})(?![0-9a-fA-F]))")
_ADDRESS = re.compile(ADDRESS)
_NO_DIGITS = re.compile(r"[^0-9a-fA-F]+")
#: Digits A to F in lower case; no character changes its length, whatever else a text holds.
_LOWER_DIGITS = str.maketrans("ABCDEF", "abcdef")
#: How an alias is written, by what parts the digits of the address it stands for.
_STYLES = {":": lambda d: _in_pairs(d, ":"), "-": lambda d: _in_pairs(d, ":"), " ": lambda d: _in_pairs(d, " "), "\t": lambda d: _in_pairs(d, " ")}


class Identifiers:
    """Known identifiers of one bundle, and what each becomes: texts in one automaton, addresses as twelve digits in another."""

    def __init__(self, key: bytes, known: Iterable[tuple[str, str]]):
        self.key, known = key, list(known)
        self.addresses: set[str] = set()
        self.texts = ahocorasick.Automaton()
        self.bare = ahocorasick.Automaton()
        stands_for: dict[str, str] = {}
        for kind in ("ssid", "secret", "path"):  # a text of several kinds becomes what its last kind says
            for value in sorted(v for k, v in known if k == kind and v):
                said = pseudonym(key, kind, value)
                stands_for.update(dict.fromkeys(name_variants(value) if kind == "ssid" else (value,), said))
        for text, said in stands_for.items():
            self.texts.add_word(text, (len(text), said))
        self.addresses = {_NO_DIGITS.sub("", v).lower() for k, v in known if k == "mac"}
        for digits in self.addresses:
            self.bare.add_word(digits, digits)
        self.texts.make_automaton()
        self.bare.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, str]]:
        """(from, 0 for an address else 1, minus length, what it becomes) of all that could be replaced; they may overlap."""
        found = []
        places = [m.span() for m in _ADDRESS.finditer(text)]
        places += [m.span(1) for m in _SPACED.finditer(text) if _NO_DIGITS.sub("", m[1]).lower() in self.addresses]
        if len(self.bare):
            places += [(end - 11, end + 1) for end, _ in self.bare.iter(text.translate(_LOWER_DIGITS))]
        for a, b in places:
            whole = text[a:b]
            alias = address_alias(self.key, _NO_DIGITS.sub("", whole).lower())
            parted = whole[2] if not whole.isalnum() else ""
            written = _STYLES.get(parted, str)(alias)
            found.append((a, 0, a - b, written.upper() if parted not in (":", "-") and whole.isupper() else written))
        if len(self.texts):
            found += [(end + 1 - n, 1, -n, said) for end, (n, said) in self.texts.iter(text)]
        return found

    def replace(self, text: str) -> str:
        """text with spans replaced: the one that begins first wins, an address before a text, then the longest. What was put in is not looked at again."""
        out, at = [], 0
        for a, _, size, said in sorted(self.spans(text)):
            if a >= at:
                out += [text[at:a], said]
                at = a - size
        return "".join([*out, text[at:]])


def replacer(key: bytes, known: Iterable[tuple[str, str]]) -> Callable[[str], str]:
    """A function that replaces, in one pass, all that is shaped like an address and all known identifiers (kind, value).

    Known addresses also go where they stand as bare digits or with blanks between octets."""
    return Identifiers(key, known).replace


def learn_identifiers(texts: DataFrame, names: DataFrame, parameters: DataFrame, bundle: str = "bundle_id") -> DataFrame:
    """(bundle, kind, value), distinct: what a bundle's sources give away, whether they will be shown or not.

    texts: bundle, text (every log line and frame record): addresses, and quoted network names. names: bundle, ssid (of frames). parameters: bundle,
    name, value (flattened): network names and secrets by the parameter's name, addresses by the value.
    """
    both = texts.select(bundle, F.col("text").alias("t")).unionByName(parameters.select(bundle, F.col("value").alias("t")))
    macs = both.select(bundle, F.explode(F.regexp_extract_all("t", F.lit(ADDRESS), F.lit(0))).alias("v")).select(bundle, F.lit("mac").alias("kind"), F.lower(F.translate("v", "-", ":")).alias("value"))
    quoted = texts.where(F.col("text").rlike(QUOTED_NAME)).select(bundle, *(F.regexp_extract_all("text", F.lit(QUOTED_NAME), F.lit(k)).alias(f"q{k}") for k in (1, 2)))
    held = quoted.select(bundle, F.explode(F.concat("q1", "q2")).alias("q")).where("q <> ''")

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(unescape_name, na_action="ignore")

    lower = F.lower("name")
    kinds = F.array(F.when(F.contains(lower, F.lit("ssid")), "ssid"), F.when(F.contains(lower, F.lit("passphrase")) | lower.isin("psk", "password"), "secret"))
    told = parameters.select(bundle, F.explode(kinds).alias("kind"), "value").where("kind is not null")
    parts = [macs, held.select(bundle, F.lit("ssid").alias("kind"), plain("q").alias("value")), names.select(bundle, F.lit("ssid").alias("kind"), F.col("ssid").alias("value")), told]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("value <> ''").distinct()


def redact(rows: DataFrame, identifiers: DataFrame, key: bytes, bundle: str = "bundle_id", text: str = "text", part_rows: int = 50_000, as_json: bool = False) -> DataFrame:
    """rows with identifiers in `text` replaced. identifiers: (bundle, kind, value), learnt from all of a bundle's sources, visible or not.

    A bundle of more than part_rows rows is dealt into parts by a hash of the text, and each part meets the bundle's identifiers, so no task holds a
    whole large bundle. Addresses with colons or hyphens need no listing. as_json: the texts are JSON, of which all strings are changed at any depth,
    each on its own, and written in canonical form; names of members stay.
    """
    columns, one = rows.columns, F.lit(1)
    parts = rows.groupBy(bundle).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts"))
    dealt = rows.join(parts, bundle, "left").withColumn("_part", F.pmod(F.xxhash64(text), F.greatest(F.coalesce("_parts", one), one)).cast("int"))
    # names of their own, as identifiers may come from the very rows
    known = identifiers.select(F.col(bundle).alias("_b"), F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    met = known.join(parts.select(F.col(bundle).alias("_b"), F.col("_parts").alias("_n")), "_b").select("_b", "_kind", "_value", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_p"))

    nothing = lambda df, taken: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in taken]
    known_first = met.select(F.col("_b").alias(bundle), F.col("_p").alias("_part"), "_kind", "_value", *nothing(rows, {bundle}))
    # a bundle's identifiers come before its rows: tasks read on from bundle to bundle, without a call and a table for each
    both = dealt.select(*columns, "_part", F.lit(None).cast("string").alias("_kind"), F.lit(None).cast("string").alias("_value"), F.lit(1).alias("_side")).unionByName(known_first.withColumn("_side", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, held, change = None, [], None
        for batch in batches:
            out, mine = [], []
            for b, p, side, kind, value, told in zip(*(batch.column(c).to_pylist() for c in (bundle, "_part", "_side", "_kind", "_value", text))):
                if at != (b, p):
                    at, held, change = (b, p), [], None
                mine.append(side == 1)
                if side == 0:
                    held.append((kind, value))
                    continue
                if change is None:
                    change = replacer(key, held)
                out.append(None if told is None else json.dumps(redact_json(json.loads(told), change), sort_keys=True) if as_json else change(told))
            shown = batch.select(columns).filter(pa.array(mine, pa.bool_()))
            yield shown.set_column(columns.index(text), text, pa.array(out, shown.schema.field(text).type))

    return map_batches(both.repartition(bundle, "_part").sortWithinPartitions(bundle, "_part", "_side"), run, rows.schema)


def redact_bundles(bundles: DataFrame, records: DataFrame, names: DataFrame, lines: DataFrame, stats: DataFrame, key: bytes, view: str, bundle: str = "bundle_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, lines, stats) of what a view shows, redacted with one key.

    bundles: bundle, parameters (JSON), path. records: bundle, frame, json. names: bundle, ssid (of frames). lines: bundle, source, line, text. stats:
    bundle, stats. Identifiers are learnt from every record, parameter, line and summary of a bundle, its hidden logs among them, and from its path
    and the path's last part; only records and lines of the view come out, as no row of a hidden source is ever joined to what is written."""
    parameters = flattened_parameters(bundles, bundle=bundle)
    whole = records.select(bundle, F.col("json").alias("text")).unionByName(lines.select(bundle, "text")).unionByName(stats.select(bundle, F.col("stats").alias("text"))).unionByName(bundles.select(bundle, F.col("parameters").alias("text")))
    paths = bundles.select(bundle, F.explode(F.array("path", F.element_at(F.split("path", "/"), -1))).alias("value")).where("value <> ''").select(bundle, F.lit("path").alias("kind"), "value")
    known = learn_identifiers(whole, names, parameters, bundle).unionByName(paths).distinct()
    return redact(records, known, key, bundle, "json", as_json=True), redact(visible(lines, view), known, key, bundle), redact(stats, known, key, bundle, "stats")


def redact_json(value: object, change: Callable[[str], str]) -> object:
    """A JSON value whose texts, at any depth, are changed; names of members stay."""
    work: list[tuple[object, object, object]] = []  # (value, holder, place): no depth is too deep
    top: list[object] = [None]
    work.append((value, top, 0))
    while work:
        item, holder, place = work.pop()
        if isinstance(item, str):
            holder[place] = change(item)
        elif isinstance(item, dict):
            holder[place] = made = dict.fromkeys(item)
            work += [(v, made, k) for k, v in item.items()]
        elif isinstance(item, list):
            holder[place] = made = [None] * len(item)
            work += [(v, made, k) for k, v in enumerate(item)]
        else:
            holder[place] = item
    return top[0]


def flattened_parameters(bundles: DataFrame, column: str = "parameters", bundle: str = "bundle_id") -> DataFrame:
    """(bundle, name, value): every text member of a JSON parameter object, at any depth of objects, under its own name. What is no JSON has none.

    The engine takes the objects apart, one level of all bundles a step; a step more than the deepest object finds nothing, and ends it."""
    spark = bundles.sparkSession
    members = lambda df: df.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(bundle, F.col("key").alias("name"), F.col("value").alias("v"), F.schema_of_variant("value").alias("kind"))
    level = members(bundles.select(bundle, F.try_parse_json(column).alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'"))
    texts = []
    while True:
        texts.append(level.where("kind = 'STRING'").select(bundle, "name", F.variant_get("v", "$", "string").alias("value")))
        objects = level.where("kind like 'OBJECT%' and kind <> 'OBJECT<>'").select(bundle, "v")
        if objects.isEmpty():
            break
        level = members(objects)
    out = texts[0]
    for more in texts[1:]:
        out = out.unionByName(more)
    return out
