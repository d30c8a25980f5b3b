"""Joins and set operations: code lookup, passages in texts, pairs of graders, set differences, schedules, exclusions, cutoffs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def code_lookup(df: DataFrame, code: str, meanings: dict[str, str], out: str = "meaning", missing: str = "unknown") -> DataFrame:
    """Adds the meaning of a code. The dictionary is a literal, so its broadcast is bounded."""
    spark = df.sparkSession
    names = F.broadcast(spark.createDataFrame(list(meanings.items()), f"`{code}` string, `{out}` string"))
    return df.join(names, code, "left").withColumn(out, F.coalesce(out, F.lit(missing)))


def passage_hits(texts: DataFrame, text_id: str, text: str, passages: DataFrame, passage_id: str, passage: str, least: int = 12, most_bytes: int = 64 << 20, parts: int = 16) -> DataFrame:
    """(passage_id, text_id, first_at): texts that contain a passage of at least `least` non-blank characters, and the passage's first place (from 1).

    The passages, wherever in words they begin, are found by one automaton in one pass over each text. They reach the driver only if their bytes are within
    most_bytes; more are dealt into `parts` (or more) by a hash, of which each task holds one, and a text meets every part. No pairs are made but hits.
    """
    wanted = passages.where(F.length(F.regexp_replace(passage, r"\s", "")) >= least).select(F.col(passage_id).alias("_p"), F.col(passage).alias("_w"))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("_i"), F.col(text).alias("_t"))
    size = wanted.agg(F.sum(F.octet_length("_w") + 64)).first()[0] or 0
    kinds = f"`{passage_id}` {wanted.schema['_p'].dataType.simpleString()}, `{text_id}` {rows.schema['_i'].dataType.simpleString()}, first_at int"
    names = [passage_id, text_id, "first_at"]

    def build(pairs: list[tuple]) -> ahocorasick.Automaton:
        ids: dict[str, list] = {}
        for key, words in pairs:
            ids.setdefault(words, []).append(key)
        out = ahocorasick.Automaton()
        for words, keys in ids.items():
            out.add_word(words, (len(words), keys))
        out.make_automaton()
        return out

    def hits(automaton: ahocorasick.Automaton, body: str) -> dict:
        first: dict = {}
        for end, (n, keys) in automaton.iter(body) if len(automaton) else ():
            for key in keys:
                first.setdefault(key, end - n + 2)
        return first

    if size <= most_bytes:
        held = [(r["_p"], r["_w"]) for r in wanted.collect()]

        key_type = to_arrow_type(wanted.schema["_p"].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build(held)
            for batch in batches:
                out = [(key, i, at) for i, body in zip(batch.column("_i").to_pylist(), batch.column("_t").to_pylist()) for key, at in hits(automaton, body).items()]
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key_type, batch.schema.field("_i").type, pa.int32()))], names)

        return rows.mapInArrow(run, kinds)
    n = max(parts, -(-size // most_bytes))
    dealt = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(64)).cast("int"))
    shares = wanted.withColumn("_part", F.pmod(F.xxhash64("_w"), F.lit(n)).cast("int")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        automaton = build(list(zip(right["_p"], right["_w"])))
        return pd.DataFrame([(key, i, at) for i, body in zip(left["_i"], left["_t"]) for key, at in hits(automaton, body).items()], columns=names)

    return dealt.groupBy("_part", "_salt").cogroup(shares.groupBy("_part", "_salt")).applyInPandas(meet, kinds)


def paired_grades(df: DataFrame, label: str, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """Two predictions of the same rows against their label: n, both right, only the left, only the right, neither, and the difference of accuracies."""
    a, b = F.col(left) == F.col(label), F.col(right) == F.col(label)
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_left"), F.count_if(~a & b).alias("only_right"), F.count_if(~a & ~b).alias("neither"))
    return found.withColumn("difference", F.try_divide(F.col("only_left") - F.col("only_right"), "n"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys of one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def seed_schedule(spark: SparkSession, base: int, classes: Sequence[str], dev: int = 4, test: int = 8) -> DataFrame:
    """(class, split, seed): consecutive seeds, class by class, the development ones of a class before its test ones."""
    each = dev + test
    rows = spark.range(len(classes) * each).select((F.col("id") / each).cast("int").alias("c"), (F.col("id") % each).alias("k"), F.col("id"))
    names = F.element_at(F.array(*(F.lit(c) for c in classes)), F.col("c") + 1)
    return rows.select(names.alias("class"), F.when(F.col("k") < dev, "dev").otherwise("test").alias("split"), (F.col("id") + base).alias("seed"))


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def cutoff(df: DataFrame, at: Column, end: Column, keys: Sequence[str]) -> DataFrame:
    """Per key: rows kept (at or before the end) and dropped (after it)."""
    return df.groupBy(*keys).agg(F.count_if(at <= end).alias("kept"), F.count_if(at > end).alias("dropped"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, centre): mean vector of each label, its dimensions in order. Sums are partial before they are shuffled: a row for each label and dimension."""
    parts = df.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("centre"))


def squared_distance(vector: Column, centre: Column) -> Column:
    return F.aggregate(F.zip_with(vector, centre, lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, d: a + F.coalesce(d, F.lit(0.0)))


def nearest(vector: Column, centres: Column, label: str = "label") -> Column:
    """The label of the nearest of an array of struct(label, centre), the smallest among equals (to nine digits)."""
    return F.array_min(F.transform(centres, lambda c: F.struct(F.round(squared_distance(vector, c["centre"]), 9).alias("dist"), c[label].alias(label))))[label]


def nearest_centroid(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, prediction): the label whose mean vector is nearest, the smallest among equals.

    All centroids travel as one row, which is as large as there are labels times dimensions; the rows themselves are not shuffled."""
    held = centroids(df, vector, label).agg(F.collect_list(F.struct(F.col(label).alias("label"), "centre")).alias("_centres"))
    return df.join(F.broadcast(held), how="cross").select(id_col, label, nearest(F.col(vector), F.col("_centres")).alias("prediction"))
