"""A training-corpus pipeline over `documents`: each stage is one operator, and works on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framescope.llm import language, neardup, packing, toxicity
from framescope.llm.common import fold, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the lexicon from labelled documents outside the held-out fold; documents that score as toxic go."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, toxicity.learn_lexicon(docs.where(fold("doc_id", 5) != 0), labels))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages outside the held-out fold; documents without letters, or that look clearly less like the learnt languages than all but
    one in 200 labelled texts of their length do, go.

    Texts of a word or two tell little, and stay."""
    labelled = docs.where(fold("doc_id", 5) != 0)
    net = language.train(*language.training_windows(labelled))
    return language.keep_known(docs, net, language.length_bounds(net, labelled))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: The stages train models; SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
