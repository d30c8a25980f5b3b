"""How filters interact: what each would remove at every place of every order, told by one count of each set of failures.

A document's failures are a bit mask. Documents are counted by part and mask, so the corpus is read once whatever the number of orders. A document
survives the filters of a set S if its mask lies in the complement of S: the subset-zeta transform of the counts, which adds each count to all supersets
of its mask one bit after the other, tells the survivors of every set at once. A step of an order is the difference of two neighbouring sets. The
same transform of a label's counts tells what labelled documents a step loses.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import free_name, map_batches, stage

#: White space that parts words (fixed value).
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of a text's words; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def failure_masks(docs: DataFrame, failures: Mapping[str, Column], mask_col: str = "mask") -> DataFrame:
    """docs with an integer whose bit k is set where the k-th condition holds; a condition that can't be told (null) doesn't hold."""
    bits = [F.when(F.coalesce(fails, F.lit(False)), 1 << k).otherwise(0) for k, fails in enumerate(failures.values())]
    return docs.withColumn(mask_col, sum(bits, F.lit(0)))


def mask_counts(rows: DataFrame, labels: DataFrame, copy_bit: int | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part have each set of failures, and how many of them are labelled.

    rows: id, text_key, part, mask. labels: id, good, toxic (boolean). copy_bit is set for a row whose text_key a row with a smaller id has. Ids and keys
    may repeat: rows with the least id of a text are no copies, each of several label rows of an id counts, and a row without an id has no labels, is no
    copy and makes none. Rows that are alike are counted before they are shuffled; a text's rows never meet in one task, but as partial counts.
    """
    alike = ["id", "text_key", "part", "mask"]
    rows = stage(rows.groupBy(*alike).agg(F.count("*").alias("n")), "failure-masks")  # documents are read once; what follows reads a few bytes of each
    told = labels.where("id is not null").groupBy("id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    marked = rows.where("id is not null").join(told, "id", "left").na.fill(False, ["good", "toxic"])
    unnamed = rows.where("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    kinds = ["part", "mask", "good", "toxic", "n"]
    counted = marked.select(*kinds)
    if copy_bit is not None:
        # all rows count as copies; then those with the least id of their text are moved back
        copy = F.col("mask").bitwiseOR(F.lit(copy_bit))
        firsts = marked.groupBy("text_key", "id").agg(F.collect_list(F.struct(*kinds)).alias("rows"))  # an id's own rows of one text
        firsts = firsts.groupBy("text_key").agg(F.min_by("rows", "id").alias("rows")).select(F.inline("rows"))
        moved = F.array(F.struct("part", "mask", "good", "toxic", "n"), F.struct("part", copy.alias("mask"), "good", "toxic", (-F.col("n")).alias("n")))
        counted = counted.withColumn("mask", copy).unionByName(firsts.select(F.inline(moved)))
    counted = counted.unionByName(unnamed.select(*kinds))
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), when("good").alias("good"), when("toxic").alias("toxic"))


def subset_zeta(counts: np.ndarray) -> np.ndarray:
    """Along the last axis, of length 2 ** k: the sum over all subsets of each index. One pass for each bit."""
    out, bit = np.array(counts, np.int64), 1
    while bit < out.shape[-1]:
        held = out.reshape(*out.shape[:-1], -1, 2, bit)
        held[..., 1, :] += held[..., 0, :]
        bit *= 2
    return out


def survivors(counts: np.ndarray) -> np.ndarray:
    """At index S: documents that fail none of the filters of S (those whose mask lies in the complement)."""
    return subset_zeta(counts)[..., ::-1]  # the complement of S is 2 ** k - 1 - S


def shapley_sums(left: np.ndarray, k: int) -> np.ndarray:
    """For each filter: what it removes, summed over all orders of k filters. left: survivors by set of filters."""
    sets = np.arange(1 << k)
    size = np.array([int(s).bit_count() for s in sets])
    orders = np.array([factorial(m) * factorial(k - 1 - m) if m < k else 0 for m in range(k + 1)])
    return np.array([((left[sets] - left[sets | 1 << f]) * orders[size])[sets >> f & 1 == 0].sum() for f in range(k)], np.int64)


AUDIT_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_orders(counts: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters (one letter each) and step; counts: part, mask, n, good, toxic.

    kept: left after the step; removed: by it; redundant: failing its filter but removed before; unique_fails: failing no other filter; good_lost and
    toxic_lost: labelled documents among the removed; shapley: what its filter removes, summed over all orders. Every part of counts gets all its rows.
    """
    k = len(names)
    cell = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("bigint") for m in range(1 << k))).alias(c)
    vectors = counts.groupBy("part").agg(cell("n"), cell("good"), cell("toxic"))  # a row for each part
    orders = list(permutations(range(k)))
    filters = np.array(orders).reshape(-1)
    after = np.array([[sum(1 << f for f in order[: i + 1]) for i in range(k)] for order in orders]).reshape(-1)
    before = after & ~(1 << filters)
    steps = pa.array(np.tile(np.arange(1, k + 1), len(orders)), pa.int32())
    said = pa.array(np.repeat(["".join(names[f] for f in order) for order in orders], k).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i, part in enumerate(batch.column("part")):
                n, good, toxic = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("n", "good", "toxic"))
                left, lost = survivors(n), [(s := survivors(x))[before] - s[after] for x in (good, toxic)]
                removed = left[before] - left[after]
                failing = (left[0] - left[1 << np.arange(k)])[filters]
                columns = [left[after], removed, failing - removed, n[1 << filters], *lost, shapley_sums(left, k)[filters]]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * filters.size, pa.string()), said, steps, *map(pa.array, columns)], [c.split()[0] for c in AUDIT_SCHEMA.split(", ")])

    return map_batches(vectors, run, AUDIT_SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column | None], part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the filters named by one letter each interact on all rows of docs, per value of part_col (null counts as an empty text): see audit_orders.

    failures: the condition under which a row of docs fails each filter; at most one may be None: it fails rows whose text a row with a smaller id has,
    removed or not. labels: id_col, quality, toxic. Null texts are empty texts (and copies of each other); texts of any length are read whole, in the
    engine. Ties and repeated rows: see mask_counts. An empty table has no parts, and gives no rows. Only the named columns are read.
    """
    bit = next((1 << k for k, fails in enumerate(failures.values()) if fails is None), None)
    told = {name: F.lit(False) if fails is None else fails for name, fails in failures.items()}
    mask = free_name("mask", docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = failure_masks(docs, told, mask).select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(mask).alias("mask"))
    marks = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit_orders(mask_counts(rows, marks, bit), "".join(failures))
