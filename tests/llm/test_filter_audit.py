"""The filter audit against every order played through document by document; and the rows that it must take."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.llm import filter_audit

NAMES = "ABC"


def failures():
    return {"A": F.length("text") < 4, "B": F.col("text").contains("x"), "C": None}


def played(rows, labels):
    """rows: (id, text, part). Every order applied to the rows one filter after the other."""
    good, toxic = ({k for k, *flags in labels if k is not None and flags[i] == 1} for i in (0, 1))
    least = {}
    for k, text, _ in rows:
        if k is not None:
            least[text or ""] = min(k, least.get(text or "", k))
    fails = [{n for n, bad in zip(NAMES, (text is not None and len(text) < 4, text is not None and "x" in text, k is not None and k > least[text or ""])) if bad} for k, text, _ in rows]
    parts, out = [part or "" for *_, part in rows], {}
    for order in permutations(NAMES):
        left = list(range(len(rows)))
        for step, f in enumerate(order, 1):
            gone = {i for i in left if f in fails[i]}
            before = left
            left = [i for i in left if i not in gone]
            for part in set(parts):
                mine = lambda s: [i for i in s if parts[i] == part]  # noqa: B023, E731
                failing = [i for i in mine(range(len(rows))) if f in fails[i]]
                row = [len(mine(left)), len(mine(gone)), len([i for i in failing if i not in before]), len([i for i in failing if fails[i] == {f}])]
                out[part, "".join(order), step] = [*row, *(len([i for i in mine(gone) if rows[i][0] in x]) for x in (good, toxic))]
    total = {}
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + row[1]
    return {key: (*row, total[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def audited(spark, rows, labels, extra=""):
    docs = spark.createDataFrame([(*r, *([7] * bool(extra))) for r in rows], "doc_id long, text string, lang string" + extra)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit_filters(docs, marks, failures()).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out}
    assert len(found) == len(out)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 60), "".join(rng.choices("abx", k=rng.randint(0, 5))), rng.choice(["en", "de", "fr"])) for _ in range(200)]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 60, 2)]
    assert audited(spark, rows, labels) == played(rows, labels)


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (2, "", "en"), (3, "same text", "en"), (3, "same text", "de"), (3, "same text", "en"), (4, "same text", None), (None, "same text", "en"), (None, None, None), (5, "x" * 200_000, "en"), (0, "", "")]
    labels = [(3, 1, None), (3, 0, 1), (None, 1, 1), (99, 1, 1), (2, None, None)]
    assert audited(spark, rows, labels, ", mask int") == played(rows, labels)
    assert audited(spark, [], labels) == {}
    assert audited(spark, rows, []) == played(rows, [])


def test_zeta_counts_subsets():
    counts = np.random.default_rng(0).integers(0, 9, (2, 16))
    wanted = [[sum(int(row[m]) for m in range(16) if m & s == m) for s in range(16)] for row in counts]
    assert filter_audit.subset_zeta(counts).tolist() == wanted
    assert filter_audit.survivors(counts)[0].tolist() == [sum(int(counts[0][m]) for m in range(16) if not m & s) for s in range(16)]
