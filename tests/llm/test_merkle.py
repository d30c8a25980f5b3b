"""Merkle manifests against trees built whole, level by level; tampering; and the rows that the operator must take."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from framescope.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grown(nodes):
    """(root, each node's siblings by level) of a tree of runs of three."""
    paths, at, held = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(held) > 1:
        for k, path in enumerate(paths):
            run = at[k] - at[k] % 3
            path.append(("".join(held[run : at[k]]), "".join(held[at[k] + 1 : run + 3])))
            at[k] //= 3
        held = [sha("".join(held[i : i + 3])) for i in range(0, len(held), 3)]
    return held[0], paths


def manifest(rows):
    """rows: (id, group, leaf): (id, group, leaf) -> sorted list of (subroot, root, path)."""
    groups = sorted({g for _, g, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = own, *grown([r[2] for r in own])
    root, upper = grown([trees[g][1] for g in groups])
    return sorted((str(r), trees[g][1], root, path + upper[k]) for k, g in enumerate(groups) for r, path in zip(trees[g][0], trees[g][2]))


def found(df):
    return sorted((str((r.doc_id, r.source, r.leaf)), r.subroot, r.root, [tuple(s) for s in r.path]) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 100])
def test_traversal_gives_every_path(n):
    leaves = [sha(str(k)) for k in range(n)]
    levels = merkle.height_of(n, 3)
    if n:
        root, paths = grown(leaves)
        for height in (1, 2, 3):
            walk = merkle.Traversal(leaves, levels, 3, height)
            assert walk.root == root and list(walk) == paths
            assert all(sum(map(len, t.nodes)) <= 3 + 9 + 27 for t in (*walk.exist, *walk.desire))


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest_equals_whole_trees(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.choice([None, *range(90)]), rng.choice([None, "", "a", "a", "a", "é", "z"]), sha(str(rng.randint(0, 80)))) for _ in range(120)] + [(5, "alone", sha("5"))] * (levels == 2)
    rows += [(k, "hot", sha(f"hot{k}")) for k in range(85)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, leaf string, pos int, root_ int").withColumnRenamed("root_", "node")
    out = merkle.merkle_manifest(df, "source", "doc_id", "leaf", levels=levels)
    assert found(out) == manifest(rows)
    assert out.columns == [*df.columns, "subroot", "root", "path"] and out.where("pos <> 1 or node <> 2").isEmpty()
    checked = out.select("root", merkle.fold_path(F.col("leaf"), F.col("path")).alias("same"), merkle.fold_path(F.lit(sha("else")), F.col("path")).alias("other"))
    assert checked.where("same <> root or other = root").isEmpty()


def test_few_rows(spark):
    schema = "doc_id long, source string, leaf string"
    assert merkle.merkle_manifest(spark.createDataFrame([], schema), "source", "doc_id", "leaf").collect() == []
    for rows in ([(1, None, sha("x"))], [(1, "a", sha("x")), (1, "a", sha("x"))], [(1, "b", sha("x")), (None, None, sha("x"))]):
        assert found(merkle.merkle_manifest(spark.createDataFrame(rows, schema), "source", "doc_id", "leaf")) == manifest(rows)


def test_row_digest(spark):
    rows = [(1, "é\n", None), (None, None, "x" * 300_000), (-2, "", "")]
    df = spark.createDataFrame(rows, "a long, b string, c string")
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert [r.d for r in df.select(merkle.row_digest([F.col(c) for c in "abc"]).alias("d")).collect()] == [sha("".join(map(told, r))) for r in rows]
