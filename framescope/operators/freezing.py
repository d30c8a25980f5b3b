"""Frozen inputs: a tree of digests over any number of files, in groups, that is compared from the root down until it names what differs.

Files hang below the first hexadecimal digits of their name's digest, so the tree is balanced however names and folders lie: each node has about sixteen
children. A node's digest is that of its children's keys and digests in order. Two trees with the same root hold the same names and contents; otherwise
only the branches whose digests differ are followed.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions.texts import fingerprint

#: Files that a lowest node holds, about.
NODE_FILES = 16
TREE = "grp string, level int, prefix string, name string, digest string"


def file_digests(spark: SparkSession, path: str, group: str, pattern: str | None = None) -> DataFrame:
    """(grp, name, digest) of the files below a folder: their path within it, and the sha256 of their bytes. pattern: of names, as in *.py.

    Spark reads no empty files; they come from its listing of the folder, which the driver holds anyway."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (files if pattern is None else files.option("pathGlobFilter", pattern)).load(path)
    listed = spark.createDataFrame([(unquote(urlparse(f).path),) for f in files.inputFiles()], "path string")
    read = files.select(F.regexp_replace("path", r"^\w+:(//[^/]*(?=/))?", "").alias("path"), F.sha2("content", 256).alias("digest"))
    base = urlparse(path).path.rstrip("/") + "/"
    name = F.substring("path", F.locate(base, F.col("path")) + len(base), 1 << 20)
    return listed.join(read, "path", "left").select(F.lit(group).alias("grp"), name.alias("name"), F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))


def entry_digests(entries: DataFrame, group: str, name: Column, entry: Column) -> DataFrame:
    """(grp, name, digest) of JSON documents: the digest is of their canonical form, so that neither blanks nor the order of members matter."""
    return entries.select(F.lit(group).alias("grp"), name.cast("string").alias("name"), fingerprint(entry).alias("digest"))


def _node(rows: DataFrame, level: int) -> DataFrame:
    """The nodes of a level from the rows below them (grp, key, digest), which hang on the first digits of `place`."""
    children = F.array_sort(F.collect_list(F.struct("key", "digest")))  # about NODE_FILES
    said = F.array_join(F.transform(children, lambda c: F.concat(c["key"], F.lit("\0"), c["digest"], F.lit("\n"))), "")
    nodes = rows.groupBy("grp", F.substring("place", 1, level).alias("prefix")).agg(F.sha2(said.cast("binary"), 256).alias("digest"))
    return nodes.select("grp", F.lit(level).alias("level"), "prefix", F.lit(None).cast("string").alias("name"), "digest")


def freeze_tree(files: DataFrame, depth: int | None = None) -> DataFrame:
    """The tree of files (grp, name, digest), as TREE: each group's nodes by level (0 is its root) and prefix, and below the last level its files.

    Names must differ within a group. depth: levels below the root; by default as many as leave about NODE_FILES files to a lowest node, by a count of
    the files. Trees are compared only if their depths agree: give the frozen tree's depth to the present one's."""
    if depth is None:
        depth, n = 0, files.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
        while NODE_FILES * 16**depth < n:
            depth += 1
    leaves = files.select("grp", F.lit(depth + 1).alias("level"), F.sha2(F.col("name").cast("binary"), 256).alias("place"), "name", "digest")
    levels = [leaves.select("grp", "level", F.substring("place", 1, depth).alias("prefix"), "name", "digest")]
    below = leaves.select("grp", "place", F.col("name").alias("key"), "digest")
    for level in range(depth, -1, -1):
        nodes = _node(below, level)
        levels.append(nodes)
        below = nodes.select("grp", F.col("prefix").alias("place"), F.col("prefix").alias("key"), "digest")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def tree_depth(tree: DataFrame) -> int:
    return (tree.agg(F.max("level")).first()[0] or 1) - 1


def tree_roots(tree: DataFrame) -> DataFrame:
    """(grp, root) of each group: what stands for all of its names and contents."""
    return tree.where("level = 0").select("grp", F.col("digest").alias("root"))


def frozen_changes(frozen: DataFrame, present: DataFrame) -> DataFrame:
    """(grp, name, status): files that were changed, added or removed since; none if nothing was. Both sides are written trees (TREE) of one depth.

    Each level looks only at children of the nodes that differ above it, and the level filter reaches the tables, so equal branches are not joined."""
    depth = tree_depth(frozen)
    if tree_depth(present) != depth and not present.isEmpty() and not frozen.isEmpty():
        raise ValueError("the trees differ in depth")
    differ = None
    for level in range(depth + 1):
        sides = [t.where(F.col("level") == level).select("grp", "prefix", F.col("digest").alias(name)) for t, name in ((frozen, "a"), (present, "b"))]
        if differ is not None:
            above = differ.withColumnRenamed("prefix", "up")
            sides = [s.withColumn("up", F.substring("prefix", 1, level - 1)).join(above, ["grp", "up"], "left_semi").drop("up") for s in sides]
        differ = sides[0].join(sides[1], ["grp", "prefix"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("grp", "prefix")
    sides = [t.where(F.col("level") == depth + 1).join(differ, ["grp", "prefix"], "left_semi").select("grp", "name", F.col("digest").alias(name)) for t, name in ((frozen, "a"), (present, "b"))]
    both = sides[0].join(sides[1], ["grp", "name"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select("grp", "name", status.alias("status"))


def verify_frozen(frozen: DataFrame, present: DataFrame, groups: Sequence[str] = ()) -> None:
    """An error that names the groups whose roots differ, or that a side (or `groups`) lacks; nothing if the inputs are those that were frozen."""
    sides = tree_roots(frozen).withColumnRenamed("root", "a").join(tree_roots(present).withColumnRenamed("root", "b"), "grp", "full_outer")
    bad = {r["grp"] for r in sides.where(~F.col("a").eqNullSafe(F.col("b"))).select("grp").collect()}  # a row for each group: a few
    bad |= set(groups) - {r["grp"] for r in tree_roots(frozen).select("grp").collect()}
    if bad:
        raise ValueError(f"frozen inputs changed: {', '.join(sorted(bad))}")
