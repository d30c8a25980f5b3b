"""A Merkle manifest of a dataset: every row's digest, the roots of its groups and of all, and for each row the path that proves that it belongs.

Rows of a group stand in order; every `arity` consecutive digests become the digest of their hexadecimal texts, level by level, until one is left. A
group of any size is cut into blocks of arity ** LEVELS rows, aligned so that a block is a whole subtree. The blocks' roots are the leaves of the next
layer, which is cut likewise, so a few rounds of Spark jobs build a tree of any height; then the groups' roots, in order, form a last tree in the same way.

Within a block the paths come from fractal traversal: the levels are cut into stacked subtrees of a few levels each, of which one per layer exists (it
holds the siblings that the present row needs) while the next one that will be desired grows by one row a step. So a block's paths come in row order from
two small subtrees a layer. Paths above the block are the same for all its rows; they meet the block's rows once, where its paths are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm.common import bound_batches, join_small, map_batches, stage

#: Levels of a block, and of a stacked subtree within it.
LEVELS, HEIGHT = 6, 2
PATH = "array<struct<left:string,right:string>>"


def row_digest(columns: Sequence[Column]) -> Column:
    """Hexadecimal sha256 of the values end to end, each as '-' if null, else its UTF-8 length in bytes, a colon and itself."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give: each level's digest is that of the left siblings, the digest so far, and the right siblings."""
    return F.aggregate(path, leaf, lambda held, s: F.sha2(F.concat(s["left"], held, s["right"]).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def joined(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height_of(rows: int, arity: int) -> int:
    """Levels above the leaves of a tree of so many."""
    height = 0
    while rows > 1:
        rows, height = -(-rows // arity), height + 1
    return height


class Growing:
    """A subtree that grows leaf by leaf: it keeps the nodes of `height` levels from `base` on, below them only each level's open run."""

    def __init__(self, base: int, height: int, arity: int):
        self.base, self.top, self.arity = base, base + height, arity
        self.open: list[list[str]] = [[] for _ in range(self.top)]
        self.nodes: list[list[str]] = [[] for _ in range(height)]
        self.root: str | None = None

    def add(self, node: str, level: int = 0) -> None:
        """A leaf, or a node that has been closed below."""
        while level < self.top:
            if level >= self.base:
                self.nodes[level - self.base].append(node)
            run = self.open[level]
            run.append(node)
            if len(run) < self.arity:
                return
            node, level = joined(run), level + 1
            run.clear()
        self.root = node

    def close(self) -> None:
        """No more leaves come: runs that are short become their parents, level by level."""
        for level in range(self.top):
            if run := self.open[level]:
                node = joined(run)
                self.open[level] = []
                self.add(node, level + 1)


class Traversal:
    """The paths of a block's leaves, one after the other; `root` is known from the start.

    Subtrees are stacked from the leaves up. Of every layer one exists, which holds the present leaf's siblings of its levels, and (but for the
    uppermost) one grows that will be desired when the leaves under the former are used up; it takes one leaf a step, so it is ready by then.
    """

    def __init__(self, leaves: Sequence[str], levels: int, arity: int, height: int = HEIGHT):
        self.leaves, self.arity = leaves, arity
        self.spans = [(base, min(height, levels - base)) for base in range(0, levels, height)]
        self.exist, self.desire = [], []
        for base, h in self.spans:
            self.exist.append(self._grown(base, h, 0))
            self.desire.append(Growing(base, h, arity))
        self.root = self.exist[-1].root if self.spans else leaves[0]

    def _grown(self, base: int, height: int, at: int) -> Growing:
        tree = Growing(base, height, self.arity)
        for leaf in self.leaves[at : at + self.arity ** (base + height)]:
            tree.add(leaf)
        tree.close()
        return tree

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        """Each leaf's siblings: for every level, those to the left and those to the right, end to end."""
        for at in range(len(self.leaves)):
            path = []
            for tree in self.exist:
                for k, nodes in enumerate(tree.nodes):
                    place = at // self.arity ** (tree.base + k) % self.arity ** (tree.top - tree.base - k)
                    run = place - place % self.arity
                    path.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + self.arity])))
            yield path
            for layer, (base, height) in enumerate(self.spans):
                span = self.arity ** (base + height)
                ahead = at + span  # the leaf, one subtree on, that the growing one takes
                if ahead < len(self.leaves):
                    self.desire[layer].add(self.leaves[ahead])
                if (at + 1) % span == 0:
                    self.desire[layer].close()  # short only at the block's end
                    self.exist[layer], self.desire[layer] = self.desire[layer], Growing(base, height, self.arity)


def _numbered(rows: DataFrame, order: Sequence[Column], parts: int) -> DataFrame:
    """rows (with a column `grp`) and their `pos` in the group, by the order, and the group's size `n`.

    All rows are range-parted by group and order, so a group may lie over any number of tasks; each task numbers its own, and a table of counts by
    group and task tells where they begin. Written once: what a lost task does again can't differ.
    """
    names = rows.columns
    sorted_ = rows.repartitionByRange(parts, F.col("grp").asc_nulls_first(), *order).sortWithinPartitions(F.col("grp").asc_nulls_first(), *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, held, at = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("grp")
            codes = groups.dictionary_encode().indices.fill_null(-1).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            local = np.arange(codes.size) - np.repeat(first, np.diff(np.append(first, codes.size)))
            if (groups[0].as_py(),) == held:  # the group that the last batch ended with goes on
                local[: first[1] if first.size > 1 else codes.size] += at
            held, at = (groups[-1].as_py(),), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(local)], [*batch.schema.names, "part", "local"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = stage(map_batches(sorted_, number, f"{fields}, part int, local long"), "merkle-numbered")
    marked = numbered.withColumn("gk", F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit("-")))  # a null group is a group of its own
    by = Window.partitionBy("gk")  # a row for each task that holds rows of the group
    counts = marked.groupBy("gk", "part").agg(F.count("*").alias("c"))
    begins = counts.select("gk", "part", F.sum("c").over(by).alias("n"), (F.sum("c").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"))
    placed = join_small(marked, stage(begins, "merkle-begins"), ["gk", "part"])
    return placed.select(*names, (F.col("before") + F.col("local")).alias("pos"), "n")


def _strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


def _level_columns(paths: list[list[tuple[str, str]]]) -> pa.Array:
    """Arrow array of paths: lists of (left, right)."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
    sides = [_strings([s[k] for p in paths for s in p]) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(sides, ["left", "right"]))


def _block_roots(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(grp, pos, n, node) of the layer above: a row for each aligned block of nodes (grp, pos, n, node)."""
    size = arity**levels

    def run(block: pa.Table) -> pa.Table:
        n, pos = block.column("n")[0].as_py(), block.column("pos").to_numpy()
        order = np.argsort(pos)
        tree = Growing(0, min(levels, height_of(n, arity)), arity)
        for node in block.column("node").take(pa.array(order)).to_pylist():
            tree.add(node)
        tree.close()
        return pa.table([block.column("grp").slice(0, 1).cast(pa.string()), pa.array([int(pos[0]) // size]), pa.array([-(-n // size)]), _strings([tree.root])], ["grp", "pos", "n", "node"])

    return nodes.select("grp", "pos", "n", "node", F.floor(F.col("pos") / size).alias("block")).groupBy("grp", "block").applyInArrow(run, "grp string, pos long, n long, node string")


def _paths(nodes: DataFrame, above: DataFrame, arity: int, levels: int) -> DataFrame:
    """nodes with `path`, the siblings of each up to its group's root and on by the path above it; above: (grp, pos, path, and texts that its rows tell
    theirs) of the blocks."""
    size = arity**levels
    own, told = [f for f in nodes.schema if f.name != "n"], [c for c in above.columns if c not in ("grp", "pos", "path")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)

    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        tail = [(s["left"], s["right"]) for s in upper.column("path")[0].as_py()]
        walk = Traversal(block.column("node").to_pylist(), min(levels, height_of(block.column("n")[0].as_py(), arity)), arity)
        out = _level_columns([path + tail for path in walk])
        return pa.table([*(block.column(f.name) for f in own), out, *(_strings([upper.column(c)[0].as_py()] * block.num_rows) for c in told)], [*(f.name for f in own), "path", *told])

    left = nodes.withColumn("_block", F.floor(F.col("pos") / size)).groupBy("grp", "_block")
    right = above.select("grp", F.col("pos").alias("_block"), "path", *told).groupBy("grp", "_block")
    return left.cogroup(right).applyInArrow(run, ", ".join([fields, f"path {PATH}", *(f"{c} string" for c in told)]))


def forest(nodes: DataFrame, arity: int = 3, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """(roots, layers) of every group of nodes (grp, pos, n, node): roots as (grp, node), layers from the nodes up, each of which is a table."""
    layers = [nodes]
    while True:
        above = stage(_block_roots(layers[-1], arity, levels), "merkle-layer")
        layers.append(above)
        if above.where("n > 1").isEmpty():
            return above.select("grp", "node"), layers


def paths_of(layers: list[DataFrame], top: DataFrame, arity: int = 3, levels: int = LEVELS) -> DataFrame:
    """The first layer's rows with their whole paths; top: grp, path (above each group's root), and texts that are handed down to all its rows."""
    above = top.withColumn("pos", F.lit(0).cast("bigint"))
    for layer in layers[-2:0:-1]:
        above = stage(_paths(layer, above, arity, levels).drop("node"), "merkle-paths")
    return _paths(layers[0], above, arity, levels)


def merkle_manifest(rows: DataFrame, group_col: str, order_col: str, leaf_col: str, arity: int = 3, levels: int = LEVELS) -> DataFrame:
    """rows with `subroot` (the root of their group's tree), `root` (of all groups' roots, by group: null first, then by bytes) and `path`.

    path lists, from the row's own level up through its group's tree and the tree of groups to the root, the row's siblings: what stands to the left of
    it and to the right, as hexadecimal digests end to end. See fold_path and path_digest. leaf_col holds the rows' digests, hexadecimal; rows is read
    twice, so it should be a written table. Rows of a group stand by order_col, a null first; equal ones by leaf, so repeated rows have leaves of their
    own. A lone row is its group's root, a lone group's root is the root. An empty table gives no rows. Only these three columns are looked at; the
    others are carried, whatever they are called. A group of any size is spread over tasks: a task holds arity ** levels rows of it at once.
    """
    bound_batches(rows.sparkSession)
    named = {c: f"c{k}" for k, c in enumerate(rows.columns)}  # names that can't clash with this operator's own
    kept = [c for c in rows.columns if c != leaf_col]
    plain = rows.toDF(*named.values())
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slim = plain.select(*(named[c] for c in kept), F.col(named[group_col]).cast("string").alias("grp"), F.col(named[leaf_col]).alias("node"))
    leaves = _numbered(slim, [F.col(named[order_col]).asc_nulls_first(), F.col("node")], parts)
    if leaves.isEmpty():
        return rows.withColumns({"subroot": F.lit("").cast("string"), "root": F.lit("").cast("string"), "path": F.array().cast(PATH)}).where(F.lit(False))
    roots, layers = forest(leaves, arity, levels)
    groups = _numbered(roots.select(F.col("grp").alias("name"), F.lit("").alias("grp"), "node"), [F.col("name").asc_nulls_first()], min(parts, 64))
    root, upper = forest(groups, arity, levels)
    top = paths_of(upper, root.select("grp", F.array().cast(PATH).alias("path"), F.col("node").alias("root")), arity, levels)
    top = stage(top.select(F.col("name").alias("grp"), F.col("node").alias("subroot"), "root", "path"), "merkle-top")
    proven = paths_of(layers, top, arity, levels)
    return proven.select(*(F.col("node" if c == leaf_col else named[c]).alias(c) for c in rows.columns), "subroot", "root", "path")
