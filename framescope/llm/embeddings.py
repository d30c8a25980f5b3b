"""Near-duplicate vectors by cosine: cover trees, and a dual traversal that prunes and accepts pairs of nodes by their covering radii.

Equal vectors are one weighted class. A net of pivots from a bounded sample is the top of the tree: every class belongs to its nearest pivot's cell, of
which the largest distance is known, and pairs of cells too far apart never meet. Cells are split into blocks, and each block grows the levels below:
centres with halving radii, every level inside its parents. Two blocks are compared from the roots down. A pair of nodes whose centres are farther apart
than both radii and the threshold ends there; only the children of the pairs that are left are measured. One whose farthest members must be within the
threshold counts as linked altogether; leaves are compared vector by vector, in double precision. Distances are chords of unit vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import map_batches, stage
from framescope.llm.components import connected_components
from framescope.llm.merges import ranges

#: Radius of the first level below a cell, and the one at which levels end. With greater radii no two nodes are ever too far apart.
FIRST, LEAF = 0.5, 0.125
_SLACK = 1e-9  # bounds are widened by more than rounding can do


def chord(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2.0
    d += 2.0
    return np.sqrt(np.maximum(d, 0.0, out=d), out=d)


class CoverTree:
    """Levels of centres over unit vectors, the coarsest first; each level's centres cover all vectors within its radius, each within its parent's node.

    Vectors are held in depth-first order (`order` gives their former places), so a node is a range of rows, and of the nodes of the next level. A level
    is left out where it has over four fifths as many centres as vectors, or the nodes of the level before: it would tell nothing new. The last level's
    nodes are the leaves. `below` tells where each node of a level begins among those of the next (rows, at the last), and the end.
    """

    def __init__(self, x: np.ndarray, paths: np.ndarray | None = None, leaf: float = LEAF):
        """paths: (rows, levels) centre of each vector at every level, where a tree over the same vectors told it before."""
        paths = self._grow(x, leaf) if paths is None else paths
        self.paths = paths
        self.order = np.lexsort(paths.T[::-1]) if paths.shape[1] else np.arange(len(x))
        self.x = x[self.order]
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        sorted_ = paths[self.order]
        self.starts: list[np.ndarray] = []  # first row of each node, and the end
        self.centres: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        change = np.zeros(len(x), bool)
        for k in range(paths.shape[1]):
            change |= np.diff(sorted_[:, k], prepend=-1) != 0
            first = np.flatnonzero(change)
            centre = place[sorted_[first, k]]
            own = np.repeat(centre, np.diff(np.append(first, len(x))))
            far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.x, self.x[own])))
            self.starts.append(np.append(first, len(x)))
            self.centres.append(centre)
            self.radii.append(np.maximum.reduceat(far, first) if len(x) else far)
        self.starts.append(np.arange(len(x) + 1))
        self.below = [np.searchsorted(fine, coarse) for coarse, fine in zip(self.starts, self.starts[1:])]

    @staticmethod
    def _grow(x: np.ndarray, leaf: float, probes: int = 64) -> np.ndarray:
        low = x.astype(np.float32)
        levels: list[np.ndarray] = []
        if not len(x):
            return np.zeros((0, 1), np.int64)
        probe = np.arange(0, len(x), max(1, len(x) // probes))
        near = _distances(low[probe], low)
        near[np.arange(probe.size), probe] = 9
        nearest = near.min(axis=1)
        nodes, radius, held = [np.arange(len(x))], FIRST, 0
        while radius >= leaf:
            if (nearest > radius).mean() > 0.8:  # whatever has no neighbour within the radius is a centre
                radius /= 2
                continue
            own, count = np.zeros(len(x), np.int64), 0
            parts = []
            for rows in nodes:
                centres, near = [], np.full(rows.size, np.inf, np.float32)
                who = np.zeros(rows.size, np.int64)
                while (near > radius).any():  # the next centre is the first row that none covers
                    c = int((near > radius).argmax())
                    d = np.sqrt(np.maximum(0, 2 - 2 * (low[rows] @ low[rows[c]])))
                    d[c] = 0
                    who[d < near] = len(centres)
                    near = np.minimum(near, d)
                    centres.append(rows[c])
                own[rows] = np.array(centres)[who]
                count += len(centres)
                by = np.argsort(who, kind="stable")
                parts += np.split(rows[by], np.cumsum(np.bincount(who, minlength=len(centres)))[:-1])
            if held < count <= 0.8 * len(x):
                levels.append(own)
                nodes, held = parts, count
            radius /= 2
        return np.stack(levels or [np.zeros(len(x), np.int64)], axis=1)


class DualTraversal:
    """Pairs of vectors of two trees (or of one with itself) with at least the cosine. `measured` counts the distances that were computed."""

    def __init__(self, a: CoverTree, b: CoverTree | None, cosine: float):
        self.a, self.b, self.same = a, a if b is None else b, b is None
        self.cosine, self.threshold, self.measured = cosine, chord(cosine), 0

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of arrays (former places in a, in b): every vector of the one is linked to every one of the other. Each linked pair comes once."""
        for left, right in self._pairs():
            yield self.a.order[left], self.b.order[right]

    def _pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        depth = max(len(self.a.centres), len(self.b.centres))
        roots = np.arange(len(self.b.centres[0])) if len(self.b.x) else np.zeros(0, np.int64)
        front = [(np.arange(len(self.a.centres[0])), roots)] if len(self.a.x) and roots.size else []
        for k in range(depth):
            ka, kb = min(k, len(self.a.centres) - 1), min(k, len(self.b.centres) - 1)
            partners: dict[int, np.ndarray] = {}
            for rows, columns in front:
                for u, near in self._measure(ka, kb, rows, columns):
                    if k == depth - 1:
                        yield from self._leaves(ka, kb, u, near)
                    elif near.size:
                        partners[u] = near
            if k < depth - 1:
                na, nb = min(k + 1, len(self.a.centres) - 1), min(k + 1, len(self.b.centres) - 1)
                front = [(self._below(self.a, ka, na, np.array([u])), self._below(self.b, kb, nb, v)) for u, v in partners.items()]

    @staticmethod
    def _below(tree: CoverTree, k: int, following: int, nodes: np.ndarray) -> np.ndarray:
        if k == following:  # this tree has ended; its leaves go on
            return nodes
        cuts = tree.below[k]
        return ranges(cuts[nodes], cuts[nodes + 1] - cuts[nodes])

    def _measure(self, ka: int, kb: int, rows: np.ndarray, columns: np.ndarray, chunk: int = 512) -> Iterator[tuple[int, np.ndarray]]:
        """(node of a, the nodes of b among columns that may hold links with it)."""
        far = self.b.x[self.b.centres[kb][columns]]
        for s in range(0, rows.size, chunk):
            part = rows[s : s + chunk]
            d = _distances(self.a.x[self.a.centres[ka][part]], far)
            self.measured += d.size
            near = d <= self.a.radii[ka][part, None] + self.b.radii[kb][columns] + self.threshold + _SLACK
            if self.same:
                near &= columns >= part[:, None]
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                yield int(part[i]), columns[near[i]]

    def _leaves(self, ka: int, kb: int, u: int, near: np.ndarray, chunk: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.arange(self.a.starts[ka][u], self.a.starts[ka][u + 1])
        d = _distances(self.a.x[self.a.centres[ka][u]][None, :], self.b.x[self.b.centres[kb][near]])[0]
        sure = d + self.a.radii[ka][u] + self.b.radii[kb][near] < self.threshold - _SLACK
        if self.same:
            sure &= near != u
        begin, end = self.b.starts[kb][near], self.b.starts[kb][near + 1]
        for v in np.flatnonzero(sure).tolist():
            yield left, np.arange(begin[v], end[v])
        right = ranges(begin[~sure], (end - begin)[~sure])
        for s in range(0, left.size, chunk):
            right = right[right > left[s]] if self.same else right
            close = self.a.x[left[s : s + chunk]] @ self.b.x[right].T >= self.cosine
            self.measured += close.size
            if self.same:
                close &= right > left[s : s + chunk, None]
            for m in np.flatnonzero(close.any(axis=1)).tolist():
                yield left[s + m : s + m + 1], right[close[m]]


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def block_links(a: CoverTree, wx: np.ndarray, b: CoverTree | None, wy: np.ndarray | None, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weight linked to each row, edges that join what is linked) of one block with itself, or with another; rows of b follow those of a."""
    n = len(a.x)
    weight = wx if b is None else np.concatenate([wx, wy])
    sums = np.zeros(weight.size, np.int64)
    union = _Union(weight.size)
    for left, right in DualTraversal(a, b, cosine).links():
        other = right if b is None else right + n
        sums[left] += weight[other].sum()
        sums[other] += weight[left].sum()
        root = union.find(int(left[0]))
        for k in (*left.tolist(), *other.tolist()):
            r = union.find(k)
            if r != root:
                union.up[r] = root
    return sums, [(k, r) for k in range(weight.size) for r in [union.find(k)] if r != k]


def _unit(column: pd.Series, dtype: str) -> np.ndarray:
    x = np.stack([np.frombuffer(v, dtype) for v in column]).astype(np.float64)
    with np.errstate(over="ignore"):
        x /= np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def near_vectors(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None, sample: int = 4096) -> DataFrame:
    """One row per row of df: id, n_links (other rows linked), component_id (least id reachable by links, its own included), kept (whether its own).

    Rows are linked if the cosine of their vectors, in double precision, is at least `cosine` (above 0). Vectors that are null, empty, zero or hold
    a null or non-finite component link with nothing, nor do vectors of different lengths. Repeated rows link. A null id has a null component, is
    kept, and counts as a link of others. An empty table gives no rows. Ties need no rule; only the two columns are read, whatever others are called.
    Pivots, at most a quarter of `sample`, are fitted on a hash sample of about `sample` classes; they only steer the work, and every vector is indexed.
    block: vectors of a block; by default 16 times the root of their number, 1,024 to 16,384. The copies of a vector grow with that root up to 1,048,576
    vectors, and with their number from there on.
    """
    single = df.schema[vector_col].dataType.elementType == T.FloatType()
    dtype = "<f4" if single else "<f8"
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<float>" if single else "array<double>").alias("v"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column("v"):
                x = np.array(v.values.to_numpy(zero_copy_only=False), dtype) if v.is_valid and v.values.null_count == 0 else np.zeros(0, dtype)
                raw.append((x + 0.0).tobytes() if x.size and np.isfinite(x).all() and x.any() else None)
            keys = [xxhash.xxh3_128_digest(x) if x is not None else None for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "node", "raw"])

    id_type = rows.schema["id"].dataType.simpleString()
    all_ = stage(map_batches(rows, keyed, f"id {id_type}, node binary, raw binary"), "vectors")
    classes = stage(all_.where("node is not null").groupBy("node").agg(F.first("raw").alias("raw"), F.count("*").alias("w"), F.octet_length(F.first("raw")).alias("size")), "vector-classes")
    sums = _block_sums(classes, cosine, dtype, block, sample)
    links = sums.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    comp = connected_components(sums.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_node = classes.select("node", "w").join(links, "node", "left").join(comp, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("comp"))
    ids = all_.where("node is not null").groupBy("node").agg(F.min("id").alias("low"))
    per_node = stage(per_node.join(ids, "node"), "vector-nodes")
    lowest = stage(per_node.groupBy("comp").agg(F.min("low").alias("component_id")), "vector-lowest")  # a table, so that a hot component's rows can be split
    found = stage(per_node.join(lowest, "comp").select("node", "n_links", "component_id"), "vector-components")
    joined = all_.select("id", "node").join(found, "node", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _pivots(classes: DataFrame, dtype: str, count: int, sample: int, total: int) -> np.ndarray:
    """Unit vectors far from each other, picked greedily from a bounded hash sample."""
    draw = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < F.lit(min(1.0, sample / total) * 1_000_000)
    found = classes.where(draw).select("raw").limit(4 * sample).toPandas()
    if not len(found):
        found = classes.select("raw").limit(1).toPandas()
    x = _unit(found.raw, dtype)
    picked = [0]
    far = _distances(x, x[:1])[:, 0]
    while len(picked) < min(count, len(x)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


def _block_sums(classes: DataFrame, cosine: float, dtype: str, most: int | None, sample: int) -> DataFrame:
    """(node, other, n): n rows linked to a class in one pair of blocks (other null), and the edges between classes (n null)."""
    spark = classes.sparkSession
    schema = "node binary, other binary, n long"
    parts = []
    for r in classes.groupBy("size").count().orderBy("size").collect():  # lengths of vectors: one, or a few
        own = classes.where(F.col("size") == r["size"])
        block = most or int(min(16384, max(1024, 16 * r["count"] ** 0.5)))
        pivots = _pivots(own, dtype, min(sample // 4, -(-r["count"] // block)), sample, r["count"])

        def place(batches: Iterator[pa.RecordBatch], pivots: np.ndarray = pivots) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = _distances(_unit(pd.Series(batch.column("raw").to_pylist()), dtype), pivots)
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "far"])

        placed = stage(map_batches(own.select("node", "raw", "w"), place, "node binary, raw binary, w long, cell int, far double"), "vector-cells")

        def plant(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("node")
            return group.assign(path=list(CoverTree(_unit(group.raw, dtype)).paths.astype(np.int32)))

        cells = {c["cell"]: (c["n"], c["far"]) for c in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row for each pivot
        between, t = _distances(pivots, pivots), chord(cosine)
        blocks = {c: -(-n // block) for c, (n, _) in cells.items()}
        at = np.array(sorted(cells))
        reach = np.array([cells[c][1] for c in at.tolist()])
        i, j = np.nonzero(np.triu(between[np.ix_(at, at)] <= reach[:, None] + reach + t + 1e-6))
        count = np.array([blocks[c] for c in at.tolist()])
        pairs = pd.DataFrame({"i": at[i], "j": at[j], "ni": count[i], "nj": count[j]}).astype("int32")
        partners = F.broadcast(spark.createDataFrame(pairs))  # at most half the squared number of pivots
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        counts = F.broadcast(spark.createDataFrame(list(blocks.items()), "cell int, blocks int"))  # a row for each pivot
        # a pair of cells with one block each is dealt with as it is; larger cells are split by a hash
        split = placed.join(counts, "cell").select("node", "raw", "w", "cell", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("part"))
        planted = stage(split.groupBy("cell", "part").applyInPandas(plant, "node binary, raw binary, w long, cell int, part int, path array<int>"), "vector-trees")
        left = planted.join(partners, F.col("cell") == F.col("i")).withColumn("a", F.col("part")).withColumn("b", spread(F.col("nj"))).where("i <> j or a <= b").withColumn("side", F.lit(0))
        right = planted.join(partners, F.col("cell") == F.col("j")).withColumn("b", F.col("part")).withColumn("a", spread(F.col("ni"))).where("i <> j or a < b").withColumn("side", F.lit(1))

        def compare(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["side", "node"])
            x, y = group[group.side == 0], group[group.side == 1]
            twin = bool((group.i.iloc[0] == group.j.iloc[0]) and (group.a.iloc[0] == group.b.iloc[0]))
            if not len(x) or not len(y) and not twin:
                return pd.DataFrame(columns=["node", "other", "n"])
            tree = lambda g: CoverTree(_unit(g.raw, dtype), np.stack(g.path.to_numpy()).astype(np.int64))
            sums, edges = block_links(tree(x), x.w.to_numpy(), None if twin else tree(y), None if twin else y.w.to_numpy(), cosine)
            nodes = group.node.to_numpy()
            some = np.flatnonzero(sums)
            out = [(nodes[k], None, int(sums[k])) for k in some.tolist()] + [(nodes[k], nodes[m], None) for k, m in edges]
            return pd.DataFrame(out, columns=["node", "other", "n"]).astype({"n": "Int64"})

        plain = ["i", "a", "j", "b", "side", "node", "raw", "w", "path"]
        parts.append(stage(left.select(plain).unionByName(right.select(plain)).groupBy("i", "a", "j", "b").applyInPandas(compare, schema), "vector-sums"))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
