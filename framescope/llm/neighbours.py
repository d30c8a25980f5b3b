"""Approximate nearest neighbours by learned partitions.

A sample's neighbour graph is cut into parts of equal size by halving it again and again, each time so that few neighbours are parted. A small network
then learns, from a vector alone, how its neighbours lie over the parts. Every vector is filed under its most probable part; a query goes to its most
probable parts, as many as hold a wanted share of the probability, and what it meets there is ranked by exact cosines. That share is measured on
sampled vectors that the network has not seen, so it rises where vectors have no structure to learn.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import join_small, map_batches, stage

#: Sampled vectors that the index is fitted on, vectors of a part that it aims at, and sampled vectors that a part needs.
SAMPLE, PART_ROWS, PART_SAMPLE = 4096, 1024, 64
#: Share of their nearest that held-out vectors of the sample must find.
TARGET = 0.96
#: Vectors and queries that meet in one task.
BLOCK, QUERY_BLOCK = 4096, 16384


def nearest(x: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """(rows, k) places of each unit vector's nearest others, nearest first."""
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), chunk):
        near = x[s : s + chunk] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -2
        out[s : s + chunk] = best(near, k)
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) places of each row's greatest scores, greatest first."""
    k = min(k, scores.shape[1])
    some = np.argpartition(scores, -k, axis=1)[:, -k:]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(scores, some, 1), axis=1, kind="stable"), 1)


def halve(graph: np.ndarray, nodes: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """nodes in two halves (sizes differ by one at most) with few links of the graph between them: split at the median of a smooth function on the
    graph, then pairs of nodes change sides as long as that parts fewer neighbours."""
    place = np.full(len(graph), -1)
    place[nodes] = np.arange(nodes.size)
    ends = place[graph[nodes]]
    a = np.repeat(np.arange(nodes.size), ends.shape[1])[ends.reshape(-1) >= 0]
    b = ends.reshape(-1)[ends.reshape(-1) >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])  # a link counts both ways
    degree = np.maximum(np.bincount(a, minlength=nodes.size), 1)
    f = np.random.default_rng(nodes.size).standard_normal(nodes.size)
    for _ in range(100):  # the walk's second eigenvector, by powers of the lazy walk without the constant part
        f -= (f * degree).sum() / degree.sum()
        f = (f + np.bincount(a, f[b], nodes.size) / degree) / 2
        f /= np.abs(f).max() or 1.0
    side = np.zeros(nodes.size, bool)
    side[np.argsort(f, kind="stable")[nodes.size // 2 :]] = True
    for _ in range(rounds):
        across = np.bincount(a, side[a] != side[b], nodes.size)
        gain = 2 * across - np.bincount(a, minlength=nodes.size)  # links that come together if this node moves
        left, right = (np.flatnonzero(side == s)[np.argsort(-gain[side == s], kind="stable")] for s in (False, True))
        m = min(left.size, right.size, max(1, nodes.size // 20))
        swap = gain[left[:m]] + gain[right[:m]] > 0
        if not swap.any():
            break
        moved = side.copy()
        moved[left[:m][swap]], moved[right[:m][swap]] = True, False
        if (moved[a] != moved[b]).sum() >= (side[a] != side[b]).sum():
            break
        side = moved
    return nodes[~side], nodes[side]


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """The part (0 to parts - 1, a power of two) of each node; sizes differ by one at most at each halving."""
    held = [np.arange(len(graph))]
    while len(held) < parts:
        held = [half for nodes in held for half in halve(graph, nodes)]
    out = np.empty(len(graph), np.int64)
    for k, nodes in enumerate(held):
        out[nodes] = k
    return out


@dataclass
class Router:
    """A network of one hidden layer that gives each part's probability from a unit vector, and the share of probability that a query should visit."""

    hidden: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    share: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.hidden + self.shift, 0) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts): the most probable parts of each row, until their probabilities reach the share."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_ = np.take_along_axis(p, order, 1)
        before = np.cumsum(sorted_, axis=1) - sorted_
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, before < self.share, 1)
        return out

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, width: int = 128, epochs: int = 40, rate: float = 3e-3, seed: int = 11) -> Router:
        """target: (rows, parts), how each row's neighbours lie over the parts. Adam on the cross entropy, with weights that decay."""
        rng = np.random.default_rng(seed)
        net = cls(rng.standard_normal((x.shape[1], width)) * math.sqrt(2), np.zeros(width), rng.standard_normal((width, target.shape[1])) * 0.05, np.zeros(target.shape[1]))
        held = [net.hidden, net.shift, net.out, net.bias]
        first, second = [np.zeros_like(w) for w in held], [np.zeros_like(w) for w in held]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), 256):
                rows = order[s : s + 256]
                z = x[rows] @ net.hidden + net.shift
                h = np.maximum(z, 0)
                d = (h @ net.out + net.bias).astype(np.float64)
                d = np.exp(d - d.max(axis=1, keepdims=True))
                d = (d / d.sum(axis=1, keepdims=True) - target[rows]) / rows.size
                back = (d @ net.out.T) * (z > 0)
                step += 1
                for k, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    held[k] -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + 1e-3 * held[k])
        return net


def fit_router(x: np.ndarray, parts: int, k: int, target: float = TARGET, links: int = 10) -> Router:
    """A router for unit vectors: graph, parts, network, and the share of probability at which held-out vectors find `target` of their k nearest."""
    if parts < 2 or len(x) <= 4 * links:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    held_out = np.arange(len(x)) % 5 == 4
    graph = nearest(x, max(links, k))
    own = balanced_parts(graph, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), own[graph.reshape(-1)]), 1.0)
    np.add.at(soft, (np.arange(len(x)), own), graph.shape[1] / 2)
    soft /= soft.sum(axis=1, keepdims=True)
    net = Router.fit(x[~held_out], soft[~held_out])
    filed = net.probabilities(x).argmax(axis=1)  # where a vector of the table would be filed
    p = net.probabilities(x[held_out])
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_ = np.take_along_axis(p, order, 1)
    before = np.take_along_axis(np.cumsum(sorted_, axis=1) - sorted_, np.argsort(order, axis=1), 1)  # probability of the parts that are visited before a part
    net.share = float(np.nextafter(np.quantile(np.take_along_axis(before, filed[graph[held_out, :k]], 1), target), 2))
    return net


def units(raw: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors scaled by powers of two, so that no square overflows and nothing is rounded; their lengths)."""
    x = np.stack([np.frombuffer(v, dtype) for v in raw]).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def parts_for(rows: int, sample: int) -> int:
    """How many parts, a power of two: about one for PART_ROWS vectors, two at least where 256 are there, and no more than the sample can tell apart."""
    if rows < 256:
        return 1
    return 1 << max(1, min(round(math.log2(rows / PART_ROWS)), int(math.log2(max(2, sample / PART_SAMPLE)))))


def nearest_vectors(df: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank from 1, id, score): for each row of df that asks, the k nearest rows found, by cosine in double precision of the original vectors.

    Nearest first, ties to the smaller id; all other rows if there are fewer than k. Candidates are all rows but those with the query's own id. Vectors
    that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with a null id; vectors meet only those of their own
    length. An id that repeats with the same vector counts once, with different vectors for each. Equal vectors are compared once, whatever their number,
    and keep the k + 1 smallest ids, which is all that a query can want of them. An empty table gives no rows. Only the named columns, and those of
    `asks`, are read, whatever others are called.

    The index is fitted on a hash sample of about `sample` distinct vectors, with at most sample / 64 parts; every vector is filed. Held-out
    vectors of the sample find `target` of their nearest; without structure in the vectors, most parts have to be visited for that.
    """
    single = df.schema[vector_col].dataType.elementType == T.FloatType()
    dtype, id_type = "<f4" if single else "<f8", df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<float>" if single else "array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).where("id is not null")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column("v"):
                x = np.array(v.values.to_numpy(zero_copy_only=False), dtype) if v.is_valid and v.values.null_count == 0 else np.zeros(0, dtype)
                raw.append((x + 0.0).tobytes() if x.size and np.isfinite(x).all() and x.any() else None)
            keys = pa.array([xxhash.xxh3_128_digest(x) if x is not None else None for x in raw], pa.binary())
            sizes = pa.array([len(x or b"") for x in raw], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), keys, sizes, pa.array(raw, pa.binary())], ["id", "asks", "node", "size", "raw"]).filter(keys.is_valid())

    all_ = stage(map_batches(rows, keyed, f"id {id_type}, asks boolean, node binary, size int, raw binary"), "neighbour-rows")
    named = all_.groupBy("node", "id").agg(F.bool_or("asks").alias("asks"))
    low = named.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
    classes = all_.groupBy("node").agg(F.first("raw").alias("raw"), F.first("size").alias("size"), F.bool_or("asks").alias("asks")).join(low, "node")
    classes = stage(classes, "neighbour-classes")
    found = None
    for r in classes.groupBy("size").count().orderBy("size").collect():  # lengths of vectors: one, or a few
        part = _found(classes.where(F.col("size") == r["size"]), r["count"], k, dtype, id_type, sample, target)
        found = part if found is None else found.unionByName(part)
    result = f"query_id {id_type}, rank int, `{id_col}` {id_type}, score double"
    if found is None:
        return df.sparkSession.createDataFrame([], result)
    # of a query's partial lists (one from each block it met) the first k + 1 vectors stay
    by = Window.partitionBy("node").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    firsts = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).groupBy("node").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    told = join_small(named.where("asks").select("node", F.col("id").alias("query_id")), stage(firsts, "neighbour-firsts"), ["node"])
    each = F.flatten(F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("away"), i.alias("id")))))
    ranked = F.slice(F.array_sort(F.filter(each, lambda c: c["id"] != F.col("query_id"))), 1, k)
    out = told.select("query_id", F.posexplode(ranked).alias("p", "c"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("c.id").alias(id_col), (-F.col("c.away")).alias("score"))


def _found(classes: DataFrame, count: int, k: int, dtype: str, id_type: str, sample: int, target: float) -> DataFrame:
    """(node, score, ids): what each asking class meets in each block of the parts it visits, k + 1 vectors of a block at most."""
    parts = parts_for(count, min(sample, count))
    low = (min(sample, count) << 64) // count - (1 << 63) - 1  # of all 64-bit hashes, so that the draw stays bounded at any count
    drawn = classes.where(F.xxhash64("node", F.lit(5)) <= F.lit(low)).select("node", "raw").limit(2 * sample).toPandas()  # about `sample` rows
    x, length = units(list(drawn.sort_values("node").raw), dtype) if len(drawn) else (np.zeros((0, 1)), np.zeros(0))
    router = fit_router(x / length[:, None], parts, k, target)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, length = units(batch.column("raw").to_pylist(), dtype)
                x /= length[:, None]
                visited = router.visited(x)
                asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                visits = [np.flatnonzero(v).tolist() if a else [] for v, a in zip(visited, asks)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "raw", "ids")), pa.array(router.probabilities(x).argmax(axis=1), pa.int32()), pa.array(visits, pa.list_(pa.int32()))], ["node", "raw", "ids", "part", "visits"])

    filed = stage(map_batches(classes.select("node", "raw", "ids", "asks"), file, f"node binary, raw binary, ids array<{id_type}>, part int, visits array<int>"), "neighbour-parts")
    visiting = filed.select(F.col("node").alias("asker"), F.col("raw").alias("asked"), F.explode("visits").alias("part"))
    held = {r["part"]: r["n"] for r in filed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each part
    come = {r["part"]: r["n"] for r in visiting.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = [(p, -(-n // BLOCK), -(-come[p] // QUERY_BLOCK)) for p, n in held.items() if p in come]
    cut = F.broadcast(classes.sparkSession.createDataFrame(blocks, "part int, nb int, nq int"))  # a row for each part
    lot = lambda of, n: F.pmod(F.xxhash64(of, F.lit(6)), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.drop("visits").join(cut, "part").withColumn("b", lot("node", "nb")).withColumn("q", over("nq"))
    right = visiting.join(cut, "part").withColumn("q", lot("asker", "nq")).withColumn("b", over("nb"))

    def compare(block: pa.Table, queries: pa.Table) -> pa.Table:
        nodes, lists, scores, rows = queries.column("asker").to_pylist(), [], [], []
        if block.num_rows and queries.num_rows:
            ids = block.column("ids").to_pylist()
            (x, nx), (y, ny) = (units(c.to_pylist(), dtype) for c in (block.column("raw"), queries.column("asked")))
            flat = (x / nx[:, None]).T
            for s in range(0, len(y), 512):
                part = y[s : s + 512]
                some = best((part / ny[s : s + 512, None]) @ flat, k + 3)  # two more than count, as products differ in the last digits
                exact = (part[:, None, :] * x[some]).sum(axis=2) / (ny[s : s + 512, None] * nx[some])
                for i, (at, said) in enumerate(zip(some.tolist(), exact.tolist())):
                    for score, _, c in sorted((-v, ids[c][0], c) for v, c in zip(said, at))[: k + 1]:
                        rows.append(nodes[s + i])
                        scores.append(-score)
                        lists.append(ids[c])
        return pa.table([pa.array(rows, pa.binary()), pa.array(scores, pa.float64()), pa.array(lists, block.schema.field("ids").type)], ["node", "score", "ids"])

    by = ["part", "b", "q"]
    met = left.select("node", "raw", "ids", *by).groupBy(*by).cogroup(right.select("asker", "asked", *by).groupBy(*by))
    return met.applyInArrow(compare, f"node binary, score double, ids array<{id_type}>")
