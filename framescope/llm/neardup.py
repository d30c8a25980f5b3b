"""Near-duplicate documents: HyperMinHash sketches, banding, collision-corrected estimates, exact confirmation, components.

A document's set holds the hashes of its distinct five-word shingles. Documents with equal sets form a class and are linked without more ado; all
else works on one row per class. Candidates come from bands of equal registers. In a bucket each class is first compared to a pivot; only classes
that are still apart after that are compared among each other, block by block and by their sketches, and what passes is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import LOWER, flat_bytes, flat_words, free_name, hash_words, join_small, map_batches, mix, runs, slices, stage
from framescope.llm.components import connected_components

WORDS = 5  # to a shingle
BUCKETS, MANTISSA = 128, 10  # registers of a sketch, and bits of each beside the count of leading zeros
#: How often all bands of a pair just at the threshold may differ.
MISS = 5e-7
_STEP = np.uint64(0xD1342543DE82EF95)


def banding(percent: int) -> tuple[int, int]:
    """(bands, registers of each) for a threshold: the longest bands with which a pair just at it is missed at most with probability MISS."""
    for rows in range(16, 0, -1):
        bands = BUCKETS // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return bands, rows
    raise ValueError("percent is too small for the sketch: pairs would be missed")


def least_set(percent: int) -> int:
    """Smaller sets have no near copy but equal ones: of m shingles and one more, m of m + 1 are shared at best."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of lower-cased (A-Z) words; a text with fewer words has one, of them all."""
    data, offsets = flat_bytes(texts)
    data = LOWER[data]
    starts, ends, first = flat_words(data, offsets)
    hashes = hash_words(data, starts, ends)
    sums = np.zeros(max(0, hashes.size - words + 1), np.uint64)
    for k in range(words):
        sums = sums * _STEP + hashes[k : k + sums.size]
    sums = mix(sums)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            found = np.sort(sums[a : b - words + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = mix(short * _STEP + hashes[k])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both > 0 and 100 * both >= percent * (a.size + b.size - both)


_DONORS = (mix(np.arange(BUCKETS * 512, dtype=np.uint64) + np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64).reshape(512, BUCKETS)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, BUCKETS) registers. The first 7 bits of a hash choose the bucket, whose least remainder is stored as its count of leading zeros and
    the bits after the leading one; 0 is no hash. An empty bucket copies the first full one of its own fixed random sequence."""
    sizes = np.array([s.size for s in sets])
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    if not sizes.sum():
        return out
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bits = int(math.log2(BUCKETS))
    bucket = (flat >> np.uint64(64 - bits)).astype(np.int64)
    # sets are sorted: the first hash of a bucket is its least
    lead = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])])
    rest = (flat[lead] << np.uint64(bits)) >> np.uint64(11)
    length = np.frexp(rest.astype(np.float64))[1]
    zeros = 53 - length
    tail = ((rest << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 53) - 1)) >> np.uint64(53 - MANTISSA)
    out[row[lead], bucket[lead]] = (zeros << MANTISSA) + tail.astype(np.int64) + 1
    full = out > 0
    at = np.argwhere(~full & (sizes > 0)[:, None])
    for step in range(len(_DONORS)):
        if not at.size:
            break
        donor = _DONORS[step][at[:, 1]]
        good = full[at[:, 0], donor]
        out[at[good, 0], at[good, 1]] = out[at[good, 0], donor[good]]
        at = at[~good]
    return out


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(rows, bands) 64-bit hashes of the bands' registers and number."""
    parts = registers[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    sums = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        sums = mix(sums * _STEP + parts[:, :, k])
    return sums.view(np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the count of equal registers, less what distinct least hashes agree on by chance: two have equally many zeros with
    probability 1/3, and then the same mantissa once in 2 ** MANTISSA."""
    chance = 2.0**-MANTISSA / 3
    return (equal / BUCKETS - chance) / (1 - chance)


def estimate_floor(least_size: np.ndarray, percent: int) -> np.ndarray:
    """Estimates below this are five standard errors under the threshold; small sets fill few buckets, so theirs spread more."""
    j = percent / 100
    return j - 5 * np.sqrt(j * (1 - j) / np.clip(least_size / 2, 1, BUCKETS))


def document_sets(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, n, node, sketch) per row: size of the set, its 128-bit key (null if empty), its registers (null for sets of fewer than `least`)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if s.size else None for s in sets]
            drawn = sketches([s if s.size >= least else s[:0] for s in sets])
            keys = [r.tobytes() if s.size >= least else None for r, s in zip(drawn, sets)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.size for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.binary())], ["id", "n", "node", "sketch"])

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n long, node binary, sketch binary")


def _registers(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), BUCKETS)


def _band_rows(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node, n) for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_hashes(_registers(batch.column("sketch")), bands, rows)
                at = pa.array(np.repeat(np.arange(batch.num_rows), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("node").take(at), batch.column("n").take(at)], ["bucket", "node", "n"])

    return map_batches(classes.select("node", "n", "sketch"), run, "bucket long, node binary, n long")


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sizes and sketches allow the threshold."""
    c = classes.select("node", "n", "sketch")
    sides = [c.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_registers(batch.column("s_a")) == _registers(batch.column("s_b"))).sum(axis=1)
                sizes = [batch.column(f"n_{x}").to_numpy() for x in "ab"]
                good = estimate(equal) >= estimate_floor(np.minimum(*sizes), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    sized = pairs.join(sides[0], "a").join(sides[1], "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return map_batches(sized, run, "a binary, b binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) that are similar on full sets."""
    sides = [texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches, "t_a"):
            sets = []
            for name in ("t_a", "t_b"):  # a pivot is in many pairs: its text is read once
                coded = batch.column(name).dictionary_encode()
                distinct = shingle_sets(coded.dictionary)
                sets.append([distinct[k] for k in coded.indices.to_pylist()])
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y, percent) for x, y in zip(*sets)], pa.bool_()))

    return map_batches(pairs.join(sides[0], "a").join(sides[1], "b"), run, "a binary, b binary")


def _with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (node, ..) with comp: the node's component under links, itself if none."""
    found = connected_components(links)
    return rows.join(found.select("node", F.col("component").alias("_c")), "node", "left").withColumn("comp", F.coalesce("_c", "node")).drop("_c")


def _mixed(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component. What is told of buckets is a table of its own here and below: Spark can only split the
    members of a hot bucket where the other side of the join comes straight from a shuffle."""
    members = stage(members, "members")
    apart = stage(members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket"), "mixed-buckets")
    return members.join(apart, "bucket")


def _pivot_pairs(members: DataFrame, seed: int) -> DataFrame:
    """Each member with its bucket's pivot, the node first in a hash order, unless they share a component."""
    first = stage(members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "comp")).alias("p")), "pivots")
    return members.join(first, "bucket").where("comp <> p.comp").select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _block_links(mixed: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, block: int, shape: tuple[int, int]) -> DataFrame:
    """(a, b): links, confirmed on full sets, that join members of a bucket which are in different components.

    A bucket's members outside its largest component meet all members in blocks of about `block` by 4 * block rows; none is left out. A pair is
    looked at in its first common band only, and confirmed if its sketches allow the threshold and nothing found before in the block has joined its
    components; so a block yields fewer links than it has components, however alike its members are.
    """
    sizes = mixed.groupBy("bucket", "comp").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("big")).where("all > 2")  # a pair has been confirmed or refused already
    sizes = stage(sizes, "bucket-sizes")
    rows = mixed.join(sizes, "bucket").join(classes.select("node", "sketch"), "node").join(texts, "node")
    bands, width = shape
    n_out = F.ceil((F.col("all") - F.col("big.k")) / block).cast("int")
    n_in = F.ceil(F.col("all") / (4 * block)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), n).cast("int")
    plain = ["bucket", "node", "comp", "n", "sketch", "text"]
    outs = rows.where("comp <> big.comp").select(*plain, place(n_out).alias("i"), F.explode(F.sequence(F.lit(0), n_in - 1)).alias("j"), F.lit(1).alias("out"))
    ins = rows.select(*plain, F.explode(F.sequence(F.lit(0), n_out - 1)).alias("i"), place(n_in).alias("j"), F.when(F.col("comp") == F.col("big.comp"), 0).otherwise(2).alias("out"))

    def candidates(group: pa.RecordBatch, nodes: list[bytes], comps: np.ndarray) -> Iterator[tuple[float, int, int]]:
        sides, sizes = group.column("out").to_numpy(), group.column("n").to_numpy()
        registers, bucket = _registers(group.column("sketch")), group.column("bucket")[0].as_py()
        inner = np.flatnonzero(sides != 1)
        for k in np.flatnonzero(sides == 1).tolist():
            rows = inner[comps[inner] != comps[k]]
            same = registers[k] == registers[rows]
            likeness = estimate(same.sum(axis=1))
            low, high = np.minimum(sizes[k], sizes[rows]), np.maximum(sizes[k], sizes[rows])
            good = np.flatnonzero((100 * low >= percent * high) & (likeness >= estimate_floor(low, percent)))
            if not good.size:
                continue
            first = same[good][:, : bands * width].reshape(-1, bands, width).all(axis=2).argmax(axis=1)
            own = int(np.flatnonzero(band_hashes(registers[k : k + 1], bands, width)[0] == bucket)[0])
            for g in good[first == own].tolist():
                m = int(rows[g])
                if sides[m] == 0 or nodes[k] < nodes[m]:
                    yield -float(likeness[g]), k, m

    def links_in(group: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
        nodes, comps = group.column("node").to_pylist(), group.column("comp").dictionary_encode().indices.to_numpy()
        found = sorted(candidates(group, nodes, comps))  # the likeliest first: they join the most
        if not found:
            return
        used = sorted({k for _, *pair in found for k in pair})
        sets = dict(zip(used, shingle_sets(group.column("text").take(pa.array(used)))))
        top = list(range(len(nodes)))

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for _, k, m in found:
            x, y = root(int(comps[k])), root(int(comps[m]))
            if x != y and similar(sets[k], sets[m], percent):
                top[x] = y
                yield min(nodes[k], nodes[m]), max(nodes[k], nodes[m])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for group in runs(batches, ["bucket", "i", "j"]):
            found = list(links_in(group))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])

    blocks = outs.unionByName(ins).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return map_batches(blocks, run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, block: int = 128) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (least id reachable by links, its own included), kept (whether that is its own id).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; percent is 11 to 100. A text without words (or null) has an
    empty set and is linked with nothing; long texts are read whole. Rows with a null id link others, keep a null component and are kept; repeated rows
    are in one component. Ties need no rule: the threshold is met or not. An empty table gives no rows. Only the two columns are read, whatever others
    are called.
    """
    bands, width = banding(percent)
    least = least_set(percent)
    sets = stage(document_sets(docs, id_col, text_col, least), "sets")
    classes = stage(sets.where(f"n >= {least}").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("id").alias("id")), "classes")
    rows = stage(_band_rows(classes, bands, width), "bands")
    shared = stage(rows.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket"), "shared-buckets")
    members = stage(rows.join(shared, "bucket").withColumn("comp", F.col("node")), "members")

    pairs = stage(_promising(_pivot_pairs(members, 0), classes, percent), "pivot-pairs")
    texts = stage(_texts_of(docs, classes.join(members.select("node").distinct(), "node").select("id", "node"), id_col, text_col), "texts")
    links = stage(_confirmed(pairs, texts, percent), "links")
    members = stage(_mixed(_with_components(members.select("bucket", "node", "n"), links)), "members")
    again = _promising(_pivot_pairs(members, 1).join(pairs, ["a", "b"], "left_anti"), classes, percent)
    more = stage(again, "pivot-pairs")
    links = stage(links.unionByName(_confirmed(more, texts, percent)), "links")
    members = stage(_mixed(_with_components(members.select("bucket", "node", "n"), links)), "members")
    links = stage(links.unionByName(_block_links(members, classes, texts, percent, block, (bands, width))), "links")
    return _resolved(sets, links, id_col)


def _texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of one document for each class of wanted (id: its least; node), found by the id, or by the set where all its ids are null."""
    wanted = stage(wanted, "wanted")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    found = join_small(rows, wanted.where("id is not null").select("id").distinct(), ["id"], "left_semi")
    nameless = wanted.where("id is null").select("node")
    if not nameless.isEmpty():
        found = found.unionByName(rows.where("id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if s.size else None for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("text")], ["node", "text"])

    return map_batches(found, run, "node binary, text string").where("node is not null").groupBy("node").agg(F.first("text").alias("text"))


def _resolved(sets: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    nodes = sets.groupBy("node").agg(F.min("id").alias("id")).where("node is not null")
    comp = stage(_with_components(nodes, links), "node-components")
    lowest = stage(comp.groupBy("comp").agg(F.min("id").alias("component_id")), "component-ids")
    found = stage(comp.join(lowest, "comp").select("node", "component_id"), "node-lowest")
    joined = sets.select("id", "n", "node").join(found, "node", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs, with all their columns, less all but one document of each component. Of rows that repeat id and text one stays, too.

    Rows with a null id stay; an empty table stays empty; any other columns pass through, whatever they are called."""
    key = free_name("_id", docs)
    judged = stage(near_duplicates(docs, id_col, text_col, percent), "near-duplicates").select(F.col(id_col).alias(key), "kept")
    ids = judged.groupBy(key).agg(F.count("*").alias("k"), F.bool_and("kept").alias("kept"))
    marked = stage(ids.where(F.col(key).isNotNull() & ((F.col("k") > 1) | ~F.col("kept"))), "marked-ids")
    left = join_small(docs.withColumn(key, docs[id_col]), marked.where("not kept").select(key), [key], "left_anti")
    again = marked.where("kept").select(key)
    if not again.isEmpty():
        once = join_small(left, again, [key], "left_semi").dropDuplicates([key, text_col])
        left = join_small(left, again, [key], "left_anti").unionByName(once)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
