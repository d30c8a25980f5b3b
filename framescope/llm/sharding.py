"""Rendezvous sharding: every record goes to the shard with the best weighted hash of (key, shard).

Main path: DataFrame functions only. No shuffle decides a shard; one shuffle numbers the rows of a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm.common import free_name, join_small, stage


def shard_scores(key: Column, shards: Column) -> Column:
    """Array of (score, shard) structs, one for each (id, weight) struct of `shards`.

    The first 52 bits of md5("key:id") give u in (0, 1); the score weight / -ln(u) makes each shard win in proportion to its weight,
    and depends on no other shard, so adding one moves rows only into the new one.
    """

    def score(s: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, s["id"].cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
        return F.struct((s["weight"] / -F.log((bits + 0.5) / F.lit(float(1 << 52)))).alias("score"), (-s["id"]).alias("shard"))

    return F.transform(shards, score)


def _shard_list(weights: Sequence[float], first: int = 0) -> Column:
    return F.array(*(F.struct(F.lit(first + i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)))


def assign_shards(df: DataFrame, key: str | Sequence[str], weights: Sequence[float], grown_weight: float | None = None, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Adds `shard` (0 .. len(weights) - 1), and `grown` (the shard if one of grown_weight were added) unless grown_weight is None.

    key: columns that name a record for good; rows with equal keys share a shard. A null key counts as empty text. Ties go to the lower shard.
    An empty table stays empty; other columns pass through, but for those named like the new ones, which are replaced.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not weights or min([*weights, *([] if grown_weight is None else [grown_weight])]) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {shard.lower(), grown.lower()}]
    best, more = (free_name(x, df) for x in ("_best", "_more"))
    scored = df.select(*kept, F.array_max(shard_scores(text, _shard_list(weights))).alias(best), *([] if grown_weight is None else [shard_scores(text, _shard_list([grown_weight], len(weights)))[0].alias(more)]))
    out = [*kept, (-F.col(f"`{best}`.shard")).alias(shard)]
    if grown_weight is not None:
        out.append((-F.greatest(best, more)["shard"]).alias(grown))
    return scored.select(*out)


#: Rows that one sorted part of a shard holds, about; and parts of a shard at least.
PART_ROWS, LEAST_PARTS = 1_000_000, 64


def number_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", part_rows: int = PART_ROWS, least_parts: int = LEAST_PARTS) -> DataFrame:
    """Adds `slot`, gapless from 0 within each shard; a column of that name is replaced.

    Each shard is dealt into parts by a digest of the order columns, about part_rows rows each; parts are sorted and numbered apart, and a part starts
    where the rows of the parts before it end, which the counts tell. So no task sorts a whole shard. df is written once, as both the counts and the
    numbers need it. Rows equal in all of `order` (nulls are empty texts) get slots in any order among themselves. An empty table stays empty; all
    other columns pass through, whatever they are called.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != slot.lower()]
    part, row, rows, before = (free_name(x, df) for x in ("_part", "_row", "_rows", "_before"))
    written = stage(df.select(*kept), "sharded")
    largest = written.groupBy(F.col(f"`{shard}`").alias("s")).count().agg(F.max("count")).first()[0] or 0
    parts = max(least_parts, -(-largest // part_rows))
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in order)).cast("binary"))
    split = written.withColumn(part, (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts).cast("int"))
    sizes = split.groupBy(f"`{shard}`", part).agg(F.count("*").alias(rows))
    earlier = Window.partitionBy(f"`{shard}`").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage(sizes.select(f"`{shard}`", part, F.coalesce(F.sum(rows).over(earlier), F.lit(0)).alias(before)), "shard-parts")
    inside = Window.partitionBy(f"`{shard}`", part).orderBy(*(F.col(f"`{c}`") for c in order))
    numbered = join_small(split.withColumn(row, F.row_number().over(inside)), sizes, [shard, part])
    return numbered.select(*kept, (F.col(before) + F.col(row) - 1).alias(slot))
