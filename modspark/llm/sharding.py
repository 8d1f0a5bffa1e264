"""Sharding by a hierarchical weighted hash tree.  DataFrame functions only.

A row descends from the root to a region, a rack and a shard. At each node every child makes one
draw, ``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name, and the
smallest wins. A child's draw depends on nothing but key, name and own weight, so when weights
change, rows move only into or out of the subtrees whose weights changed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from modspark.llm.base import staged

#: Shape of a full region, and shards that are laid out in full regions; each further one has a region of its own.
RACKS, SHARDS_PER_RACK, LAID_OUT = 3, 4, 24
#: Rows that one numbering group is meant to hold, and the least number of groups of a shard.
GROUP, LEAST_GROUPS = 100_000, 16


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def spread(shards: int) -> list[Shard]:
    """The tree of so many equal shards: four to a rack, three racks to a region, up to ``LAID_OUT``;
    beyond, the tree of one shard fewer, grown by one. So id and shard count alone decide, and from
    ``LAID_OUT`` on one more shard takes rows only into itself."""
    size = RACKS * SHARDS_PER_RACK
    tree = [Shard(i, f"region{i // size}", f"rack{i % size // SHARDS_PER_RACK}") for i in range(min(shards, LAID_OUT))]
    while len(tree) < shards:
        tree = grown(tree)
    return tree


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own: no other region's or rack's weight changes, so rows
    move into the new shard and nowhere else."""
    number = 1 + max((s.number for s in tree), default=-1)
    return [*tree, Shard(number, f"region-of-{number}", "rack0", weight)]


def _children(tree: list[Shard]) -> dict[str, dict[str, float]]:
    """Weight of each child of each node; a node's weight is that of the shards below it."""
    out: dict[str, dict[str, float]] = {}
    for s in tree:
        if s.weight <= 0:
            continue
        path = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}"]
        for above, node in zip(path, path[1:], strict=False):
            weights = out.setdefault(above, {})
            weights[node] = weights.get(node, 0.0) + s.weight
    return out


def _winner(key: Column, weights: dict[str, float]) -> Column:
    draws = []
    for node, weight in weights.items():
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        draws.append(F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(node).alias("node")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["node"]


def _descend(key: Column, node: Column, children: dict[str, dict[str, float]], level: list[str]) -> Column:
    """The winning child of ``node``, one of ``level``; only that node's children draw."""
    out = F.when(node == level[0], _winner(key, children[level[0]]))
    for name in level[1:]:
        out = out.when(node == name, _winner(key, children[name]))
    return out


def place(df: DataFrame, key: Column, tree: list[Shard], name: str) -> DataFrame:
    """``df`` with the row's shard number in column ``name``."""
    children = _children(tree)
    regions = list(children[""])
    racks = [r for region in regions for r in children[region]]
    return (
        df.withColumn("__region", _winner(key, children[""]))
        .withColumn("__rack", _descend(key, F.col("__region"), children, regions))
        .withColumn(name, F.element_at(F.split(_descend(key, F.col("__rack"), children, racks), "/"), -1).cast("int"))
        .drop("__region", "__rack"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: list[Shard] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    The key (any id, null too) and the tree decide, so rows with one id share a shard. ``size`` is
    the text's bytes plus 8; a null text has no bytes, its crc32 is 0. Slots count 0, 1, 2 ... in
    each shard by (group, id, crc32); groups are hashed from id, crc32 and size, so that rows that share
    an id alone (null, too) spread; rows repeated whole take neighbouring slots. No rows in,
    no rows out.

    A shard is numbered in hashed groups of bounded size, each shifted by the sizes of the groups
    before it, so that no task sorts a whole shard.
    """
    tree = tree or spread(24)
    key, text = F.col(id_col), F.col(text_col)
    rows = docs.select(
        key.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = place(rows, F.col("doc_id"), tree, "shard")
    rows = staged(place(rows, F.col("doc_id"), grown(tree), "grown_shard"), "shards")
    groups = max(LEAST_GROUPS, math.ceil(rows.count() / len(tree) / GROUP))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("slot")), F.lit(groups)))
    along = W.partitionBy("shard").orderBy("group").rowsBetween(W.unboundedPreceding, -1)  # one row per group
    starts = (
        rows.groupBy("shard", "group").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n"))
    inside = W.partitionBy("shard", "group").orderBy("doc_id", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(inside)).join(starts, ["shard", "group"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("place") - 1).alias("slot"), "grown_shard"))
