"""Near dedup by exact similarity: texts link if their sets of word runs have a Jaccard similarity of ``SHARE`` or more.

Fingerprints only propose pairs; every pair is verified on the sets themselves. Texts of equal sets
are one node. A linked pair's set sizes differ by a quarter at most, so tiles are dealt by size and
only neighbouring sizes meet.

1. Each pair of tiles tells which nodes have a partner within the radii: never the pairs, whose number
   grows with the square of a group of texts that look alike.
2. The sets of those nodes alone are made again and brought together, cell by cell of a tile pair. The
   task finds the pairs anew and verifies each whose nodes are not connected yet; it hands on a
   spanning forest of the links, no more rows than nodes.

No pair links without its exact similarity. Pairs are lost only if their fingerprints differ in more
than ``FIRST`` of the first 64 or ``WIDE`` of all 256 bits: at similarity 0.8 some 39 bits are
expected to differ, give or take 6 (at most 48 for the smallest sets that can differ, of four and
five runs).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.base import pieces, staged, width
from modspark.llm.graph import components
from modspark.llm.simhash import AT_ONCE, SEED, TILE, drop_odd, shingles, word_bits

#: Least similarity, as a fraction of whole numbers.
SHARE = (4, 5)
#: Words of a fingerprint; bits that may differ in the first word, in all, and in all for sets under SMALL runs.
WORDS, FIRST, WIDE, WIDE_SMALL, SMALL = 4, 24, 60, 72, 16
#: Nodes of either side that are verified together, and bytes of run hashes that a tile's nodes may have.
CELL, TILE_BYTES = 2048, 64_000_000
#: Sizes within this ratio share a class: a little over 5/4, so that linked sizes are one class apart at most.
RATIO = 1.26


def run_hashes(text: bytes | None, words: int) -> np.ndarray:
    """Sorted hashes of the different word runs of a text."""
    found = b"".join([xxhash.xxh64_digest(r, SEED) for r in set(shingles(text, words))])
    return np.sort(np.frombuffer(found, ">u8").astype(np.uint64))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, digest (of the text), key (digest of the set), size (of the set), fp, rest; written once."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = [run_hashes(t, words) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            made = word_bits(np.concatenate(sets), sizes, WORDS)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("digest"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array(sizes), pa.array(made[:, 0].astype(np.int64)), pa.array([r.tobytes() for r in np.ascontiguousarray(made[:, 1:])], pa.binary())],
                names=["doc_id", "digest", "key", "size", "fp", "rest"])

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("binary").alias("text"))
    return staged(rows.mapInArrow(step, "doc_id bigint, digest bigint, key binary, size bigint, fp bigint, rest binary"), "near")


def _tile(row: dict, side: str) -> tuple[np.ndarray, ...]:
    """fp, rest, size, node of a tile, by size."""
    whole = [row[f"{c}_{side}"].values.to_numpy(zero_copy_only=False) for c in ("fp", "size", "node")]
    rest = np.frombuffer(b"".join(row[f"rest_{side}"].values.to_pylist()), np.uint64).reshape(len(whole[0]), -1)
    order = np.argsort(whole[1], kind="stable")
    return whole[0].astype(np.uint64)[order], rest[order], *[w[order] for w in whole[1:]]


def _pairs(a: tuple, b: tuple, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in the tiles of pairs within the radii whose sizes allow a link."""
    (fa, ra, sa), (fb, rb, sb) = a[:3], b[:3]
    strip = max(1, AT_ONCE // max(1, len(fb)))
    for i in range(0, len(fa), strip):
        size = sa[i:i + strip]
        low = int(np.searchsorted(sb * SHARE[1], size[0] * SHARE[0], "left"))
        high = int(np.searchsorted(sb * SHARE[0], size[-1] * SHARE[1], "right"))
        low = max(low, i) if same else low
        if low >= high:
            continue
        x, y = np.nonzero(np.bitwise_count(fa[i:i + strip, None] ^ fb[None, low:high]) <= FIRST)
        x, y = x + i, y + low
        small, large = np.minimum(sa[x], sb[y]), np.maximum(sa[x], sb[y])
        may = (small * SHARE[1] >= large * SHARE[0]) & (x < y if same else True)
        x, y, small = x[may], y[may], small[may]
        bits = np.bitwise_count(fa[x] ^ fb[y]) + np.bitwise_count(ra[x] ^ rb[y]).sum(axis=1, dtype=np.int64)
        may = bits <= np.where(small < SMALL, WIDE_SMALL, WIDE)
        if may.any():
            yield x[may], y[may]


def propose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell (CELL by CELL nodes of a tile pair) the nodes that have a partner within the radii in it."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            same, a, b = row["same"].as_py(), _tile(row, "a"), _tile(row, "b")
            wide = -(-len(b[0]) // CELL)
            found: dict[int, list[set]] = {}
            for x, y in _pairs(a, b, same):
                cell = x // CELL * wide + y // CELL
                for c in np.unique(cell):
                    sides = found.setdefault(int(c), [set(), set()])
                    sides[0].update(np.unique(x[cell == c]).tolist())
                    sides[1].update(np.unique(y[cell == c]).tolist())
            for c, sides in found.items():
                for left, tile, at in ((True, a, sides[0]), (False, b, sides[1])):
                    node = tile[3][sorted(at)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{row['pair'].as_py()}/{c}"] * len(node)), pa.array([left] * len(node)), pa.array(node)], names=["cell", "left", "node"])


def proposed(nodes: DataFrame, tile: int) -> DataFrame:
    """cell, left, node: the ``nodes`` (node, size, fp, rest) that must be verified, side by side."""
    # Sets of up to three runs are equal or less alike than SHARE.
    held = nodes.filter(F.col("size") >= SHARE[0]).withColumn("kind", F.floor(F.log("size") / math.log(RATIO)).cast("bigint"))
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("size") * 8 / TILE_BYTES))
    sizes = staged(held.groupBy("kind").agg(chunks.alias("chunks")), "near-sizes")
    names = ("fp", "rest", "size", "node")
    tiles = staged(
        held.join(sizes, "kind").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
        .groupBy("kind", "chunk").agg(*[F.collect_list(c).alias(c) for c in names]), "near-tiles")
    left = (
        tiles.select(F.col("chunk").alias("chunk_a"), *[F.col(c).alias(f"{c}_a") for c in names], "kind", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
        .withColumn("kind", F.col("kind") + F.col("step")).join(sizes, "kind")
        .withColumn("chunk_b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .filter((F.col("step") != 0) | (F.col("chunk_a") <= F.col("chunk_b"))))
    right = tiles.select("kind", F.col("chunk").alias("chunk_b"), *[F.col(c).alias(f"{c}_b") for c in names])
    parts, on = width(nodes.sparkSession), ["kind", "chunk_b"]
    pairs = (
        left.repartition(parts, *on).join(right.repartition(parts, *on), on)
        .select(F.concat_ws("/", "kind", "step", "chunk_a", "chunk_b").alias("pair"),
                ((F.col("step") == 0) & (F.col("chunk_a") == F.col("chunk_b"))).alias("same"), *[f"{c}_{s}" for s in "ab" for c in names]))
    return staged(pairs.mapInArrow(propose, "cell string, left boolean, node bigint"), "near-cells")


class Joined:
    """Which of some nodes are known to be connected."""

    def __init__(self, nodes: int):
        self.up = np.arange(nodes)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up[at]

    def join(self, a: int, b: int) -> None:
        a, b = self.roots(np.array([a, b]))
        self.up[max(a, b)] = min(a, b)


def verify(cell: pa.Table) -> pa.Table:
    """Edges of a spanning forest of the cell's links: pairs within the radii whose sets are alike.

    Each such pair is looked at unless its nodes are connected already. The shared runs of a node
    and all its open partners are counted at once, in a table of the cell's runs.
    """
    is_left = cell.column("left").to_numpy(zero_copy_only=False).astype(bool)
    sides = []
    for side in (cell.filter(pa.array(is_left)), cell.filter(pa.array(~is_left))):
        fp, size, node = (side.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "size", "node"))
        rest = np.frombuffer(b"".join(side.column("rest").to_pylist()), np.uint64).reshape(len(fp), -1)
        runs = [np.frombuffer(r, np.int64) for r in side.column("runs").to_pylist()]
        order = np.lexsort((node, size))
        sides.append((fp.astype(np.uint64)[order], rest[order], size[order], node[order], [runs[i] for i in order]))
    a, b = sides
    nodes, ends = np.unique(np.concatenate([a[3], b[3]]), return_inverse=True)
    own_a, own_b = ends[:len(a[3])], ends[len(a[3]):]
    known, codes = np.unique(np.concatenate([*a[4], *b[4]]), return_inverse=True)
    first_a = np.cumsum(np.r_[0, a[2]])
    first_b = np.cumsum(np.r_[0, b[2]])
    codes_a, codes_b = codes[:first_a[-1]], codes[first_a[-1]:]
    marked, joined, out = np.zeros(len(known), np.int64), Joined(len(nodes)), []
    for x, y in _pairs(a, b, False):
        for i in np.unique(x):
            near = y[x == i]
            near = near[joined.roots(own_b[near]) != joined.roots(own_a[i:i + 1])]
            if not len(near):
                continue
            mine = codes_a[first_a[i]:first_a[i + 1]]
            marked[mine] = 1
            lengths = b[2][near]
            starts = np.cumsum(lengths) - lengths
            both = np.add.reduceat(marked[codes_b[np.repeat(first_b[near] - starts, lengths) + np.arange(lengths.sum())]], starts)
            marked[mine] = 0
            for j in near[both * SHARE[1] >= (a[2][i] + lengths - both) * SHARE[0]]:
                p, q = own_a[i], own_b[j]
                if len(np.unique(joined.roots(np.array([p, q])))) == 2:
                    joined.join(p, q)
                    out.append((nodes[p], nodes[q]))
    return pa.table({"a": pa.array([e[0] for e in out], pa.int64()), "b": pa.array([e[1] for e in out], pa.int64())})


def links(nodes: DataFrame, docs: DataFrame, text_col: str, words: int, tile: int) -> DataFrame:
    """a, b: edges that connect the ``nodes`` whose sets are alike; sets are made again, of the proposed nodes alone."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = [run_hashes(t, words).astype(np.int64).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "runs"])

    cells = proposed(nodes, tile)
    wanted = nodes.join(cells.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.xxhash64(text_col).alias("__digest"), F.col(text_col).cast("binary").alias("text")).join(
        wanted.select("node", F.col("best.digest").alias("__digest")), "__digest")
    sets = staged(texts.select("node", "text").mapInArrow(step, "node bigint, runs binary").groupBy("node").agg(F.first("runs").alias("runs")), "near-sets")
    held = cells.join(wanted.select("node", "fp", "rest", "size").join(sets, "node"), "node")
    return staged(held.groupBy("cell").applyInArrow(verify, "a bigint, b bigint"), "near-links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, tile: int = TILE) -> DataFrame:
    """doc_id, component_id, digest, stays: one row per row of ``docs``.

    ``component_id`` is the smallest id that links lead to. Null, empty and blank texts have no
    runs and are alike; a text of fewer than ``words`` words is one run. Null ids are the last in
    order: a group of null ids only has a null component. ``stays`` marks the group's row of
    smallest (id, digest); rows equal in both have it alike. No rows in, none out.
    """
    kind = docs.schema[id_col].dataType
    made = fingerprints(docs, id_col, text_col, words)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
    nodes = staged(
        made.groupBy("key").agg(best, *[F.first(c).alias(c) for c in ("size", "fp", "rest")]).withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    found = components(links(nodes, docs, text_col, words, tile))
    grouped = staged(nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
    groups = grouped.groupBy("root").agg(F.min("best").alias("first"))
    return (
        made.join(grouped.join(groups, "root").select("key", "first"), "key")
        .select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("first.doc_id").cast(kind).alias("component_id"), "digest",
                (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("stays")))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row of each group, all their columns kept."""
    return drop_odd(docs, near_dedup(docs, id_col, text_col, **options), id_col, text_col)
