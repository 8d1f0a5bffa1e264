"""SimHash near-dedup by tiled exact comparison.

Fingerprints that differ are put into tiles by their population counts. If two fingerprints differ
in at most ``radius`` bits, so do their population counts, and so does the sum of the differences
between the counts of their quarters; tile pairs for which that sum must be larger never meet. The
others are compared whole, with numpy's exclusive-or and bit counts. Each comparison hands on a
spanning forest of what it has linked (no more edges than fingerprints), never all pairs.

The comparison is exact, hence still quadratic in the number of different fingerprints of alike
counts; see the README for what that means at scale.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.base import pieces, staged, width
from modspark.llm.graph import components

#: Fingerprints that a tile is meant to hold, and comparisons made at once.
TILE, AT_ONCE = 16_384, 1 << 20
#: Parts of the first word whose population counts are told apart.
PARTS = 4
SEED = 42


def shingles(text: bytes | None, words: int) -> list[bytes]:
    """Runs of ``words`` words, A-Z in lower case, repeats included, joined by a space; all the
    words if there are fewer; none if there are none."""
    found = (text or b"").lower().split()
    if len(found) < words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(itertools.islice(found, i, None) for i in range(words)), strict=False)))


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits for each hash (the finisher of splitmix64)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * word) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits set in over half of it; 0 for an empty run.

    Eight bit positions are counted at once in the bytes of a word, over blocks of up to 255.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    blocks = -(-n // 255)
    first = np.cumsum(blocks) - blocks
    inner = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    starts = np.repeat(np.cumsum(n) - n, blocks) + inner * 255
    lanes, held = np.uint64(0x0101010101010101), np.empty((len(starts), 8, 8), np.uint8)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, starts)
        held[:, :, bit] = sums.view(np.uint8).reshape(-1, 8)
    totals = np.add.reduceat(held.reshape(-1, 64).astype(np.int64), first, axis=0)
    set_ = totals * 2 > n[:, None]
    out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def codes(texts: list[bytes | None], words: int, width: int) -> np.ndarray:
    """(texts, width) fingerprint words."""
    digest, found, counts = xxhash.xxh64_digest, [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        runs = shingles(text, words)
        counts[i] = len(runs)
        found.append(b"".join([digest(r, SEED) for r in runs]))
    return word_bits(np.frombuffer(b"".join(found), ">u8").astype(np.uint64), counts, width)


def word_bits(hashes: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """(runs, width) fingerprint words of runs of ``counts`` hashes."""
    return np.stack([majority(_mixed(hashes, w) if w else hashes, counts) for w in range(width)], axis=1)


_CODES = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64()), ("rest", pa.binary())])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, width: int) -> DataFrame:
    """doc_id, digest (of the text), fp (first word), rest (further words), written once."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            made = codes(batch.column("text").to_pylist(), words, width)
            rest = np.ascontiguousarray(made[:, 1:]).tobytes()
            size = 8 * (width - 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("digest"), pa.array(made[:, 0].astype(np.int64)),
                pa.array([rest[i * size:(i + 1) * size] for i in range(len(made))], pa.binary())], schema=_CODES)

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("binary").alias("text"))
    return staged(rows.mapInArrow(step, "doc_id bigint, digest bigint, fp bigint, rest binary"), "simhash")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes, one fewer than the nodes of each component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _tile(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fp = row[f"fp_{side}"].values.to_numpy(zero_copy_only=False).astype(np.uint64)
    rest = b"".join(row[f"rest_{side}"].values.to_pylist())
    return fp, np.frombuffer(rest, np.uint64).reshape(len(fp), -1), row[f"node_{side}"].values.to_numpy(zero_copy_only=False)


def compare(batches: Iterable[pa.RecordBatch], radius: int, wide_radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges between the fingerprints of each pair of tiles."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            same, (fa, ra, na), (fb, rb, nb) = row["same"].as_py(), _tile(row, "a"), _tile(row, "b")
            strip, xs, ys = max(1, AT_ONCE // max(1, len(fb))), [], []
            for i in range(0, len(fa), strip):
                x, y = np.nonzero(np.bitwise_count(fa[i:i + strip, None] ^ fb[None, :]) <= radius)
                x = x + i
                if same:
                    x, y = x[x < y], y[x < y]
                if ra.shape[1] and len(x):
                    bits = np.bitwise_count(fa[x] ^ fb[y]) + np.bitwise_count(ra[x] ^ rb[y]).sum(axis=1, dtype=np.int64)
                    x, y = x[bits <= wide_radius], y[bits <= wide_radius]
                if len(x):
                    a, b = forest(na[x], nb[y])
                    xs.append(a)
                    ys.append(b)
            if xs:
                a, b = forest(np.concatenate(xs), np.concatenate(ys))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _steps(radius: int, span: int) -> list[tuple[int, ...]]:
    """Differences that the classes (``span`` counts each) of a linked pair may have, one of each two opposites."""
    reach = -(-radius // span)
    least = lambda d: sum(max(0, (abs(x) - 1) * span + 1) for x in d)  # noqa: E731  of the counts
    return [d for d in itertools.product(range(-reach, reach + 1), repeat=PARTS) if d >= (0,) * PARTS and least(d) <= radius]


def links(distinct: DataFrame, radius: int, wide_radius: int, tile: int = TILE) -> DataFrame:
    """a, b: edges between nodes of ``distinct`` (node, fp, rest) that connect what is linked."""
    span = 1 if radius <= 2 else radius  # counts that share a class: wide radii reach over most classes anyway
    bits = 64 // PARTS
    # Classes are packed twelve bits each, with room for every step on either side.
    classes = [
        F.floor(F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit((1 << bits) - 1))) / span).cast("bigint") + 64
        for i in range(PARTS)]
    packed = classes[0]
    for i, c in enumerate(classes[1:], 1):
        packed = packed + F.shiftleft(c, 12 * i)
    held = distinct.withColumn("kind", packed)
    sizes = staged(held.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / tile).alias("chunks")), "tile-sizes")
    tiles = staged(
        held.join(sizes, "kind").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
        .groupBy("kind", "chunk").agg(*[F.collect_list(c).alias(c) for c in ("fp", "rest", "node")]), "tiles")
    steps = [sum(d << (12 * i) for i, d in enumerate(s)) for s in _steps(radius, span)]
    left = (
        tiles.select(*[F.col(c).alias(f"{c}_a") for c in ("chunk", "fp", "rest", "node", "kind")], F.explode(F.array(*[F.lit(x).cast("bigint") for x in steps])).alias("step"))
        .withColumn("kind", F.col("kind_a") + F.col("step")).join(sizes, "kind")
        .withColumn("chunk_b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .filter((F.col("step") != 0) | (F.col("chunk_a") <= F.col("chunk_b"))))
    right = tiles.select("kind", *[F.col(c).alias(f"{c}_b") for c in ("chunk", "fp", "rest", "node")])
    # Comparing takes longer than the tiles' bytes tell: a fixed number of tasks, tile by tile of the right side.
    parts, on = width(distinct.sparkSession), ["kind", "chunk_b"]
    pairs = (
        left.repartition(parts, *on).join(right.repartition(parts, *on), on)
        .select(((F.col("step") == 0) & (F.col("chunk_a") == F.col("chunk_b"))).alias("same"), *[f"{c}_{s}" for s in "ab" for c in ("fp", "rest", "node")]))
    return pairs.mapInArrow(lambda batches: compare(batches, radius, wide_radius), "a bigint, b bigint")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2,
               width: int = 1, wide_radius: int = 0, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id, digest, stays: one row per row of ``docs``.

    ``component_id`` is the smallest id that links lead to. Links: the first 64 bits differ in at
    most ``radius`` places and, for fingerprints of ``width`` > 1 words, all bits in at most
    ``wide_radius``. Null and empty texts have fingerprint zero and link like any other. Null ids
    are the last in order: a group of null ids only has a null component. ``stays`` marks the
    group's row of smallest (id, digest); rows equal in both have it alike. No rows in, none out.
    """
    kind = docs.schema[id_col].dataType
    made = fingerprints(docs, id_col, text_col, words, width)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
    distinct = staged(
        made.groupBy("fp", "rest").agg(best).withColumn("node", F.monotonically_increasing_id()), "simhash-distinct")
    found = components(links(distinct.select("node", "fp", "rest"), radius, wide_radius, tile))
    rooted = staged(
        distinct.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "simhash-rooted")
    groups = rooted.groupBy("root").agg(F.min("best").alias("first"))
    classes = rooted.join(groups, "root").select("fp", "rest", "first")
    return (
        made.join(classes, ["fp", "rest"])
        .select(F.col("doc_id").cast(kind).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                F.col("first.doc_id").cast(kind).alias("component_id"), "digest",
                (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("stays")))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row of each group, all their columns kept."""
    return drop_odd(docs, near_dedup(docs, id_col, text_col, **options), id_col, text_col)


def drop_odd(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay by ``found`` (doc_id, digest, stays).

    A row is known by id and digest of its text; rows that share both leave one.
    """
    verdict = found.groupBy("doc_id", "digest").agg(
        F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    odd = staged(verdict.filter(~F.col("stays") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__odd"), F.col("stays").alias("__stays")), "simhash-odd")
    marked = docs.withColumn("__digest", F.xxhash64(text_col))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__odd"))
    clear = marked.join(odd, on, "left_anti").drop("__digest")
    twins = odd.filter("__stays")
    if twins.isEmpty():
        return clear
    return clear.unionByName(marked.join(twins, on, "left_semi").dropDuplicates([id_col, "__digest"]).drop("__digest"))
