"""Embedding near-dedup by cross-polytope hashing.

A vector is turned by fast Hadamard rotations (three rounds of random signs and a Hadamard
transform) and hashed to the axis it then lies nearest to; a bucket is the axes of ``rotations``
such turns. In each of ``tables`` tables a vector lives in its bucket and visits the ``probes``
likeliest ones, nearest axes first. Visitors meet inhabitants in blocks of bounded size; each
candidate pair is verified by its cosine in double precision.

A block hands on counts and a spanning forest, never its pairs. A pair that meets several times is
counted where it meets first (table by table), which both vectors' hashes tell. Equal vectors are
one node with a multiplicity throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.llm.base import staged
from modspark.llm.graph import components
from modspark.llm.simhash import forest

TABLES, ROTATIONS, PROBES, SEED = 4, 2, 8, 7
#: Vectors of a block's side (expected).
BLOCK = 2048
#: Axes of a turn that may be probed.
AXES = 12


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d, half = len(x), x.shape[1], 1
    while half < d:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, tables: int, rotations: int, probes: int, seed: int) -> np.ndarray:
    """(vectors, tables, probes) buckets of unit vectors, each vector's own first."""
    n, d = x.shape
    size = 1 << max(1, d - 1).bit_length()
    x = np.concatenate([x, np.zeros((n, size - d))], axis=1)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        codes, costs = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for r in range(rotations):
            signs, y = np.random.default_rng([seed, t, r, size]).choice([-1.0, 1.0], (3, size)), x
            for s in signs:
                y = _hadamard(y * s)
            axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :AXES]
            high = np.take_along_axis(y, axes, axis=1)
            axes, cost = axes * 2 + (high < 0), (np.abs(high[:, :1]) - np.abs(high)) ** 2
            codes = (codes[:, :, None] * (2 * size) + axes[:, None, :]).reshape(n, -1)
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(n, -1)
            best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
            codes, costs = np.take_along_axis(codes, best, axis=1), np.take_along_axis(costs, best, axis=1)
        out[:, t, :codes.shape[1]] = codes
        out[:, t, codes.shape[1]:] = codes[:, :1]  # fewer buckets than probes: its own again
    return out


def _unit(held: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(held), dtype).reshape(len(held), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(dtype: str, options: tuple):
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = [np.array(v, dtype) for v in batch.column("vec").to_pylist()]
                spots: list = [None] * len(rows)
                for dim in {len(r) for r in rows}:
                    own = [i for i, r in enumerate(rows) if len(r) == dim]
                    for i, b in zip(own, buckets(_unit([rows[i].tobytes() for i in own], dtype), *options), strict=True):
                        spots[i] = b.reshape(-1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("node"), batch.column("n"), pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary()),
                    pa.array(spots, pa.list_(pa.int64()))], names=["node", "n", "dim", "vec", "spots"])

    return step


def _verify(dtype: str, threshold: float, options: tuple):
    tables = options[0]

    def meets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Per pair and table: does x (rows of buckets) visit y's own bucket?"""
        return (x == y[:, :, :1]).any(axis=2)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                table = batch.column("t")[k].as_py()
                at, away = (batch.column(c)[k].values for c in ("at", "away"))
                a, b = (_unit(side.field("vec").to_pylist(), dtype) for side in (away, at))
                ida, idb = (side.field("node").to_numpy(zero_copy_only=False) for side in (away, at))
                na, nb = (side.field("n").to_numpy(zero_copy_only=False) for side in (away, at))
                x, y = np.nonzero(a @ b.T >= threshold)
                apart = ida[x] != idb[y]
                x, y = x[apart], y[apart]
                if not len(x):
                    continue
                first = np.zeros(len(x), bool)
                (va, pi), (vb, qi) = (np.unique(z, return_inverse=True) for z in (x, y))
                ca, cb = buckets(a[va], *options), buckets(b[vb], *options)
                low = (ida[x] < idb[y])[:, None]
                for i in range(0, len(x), 1 << 14):
                    part = slice(i, i + (1 << 14))
                    p, q = ca[pi[part]], cb[qi[part]]
                    out, back = meets(p, q), meets(q, p)
                    # Two encounters a table: the lower node's visit comes before the other's.
                    order = np.stack([np.where(low[part], out, back), np.where(low[part], back, out)], axis=2).reshape(len(p), 2 * tables)
                    first[part] = order.argmax(axis=1) == 2 * table + ~low[part, 0]
                x, y = x[first], y[first]
                if len(x):
                    node = np.concatenate([ida[x], idb[y]])
                    held, place = np.unique(node, return_inverse=True)
                    more = np.bincount(place, weights=np.concatenate([nb[y], na[x]])).astype(np.int64)
                    u, v = forest(ida[x], idb[y])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([held, u])), pa.array(np.concatenate([more, np.zeros(len(u), np.int64)])),
                        pa.concat_arrays([pa.nulls(len(held), pa.int64()), pa.array(v)])], names=["node", "links", "other"])

    return step


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, tables: int = TABLES,
               rotations: int = ROTATIONS, probes: int = PROBES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing;
    vectors of different lengths never link. Rows with equal vectors are linked, rows repeated whole
    too. A component of null ids only has a null component. No rows in, none out.
    """
    element = vectors.schema[vec_col].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(T.ArrayType(element if dtype == "<f4" else T.DoubleType())).alias("vec"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    sound = F.coalesce(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = staged(rows.withColumn("sound", sound), "vectors")
    distinct = staged(
        rows.filter("sound").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("node", F.monotonically_increasing_id()), "vectors-distinct")

    options = (tables, rotations, probes, seed)
    hashed = staged(
        distinct.select("node", "n", "vec").mapInArrow(_hashed(dtype, options), "node bigint, n bigint, dim int, vec binary, spots array<bigint>"), "vectors-hashed")
    spots = hashed.select("dim", "node", "n", "vec", F.posexplode("spots").alias("pos", "spot")).select(
        "dim", F.floor(F.col("pos") / probes).cast("int").alias("t"), "spot", (F.col("pos") % probes == 0).alias("home"), F.struct("node", "n", "vec").alias("held"))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        key = ["dim", "t", "spot"]
        sizes = side.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).alias("chunks"))
        return (
            side.join(sizes, key).withColumn("chunk", F.pmod(F.xxhash64("held.node"), F.col("chunks")))
            .groupBy(*key, "chunk").agg(F.collect_list("held").alias(name)).drop("chunk"))

    met = blocks(spots.filter("home"), "at").join(blocks(spots, "away"), ["dim", "t", "spot"])
    found = staged(
        met.select("t", "at", "away").mapInArrow(_verify(dtype, threshold, options), "node bigint, links bigint, other bigint"), "vectors-links")

    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = staged(
        distinct.join(classes, "node", "left").join(counts, "node", "left")
        .select("vec", "least", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vectors-rooted")
    answers = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("vec", "n_links", "component_id")
    linked = rows.filter("sound").join(answers, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("sound")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
