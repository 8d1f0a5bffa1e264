"""Prefix trie of conversations by the Euler-tour technique.

1. Turns are numbered, conversations rebuilt, and every prefix is named by its depth and the sum of
   hashes of (place, role, text): a running sum, so that no task holds a whole conversation. Prefixes
   with equal names are one node, known by its smallest member and its depth.
2. Every node has an arc that enters it and one that leaves it. Parents and children are sorted
   together (a parent before its children, children by smallest member), from which each arc's
   successor on the tour is read off.
3. The tour is ranked: arcs that follow one another along a path are joined in tasks, the rest
   by pointer jumping over the cluster, whose rounds grow with the logarithm of the number of paths.
4. Sorted by rank, leaves and savings of a subtree are what their running sums gain between a node's two arcs.

No step groups by a key without bound: parents of many children, long conversations and nodes with
many members are spread over partitions and carried on between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.base import staged, width
from modspark.llm.ordered import numbers, ordered, running

#: Conversations of a family share the beginning of its first; turns shared are fewer than MOST.
FAMILY, MOST = 5, 9
#: A prefix's name: LANES sums of BITS bits each.
LANES, BITS = 3, 42
#: Arcs of a path that are joined in one task, arcs joined at once, and bytes of ids hashed together.
STRETCH, CHUNK, PIECE = 8192, 200_000, 1 << 16
LANE = [f"l{i}" for i in range(LANES)]
NAME = ["depth", *LANE]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turn_lanes(digests: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Hashes of turns (n, 2) at their places, below 2**BITS."""
    at = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [
        (_mixed(digests[:, 0] ^ _mixed(digests[:, 1] + at + np.uint64(0xD1B54A32D192ED03 * (i + 1) % 2**64))) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        for i in range(LANES)]


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
            lanes = turn_lanes(digests, numbers(batch.column("depth")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("depth"), batch.column("bytes"), *map(pa.array, lanes)],
                names=["conv", "depth", "bytes", *[f"t{i}" for i in range(LANES)]])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv) and their rebuilt turns (conv, depth, bytes, lanes and those of the prefix before)."""
    one = F.lit(1).cast("bigint")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"), one.alias("one"))
    numbered = staged(running(ordered(rows, "conv", "turn", "digest"), {"place": "one"}, "conv").select("conv", "place", "digest", "bytes", "one"), "trie-turns")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % MOST
    convs = staged(numbered.filter("place = 1").select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("first"), taken.alias("taken")), "trie-convs")
    heads = numbered.filter(F.col("place") < MOST).withColumnRenamed("conv", "first").join(convs, "first").filter("place <= taken")
    columns = ("conv", "part", "place", "digest", "bytes", "one")
    both = heads.withColumn("part", F.lit(0)).select(*columns).unionByName(
        numbered.filter(F.col("place") > taken).withColumn("part", F.lit(1)).select(*columns))
    counted = running(ordered(both, "conv", "part", "place"), {"depth": "one"}, "conv").select("conv", "depth", "digest", "bytes")
    turn = [f"t{i}" for i in range(LANES)]
    hashed = counted.mapInArrow(_hashed, "conv bigint, depth bigint, bytes bigint, " + ", ".join(f"{t} bigint" for t in turn))
    summed = running(hashed, dict(zip(LANE, turn, strict=True)), "conv", BITS)
    before = [(F.col(lane) - F.col(t)).bitwiseAND(F.lit((1 << BITS) - 1)).alias(f"p{i}") for i, (lane, t) in enumerate(zip(LANE, turn, strict=True))]
    return convs.select("conv"), staged(summed.select("conv", "depth", "bytes", *LANE, *before), "trie-prefixes")


def nodes_of(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """One row per prefix: its name, the name before it, conv (smallest member), n, bytes (of the last text)."""
    before = [f"p{i}" for i in range(LANES)]
    made = prefixes.groupBy(*NAME).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("bytes", *before)])
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        *[zero.alias(c) for c in (*NAME, "bytes", *before)], "conv", "n")
    return staged(made.unionByName(root), "trie-nodes")


_ARCS = "conv bigint, at bigint, next_conv bigint, next_at bigint, leaf bigint, n bigint, saved bigint, parent bigint"


def arcs_of(nodes: DataFrame) -> DataFrame:
    """The tour's arcs: (conv, at) is followed by (next_conv, next_at); at is twice the depth, plus one when leaving."""
    parents = nodes.select(*NAME, F.lit(0).alias("kind"), "conv", "n", (F.col("bytes") * (F.col("n") - 1)).alias("saved"))
    none = F.lit(0).cast("bigint")
    children = nodes.filter("depth > 0").select(
        (F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(lane) for i, lane in enumerate(LANE)], F.lit(1).alias("kind"), "conv",
        none.alias("n"), none.alias("saved"))
    rows, names = ordered(parents.unionByName(children), *NAME, "kind", "conv"), [*NAME, "kind", "conv", "n", "saved"]

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parent = None, None
        for batch in batches:
            if batch.num_rows:
                first = [batch.column(c)[0].as_py() for c in names] if first is None else first
                at = np.flatnonzero(numbers(batch.column("kind")) == 0)
                parent = batch.column("conv")[int(at[-1])].as_py() if len(at) else parent
        if first is not None:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "first": pa.array([first], pa.list_(pa.int64())),
                "parent": pa.array([parent], pa.int64())})

    found = sorted(rows.mapInArrow(bounds, "part bigint, first array<bigint>, parent bigint").collect())
    after, last = {}, {}
    for (part, *_), (_, first, _) in zip(found, found[1:], strict=False):
        after[part] = first
    parent = None
    for part, _, own in found:
        last[part] = parent
        parent = own if own is not None else parent

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        parent, held = last.get(part), None
        for batch in _with_end(batches):
            if batch is None:
                rest = after.get(part)
                new = {c: np.array([rest[i]] if rest else [], np.int64) for i, c in enumerate(names)}
            else:
                new = {c: numbers(batch.column(c)).astype(np.int64) for c in names}
            cols = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
            done = len(cols["conv"]) - 1 + (batch is None and part not in after)
            if done > 0:
                made, parent = _followed(cols, done, parent)
                yield made
            held = {c: v[-1:] for c, v in cols.items()}

    return rows.mapInArrow(step, _ARCS)


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches with rows, then None if there was one."""
    some = False
    for batch in batches:
        if batch.num_rows:
            some = True
            yield batch
    if some:
        yield None


def _followed(cols: dict[str, np.ndarray], done: int, parent: int | None) -> tuple[pa.RecordBatch, int | None]:
    """Arcs of the first ``done`` records; those behind them only tell what follows."""
    kind, conv, depth = cols["kind"], cols["conv"], cols["depth"]
    kin = np.zeros(done, bool)  # whether a child of the same parent follows
    near = min(done, len(kind) - 1)
    kin[:near] = kind[1:near + 1] == 1
    for c in NAME:
        kin[:near] &= cols[c][1:near + 1] == cols[c][:near]
    follower = np.zeros(done, np.int64)
    follower[:near] = conv[1:near + 1]
    kind, conv, depth = kind[:done], conv[:done], depth[:done]
    seen = np.maximum.accumulate(np.where(kind == 0, np.arange(done), -1))
    above = np.where(seen >= 0, conv[np.maximum(seen, 0)], parent if parent is not None else 0)
    enters = kind == 0
    at = np.where(enters, 2 * depth, 2 * depth + 3)
    next_conv = np.where(kin, follower, above)
    next_at = np.where(kin, 2 * depth + 2, 2 * depth + 1)
    made = [conv, at, next_conv, next_at, (enters & ~kin).astype(np.int64), cols["n"][:done], cols["saved"][:done], above]
    made = [pa.array(x, pa.int64(), mask=enters if i == 7 else None) for i, x in enumerate(made)]
    root = np.flatnonzero(enters & (depth == 0))
    if len(root):  # the tour ends where it leaves the root
        end = [[int(conv[root[0]])], [1], [None], [None], [0], [0], [0], [None]]
        made = [pa.concat_arrays([a, pa.array(b, pa.int64())]) for a, b in zip(made, end, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=[f.split()[0] for f in _ARCS.split(", ")]), int(above[-1])


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole stretches of paths, about CHUNK arcs each."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            whole = pa.Table.from_batches(held)
            conv, stretch = numbers(whole.column("conv")), numbers(whole.column("at")) // STRETCH
            ends = np.flatnonzero((conv[1:] != conv[:-1]) | (stretch[1:] != stretch[:-1]))
            if len(ends):
                cut = int(ends[-1]) + 1
                yield whole.slice(0, cut)
                held = whole.slice(cut).to_batches()
                rows = whole.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each arc's place (off) behind the first arc (head_conv, head_at) of its chain; on first arcs also the chain's length and what follows it."""
    for table in _stretches(batches):
        conv, at = numbers(table.column("conv")), numbers(table.column("at"))
        next_conv, next_at = numbers(table.column("next_conv").fill_null(0)), numbers(table.column("next_at").fill_null(-1))
        known, codes = np.unique(conv, return_inverse=True)
        span = int(max(at.max(), next_at.max())) + 1
        code = codes * span + at
        owner = np.minimum(np.searchsorted(known, next_conv), len(known) - 1)
        wanted = np.where((known[owner] == next_conv) & (next_at >= 0), owner * span + next_at, -1)
        place = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        inside = code[place] == wanted
        n = np.arange(len(code))
        head, off = n.copy(), np.zeros(len(code), np.int64)
        head[place[inside]] = n[inside]
        off[place[inside]] = 1
        while True:
            further = head[head]
            if (further == head).all():
                break
            off = off + off[head]
            head = further
        tails = n[~inside]
        length, follow = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        length[head[tails]] = off[tails] + 1
        follow[head[tails]] = tails
        ends = (length == 0) | (next_at[follow] < 0)
        made = [pa.array(conv[head]), pa.array(at[head]), pa.array(off), pa.array(length, mask=length == 0),
                pa.array(next_conv[follow], mask=ends), pa.array(next_at[follow], mask=ends)]
        names = ["head_conv", "head_at", "off", "length", "next_conv", "next_at"]
        kept = table.drop_columns(["next_conv", "next_at"]).combine_chunks()
        out = pa.Table.from_arrays([*kept.columns, *made], names=[*kept.schema.names, *names])
        yield from out.to_batches()


def ranked(arcs: DataFrame) -> DataFrame:
    """``arcs`` with ``position``, from 0, on the tour."""
    parts = width(arcs.sparkSession)
    near = arcs.repartition(parts, "conv", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("conv", "at")
    chains = staged(near.mapInArrow(
        _joined, "conv bigint, at bigint, leaf bigint, n bigint, saved bigint, parent bigint, "
                 "head_conv bigint, head_at bigint, off bigint, length bigint, next_conv bigint, next_at bigint"), "trie-arcs")
    total = chains.count()
    now = chains.filter("length is not null").select("conv", "at", "next_conv", "next_at", F.col("length").alias("rest"))
    while not (going := now.filter("next_at is not null")).isEmpty():
        then = now.select(F.col("conv").alias("next_conv"), F.col("at").alias("next_at"), F.col("next_conv").alias("c"), F.col("next_at").alias("a"), F.col("rest").alias("r"))
        jumped = going.join(then, ["next_conv", "next_at"]).select(
            "conv", "at", F.col("c").alias("next_conv"), F.col("a").alias("next_at"), (F.col("rest") + F.col("r")).alias("rest"))
        now = staged(jumped.unionByName(now.filter("next_at is null")), "trie-jumps")
    rest = now.select(F.col("conv").alias("head_conv"), F.col("at").alias("head_at"), "rest")
    return chains.join(rest, ["head_conv", "head_at"]).select(
        "conv", "at", "leaf", "n", "saved", "parent", (F.lit(total) - F.col("rest") + F.col("off")).alias("position"))


_ENDS = ", ".join(f"{c} bigint" for c in NAME)


def ends_of(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a prefix; ids are joined piece by piece where
    they lie, so that the task that hashes a node meets few rows, however many members it has."""
    last = prefixes.groupBy("conv").agg(F.max(F.struct(*NAME)).alias("last"))
    zero = F.lit(0).cast("bigint")
    rows = convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col(f"last.{c}"), zero).alias(c) for c in NAME])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, ids, size, at = TaskContext.get().partitionId(), None, [], 0, 0
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                **{c: pa.array([r[0][i] for r in rows], pa.int64()) for i, c in enumerate(NAME)},
                "part": pa.array([part] * len(rows), pa.int64()), "piece": pa.array([r[1] for r in rows], pa.int64()), "ids": pa.array([r[2] for r in rows])})

        for batch in batches:
            for *own, conv in zip(*[batch.column(c).to_pylist() for c in (*NAME, "conv")], strict=True):
                if own != name or size > PIECE:
                    if ids:
                        out.append((name, at, ",".join(ids)))
                        at += 1
                    name, ids, size = own, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield batch_of(out)
                out = []
        if ids:
            yield batch_of([(name, at, ",".join(ids))])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, out = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                **{c: pa.array([r[0][i] for r in rows], pa.int64()) for i, c in enumerate(NAME)}, "ends_sha256": pa.array([r[1] for r in rows])})

        for batch in batches:
            for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*NAME, "ids")], strict=True):
                if own != name:
                    if state:
                        out.append((name, state.hexdigest()))
                    name, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield batch_of(out)
                out = []
        if state:
            yield batch_of([(name, state.hexdigest())])

    found = ordered(rows, *NAME, "conv").mapInArrow(joined, _ENDS + ", part bigint, piece bigint, ids string")
    return (found.repartition(width(convs.sparkSession), *NAME).sortWithinPartitions(*NAME, "part", "piece")
            .mapInArrow(digests, _ENDS + ", ends_sha256 string"))


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of ``turns`` (conv_id, turn, role, text): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation. Null roles and texts count as empty; null
    turns come first, equal turns by a digest of role and text (rows equal in all stay repeated
    turns). Other columns are not read. Without conversations there is no root and no row.
    """
    convs, prefixes = rebuilt(turns)
    nodes = nodes_of(convs, prefixes)
    tour = staged(running(ordered(ranked(arcs_of(nodes)), "position"), {"leaves": "leaf", "savings": "saved"}), "trie-tour")
    leaving, depth = F.col("at") % 2 == 1, F.floor(F.col("at") / 2).cast("bigint")
    gain = lambda total, own: F.max(F.when(leaving, F.col(total))) - F.max(F.when(~leaving, F.col(total) - F.col(own)))
    whole = tour.groupBy("conv", depth.alias("depth")).agg(
        F.max("parent").alias("parent_conv_id"), F.max(F.when(~leaving, F.col("n"))).alias("n_convs"),
        gain("leaves", "leaf").alias("n_leaves"), gain("savings", "saved").alias("saved_tokens"))
    children = tour.filter("parent is not null").groupBy(F.col("parent").alias("conv"), (depth - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = nodes.select("conv", *NAME).join(ends_of(convs, prefixes), NAME).select("conv", "depth", "ends_sha256")
    return (
        whole.join(children, ["conv", "depth"], "left").join(ends, ["conv", "depth"], "left")
        .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
                "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
