"""A row is accepted when enough time has passed since the last accepted one.

The rule depends on all earlier decisions, yet a slice of time maps "when was a row last accepted
before me" to "when is one last accepted in me" through a small step table. Tables of neighbouring
slices are composed, ``fan`` at a time, in rounds of a tree (a parallel prefix scan), and what comes
before each slice is handed down the same tree. So no task meets more than ``fan`` tables of a key,
however many rows the key has, and every slice is then decided on its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.durable import written
from modspark.functions.bind import once
from modspark.functions.times import SECOND

#: Step tables that are composed in one group, and moments that are worked on at once.
FAN, AT_ONCE = 512, 100_000
STEPS = "array<struct<reach:bigint,exit:bigint>>"


def _whole_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole slices (rows of one slice follow one another)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= AT_ONCE:
            whole = pa.Table.from_batches(held)
            changes = np.flatnonzero(_new(whole))
            cut = int(changes[-1])
            if cut:
                yield whole.slice(0, cut)
                held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _new(table: pa.Table) -> np.ndarray:
    """Whether a row begins a slice."""
    mark, piece = (table.column(c).to_numpy() for c in ("mark", "slice"))
    return np.r_[True, (mark[1:] != mark[:-1]) | (piece[1:] != piece[:-1])]


class Slices:
    """The moments of some slices, in order, and the first moment that each leaves free."""

    def __init__(self, table: pa.Table, wait: int, gap: int, width: int):
        self.us = table.column("us").to_numpy()
        self.starts = np.flatnonzero(_new(table))
        self.owner = np.cumsum(_new(table)) - 1
        self.since = self.us - self.us[self.starts][self.owner]
        self.wait, self.gap, self.span = wait, gap, width + gap + 1
        self.line = self.owner * self.span + self.since
        self.following = self.at_or_after(self.owner, self.since + gap)

    def at_or_after(self, owner: np.ndarray, since: np.ndarray) -> np.ndarray:
        """The first moment of a slice so long after its first one; -1 if there is none."""
        at = np.searchsorted(self.line, owner * self.span + since)
        inside = (at < len(self.us)) & (self.owner[np.minimum(at, len(self.us) - 1)] == owner)
        return np.where(inside, at, -1)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Moments at which a chain may enter (within one wait of the first, or the one after), and where it leaves."""
        n = np.arange(len(self.us))
        final = np.where(self.following < 0, n, self.following)
        while (final[final] != final).any():
            final = final[final]
        begins = np.r_[True, self.owner[1:] != self.owner[:-1]]
        at = np.flatnonzero(begins | np.r_[False, self.since[:-1] < self.wait])
        leave = final[at]
        last = np.r_[(self.owner[at][1:] != self.owner[at][:-1]) | (leave[1:] != leave[:-1]), True]
        return at[last], leave[last]

    def decide(self, before: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per moment whether it is accepted, and the last time accepted before it (and where there is none)."""
        taken, n = np.zeros(len(self.us), bool), len(self.us)
        first = self.starts
        least = np.where(missing[first], 0, np.maximum(before[first] + self.gap - self.us[first], 0))
        at = self.at_or_after(np.arange(len(first)), least)
        while len(at := at[at >= 0]):
            taken[at] = True
            at = self.following[at]
        seen = np.r_[-1, np.maximum.accumulate(np.where(taken, np.arange(n), -1))[:-1]] if n else np.empty(0, np.int64)
        own = seen >= first[self.owner]
        return taken, np.where(own, self.us[np.maximum(seen, 0)], before), missing & ~own


def _leave(steps: Column, last: Column, gap: int) -> Column:
    """The last time accepted once a slice of these steps is over."""
    entry = F.get(F.filter(steps, lambda s: last.isNull() | (s["reach"] >= last + gap)), F.lit(0))
    return F.coalesce(entry["exit"], last)


def _composed(first: Column, then: Column, gap: int) -> Column:
    """The steps of a slice followed by another. Where the first has no entry, a chain passes it by
    and enters the second, unless none can come so late."""
    closes, opens = F.element_at(first, -1)["reach"], F.get(first, F.lit(0))["reach"]
    late = F.when((F.size(first) == 0) | (closes < opens + gap), then).otherwise(F.array().cast(STEPS))
    moved = F.transform(first, lambda s: F.struct(s["reach"].alias("reach"), _leave(then, s["exit"], gap).alias("exit")))
    return once(F.concat(moved, late), lambda all_: F.filter(
        all_, lambda s, i: F.coalesce(F.get(all_, i + 1)["exit"] != s["exit"], F.lit(True)))).cast(STEPS)


def _all_composed(kids: Column, gap: int) -> Column:
    return F.aggregate(kids, F.array().cast(STEPS), lambda acc, kid: F.when(F.size(acc) == 0, kid["steps"]).otherwise(
        once(F.struct(acc.alias("a"), kid["steps"].alias("b")), lambda x: _composed(x["a"], x["b"], gap))))


def _told(kids: Column, before: Column, gap: int) -> Column:
    """For each slice of a group what was accepted last before it."""
    def walk(acc: Column, kid: Column) -> Column:
        told = F.struct(kid["block"].alias("block"), acc["last"].alias("before_us"))
        return F.struct(_leave(kid["steps"], acc["last"], gap).alias("last"), F.concat(acc["out"], F.array(told)).alias("out"))

    start = F.struct(before.alias("last"), F.array().cast("array<struct<block:bigint,before_us:bigint>>").alias("out"))
    return F.aggregate(kids, start, walk, lambda acc: acc["out"])


def _on(left: str, right: str, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def before_slices(steps: DataFrame, keys: list[str], gap: int, fan: int) -> DataFrame:
    """keys, block, before_us for ``steps`` (keys, block, steps): up the tree of groups of ``fan``, and down again."""
    ends = steps.agg(F.min("block"), F.max("block")).first()
    low, reach = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0)
    levels, tables = [], steps.withColumn("block", F.col("block") - F.lit(low))
    while True:
        groups = tables.groupBy(*keys, F.floor(F.col("block") / fan).cast("bigint").alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("block", "steps"))).alias("kids"))
        reach //= fan
        if not reach:
            break
        levels.append(groups := written(groups, "cooldown-groups"))
        tables = groups.select(*keys, F.col("parent").alias("block"), _all_composed(F.col("kids"), gap).alias("steps"))
    before = groups.select(*keys, F.inline(_told(F.col("kids"), F.lit(None).cast("bigint"), gap)))
    for groups in reversed(levels):
        known = groups.alias("g").join(before.withColumnRenamed("block", "parent").alias("b"), _on("g", "b", [*keys, "parent"]))
        before = known.select(*[F.col(f"g.{k}") for k in keys], F.inline(_told(F.col("kids"), F.col("before_us"), gap)))
    return before.withColumn("block", F.col("block") + F.lit(low))


def cooldown(df: DataFrame, keys: list[str], order: str, wait: int, closed: bool = True, slice_waits: int = 8, fan: int = FAN) -> DataFrame:
    """Adds accepted and wait_s to ``df`` (with its time ``us`` in microseconds).

    A row is accepted when at least ``wait`` passed since the last accepted row of the key;
    rejected rows do not reset the clock. ``wait_s`` are the seconds left, rounded up by one as
    the reference counts. With ``closed=False`` exactly ``wait`` is still too early (the exact form
    of W6). Of rows of one moment the least by ``order`` may be accepted. Null keys are a key;
    rows without a time are never accepted and have no ``wait_s``.
    """
    gap, width = wait if closed else wait + 1, wait * slice_waits
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    key_fields = [T.StructField(k, kinds[k]) for k in keys]
    big = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    piece = F.floor(F.col("us") / F.lit(width)).cast("bigint")
    points = written(
        df.where(F.col("us").isNotNull()).groupBy(*keys, "us").agg(F.min(order).alias("first_id"))
        .withColumn("slice", piece).withColumn("mark", F.xxhash64(*keys)), "cooldown-points")

    def steps_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_slices(batches):
            slices = Slices(table, wait, gap, width)
            at, leave = slices.entries()
            out = table.select([*keys, "slice"]).take(pa.array(at))
            out = out.append_column("reach", pa.array(slices.us[at])).append_column("exit", pa.array(slices.us[leave]))
            yield from out.combine_chunks().to_batches()

    sorted_points = points.select(*keys, "slice", "mark", "us").repartition(parts, *keys, "slice").sortWithinPartitions(*keys, "slice", "us")
    found = sorted_points.mapInArrow(steps_of, T.StructType([*key_fields, *big("slice", "reach", "exit")]))
    steps = written(found.groupBy(*keys, F.col("slice").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("reach", "exit"))).alias("steps")), "cooldown-steps")

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_slices(batches):
            before = table.column("before_us")
            taken, last, none = Slices(table, wait, gap, width).decide(before.fill_null(0).to_numpy(), before.is_null().to_numpy())
            out = table.select([*keys, "us", "first_id"]).append_column("taken", pa.array(taken)).append_column("last_us", pa.array(last, mask=none))
            yield from out.combine_chunks().to_batches()

    before = before_slices(steps, keys, gap, fan)
    known = points.alias("p").join(before.withColumnRenamed("block", "slice").alias("b"), _on("p", "b", [*keys, "slice"])).select(
        *[F.col(f"p.{c}") for c in (*keys, "slice", "mark", "us", "first_id")], "before_us")
    told = known.repartition(parts, *keys, "slice").sortWithinPartitions(*keys, "slice", "us").mapInArrow(
        decide, T.StructType([*key_fields, *big("us"), T.StructField("first_id", kinds[order]), T.StructField("taken", T.BooleanType()), *big("last_us")]))
    told = told.select(*[F.col(c).alias(f"__{c}") for c in (*keys, "us")], "first_id", "taken", "last_us")
    on = F.col("us") == F.col("__us")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    own = F.coalesce(F.col("taken") & (F.col(order) == F.col("first_id")), F.lit(False))
    rest = F.lit(wait) - (F.col("us") - F.when(F.col("taken"), F.col("us")).otherwise(F.col("last_us")))
    joined = df.join(told, on, "left").withColumn("accepted", own).withColumn(
        "wait_s", F.when(~F.col("accepted"), F.floor(rest / F.lit(SECOND)).cast("bigint") + 1))
    return joined.drop("first_id", "taken", "last_us", *[f"__{c}" for c in (*keys, "us")])
