"""After so many failures within a span, attempts are turned away unrecorded.

What is decided about an attempt depends on all decisions before it. Attempts are range-partitioned
by user, time and id, so a busy user's run lies in many parts, and each part is worked off as if
nothing came before it. Where a run goes on from the part before, the failures that part leaves may
tell that this was wrong: only the run at the head of such a part is worked off again, with what was
left, until no part is told anything new. A success, a pause, or a lock that ends inside a part makes
the guess right from there on, so few rounds do; a run of nothing but dense failures needs as many
rounds as it has parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.durable import written
from modspark.functions.times import SECOND

#: Rounds after which what is known of the parts is written, so that plans stay short.
WRITE_EVERY = 4
OUTCOMES = pa.array(["failed", "ok", "locked"])


def outcomes(us: np.ndarray, success: np.ndarray, fails: list[int], limit: int, span: int) -> tuple[np.ndarray, list[int]]:
    """Outcomes (numbers into OUTCOMES) of a user's attempts in order, and the failures left, from those before."""
    out, i = np.zeros(len(us), np.int8), 0
    while i < len(us):
        now = int(us[i])
        live = [t for t in fails if now - t < span]
        # Remaining seconds are cut to whole ones: in the last second the door is open.
        if len(live) >= limit and now <= live[0] + span - SECOND:
            until = i + int(np.searchsorted(us[i:], live[0] + span - SECOND, side="right"))
            out[i:until] = 2
            i = until
            continue
        if success[i]:
            out[i], fails = 1, []
        else:
            fails = [*live, now]
        i += 1
    return out, fails


def _fold(user: str, limit: int, span: int):
    """Works off rows (part, user, us, success, entry, …) in order of part, user and time.

    Adds outcome, n (place in the part), head (whether the run that opens the part still goes on) and,
    on the last row of a part in a batch, exit (the failures left).
    """

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = who = last = None
        head, n, fails = False, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, us = batch.column("part").to_numpy(), batch.column("us").to_numpy()
            users, success = batch.column(user).to_pylist(), batch.column("success").to_numpy(zero_copy_only=False)
            same = np.fromiter((a == b for a, b in zip(users[1:], users[:-1], strict=True)), bool, len(users) - 1)
            begins = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | ~same])
            codes, heads, places = np.zeros(len(us), np.int8), np.zeros(len(us), bool), np.zeros(len(us), np.int64)
            exits: list[list[int] | None] = [None] * len(us)
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(us)], strict=True):
                if parts[a] != part:
                    head, n, fails, last = True, 0, batch.column("entry")[a].as_py() or [], None
                elif users[a] != who:
                    head, fails, last = False, [], None
                part, who = parts[a], users[a]
                pauses = np.diff(us[a:b], prepend=us[a] if last is None else last) >= span
                heads[a:b] = head & ~np.logical_or.accumulate(pauses)
                head, last = bool(heads[b - 1]), us[b - 1]
                codes[a:b], fails = outcomes(us[a:b], success[a:b], fails, limit, span)
                places[a:b] = np.arange(n, n + b - a)
                n += b - a
                if b == len(us) or parts[b] != part:
                    exits[b - 1] = fails
            kept = [batch.column(c) for c in batch.schema.names if c not in ("entry", "success")]
            names = [c for c in batch.schema.names if c not in ("entry", "success")]
            yield pa.RecordBatch.from_arrays(
                [*kept, batch.column("success"), OUTCOMES.take(pa.array(codes)), pa.array(places), pa.array(heads), pa.array(exits, pa.list_(pa.int64()))],
                names=[*names, "success", "outcome", "n", "head", "exit"])

    return step


def lockout(df: DataFrame, user: str, order: str, success: str, limit: int = 5, span: int = 900 * SECOND, parts: int | None = None) -> DataFrame:
    """Adds ``outcome``: ok, failed or locked, to ``df`` (with its time ``us`` in microseconds).

    After ``limit`` failures within ``span`` every attempt is turned away unrecorded
    until the oldest is ``span`` old; a success clears the record. A null user is a user; an attempt
    without a time has no outcome and counts for nothing; a null success is a failure.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nothing = F.array().cast("array<bigint>")
    attempts = df.where(F.col("us").isNotNull()).select(
        F.col(user).alias("user"), F.col(order).alias("id"), "us", F.coalesce(F.col(success), F.lit(False)).alias("success"))
    shape = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("user", kinds[user]), T.StructField("id", kinds[order]), T.StructField("us", T.LongType()),
        T.StructField("success", T.BooleanType()), T.StructField("outcome", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("head", T.BooleanType()), T.StructField("exit", T.ArrayType(T.LongType()))])
    fold = _fold("user", limit, span)
    laid = attempts.repartitionByRange(parts, "user", "us", "id").sortWithinPartitions("user", "us", "id").select(
        F.spark_partition_id().cast("bigint").alias("part"), "user", "id", "us", "success", nothing.alias("entry"))
    first = written(laid.mapInArrow(fold, shape), "lockout-first")

    # One row per part from here to the loop's end, but for the rows that are worked off again.
    place = F.struct("user", "us")
    ends = written(first.groupBy("part").agg(
        F.min_by(place, "n").alias("opens"), F.max_by(place, "n").alias("closes"),
        F.max_by("exit", F.when(F.col("exit").isNotNull(), F.col("n"))).alias("exit"), F.bool_and("head").alias("whole")), "lockout-ends")
    line = W.orderBy("part")
    links = (
        ends.select("part", "opens", F.lag("part").over(line).alias("before"), F.lag("closes").over(line).alias("left"))
        .where(F.col("before").isNotNull() & F.col("opens.user").eqNullSafe(F.col("left.user")) & (F.col("opens.us") - F.col("left.us") < span))
        .select("part", "before", F.col("opens.us").alias("opens_us")))
    exits, whole = ends.select("part", "exit"), ends.where("whole").select("part")
    told = df.sparkSession.createDataFrame([], "part bigint, entry array<bigint>, round int")
    heads, rounds = first.where("head"), [first.withColumn("round", F.lit(0))]
    while True:
        entry = F.filter("exit", lambda t: F.col("opens_us") - t < span)
        due = links.join(exits.withColumnRenamed("part", "before"), "before").select("part", entry.alias("entry"))
        known = told.select("part", F.col("entry").alias("known"))
        wrong = written(due.join(known, "part", "left").where(F.col("entry") != F.coalesce("known", nothing)).select("part", "entry"), "lockout-wrong")
        if wrong.isEmpty():
            break
        again = heads.select("part", "user", "id", "us", "success", "n").join(wrong, "part").repartition(parts, "part").sortWithinPartitions("part", "n").drop("n")
        redone = written(again.mapInArrow(fold, shape), "lockout-again")
        left = redone.where(F.col("exit").isNotNull()).join(whole, "part").groupBy("part").agg(F.max_by("exit", "n").alias("new"))
        exits = exits.join(left, "part", "left").select("part", F.coalesce("new", "exit").alias("exit"))
        told = told.join(wrong, "part", "left_anti").unionByName(wrong.withColumn("round", F.lit(len(rounds))))
        if not len(rounds) % WRITE_EVERY:
            exits, told = written(exits, "lockout-exits"), written(told, "lockout-told")
        rounds.append(redone.withColumn("round", F.lit(len(rounds))))
    every = rounds[0]
    for redone in rounds[1:]:
        every = every.unionByName(redone)
    valid = F.when(F.col("head"), F.coalesce("told_in", F.lit(0))).otherwise(0)
    decided = every.join(told.select("part", F.col("round").alias("told_in")), "part", "left").where(F.col("round") == valid).select(
        F.col("id").alias("__id"), "outcome")
    return df.join(decided, F.col(order) == F.col("__id"), "left").drop("__id")
