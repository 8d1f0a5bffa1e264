"""Keyed decisions over a message stream (ST1-ST8).

Each decision keeps a few numbers per key in state and handles the rows of a
micro-batch in (time, id) order.  State expires by a time-to-live.  Message time is
used throughout; the batch operators give the same answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from modspark.durable import run_dir
from modspark.functions.times import SECOND
from modspark.operators import ledger as G
from modspark.operators.admission import HOUR
from modspark.streaming import kept

# What a decision sees: the kept numbers, the row's time and its flag; what it gives:
# the numbers to keep and the output values.
Decision = Callable[[list[int], int, bool], tuple[list[int], tuple]]


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Keyed(StatefulProcessor):
    def __init__(self, decide: Decision, outputs: list[str], ttl_ms: int | None):
        self.decide, self.outputs, self.ttl_ms = decide, outputs, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "numbers array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")
        numbers = [int(n) for n in self.memory.get()[0]] if self.memory.exists() else []
        made = []
        for us, flag in zip(batch["us"], batch["flag"]):
            numbers, values = self.decide(numbers, int(us), bool(flag))
            made.append(values)
        self.memory.update((numbers,))
        out = batch[["key", "id", "us"]].reset_index(drop=True)
        for i, name in enumerate(self.outputs):
            out[name] = [m[i] for m in made]
        yield out

    def close(self) -> None:
        pass


def decide_stream(rows: DataFrame, decide: Decision, outputs: dict[str, str], ttl_ms: int | None = None) -> DataFrame:
    """Apply a decision to a stream of key (string), id, us, flag."""
    ddl = "key string, id bigint, us bigint, " + ", ".join(f"{n} {t}" for n, t in outputs.items())
    return rows.select("key", "id", "us", "flag").groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Keyed(decide, list(outputs), ttl_ms), outputStructType=ddl, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None")


def flood_rule(fast=(3, 6 * SECOND), burst=(10, 60 * SECOND)) -> Decision:
    """ST2: the last few times of the user."""
    depth = max(fast[0], burst[0])

    def decide(times, us, _):
        def over(limit):
            return len(times) >= limit[0] and us - times[-limit[0]] < limit[1]
        verdict = "fast" if over(fast) else "burst" if over(burst) else None
        return (times + [us])[-depth:], (verdict,)
    return decide


def quota_rule(limit: int, bucket: int = HOUR) -> Decision:
    """ST1: bucket number and messages passed in it."""
    def decide(state, us, _):
        number = us // bucket
        used = state[1] if state and state[0] == number else 0
        ok = used < limit
        used += ok
        return [number, used], (ok, used)
    return decide


def cooldown_rule(wait: int, closed: bool = True) -> Decision:
    """ST3: time of the last accepted message.  With ``closed=False`` on a content
    fingerprint this is ST5: a copy within ``wait`` of a kept message is a duplicate."""
    def decide(state, us, _):
        if state and (us - state[0] < wait if closed else us - state[0] <= wait):
            return state, (False, (wait - (us - state[0])) // SECOND + 1)
        return [us], (True, None)
    return decide


def strike_rule(span: int = 900 * SECOND) -> Decision:
    """ST4: times of the last three violations; the fourth value is the end of the mute
    in force, replaced by each new one."""
    def decide(state, us, _):
        mute, times = (state[0], state[1:]) if state else (0, [])
        recent = [t for t in times if us - t <= span]
        level = min(4, len(recent) + 1)
        minutes = {3: 15, 4: 120}.get(level)
        muted = us < mute
        if minutes:
            mute = us + minutes * 60 * SECOND
        return [mute, *(recent + [us])[-3:]], (level, minutes, muted)
    return decide


def lockout_rule(limit: int = 5, span: int = 900 * SECOND) -> Decision:
    """ST8: failures still counting."""
    def decide(fails, us, success):
        live = [t for t in fails if us - t < span]
        if len(live) >= limit and span - (us - live[0]) >= SECOND:
            return fails, ("locked",)
        if success:
            return [], ("ok",)
        return live + [us], ("failed",)
    return decide


def hourly_totals(messages: DataFrame, user: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """ST1 totals for sinks that only append: messages per user and hour, once an hour is closed;
    later rows than ``late`` are left out. ``all_hourly_totals`` leaves out none."""
    timed = messages.withColumn("at", F.col(ts).cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", "1 hour"), user).agg(F.count(F.lit(1)).alias("n"))


def all_hourly_totals(messages: DataFrame, user: str, folder: str, ts: str = "ts", every: int = kept.EVERY) -> DataFrame:
    """ST1 totals: user, hour, n over every message so far, open hours and late messages included,
    kept below ``folder`` over restarts. Null users and times are groups of their own."""
    ones = messages.select(F.col(user), F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("hour"), F.lit(1).cast("bigint").alias("n"))
    return kept.keep(ones, folder, lambda rows: rows.groupBy(user, "hour").agg(F.sum("n").alias("n")), every)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all available input into files of the shared folder."""
    spark = stream.sparkSession
    folder = run_dir(spark, name)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/progress")
             .trigger(availableNow=True).start(f"{folder}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def merge_states(events: DataFrame, name: str, folder: str | None = None, every: int = kept.EVERY) -> DataFrame:
    """ST6: life-cycle events (id, event, us, message_id) merged batch by batch, the last of each id.

    With a ``folder`` a later run goes on from what is kept there (S8); a repeated batch counts once.
    """
    rows = events.select("id", "event", "us", "message_id")
    return G.lifecycle(kept.keep(rows, folder or run_dir(events.sparkSession, name), lambda x: G.latest(x, ["id"], F.col("us")), every))
