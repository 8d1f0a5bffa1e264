"""Admission control over a message stream, batch form (W1-W6, W9, J6, J9, F*, V8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modspark.durable import cut
from modspark.functions.times import SECOND, from_micros
from modspark.operators import timeline as L
from modspark.operators.cooldown import cooldown
from modspark.operators.lockout import lockout

HOUR = 3600 * SECOND


def flood(df: DataFrame, user: str, order: str, fast: tuple[int, int] = (3, 6 * SECOND),
          burst: tuple[int, int] = (10, 60 * SECOND)) -> DataFrame:
    """Adds ``flood``: 'fast' or 'burst' when over a limit, else null.

    Rejected messages count.  Over n in a window means the n-th message before this
    one is younger than the window (strictly).
    """
    depth = max(fast[0], burst[0])
    seen = L.with_recent(df, [user], order, depth, max(fast[1], burst[1]))

    def over(limit: tuple[int, int]) -> Column:
        older = F.get("recent", F.lit(limit[0] - 1))
        return F.coalesce(F.col("us") - older < limit[1], F.lit(False))

    return seen.withColumn("flood", F.when(over(fast), "fast").when(over(burst), "burst")).drop("recent")


def hourly_quota(df: DataFrame, user: str, order: str, limit: int, bucket: int = HOUR) -> DataFrame:
    """The first ``limit`` messages of a user and hour pass; the reported count
    stops at the limit.

    Only the first ``limit`` rows of each group are ever ranked (Spark drops the rest
    before the shuffle); the others are told apart by a join on their own id.
    """
    hourly = df.withColumn("bucket", F.floor(F.col("us") / F.lit(bucket)).cast("bigint"))
    first = W.partitionBy(user, "bucket").orderBy("us", order)
    passed = hourly.select(user, "bucket", "us", order).withColumn("rank", F.row_number().over(first)).where(
        F.col("rank") <= limit).select(order, "rank")
    return hourly.join(passed, order, "left").withColumns({
        "quota_ok": F.col("rank").isNotNull(),
        "quota_count": F.coalesce("rank", F.lit(limit)),
    }).drop("rank", "bucket")


def strikes(df: DataFrame, user: str, order: str, span: int = 900 * SECOND) -> DataFrame:
    """Violations only; strike level 1 none, 2 warning, 3 short mute, 4 and up long
    mute, counting the last ``span`` inclusive.  Adds strike, penalty, mute_minutes,
    muted_until."""
    seen = L.with_recent(df, [user], order, 3, span)
    level = F.least(F.lit(4), F.size("recent") + 1)
    # Minutes of the two automatic mutes.
    minutes = F.when(level == 3, 15).when(level == 4, 120).cast("bigint")
    return (
        seen.withColumn("strike", level)
        .withColumn("penalty", F.when(level == 1, "none").when(level == 2, "warning").when(level == 3, "AUTO_MUTE")
                    .otherwise("AUTO_MUTE_EXTENDED"))
        .withColumn("mute_minutes", minutes.cast("int"))
        .withColumn("muted_until_us", F.col("us") + minutes * (60 * SECOND))
        .withColumn("muted_until", from_micros("muted_until_us"))
        .drop("recent", "muted_until_us")
    )


def duplicates(df: DataFrame, fingerprint: list[str], order: str, span: int = 300 * SECOND) -> DataFrame:
    """Adds ``duplicate``: an equal fingerprint came within ``span`` before
    (rows of the same time count in id order).  No self-join."""
    seen = L.with_recent(df, fingerprint, order, 1, span)
    return seen.withColumn("duplicate", F.size("recent") > 0).drop("recent")



# --- mutes --------------------------------------------------------------------------

def mute_timeline(actions: DataFrame, user: str, order: str, width: int = 24 * HOUR) -> DataFrame:
    """Mute intervals; each action of the user replaces what was in force.  ``actions``
    has us, minutes (null for an unmute)."""
    line = L.carry_next(actions, [user], order, F.col("us"), "next_us", width)
    end = F.col("us") + F.col("minutes").cast("bigint") * (60 * SECOND)
    return line.where(F.col("minutes").isNotNull()).withColumn("start_us", F.col("us")).withColumn(
        "end_us", F.least(end, F.coalesce("next_us", end))).drop("next_us")


def muted_at(messages: DataFrame, actions: DataFrame, user: str, order: str, width: int = 24 * HOUR) -> DataFrame:
    """Was the user muted when the message came?  The last action up to then decides;
    an action of the same time as the message counts first."""
    told = actions.select(user, "us", F.lit(None).cast("bigint").alias("message"), F.struct(
        (F.col("us") + F.col("minutes").cast("bigint") * (60 * SECOND)).alias("until_us")).alias("state"))
    asked = messages.select(user, "us", F.col(order).alias("message"), F.lit(None).cast("struct<until_us:bigint>").alias("state"))
    line = told.unionByName(asked).withColumn("seq", F.coalesce("message", F.lit(-1)))
    state = L.carry_last(line, [user], "seq", F.col("state"), "in_force", width)
    answer = state.where(F.col("message").isNotNull()).select(
        F.col("message").alias(order), F.coalesce(F.col("in_force.until_us") > F.col("us"), F.lit(False)).alias("muted"))
    return messages.join(answer, order)


# --- gates --------------------------------------------------------------------------

def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """Name of the first gate that stops the row; null when all let it pass."""
    return F.coalesce(*[F.when(stopped, F.lit(name)) for name, stopped in gates])


def account_gate(df: DataFrame, students: DataFrame, key: str, as_of_us: Column, intake_open: bool = True) -> DataFrame:
    """ban, then mute, then the intake switch."""
    joined = df.join(students.select(key, "is_banned", "muted_until_us"), key, "left")
    return joined.withColumn("stopped_by", first_reason([
        ("banned", F.coalesce("is_banned", F.lit(False))),
        ("muted", F.coalesce(F.col("muted_until_us") > as_of_us, F.lit(False))),
        ("intake_closed", F.lit(not intake_open)),
    ]))


def keep_recent(df: DataFrame, as_of_us: Column, span: int) -> DataFrame:
    """F7 / A3 bound: rows not older than ``span`` (inclusive)."""
    return df.where(F.col("us") >= as_of_us - span)


def recent_counts(events: DataFrame, user: str, kind: str, as_of_us: Column, span: int) -> DataFrame:
    """A3."""
    return keep_recent(events, as_of_us, span).where(F.col("us") <= as_of_us).groupBy(user, kind).agg(
        F.count(F.lit(1)).alias("n_recent"))


def hourly_counts(events: DataFrame, user: str, limit: int, bucket: int = HOUR) -> DataFrame:
    """A4: messages per user and hour, reported up to the limit."""
    return events.groupBy(user, F.floor(F.col("us") / F.lit(bucket)).cast("bigint").alias("bucket")).agg(
        F.least(F.count(F.lit(1)), F.lit(limit)).cast("int").alias("count"))


def admit(messages: DataFrame, user: str, order: str, *, flood_fast=(3, 6 * SECOND), flood_burst=(10, 60 * SECOND),
          members: DataFrame, students: DataFrame, fingerprint: list[str], duplicate_span: int = 300 * SECOND,
          quota: int = 10, max_length: int = 4000, intake_open: bool = True) -> DataFrame:
    """V8: the ordered gates of a submission.  Flood counts every message; duplicates and
    quota only see messages that passed all earlier gates, so they run in stages."""
    checked = flood(messages, user, order, flood_fast, flood_burst)
    in_group = members.where(F.col("status").isin("member", "administrator", "creator")).select(user).distinct()
    checked = checked.join(in_group.withColumn("is_member", F.lit(True)), user, "left")
    checked = checked.join(students.select(user, "is_banned", "muted_until_us"), user, "left")
    early = first_reason([
        ("flood", F.col("flood").isNotNull()),
        ("not_member", F.col("is_member").isNull()),
        ("banned", F.coalesce("is_banned", F.lit(False))),
        ("muted", F.coalesce(F.col("muted_until_us") > F.col("us"), F.lit(False))),
        ("intake_closed", F.lit(not intake_open)),
        ("unsupported", ~F.col("supported")),
        ("too_long", F.col("n_chars") > max_length),
    ])
    # Written once: the later stages read it several times.
    checked = cut(checked.withColumn("early", early).drop("flood", "is_member", "is_banned", "muted_until_us"))
    open_ = checked.where(F.col("early").isNull())
    # Rejected duplicates are not recorded, hence the cooldown form.
    fresh = cut(cooldown(open_.select(*fingerprint, "us", order, user), fingerprint, order, duplicate_span, closed=False).select(
        user, "us", order, "accepted"))
    counted = hourly_quota(fresh.where("accepted").select(user, "us", order), user, order, quota)
    late = fresh.select(order, "accepted").join(counted.select(order, "quota_ok"), order, "left")
    return checked.join(late, order, "left").withColumn("reject_reason", F.coalesce(
        "early",
        F.when(~F.col("accepted"), "duplicate"),
        F.when(~F.col("quota_ok"), "quota"),
    )).drop("early", "accepted", "quota_ok")
