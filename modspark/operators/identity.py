"""Pseudonyms, registration, bans and erasure as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modspark.durable import cut
from modspark.functions import crypto as K
from modspark.operators.timeline import latest

FIRST_NUMBER = 101
ERASED_REASON = "erased on request"


def number_rows(df: DataFrame, order: list[str], name: str, after: int) -> DataFrame:
    """Gap-free numbers ``after + 1, after + 2, ...`` over the whole table in ``order``
    (which must be unique).

    Rows are range-partitioned, numbered within their partition, and shifted by the
    sizes of the partitions before: one row per partition is all that is gathered.
    The split is checkpointed, so a lost executor cannot renumber it.
    """
    spark = df.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(
        df.repartitionByRange(width, *order).sortWithinPartitions(*order)
        .withColumn("spot", F.monotonically_increasing_id()))
    # The id holds the partition in its upper bits and the position in the lower 33.
    part, position = F.shiftright("spot", 33), F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return placed.withColumn("part", part).join(starts, "part").withColumn(
        name, (F.lit(after + 1) + F.col("start") + position).cast("bigint")).drop("part", "spot", "start")


def high_water_mark(df: DataFrame, column: str, default: int) -> int:
    """A5 as one number."""
    return df.agg(F.coalesce(F.max(column), F.lit(default))).first()[0]


def assign_pseudonyms(sightings: DataFrame, students: DataFrame | None, key: bytes, user: str, seen: str) -> DataFrame:
    """W7 on new identities: (user_hash, anonymous_id) by first appearance, continuing
    from the highest number; known hashes are left out, so a re-run adds nothing."""
    hashed = sightings.withColumn("user_hash", K.blind_index(F.col(user), key))
    first = hashed.groupBy("user_hash").agg(F.min(seen).alias("first_seen"))
    after = FIRST_NUMBER - 1
    if students is not None:
        first = new_identities(first, students)
        after = high_water_mark(students, "anonymous_id", after)
    return number_rows(first, ["first_seen", "user_hash"], "anonymous_id", after)


def new_identities(hashed: DataFrame, students: DataFrame) -> DataFrame:
    """J5."""
    return hashed.join(students.select("user_hash"), "user_hash", "left_anti")


def with_lasting_bans(registrations: DataFrame, banned: DataFrame) -> DataFrame:
    """A stored fingerprint bans again and its reason wins."""
    prints = banned.select(F.col("id_hash").alias("user_hash"), F.col("reason").alias("print_reason"),
                           F.lit(True).alias("print_hit"))
    joined = registrations.join(prints, "user_hash", "left")
    hit = F.coalesce("print_hit", F.lit(False))
    return joined.withColumns({
        "is_banned": hit | F.col("is_banned"),
        "ban_reason": F.when(hit, F.col("print_reason")).otherwise(F.col("ban_reason")),
    }).drop("print_reason", "print_hit")


def register(batch: DataFrame, students: DataFrame, banned: DataFrame, blind_key: bytes, seal_key: bytes,
             user: str = "telegram_id") -> DataFrame:
    """The new snapshot of students after a batch of (user, full_name, username, ts).

    Known people get the names supplied and a new activity time, new people a number
    and sealed columns; fingerprints of banned people apply to both.
    """
    hashed = batch.withColumn("user_hash", K.blind_index(F.col(user), blind_key))
    last = hashed.groupBy("user_hash").agg(
        F.max(user).alias(user), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max_by("full_name", F.when(F.coalesce("full_name", F.lit("")) != "", F.col("ts"))).alias("full_name"),
        F.max_by("username", F.when(F.coalesce("username", F.lit("")) != "", F.col("ts"))).alias("username"))
    numbers = number_rows(new_identities(last, students).select("first_ts", "user_hash"), ["first_ts", "user_hash"],
                          "number", high_water_mark(students, "anonymous_id", FIRST_NUMBER - 1)).drop("first_ts")

    def sealed(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(F.coalesce(text, F.lit("")) != "", K.encrypt(text, seal_key))

    touched = students.join(last, "user_hash", "full").join(numbers, "user_hash", "left")
    merged = touched.select(
        F.coalesce("anonymous_id", "number").alias("anonymous_id"), "user_hash",
        F.coalesce("enc_telegram_id", sealed(user)).alias("enc_telegram_id"),
        F.coalesce(sealed("full_name"), "enc_full_name").alias("enc_full_name"),
        F.coalesce(sealed("username"), "enc_username").alias("enc_username"),
        F.coalesce("is_banned", F.lit(False)).alias("is_banned"), "ban_reason", "muted_until",
        F.coalesce("created_at", "first_ts").alias("created_at"),
        F.greatest("last_active_at", "last_ts").alias("last_active_at"),
        F.col("last_ts").isNotNull().alias("active_now"))
    quiet, active = merged.where(~F.col("active_now")), merged.where("active_now")
    return quiet.unionByName(with_lasting_bans(active, banned)).drop("active_now")


def last_actions(actions: DataFrame, *verbs: str) -> DataFrame:
    """The last action among ``verbs`` per pseudonym; columns verb, minutes, reason, ts, id."""
    return latest(actions.where(F.col("verb").isin(*verbs)), ["anonymous_id"], F.col("ts"), F.col("id"))


def apply_bans(students: DataFrame, banned: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(students, fingerprints) after ban and unban actions.

    A ban stores the current hash unless erased; an unban removes the current hash
    only, so the fingerprint of somebody erased since stays.
    """
    act = last_actions(actions, "ban", "unban").select("anonymous_id", "verb", F.col("reason").alias("new_reason"), "ts")
    joined = students.join(act, "anonymous_id", "left")
    ban, unban = F.col("verb") == "ban", F.col("verb") == "unban"
    people = joined.withColumns({
        "is_banned": F.when(ban, True).when(unban, False).otherwise(F.col("is_banned")),
        "ban_reason": F.when(ban, F.col("new_reason")).when(unban, None).otherwise(F.col("ban_reason")),
    }).drop("verb", "new_reason", "ts")
    marks = joined.where(F.col("verb").isNotNull()).select("user_hash", "verb", "new_reason", "ts")
    kept = banned.join(marks.select(F.col("user_hash").alias("id_hash")), "id_hash", "left_anti")
    added = marks.where((F.col("verb") == "ban") & ~F.startswith("user_hash", F.lit("WIPED_"))).select(
        F.col("user_hash").alias("id_hash"), F.col("new_reason").alias("reason"), F.col("ts").alias("banned_at"))
    return people, kept.unionByName(added)


def apply_mutes(students: DataFrame, actions: DataFrame) -> DataFrame:
    """The last mute or unmute decides ``muted_until``."""
    act = last_actions(actions, "mute", "unmute").select("anonymous_id", "verb", "minutes", "ts")
    until = F.col("ts") + F.make_dt_interval(mins=F.col("minutes"))
    return students.join(act, "anonymous_id", "left").withColumn(
        "muted_until", F.when(F.col("verb") == "mute", until).when(F.col("verb") == "unmute", None)
        .otherwise(F.col("muted_until"))).drop("verb", "minutes", "ts")


def erase(students: DataFrame, requests: DataFrame) -> DataFrame:
    """Hash replaced by a tombstone, sealed columns by the erased mark, account banned;
    number and history stay."""
    asked = requests.groupBy("anonymous_id").agg(F.max("us").alias("asked_us"))
    joined = students.join(asked, "anonymous_id", "left")
    gone = F.col("asked_us").isNotNull()
    tombstone = F.concat(F.lit("WIPED_"), F.col("anonymous_id").cast("string"), F.lit("_"), F.col("asked_us").cast("string"))
    out = joined.withColumn("user_hash", F.when(gone, tombstone).otherwise(F.col("user_hash")))
    for name in ("enc_telegram_id", "enc_full_name", "enc_username"):
        out = out.withColumn(name, F.when(gone, F.lit(K.ERASED)).otherwise(F.col(name)))
    return out.withColumns({
        "is_banned": gone | F.col("is_banned"),
        "ban_reason": F.when(gone, F.lit(ERASED_REASON)).otherwise(F.col("ban_reason")),
    }).drop("asked_us")


def active_audience(students: DataFrame) -> DataFrame:
    """F2."""
    return students.where(~F.col("is_banned") & (F.col("enc_telegram_id") != K.ERASED))


def reveal(students: DataFrame, callers: DataFrame, seal_key: bytes) -> DataFrame:
    """K6: identity columns for each caller; null unless the caller is the primary
    administrator with a live session.  ``callers``: caller, role, session_ok,
    anonymous_id."""
    allowed = (F.col("role") == "primary_admin") & F.col("session_ok")
    out = callers.join(students, "anonymous_id")
    shown = {name: F.when(allowed, K.decrypt(F.col(f"enc_{name}"), seal_key)) for name in ("full_name", "username")}
    shown["telegram_id"] = F.when(allowed, K.decrypt_int(F.col("enc_telegram_id"), seal_key))
    return out.select("caller", "anonymous_id", allowed.alias("revealed"), *[c.alias(n) for n, c in shown.items()])
