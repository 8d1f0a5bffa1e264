"""Posts, replies, settings and audit as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.operators.timeline import earliest, latest


def both_kinds(posts: DataFrame, replies: DataFrame) -> DataFrame:
    """One table of posts and replies; ``kind_order`` puts posts first."""
    p = posts.select("anonymous_id", F.col("channel_message_id").alias("message_id"), "content_preview",
                     F.lit("post").alias("kind"), F.lit(0).alias("kind_order"))
    r = replies.select("anonymous_id", F.col("reply_channel_msg_id").alias("message_id"), "content_preview",
                       F.lit("reply").alias("kind"), F.lit(1).alias("kind_order"))
    return p.unionByName(r)


def authors_of(requests: DataFrame, posts: DataFrame, replies: DataFrame, students: DataFrame) -> DataFrame:
    """Author of each requested ``message_id``; a post wins over a reply of that id."""
    # Only requested messages travel on; the minimum keeps one per id.
    found = both_kinds(posts, replies).join(requests.select("message_id").distinct(), "message_id", "left_semi")
    chosen = found.groupBy("message_id").agg(F.min(F.struct("kind_order", "kind", "anonymous_id", "content_preview")).alias("m"))
    picked = chosen.select("message_id", "m.kind", "m.anonymous_id", "m.content_preview")
    return requests.join(picked, "message_id", "left").join(students, "anonymous_id", "left")


def whois(queries: DataFrame, posts: DataFrame, replies: DataFrame, students: DataFrame) -> DataFrame:
    """Each ``number`` as a message id first, else as a pseudonym."""
    known = students.select("anonymous_id")
    by_message = authors_of(queries.select(F.col("number").alias("message_id")).distinct(), posts, replies, known).where(
        F.col("anonymous_id").isNotNull()).select(F.col("message_id").alias("number"), "kind", F.col("anonymous_id").alias("author"))
    by_number = known.select(F.col("anonymous_id").alias("number"), F.col("anonymous_id").alias("self"))
    joined = queries.join(by_message, "number", "left").join(by_number, "number", "left")
    return joined.select(*queries.columns, F.coalesce("author", "self").alias("anonymous_id"),
                         F.when(F.col("author").isNotNull(), F.col("kind")).when(F.col("self").isNotNull(), "student").alias("found_as"))


#: Up to SMALL ids Spark broadcasts by itself; of more, a task may keep HELD in a hash table (some 100 bytes each).
SMALL, HELD = 500_000, 2_000_000


def _known(rows: DataFrame, owners: DataFrame, id_column: str, key: str) -> DataFrame:
    """Ids of ``owners``, one row each, named ``key``, to be looked up by ``rows`` (right side of a join).  Where rows are the
    bulk the ids are hashed and the rows pass by, as a sort would hold all rows of a task.  Otherwise Spark sorts, which spills."""
    ids = owners.select(F.col(id_column).alias(key)).distinct()
    if rows.isStreaming or owners.isStreaming or (n := owners.count()) <= SMALL:
        return ids
    held = HELD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Partitions are merged up to a size in bytes, so the share of the ids in them has to be small as well.
    return ids.hint("shuffle_hash") if n <= held and 2 * n <= rows.count() else ids


def with_parent(replies: DataFrame, messages: DataFrame, parent: str, keep: bool = True) -> DataFrame:
    """Replies whose parent exists (or, with ``keep=False``, those rejected)."""
    return replies.join(_known(replies, messages, "message_id", parent), parent, "left_semi" if keep else "left_anti")


def without_owner(messages: DataFrame, students: DataFrame) -> DataFrame:
    """Rows whose author does not exist; expected empty."""
    return messages.join(_known(messages, students, "anonymous_id", "anonymous_id"), "anonymous_id", "left_anti")


def root_if_orphan(replies: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """A reply whose parent is gone is published as a root message."""
    ids = _known(replies, parents, "message_id", parent)
    return replies.join(ids.withColumn("alive", F.lit(True)), parent, "left").withColumn(
        parent, F.when(F.col("alive"), F.col(parent))).drop("alive")


def split_published(judged: DataFrame, allowed: str) -> tuple[DataFrame, DataFrame]:
    """(published, failed)."""
    return judged.where(F.col(allowed)), judged.where(~F.col(allowed))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], *order: Column) -> DataFrame:
    """Insert new keys; of known ones replace the ``update`` columns.  With ``order``
    the last source row per key counts."""
    fresh = latest(source, keys, *order) if order else source
    fresh = fresh.select(*keys, F.struct(*target.columns).alias("new"))
    joined = target.select(*keys, F.struct(*target.columns).alias("old")).join(fresh, keys, "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        known = F.col("new").isNotNull() if c in update else F.col("old").isNull()
        return F.when(known, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Known keys stay; of several new rows per key the first by ``order``, then by all columns, enters."""
    one = earliest(source, keys, *order, *[F.col(c) for c in source.columns])
    return target.unionByName(one.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def lifecycle(events: DataFrame) -> DataFrame:
    """State of each submission after its last event (id, event, us, message_id).
    Failed ones are soft-deleted; an unpublished one has no message id."""
    last = latest(events, ["id"], F.col("us"), F.col("message_id"), F.col("event"))
    return last.select(
        "id", F.col("event").alias("status"), F.when(F.col("event") == "published", F.col("message_id")).alias("message_id"),
        (F.col("event") == "failed").alias("is_deleted"))


def stale_pending(state: DataFrame, submitted: DataFrame, as_of_us: Column, limit: int) -> DataFrame:
    """Submissions still pending after ``limit`` microseconds."""
    return state.where(F.col("status") == "pending").join(submitted.select("id", "us"), "id").where(
        F.col("us") < as_of_us - limit)


def soft_delete(messages: DataFrame, requests: DataFrame, key: str = "message_id") -> DataFrame:
    """D7."""
    asked = requests.select(key).distinct().withColumn("asked", F.lit(True))
    return messages.join(asked, key, "left").withColumn(
        "is_deleted", F.col("is_deleted") | F.coalesce("asked", F.lit(False))).drop("asked")


def write_settings(settings: DataFrame, writes: DataFrame, *order: Column) -> DataFrame:
    """Last write per key wins; of writes at one time the last by ``order``, then by value."""
    return upsert(settings, writes, ["key"], ["value", "updated_at"], F.col("updated_at"), *order, F.col("value"))


def toggled(start: DataFrame, toggles: DataFrame) -> DataFrame:
    """A switch after any number of toggles; only their parity matters."""
    odd = toggles.groupBy("key").agg((F.count(F.lit(1)) % 2 == 1).alias("odd"))
    return start.join(odd, "key", "left").select(
        "key", (F.col("enabled") != F.coalesce("odd", F.lit(False))).alias("enabled"))


def audit_entries(actions: DataFrame) -> DataFrame:
    """One audit row per staff or automatic action (admin 0)."""
    return actions.select(
        F.coalesce("admin_id", F.lit(0)).alias("admin_id"), F.upper("action").alias("action"),
        F.col("anonymous_id").alias("target_anonymous_id"), "details", F.col("ts").alias("created_at"))


def system_stats(students: DataFrame, posts: DataFrame, replies: DataFrame, settings: DataFrame) -> DataFrame:
    """A1: five figures in one row; an absent intake switch counts as on.  Every input is
    reduced to partial sums first; a union of one-row tables joins them."""
    def line(df: DataFrame, **figures: Column) -> DataFrame:
        return df.agg(*[c.alias(n) for n, c in figures.items()])

    parts = [
        line(students, students=F.count(F.lit(1)), banned=F.count_if("is_banned")),
        line(posts, live_posts=F.count_if(~F.col("is_deleted"))),
        line(replies, live_replies=F.count_if(~F.col("is_deleted"))),
        line(settings.where(F.col("key") == "submissions_enabled"), intake=F.max(F.col("value") == "true")),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.agg(
        F.max("students").alias("students"), F.max("live_posts").alias("live_posts"),
        F.max("live_replies").alias("live_replies"), F.max("banned").alias("banned"),
        F.coalesce(F.max("intake"), F.lit(True)).alias("intake_open"))


def student_counters(messages: DataFrame) -> DataFrame:
    """A2: published posts and replies and last activity per author, recomputed."""
    published = F.col("status") == "published"
    return messages.groupBy("anonymous_id").agg(
        F.count_if(published & (F.col("kind") == "post")).alias("total_posts"),
        F.count_if(published & (F.col("kind") == "reply")).alias("total_replies"),
        F.max(F.when(published, F.col("ts"))).alias("last_active_at"))


def delivery_tally(sent: DataFrame, ok: str) -> DataFrame:
    """A8."""
    return sent.groupBy(ok).agg(F.count(F.lit(1)).alias("n"))


def recent_page(audit: DataFrame, limit: int = 15, offset: int = 0) -> DataFrame:
    """O1: newest entries first."""
    return audit.orderBy(F.col("id").desc()).offset(offset).limit(limit)


def attempts_in_window(attempts: DataFrame, as_of_us: Column, span: int) -> DataFrame:
    """O2: attempts of the window, oldest first."""
    return attempts.where((F.col("us") >= as_of_us - span) & (F.col("us") <= as_of_us)).orderBy("us", "id")


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """point lookup; the test reaches the scan."""
    return df.where(F.col(column) == F.lit(value))


def setting(settings: DataFrame, keys: DataFrame) -> DataFrame:
    """value of each asked key, or its default."""
    return keys.join(settings.select("key", "value"), "key", "left").select("key", F.coalesce("value", "default").alias("value"))


def table_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table name."""
    return reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()])


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """A table is complete when the target has at least the source's rows."""
    joined = source.withColumnRenamed("n", "n_source").join(target.withColumnRenamed("n", "n_target"), "name", "full")
    n_source, n_target = (F.coalesce(c, F.lit(0)) for c in ("n_source", "n_target"))
    return joined.select("name", n_source.alias("n_source"), n_target.alias("n_target"), (n_target >= n_source).alias("complete"))
