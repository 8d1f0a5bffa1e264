import datetime as dt

import pytest
from pyspark.sql import functions as F

from modspark import schemas
from modspark.functions import crypto as K
from modspark.operators import identity as I
from modspark.operators import ledger as G
from modspark.operators import roles as O
from modspark.plans import migrate as M
from modspark.sources import tables as R

BLIND, SEAL = K.derive_key(b"m", b"b"), K.derive_key(b"m", b"s")
BATCH = "telegram_id bigint, full_name string, username string, ts timestamp_ntz"
STUDENTS = """anonymous_id bigint, user_hash string, enc_telegram_id string, enc_full_name string, enc_username string, is_banned boolean,
    ban_reason string, muted_until timestamp_ntz, created_at timestamp_ntz, last_active_at timestamp_ntz"""
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def nobody(spark):
    return spark.createDataFrame([], STUDENTS), spark.createDataFrame([], "id_hash string, reason string, banned_at timestamp_ntz")


def test_numbers_are_contiguous_and_stable(spark):
    people, prints = nobody(spark)
    batch = spark.createDataFrame([(i, f"n{i}", None, at(i % 7)) for i in range(50)], BATCH)
    once = I.register(batch, people, prints, BLIND, SEAL)
    assert sorted(r.anonymous_id for r in once.collect()) == list(range(101, 151))
    again = I.register(batch.repartition(3), once, prints, BLIND, SEAL)
    assert {(r.user_hash, r.anonymous_id) for r in once.collect()} == {(r.user_hash, r.anonymous_id) for r in again.collect()}
    more = I.register(spark.createDataFrame([(99, "x", "h", at(1))], BATCH), again, prints, BLIND, SEAL)
    assert more.count() == 51 and more.agg(F.max("anonymous_id")).first()[0] == 151


def test_names_change_only_when_supplied(spark):
    people, prints = nobody(spark)
    one = I.register(spark.createDataFrame([(1, "Old", "old", at(0))], BATCH), people, prints, BLIND, SEAL)
    two = I.register(spark.createDataFrame([(1, None, "new", at(5))], BATCH), one, prints, BLIND, SEAL)
    r = two.select(K.decrypt(F.col("enc_full_name"), SEAL).alias("n"), K.decrypt(F.col("enc_username"), SEAL).alias("u"), "last_active_at", "created_at").first()
    assert (r.n, r.u, r.last_active_at, r.created_at) == ("Old", "new", at(5), at(0))


def test_ban_outlives_erasure_but_not_without_a_print(spark):
    people, prints = nobody(spark)
    base = I.register(spark.createDataFrame([(1, "a", None, at(0)), (2, "b", None, at(1))], BATCH), people, prints, BLIND, SEAL)
    acts = "anonymous_id bigint, verb string, minutes int, reason string, ts timestamp_ntz, id int"
    banned, marks = I.apply_bans(base, prints, spark.createDataFrame([(101, "ban", None, "spam", at(2), 1)], acts))
    gone = I.erase(banned, spark.createDataFrame([(101, 5), (102, 5), (101, 9)], "anonymous_id bigint, us bigint"))
    assert gone.where("is_banned and enc_full_name = '[WIPED]' and user_hash like 'WIPED_%'").count() == 2
    assert I.active_audience(gone).count() == 0
    back = I.register(spark.createDataFrame([(1, "a", None, at(9)), (2, "b", None, at(8))], BATCH), gone, marks, BLIND, SEAL)
    fresh = {r.anonymous_id: (r.is_banned, r.ban_reason) for r in back.where("anonymous_id > 102").collect()}
    assert fresh == {103: (False, None), 104: (True, "spam")}
    # lifting the ban of the erased row cannot remove the old print
    _, left = I.apply_bans(back, marks, spark.createDataFrame([(101, "unban", None, None, at(10), 2)], acts))
    assert left.count() == 1
    _, lifted = I.apply_bans(back, marks, spark.createDataFrame([(104, "unban", None, None, at(10), 2)], acts))
    assert lifted.count() == 0


def test_mute_and_unmute(spark):
    people, prints = nobody(spark)
    base = I.register(spark.createDataFrame([(1, "a", None, at(0))], BATCH), people, prints, BLIND, SEAL)
    acts = "anonymous_id bigint, verb string, minutes int, reason string, ts timestamp_ntz, id int"
    muted = I.apply_mutes(base, spark.createDataFrame([(101, "mute", 15, None, at(1), 1)], acts))
    assert muted.first().muted_until == at(16)
    assert I.apply_mutes(muted, spark.createDataFrame([(101, "unmute", None, None, at(2), 2)], acts)).first().muted_until is None


def test_identity_is_shown_to_the_primary_role_only(spark):
    people, prints = nobody(spark)
    base = I.register(spark.createDataFrame([(7, "Name", "h", at(0))], BATCH), people, prints, BLIND, SEAL)
    callers = spark.createDataFrame([("p", "primary_admin", True, 101), ("old", "primary_admin", False, 101), ("m", "moderator", True, 101)],
                                    "caller string, role string, session_ok boolean, anonymous_id bigint")
    got = {r.caller: (r.full_name, r.telegram_id) for r in I.reveal(base, callers, SEAL).collect()}
    assert got == {"p": ("Name", 7), "old": (None, None), "m": (None, None)}
    assert not set(schemas.IDENTITY_COLUMNS) & set(schemas.students_public(base).columns)


def test_life_cycle_counts(spark):
    events = spark.createDataFrame([(1, "pending", 1, 5), (1, "published", 2, 50), (2, "pending", 1, 6), (2, "failed", 2, 6), (3, "pending", 1, 7)],
                                   "id int, event string, us bigint, message_id bigint")
    state = G.lifecycle(events)
    assert {r.id: (r.status, r.message_id, r.is_deleted) for r in state.collect()} == {
        1: ("published", 50, False), 2: ("failed", None, True), 3: ("pending", None, False)}
    assert [r.id for r in G.stale_pending(state, events.where("event = 'pending'"), F.lit(100), 50).collect()] == [3]


def test_upserts(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    source = spark.createDataFrame([("a", 9, "q", 1), ("a", 10, "r", 2), ("c", 3, None, 1)], "k string, n int, s string, seq int")
    got = {r.k: (r.n, r.s) for r in G.upsert(target, source, ["k"], ["n"], F.col("seq")).collect()}
    assert got == {"a": (10, "x"), "b": (2, "y"), "c": (3, None)}
    kept = {r.k: r.n for r in G.insert_if_absent(target, source, ["k"], F.col("seq")).collect()}
    assert kept == {"a": 1, "b": 2, "c": 3}


def test_many_rows_are_looked_up_without_a_sort(spark):
    """Sorted, a task would hold all its rows; hashed, it holds the ids."""
    n = 600_000
    ids = spark.range(n).select((F.col("id") * 2).alias("message_id"))
    ids = ids.union(ids.limit(5)).union(spark.createDataFrame([(None,)], "message_id bigint"))  # repeated and null ids
    rows = spark.range(2 * n + 1000).select(F.when(F.col("id") % 1000 != 0, F.col("id")).alias("parent"), F.col("id").alias("asked"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {"kept": G.with_parent(rows, ids, "parent"), "rejected": G.with_parent(rows, ids, "parent", keep=False), "all": G.root_if_orphan(rows, ids, "parent"),
                 "unowned": G.without_owner(rows.withColumnRenamed("parent", "anonymous_id"), ids.withColumnRenamed("message_id", "anonymous_id"))}
        plans = {k: df._jdf.queryExecution().executedPlan().toString() for k, df in found.items()}
        few = G.with_parent(rows.limit(100), ids, "parent")._jdf.queryExecution().executedPlan().toString()
        # (id, or null every 1000th) is known when even and below 2n
        even = n - n // 500
        assert {k: df.count() for k, df in found.items()} == {"kept": even, "rejected": 2 * n + 1000 - even, "all": 2 * n + 1000, "unowned": 2 * n + 1000 - even}
        assert found["kept"].where("parent is null or parent != asked or parent % 2 = 1").isEmpty()
        assert found["rejected"].where(f"parent % 2 = 0 and parent < {2 * n}").isEmpty()
        assert found["all"].where("parent is not null").count() == even and found["all"].where("parent != asked").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert all("ShuffledHashJoin" in p and "Sort" not in p.replace("SortOrder", "") for p in plans.values())
    assert "SortMergeJoin" in few  # ids that outnumber the rows are not held in memory


def test_roles(spark):
    roles = spark.createDataFrame([(1, 2, "moderator"), (1, 0, "primary_admin"), (2, 1, "moderator")], "u int, priority int, role string")
    users = O.with_role(spark.createDataFrame([(1,), (2,), (3,)], "u int"), roles, "u")
    assert {r.u: r.role for r in users.collect()} == {1: "primary_admin", 2: "moderator", 3: None}
    members = spark.createDataFrame([(1, "member"), (2, "restricted")], "u int, status string")
    assert [r.u for r in O.members_only(users, members, "u").collect()] == [1]


def test_migration_writes_and_reconciles(spark, tmp_path):
    empty = {n: spark.createDataFrame([], ddl) for n, ddl in schemas.TABLES.items()}
    old = {
        "students": spark.createDataFrame([(101, "h1"), (102, "h2")], "anonymous_id int, user_hash string"),
        "system_settings": spark.createDataFrame([("a", "1")], "key string, value string"),
    }
    target = dict(empty, system_settings=spark.createDataFrame([("a", "0", None), ("b", "2", None)], schemas.TABLES["system_settings"]))
    folder = str(tmp_path / "new")
    assert all(r.complete for r in M.migrate(spark, old, target, folder).collect())
    students = R.read_table(spark, f"{folder}/students", "students")
    assert students.where("is_banned = false and total_posts = 0").count() == 2
    assert {r.key: r.value for r in R.read_table(spark, f"{folder}/system_settings", "system_settings").collect()} == {"a": "1", "b": "2"}
    # again, onto the result: nothing is doubled
    snapshots = {n: R.read_table(spark, f"{folder}/{n}", n) for n, *_ in M.STEPS}
    assert M.plan(old, snapshots)["students"].count() == 2


def test_a_broken_migration_goes_on_and_publishes_once(spark, tmp_path):
    empty = {n: spark.createDataFrame([], ddl) for n, ddl in schemas.TABLES.items()}
    old = {"students": spark.createDataFrame([(1, "h")], "anonymous_id int, user_hash string"),
           "posts": spark.createDataFrame([(5,)], "channel_message_id int")}
    broken = spark.range(1).select(F.raise_error(F.lit("lost")).cast("bigint").alias("channel_message_id"))
    folder = str(tmp_path / "new")
    with pytest.raises(Exception, match="lost"):
        M.migrate(spark, old | {"posts": broken}, empty, folder)
    assert M.published(spark, folder) == {}
    changed = old | {"students": old["students"].union(old["students"].selectExpr("2", "'later'"))}
    counts = {r.name: (r.n_source, r.n_target) for r in M.migrate(spark, changed, empty, folder).collect()}
    assert counts == {"students": (2, 1), "posts": (1, 1)}  # students were staged whole before the break
    tables = M.published(spark, folder)
    assert set(tables) == {n for n, *_ in M.STEPS} and tables["posts"].first().channel_message_id == 5
    with pytest.raises(ValueError):
        M.migrate(spark, old, empty, folder)


def test_appending_sinks(spark, tmp_path):
    df = spark.createDataFrame([(True, "call 01234567890"), (False, "x")], "ok boolean, note string")
    R.append_published(df, "ok", str(tmp_path / "p"), str(tmp_path / "f"))
    R.append_redacted(df, str(tmp_path / "log"), "note")
    R.append_redacted(df, str(tmp_path / "log"), "note")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1 and spark.read.parquet(str(tmp_path / "f")).count() == 1
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and log.where("note like '%0123%'").count() == 0
