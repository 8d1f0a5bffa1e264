"""Default windows on hand-made rows, and random streams against plain simulations."""

import random

import pytest
from pyspark.sql import functions as F

from modspark.functions.times import SECOND
from modspark.operators import admission as A
from modspark.operators import cooldown as C
from modspark.streaming import keyed as S

MESSAGE = "user string, id bigint, us bigint"


def rows(spark, times, user="u"):
    return spark.createDataFrame([(user, i, int(t * SECOND)) for i, t in enumerate(times)], MESSAGE)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def random_stream(seed, n, users, span, hot=0.5):
    """Half of all rows belong to one user; several share a time."""
    r = random.Random(seed)
    times = sorted(r.choice([r.randint(0, span), r.randint(0, span // 50) * 50]) for _ in range(n))
    return [("hot" if r.random() < hot else f"u{r.randint(1, users)}", i, t * SECOND, r.random() < 0.4) for i, t in enumerate(times)]


def simulate(stream, decide):
    state, out = {}, {}
    for user, i, us, flag in stream:
        state[user], values = decide(state.get(user, []), us, flag)
        out[i] = values
    return out


def test_flood_defaults(spark):
    got = A.flood(rows(spark, [0, 1, 2, 3, 6.0, 20, 27, 34, 41, 48, 55, 59.9, 200]), "user", "id")
    assert column(got, "flood") == [None, None, None, "fast", "fast", None, None, None, None, None, "burst", "burst", None]


def test_quota(spark):
    got = A.hourly_quota(rows(spark, [0, 10, 20, 30, 3600]), "user", "id", 3)
    assert column(got, "quota_ok") == [True, True, True, False, True]
    assert column(got, "quota_count") == [1, 2, 3, 3, 1]


def test_strikes(spark):
    got = A.strikes(rows(spark, [0, 900, 901, 902, 5000]), "user", "id")
    assert column(got, "strike") == [1, 2, 2, 3, 1] and column(got, "mute_minutes") == [None, None, None, 15, None]


def test_duplicates_inclusive(spark):
    got = A.duplicates(rows(spark, [0, 300, 601, 601]), ["user"], "id")
    assert column(got, "duplicate") == [False, True, False, True]


def test_cooldown(spark):
    got = A.cooldown(rows(spark, [0, 2, 3, 4, 6, 100]), ["user"], "id", 3 * SECOND)
    assert column(got, "accepted") == [True, False, True, False, True, True]
    assert column(got, "wait_s") == [None, 2, None, 3, None, None]


def test_lockout(spark):
    df = rows(spark, [0, 1, 2, 3, 4, 5, 899.5, 900.5, 2000]).withColumn("ok", F.col("id").isin(5, 8))
    got = A.lockout(df, "user", "id", "ok")
    assert column(got, "outcome") == ["failed"] * 5 + ["locked", "failed", "failed", "ok"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_streams_match_a_simulation(spark, seed):
    stream = random_stream(seed, 3000, 8, 20000)
    df = spark.createDataFrame(stream, MESSAGE + ", flag boolean").repartition(5)
    fast, burst, wait, span = (3, 20 * SECOND), (10, 90 * SECOND), 30 * SECOND, 60 * SECOND

    def check(got, names, decide):
        want = simulate(stream, decide)
        for r in got.collect():
            assert tuple(r[n] for n in names) == want[r.id][:len(names)], (r, want[r.id])

    check(A.flood(df, "user", "id", fast, burst), ["flood"], S.flood_rule(fast, burst))
    check(A.hourly_quota(df, "user", "id", 5, 100 * SECOND), ["quota_ok", "quota_count"], S.quota_rule(5, 100 * SECOND))
    check(A.cooldown(df, ["user"], "id", wait), ["accepted", "wait_s"], S.cooldown_rule(wait))
    check(A.cooldown(df, ["user"], "id", wait, closed=False, slice_waits=2), ["accepted"], S.cooldown_rule(wait, closed=False))
    check(A.cooldown(df, ["user"], "id", wait, slice_waits=1, fan=3), ["accepted", "wait_s"], S.cooldown_rule(wait))
    check(A.cooldown(df, ["user"], "id", wait, closed=False, slice_waits=1, fan=2), ["accepted", "wait_s"], S.cooldown_rule(wait, closed=False))
    check(A.strikes(df, "user", "id", span), ["strike", "mute_minutes"], S.strike_rule(span))
    check(A.lockout(df, "user", "id", "flag", 3, span), ["outcome"], S.lockout_rule(3, span))
    check(A.lockout(df, "user", "id", "flag", 3, span, parts=17), ["outcome"], S.lockout_rule(3, span))


def test_cooldown_of_a_hot_key(spark, monkeypatch):
    """One key with half of all rows over many slices and rounds of the tree; null keys, null times, moments that repeat."""
    monkeypatch.setattr(C, "AT_ONCE", 300)
    times = sorted((i * 7919 % 60_000) * SECOND // 4 for i in range(6000))
    stream = [(("hot", None, "a", "b")[0 if i % 2 else 1 + i % 3], i, us // 3 * 3, i % 3 == 0) for i, us in enumerate(times)]
    for wait, closed, fan in ((3 * SECOND, True, 4), (SECOND // 2, False, 2), (400 * SECOND, True, 512)):
        df = spark.createDataFrame(stream, MESSAGE + ", flag boolean").repartition(5)
        got = {r.id: (r.accepted, r.wait_s) for r in A.cooldown(df, ["user"], "id", wait, closed=closed, slice_waits=2, fan=fan).collect()}
        want = simulate([(str(u), *rest) for u, *rest in stream], S.cooldown_rule(wait, closed=closed))
        assert got == {i: w[:2] for i, w in want.items()}
    timeless = spark.createDataFrame([("a", 1, None, True), (None, 2, 5, True)], MESSAGE + ", flag boolean")
    assert sorted((r.id, r.accepted, r.wait_s) for r in A.cooldown(timeless, ["user"], "id", 3).collect()) == [(1, False, None), (2, True, None)]
    assert A.cooldown(timeless.limit(0), ["user"], "id", 3).count() == 0


@pytest.mark.parametrize("successes", [0, 40])
def test_lockout_of_a_hot_key(spark, successes):
    """A user with half of all attempts, over many parts, without a pause; with no success at all each guess is wrong."""
    stream = [(("hot", None, "a", "b")[0 if i % 2 else 1 + i % 3], i, i * SECOND // 2, i % 100 < successes and i % 7 == 0) for i in range(4000)]
    df = spark.createDataFrame(stream, MESSAGE + ", flag boolean").repartition(5)
    got = A.lockout(df, "user", "id", "flag", 4, 50 * SECOND, parts=9)
    want = simulate([(str(u), *rest) for u, *rest in stream], S.lockout_rule(4, 50 * SECOND))
    assert {r.id: r.outcome for r in got.collect()} == {i: w[0] for i, w in want.items()}


def test_lockout_without_time_or_rows(spark):
    df = spark.createDataFrame([("a", 1, None, None), (None, 2, 5, None), (None, 3, 6, True)], MESSAGE + ", flag boolean")
    got = A.lockout(df, "user", "id", "flag")
    assert column(got, "outcome") == [None, "failed", "ok"] and got.columns == [*df.columns, "outcome"]
    assert A.lockout(df.limit(0), "user", "id", "flag").count() == 0


def test_order_of_input_does_not_matter(spark):
    stream = random_stream(5, 500, 3, 3000)
    df = spark.createDataFrame(stream, MESSAGE + ", flag boolean")
    first = column(A.cooldown(df, ["user"], "id", 9 * SECOND), "accepted")
    assert first == column(A.cooldown(df.orderBy(F.rand(3)).repartition(7), ["user"], "id", 9 * SECOND), "accepted")


def test_mutes(spark):
    actions = spark.createDataFrame([("u", 0, 0, 10), ("u", 1, 300 * SECOND, None), ("u", 2, 4000 * SECOND, 1)], MESSAGE + ", minutes int")
    line = A.mute_timeline(actions, "user", "id").orderBy("id").collect()
    assert [(r.start_us // SECOND, r.end_us // SECOND) for r in line] == [(0, 300), (4000, 4060)]
    asked = rows(spark, [-1, 0, 299, 300, 4059, 4060])
    assert column(A.muted_at(asked, actions, "user", "id", width=100 * SECOND), "muted") == [False, True, True, False, True, False]


def test_stream_over_many_files_equals_batch(spark, tmp_path):
    S.use_state_store(spark)
    stream = random_stream(9, 400, 4, 2000)
    schema = MESSAGE + ", flag boolean"
    for part in range(4):
        spark.createDataFrame(stream[part * 100:(part + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumnRenamed("user", "key")
    rule = S.flood_rule((3, 20 * SECOND), (10, 90 * SECOND))
    got = S.run_once(S.decide_stream(source, rule, {"flood": "string"}), "test-flood")
    batch = A.flood(spark.createDataFrame(stream, schema), "user", "id", (3, 20 * SECOND), (10, 90 * SECOND))
    assert column(got, "flood") == column(batch, "flood")


def test_states_merge_over_batches(spark, tmp_path):
    schema = "id bigint, event string, us bigint, message_id bigint"
    for batch in ([(1, "pending", 1, None), (2, "pending", 1, None)], [(1, "published", 2, 77)], [(2, "failed", 3, None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.id: (r.status, r.message_id, r.is_deleted) for r in S.merge_states(source, "test-states").collect()}
    assert got == {1: ("published", 77, False), 2: ("failed", None, True)}


def test_totals_and_states_go_on_after_a_restart(spark, tmp_path):
    """Two runs over a growing folder, with a whole fold in between, equal one count over all rows: late ones, open hours, nulls."""
    hour = 3600
    messages = [[("a", 0), ("b", 5 * hour), (None, 1)], [("a", 1), ("a", 9 * hour)], [("b", 5 * hour + 1), ("a", None)], [("a", 2), ("b", 0)]]
    events = [[(1, "pending", 1, None), (2, "pending", 1, None)], [(1, "published", 5, 77)], [(1, "failed", 3, None)], [(2, "failed", 4, None)]]
    kinds = {"m": "user string, s long", "e": "id bigint, event string, us bigint, message_id bigint"}
    got = {}
    for upto in (2, 4):
        for n in range(upto - 2, upto):
            spark.createDataFrame(messages[n], kinds["m"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
            spark.createDataFrame(events[n], kinds["e"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        read = lambda name: spark.newSession().readStream.schema(kinds[name]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        timed = read("m").withColumn("ts", F.timestamp_seconds("s"))
        got["totals"] = S.all_hourly_totals(timed, "user", str(tmp_path / "totals"), every=3)
        got["states"] = S.merge_states(read("e"), "x", str(tmp_path / "states"), every=2)
    assert sorted(((r.user or "", r.hour.hour if r.hour else -1), r.n) for r in got["totals"].collect()) == [
        (("", 0), 1), (("a", -1), 1), (("a", 0), 3), (("a", 9), 1), (("b", 0), 1), (("b", 5), 2)]
    assert {r.id: (r.status, r.message_id) for r in got["states"].collect()} == {1: ("published", 77), 2: ("failed", None)}
