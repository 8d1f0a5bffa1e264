"""Registered queries over the message stream, batch and streaming, each with its SQL.

The events of the test tables are hours apart, so the windows are widened; the
defaults are covered by unit tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from modspark.durable import run_dir
from modspark.functions.times import SECOND, from_micros
from modspark.operators import admission as A
from modspark.operators import verdict as V
from modspark.operators.timeline import with_micros
from modspark.plans.text_queries import table
from modspark.plans.text_sql import verdicts
from modspark.sources.tables import read_messages
from modspark.streaming import keyed as S

HOUR, DAY = 3600 * SECOND, 86400 * SECOND
FAST, BURST, WAIT, QUOTA, STRIKES = (3, DAY), (10, 4 * DAY), 6 * HOUR, 2, 3 * DAY
AS_OF_US = 1_706_659_200_000_000  # 2024-01-31
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def events(spark, sf):
    return with_micros(table(spark, sf, "events"))


FLOOD_SQL = """with c as (select event_id, ts, lag(ts, 3) over w as third, lag(ts, 10) over w as tenth from events window w as (partition by user_id order by ts, event_id))
  select event_id, case when third > ts - interval 1 day then 'fast' when tenth > ts - interval 4 days then 'burst' end as flood from c"""
QUOTA_SQL = """with c as (select event_id, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as rn from events)
  select event_id, rn <= 2 as quota_ok, least(rn, 2) as quota_count from c"""


def folded(key: str, source: str, wait: str, comparison: str) -> str:
    """Recursive walk over the rows of a key: rn, last accepted time, accepted."""
    return f"""with recursive e as (select *, row_number() over (partition by {key} order by ts, event_id) as rn from ({source})),
  f as (select e.event_id, e.{key}, e.ts, e.rn, true as accepted, e.ts as last from e where rn = 1
   union all select e.event_id, e.{key}, e.ts, e.rn, e.ts - f.last {comparison} interval {wait}, case when e.ts - f.last {comparison} interval {wait} then e.ts else f.last end
   from f join e on e.{key} = f.{key} and e.rn = f.rn + 1)"""


COOLDOWN_SQL = folded("user_id", "select * from events", "6 hours", ">=") + """
  select event_id, accepted, case when not accepted then (21600000000 - (epoch_us(ts) - epoch_us(last))) // 1000000 + 1 end as wait_s from f"""
STRIKES_SQL = """with c as (select event_id, ts, least(4, count(*) over (partition by user_id order by ts range between interval 3 days preceding and current row)) as strike
   from events where event_type = 'error')
  select event_id, strike, case strike when 3 then 15 when 4 then 120 end as mute_minutes from c"""


@query(FLOOD_SQL)
def flood_check(spark, sf):
    return A.flood(events(spark, sf), "user_id", "event_id", FAST, BURST).select("event_id", "flood")


@query(QUOTA_SQL)
def hourly_quota(spark, sf):
    return A.hourly_quota(events(spark, sf), "user_id", "event_id", QUOTA, DAY).select("event_id", "quota_ok", "quota_count")


@query("""select user_id, date_trunc('hour', ts) as hour, least(count(*), 10) as count from events group by all""")
def hourly_counts(spark, sf):
    """A4."""
    out = A.hourly_counts(events(spark, sf), "user_id", 10).withColumn("us", F.col("bucket") * HOUR)
    return out.select("user_id", from_micros("us").alias("hour"), "count")


@query(COOLDOWN_SQL)
def cooldown(spark, sf):
    return A.cooldown(events(spark, sf), ["user_id"], "event_id", WAIT).select("event_id", "accepted", "wait_s")


@query("""with c as (select event_id, ts, least(4, count(*) over (partition by user_id order by ts range between interval 3 days preceding and current row)) as strike
   from events where event_type = 'error'), d as (select *, case strike when 3 then 15 when 4 then 120 end as mute_minutes from c)
  select event_id, strike, mute_minutes, case strike when 1 then 'none' when 2 then 'warning' when 3 then 'AUTO_MUTE' else 'AUTO_MUTE_EXTENDED' end as penalty,
   ts + mute_minutes * interval 1 minute as muted_until from d""")
def strike_ladder(spark, sf):
    errors = events(spark, sf).where("event_type = 'error'")
    return A.strikes(errors, "user_id", "event_id", STRIKES).select("event_id", "strike", "penalty", "mute_minutes", "muted_until")


@query("""select event_id, count(*) over (partition by event_type, props order by epoch_us(ts) range between 3600000000 preceding and current row) > 1 as duplicate from events""")
def duplicate_window(spark, sf):
    """W6, J6, F6."""
    return A.duplicates(events(spark, sf), ["event_type", "props"], "event_id", HOUR).select("event_id", "duplicate")


DUPLICATE_SQL = folded("mark", "select *, event_type || props as mark from events", "1 day", ">") + " select event_id, accepted from f"


@query(DUPLICATE_SQL)
def duplicate_recorded(spark, sf):
    """W6, exact form: rejected duplicates are not recorded."""
    return A.cooldown(events(spark, sf), ["event_type", "props"], "event_id", DAY, closed=False).select("event_id", "accepted")


ACTIONS_SQL = """a as (select event_id, user_id, ts, case when event_type = 'error' then 600 + event_id % 7 * 300 end as minutes from events where event_type in ('error', 'purchase'))"""


def _actions(spark, sf):
    ev = events(spark, sf).where("event_type in ('error', 'purchase')")
    return ev.select("event_id", "user_id", "us", F.when(F.col("event_type") == "error", 600 + F.col("event_id") % 7 * 300).alias("minutes"))


@query(f"""with {ACTIONS_SQL}, n as (select *, lead(ts) over (partition by user_id order by ts, event_id) as nxt from a)
  select event_id, user_id, ts as start, least(ts + minutes * interval 1 minute, coalesce(nxt, ts + minutes * interval 1 minute)) as until from n where minutes is not null""")
def mute_timeline(spark, sf):
    return A.mute_timeline(_actions(spark, sf), "user_id", "event_id").select(
        "event_id", "user_id", from_micros("start_us").alias("start"), from_micros("end_us").alias("until"))


@query(f"""with {ACTIONS_SQL}, m as (select * from events where event_type in ('view', 'click'))
  select m.event_id, coalesce(a.ts + a.minutes * interval 1 minute > m.ts, false) as muted from m asof left join a on m.user_id = a.user_id and m.ts >= a.ts""")
def muted_asof(spark, sf):
    asked = events(spark, sf).where("event_type in ('view', 'click')")
    return A.muted_at(asked, _actions(spark, sf), "user_id", "event_id").select("event_id", "muted")


def _attempts(spark, sf):
    tried = events(spark, sf).where("event_type in ('error', 'signup')")
    return tried.withColumn("ok", F.col("event_type") == "signup")


LOCKOUT_SQL = """with recursive e as (select event_id, user_id, epoch_us(ts) as us, event_type = 'signup' as ok,
    row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type in ('error', 'signup')),
  g as (select event_id, user_id, us, ok, rn, case when ok then 'ok' else 'failed' end as outcome, case when ok then []::bigint[] else [us] end as fails from e where rn = 1
   union all select n.event_id, n.user_id, n.us, n.ok, n.rn, n.outcome,
     case n.outcome when 'locked' then n.old when 'ok' then []::bigint[] else list_append(n.live, n.us) end
   from (select x.*, case when len(live) >= 3 and 259200000000 - (us - live[1]) >= 1000000 then 'locked' when ok then 'ok' else 'failed' end as outcome
     from (select e.*, g.fails as old, list_filter(g.fails, lambda t: e.us - t < 259200000000) as live from g join e on e.user_id = g.user_id and e.rn = g.rn + 1) x) n)
  select event_id, outcome from g"""


@query(LOCKOUT_SQL)
def login_lockout(spark, sf):
    """W5."""
    return A.lockout(_attempts(spark, sf), "user_id", "event_id", "ok", 3, 3 * DAY).select("event_id", "outcome")


@query("""select user_id, event_type, count(*) as n_recent from events where ts >= timestamp '2024-01-31' - interval 5 days and ts <= timestamp '2024-01-31' group by all""")
def recent_security_events(spark, sf):
    """A3, F7."""
    return A.recent_counts(events(spark, sf), "user_id", "event_type", F.lit(AS_OF_US), 5 * DAY)


@query("""select event_id as id, ts from events where event_type = 'error' and ts between timestamp '2024-01-26' and timestamp '2024-01-31' order by ts, event_id""")
def recent_attempts(spark, sf):
    """O2."""
    from modspark.operators.ledger import attempts_in_window
    tried = events(spark, sf).where("event_type = 'error'").withColumnRenamed("event_id", "id")
    return attempts_in_window(tried, F.lit(AS_OF_US), 5 * DAY).select("id", "ts")


PEOPLE_SQL = """p as (select s_suppkey as user_id, s_acctbal < 0 as is_banned, s_nationkey < 5 as muted, s_nationkey <> 7 as member from supplier)"""


def _people(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("user_id"), (F.col("s_acctbal") < 0).alias("is_banned"),
        F.when(F.col("s_nationkey") < 5, AS_OF_US).alias("muted_until_us"),
        F.when(F.col("s_nationkey") != 7, "member").otherwise("left").alias("status"))


@query(f"""with {PEOPLE_SQL} select event_id, case when is_banned then 'banned' when muted and ts < timestamp '2024-01-31' then 'muted' end as stopped_by
  from events left join p using (user_id)""")
def account_gate(spark, sf):
    """F3."""
    return A.account_gate(events(spark, sf), _people(spark, sf), "user_id", F.col("us")).select("event_id", "stopped_by")


@query(f"""with recursive {PEOPLE_SQL},
  fl as ({FLOOD_SQL}),
  s1 as (select e.*, case when flood is not null then 'flood' when not coalesce(member, false) then 'not_member' when is_banned then 'banned' when muted then 'muted'
    when event_type = 'signup' then 'unsupported' when length(props) > 9 then 'too_long' end as early from events e join fl using (event_id) left join p using (user_id)),
  o as (select event_id, user_id, ts, event_type || props as mark from s1 where early is null),
  r as (select *, row_number() over (partition by mark order by ts, event_id) as rn from o),
  f as (select event_id, user_id, mark, ts, rn, true as accepted, ts as last from r where rn = 1
    union all select r.event_id, r.user_id, r.mark, r.ts, r.rn, r.ts - f.last > interval 1 day, case when r.ts - f.last > interval 1 day then r.ts else f.last end
    from f join r on r.mark = f.mark and r.rn = f.rn + 1),
  q as (select event_id, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as n from f where accepted)
  select s1.event_id, coalesce(early, case when not f.accepted then 'duplicate' when q.n > 1 then 'quota' end) as reject_reason
  from s1 left join f using (event_id) left join q using (event_id)""")
def admission_gate(spark, sf):
    """V8."""
    ev = events(spark, sf).withColumns({"supported": F.col("event_type") != "signup", "n_chars": F.length("props")})
    people = _people(spark, sf)
    return A.admit(ev, "user_id", "event_id", flood_fast=FAST, flood_burst=BURST, members=people, students=people,
                   fingerprint=["event_type", "props"], duplicate_span=DAY, quota=1, max_length=9).select("event_id", "reject_reason")


# --- streams ------------------------------------------------------------------------------

def _stream(spark, sf, flag=None):
    S.use_state_store(spark)
    rows = with_micros(read_messages(spark, f"{sf}/events.parquet"))
    return rows.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "us", "event_type", (
        F.lit(False) if flag is None else flag).alias("flag"))


@query(FLOOD_SQL)
def stream_flood(spark, sf):
    """ST2."""
    out = S.run_once(S.decide_stream(_stream(spark, sf), S.flood_rule(FAST, BURST), {"flood": "string"}), "flood")
    return out.select(F.col("id").alias("event_id"), "flood")


@query(QUOTA_SQL)
def stream_quota(spark, sf):
    """ST1."""
    out = S.run_once(S.decide_stream(_stream(spark, sf), S.quota_rule(QUOTA, DAY), {"quota_ok": "boolean", "quota_count": "int"}), "quota")
    return out.select(F.col("id").alias("event_id"), "quota_ok", "quota_count")


@query(COOLDOWN_SQL)
def stream_cooldown(spark, sf):
    """ST3."""
    out = S.run_once(S.decide_stream(_stream(spark, sf), S.cooldown_rule(WAIT), {"accepted": "boolean", "wait_s": "bigint"}), "cooldown")
    return out.select(F.col("id").alias("event_id"), "accepted", "wait_s")


@query("""with c as (select event_id, user_id, ts, least(4, count(*) over (partition by user_id order by ts range between interval 3 days preceding and current row)) as strike
    from events where event_type = 'error'),
  m as (select *, case strike when 3 then 15 when 4 then 120 end as mute_minutes from c)
  select event_id, strike, mute_minutes, coalesce(last_value(ts + to_minutes(mute_minutes) ignore nulls) over (
    partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) > ts, false) as muted from m""")
def stream_strikes(spark, sf):
    """ST4."""
    rows = _stream(spark, sf).where("event_type = 'error'")
    out = S.run_once(S.decide_stream(rows, S.strike_rule(STRIKES), {"strike": "int", "mute_minutes": "int", "muted": "boolean"}), "strikes")
    return out.select(F.col("id").alias("event_id"), "strike", "mute_minutes", "muted")


@query(LOCKOUT_SQL)
def stream_lockout(spark, sf):
    """ST8."""
    rows = _stream(spark, sf, F.col("event_type") == "signup").where("event_type in ('error', 'signup')")
    out = S.run_once(S.decide_stream(rows, S.lockout_rule(3, 3 * DAY), {"outcome": "string"}), "lockout")
    return out.select(F.col("id").alias("event_id"), "outcome")


@query("select user_id, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2")
def stream_hourly_totals(spark, sf):
    """ST1: every hour, late messages and open hours too."""
    return S.all_hourly_totals(read_messages(spark, f"{sf}/events.parquet"), "user_id", run_dir(spark, "totals"))


@query(DUPLICATE_SQL)
def stream_duplicates(spark, sf):
    """ST5."""
    S.use_state_store(spark)
    rows = with_micros(read_messages(spark, f"{sf}/events.parquet")).select(
        F.concat("event_type", "props").alias("key"), F.col("event_id").alias("id"), "us", F.lit(False).alias("flag"))
    out = S.run_once(S.decide_stream(rows, S.cooldown_rule(DAY, closed=False), {"accepted": "boolean", "wait_s": "bigint"}), "duplicates")
    return out.select(F.col("id").alias("event_id"), "accepted")


@query("""select o_custkey as id, arg_max(case o_orderstatus when 'F' then 'published' when 'O' then 'pending' else 'failed' end, (o_orderdate, o_orderkey)) as status from orders group by 1""")
def stream_states(spark, sf):
    """ST6: every order is a life-cycle event of its customer."""
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    rows = with_micros(read_messages(spark, f"{sf}/orders.parquet", schema), "o_orderdate")
    event = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    told = rows.select(F.col("o_custkey").alias("id"), event.alias("event"), (F.col("us") + F.col("o_orderkey")).alias("us"), F.col("o_orderkey").alias("message_id"))
    return S.merge_states(told, "states").select("id", "status")


TALK = "select conv_id || '/' || turn as k, text as raw from conversations"


@query(f"with {verdicts(TALK)} select split_part(k, '/', 1)::bigint as conv_id, split_part(k, '/', 2)::bigint as turn, * exclude (k) from verdicts")
def stream_moderate(spark, sf):
    """ST7: the narrow layers of the cascade on a stream; no state at all."""
    rows = read_messages(spark, f"{sf}/conversations.parquet", "conv_id bigint, turn bigint, role string, text string")
    judged = V.moderate(rows, "conv_id", "text", V.lexicon_from(spark), fuzzy=False)
    return S.run_once(V.flat(judged, "conv_id", "turn"), "moderated")
