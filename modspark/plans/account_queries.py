"""Registered queries over identities, ledger and roles, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from modspark import schemas
from modspark.durable import run_dir
from modspark.functions import crypto as K
from modspark.functions import text as T
from modspark.functions.times import hour_label, micros, mute_minutes, parse_timestamp
from modspark.operators import identity as I
from modspark.operators import ledger as G
from modspark.operators import roles as O
from modspark.plans import migrate as M
from modspark.plans.text_queries import KEY, table

BLIND, SEAL = K.derive_key(KEY, b"blind-index"), K.derive_key(KEY, b"sealed-columns")
DAY = 86_400_000_000
AS_OF = "timestamp_ntz'2001-08-01 00:00:00'"
AS_OF_US = 996_624_000_000_000

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def hmac_sql(x: str) -> str:
    inner, outer = (p.hex() for p in K.pads(BLIND))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || ({x})::varchar::blob)))"


# --- tables in the roles of the ledger ---------------------------------------------

def people(spark, sf):
    """Customers as registered students."""
    c = table(spark, sf, "customer")
    return c.select(
        (F.col("c_custkey") + 101).alias("anonymous_id"), K.blind_index(F.col("c_custkey"), BLIND).alias("user_hash"),
        K.encrypt(F.col("c_custkey"), SEAL).alias("enc_telegram_id"), K.encrypt(F.col("c_name"), SEAL).alias("enc_full_name"),
        F.lit(None).cast("string").alias("enc_username"), (F.col("c_acctbal") < 0).alias("is_banned"),
        F.when(F.col("c_acctbal") < 0, F.lit("debt")).alias("ban_reason"), F.lit(None).cast("timestamp_ntz").alias("muted_until"),
        F.expr("timestamp_ntz'1995-01-01 00:00:00'").alias("created_at"), F.expr("timestamp_ntz'1995-01-01 00:00:00'").alias("last_active_at"),
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey")


def messages(spark, sf):
    """Orders as posts (urgent or high priority) and replies (the others)."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("message_id"), (F.col("o_custkey") + 101).alias("anonymous_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "post").otherwise("reply").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "P").alias("is_deleted"), F.col("o_orderpriority").alias("content_preview"))


def posts_and_replies(spark, sf):
    m = messages(spark, sf)
    return (m.where("kind = 'post'").withColumnRenamed("message_id", "channel_message_id"),
            m.where("kind = 'reply'").withColumnRenamed("message_id", "reply_channel_msg_id"))


MESSAGES_SQL = """m as (select o_orderkey as message_id, o_custkey + 101 as anonymous_id,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'post' else 'reply' end as kind,
  case o_orderstatus when 'F' then 'published' when 'O' then 'pending' else 'failed' end as status,
  o_orderdate as ts, o_orderstatus = 'P' as is_deleted, o_orderpriority as content_preview from orders)"""


# --- identity ------------------------------------------------------------------------

@query(f"select c_custkey, {hmac_sql('c_custkey')} as user_hash from customer")
def blind_index(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", K.blind_index(F.col("c_custkey"), BLIND).alias("user_hash"))


@query(f"""with s as (select {hmac_sql('o_custkey')} as user_hash, min(o_orderdate) as first_seen from orders group by 1)
  select user_hash, first_seen, 100 + row_number() over (order by first_seen, user_hash) as anonymous_id from s""")
def pseudonyms(spark, sf):
    return I.assign_pseudonyms(table(spark, sf, "orders"), None, BLIND, "o_custkey", "o_orderdate").select(
        "user_hash", "first_seen", "anonymous_id")


@query(f"""with known as (select s_suppkey as id, 101 + s_suppkey as anonymous_id, s_name, s_acctbal from supplier),
  batch as (select o_custkey as id, min(o_orderdate) as first_ts, max(o_orderdate) as last_ts,
    arg_max(o_orderstatus, o_orderkey) as x from orders group by 1),
  top as (select coalesce(max(anonymous_id), 100) as t from known),
  fresh as (select b.id, t + row_number() over (order by first_ts, {hmac_sql('b.id')}) as number from batch b, top where b.id not in (select id from known)),
  a as (select coalesce(k.id, b.id) as id, k.anonymous_id, f.number, b.last_ts, k.s_acctbal from known k full join batch b on k.id = b.id left join fresh f on f.id = b.id)
  select coalesce(anonymous_id, number) as anonymous_id, {hmac_sql('id')} as user_hash, id as telegram_id,
    case when last_ts is not null then 'Name ' || id else (select s_name from supplier where s_suppkey = id) end as full_name,
    last_ts is not null and coalesce(s_acctbal, 0) < 0 as is_banned, case when last_ts is not null and s_acctbal < 0 then 'lasting' end as ban_reason,
    greatest(timestamp '1995-01-01', coalesce(last_ts, timestamp '1995-01-01')) as last_active_at from a""")
def register_batch(spark, sf):
    """Suppliers are known, everybody who ordered registers; those in debt left a fingerprint."""
    s = table(spark, sf, "supplier")
    start = F.expr("timestamp_ntz'1995-01-01 00:00:00'")
    known = s.select(
        (F.col("s_suppkey") + 101).alias("anonymous_id"), K.blind_index(F.col("s_suppkey"), BLIND).alias("user_hash"),
        K.encrypt(F.col("s_suppkey"), SEAL).alias("enc_telegram_id"), K.encrypt(F.col("s_name"), SEAL).alias("enc_full_name"),
        F.lit(None).cast("string").alias("enc_username"), F.lit(False).alias("is_banned"), F.lit(None).cast("string").alias("ban_reason"),
        F.lit(None).cast("timestamp_ntz").alias("muted_until"), start.alias("created_at"), start.alias("last_active_at"))
    prints = s.where("s_acctbal < 0").select(K.blind_index(F.col("s_suppkey"), BLIND).alias("id_hash"), F.lit("lasting").alias("reason"))
    batch = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("telegram_id"), F.concat(F.lit("Name "), F.col("o_custkey").cast("string")).alias("full_name"),
        F.lit(None).cast("string").alias("username"), F.col("o_orderdate").alias("ts"))
    out = I.register(batch, known, prints, BLIND, SEAL)
    return out.select("anonymous_id", "user_hash", K.decrypt_int(F.col("enc_telegram_id"), SEAL).alias("telegram_id"),
                      K.decrypt(F.col("enc_full_name"), SEAL).alias("full_name"), "is_banned", "ban_reason", "last_active_at")


@query(f"""with c as (select *, c_custkey + 101 as number, c_acctbal < 0 as ban, c_mktsegment = 'BUILDING' as gone from customer),
  t as (select max(number) as top from c),
  old as (select number as anonymous_id, case when gone then 'erased on request' when ban then 'spam' end as ban_reason, gone or ban as is_banned,
    case when gone then 'WIPED_' || number || '_1000' else {hmac_sql('c_custkey')} end as user_hash from c),
  again as (select top + row_number() over (order by {hmac_sql('c_custkey')}) as anonymous_id, case when ban then 'spam' end as ban_reason, ban as is_banned,
    {hmac_sql('c_custkey')} as user_hash from c, t where gone)
  select * from old union all select * from again""")
def erase_and_rejoin(spark, sf):
    """Ban, erase, register again: a new number, and the ban comes back."""
    base = people(spark, sf).withColumns({"is_banned": F.lit(False), "ban_reason": F.lit(None).cast("string")})
    c = table(spark, sf, "customer")
    ts = F.expr("timestamp_ntz'2000-01-01 00:00:00'")
    bans = c.where("c_acctbal < 0").select((F.col("c_custkey") + 101).alias("anonymous_id"), F.lit("ban").alias("verb"),
                                           F.lit(None).cast("int").alias("minutes"), F.lit("spam").alias("reason"), ts.alias("ts"), F.col("c_custkey").alias("id"))
    none = spark.createDataFrame([], "id_hash string, reason string, banned_at timestamp_ntz")
    students = base.drop("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    banned_people, prints = I.apply_bans(students, none, bans)
    requests = c.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 101).alias("anonymous_id"), F.lit(1000).cast("bigint").alias("us"))
    erased = I.erase(banned_people, requests)
    batch = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("telegram_id"), F.col("c_name").alias("full_name"),
                                                         F.lit(None).cast("string").alias("username"), ts.alias("ts"))
    return I.register(batch, erased, prints, BLIND, SEAL).select("anonymous_id", "user_hash", "is_banned", "ban_reason")


@query(f"""with c as (select c_custkey + 101 as anonymous_id, c_acctbal, c_custkey, c_nationkey from customer),
  a as (select c.*, case when c_nationkey < 5 then 'ban' when c_nationkey < 10 then 'unban' end as verb from c)
  select anonymous_id, case verb when 'ban' then true when 'unban' then false else c_acctbal < 0 end as is_banned,
    case verb when 'ban' then 'rude' when 'unban' then null else case when c_acctbal < 0 then 'debt' end end as ban_reason,
    case when verb = 'ban' then true when verb = 'unban' then false else c_acctbal < 0 end as has_print,
    case when c_nationkey between 10 and 14 then timestamp '2000-01-01' + (c_nationkey * interval 1 minute) end as muted_until from a""")
def staff_actions(spark, sf):
    """Bans, unbans and mutes as one action table."""
    s = people(spark, sf)
    ts = F.expr("timestamp_ntz'2000-01-01 00:00:00'")
    n = F.col("c_nationkey")
    verb = F.when(n < 5, "ban").when(n < 10, "unban").when(n < 15, "mute").when(n < 20, "unmute")
    acts = s.select("anonymous_id", verb.alias("verb"), n.alias("minutes"), F.lit("rude").alias("reason"), ts.alias("ts"), F.col("c_custkey").alias("id")).where("verb is not null")
    prints = s.where("is_banned").select(F.col("user_hash").alias("id_hash"), F.lit("debt").alias("reason"), ts.alias("banned_at"))
    after, marks = I.apply_bans(s, prints, acts)
    after = I.apply_mutes(after, acts).join(marks.select(F.col("id_hash").alias("user_hash"), F.lit(True).alias("has_print")), "user_hash", "left")
    return after.select("anonymous_id", "is_banned", "ban_reason", F.coalesce("has_print", F.lit(False)).alias("has_print"), "muted_until")


@query("select c_custkey + 101 as anonymous_id, c_acctbal < 0 as is_banned, c_custkey, c_name, c_mktsegment, c_nationkey from customer")
def public_view(spark, sf):
    return schemas.students_public(people(spark, sf)).drop("ban_reason", "muted_until", "created_at", "last_active_at")


@query("select c_custkey + 101 as anonymous_id from customer where c_acctbal >= 0 and c_mktsegment <> 'BUILDING'")
def active_audience(spark, sf):
    s = people(spark, sf)
    gone = s.where("c_mktsegment = 'BUILDING'").select("anonymous_id", F.lit(5).cast("bigint").alias("us"))
    return I.active_audience(I.erase(s, gone)).select("anonymous_id")


@query("select c_custkey, c_name as name, c_custkey as number, '[WIPED]' as erased, '[UNREADABLE]' as broken, null as empty from customer")
def encrypt_roundtrip(spark, sf):
    c = table(spark, sf, "customer")
    sealed = c.select("c_custkey", K.encrypt(F.col("c_name"), SEAL).alias("n"), K.encrypt(F.col("c_custkey"), SEAL).alias("k"))
    return sealed.select("c_custkey", K.decrypt(F.col("n"), SEAL).alias("name"), K.decrypt_int(F.col("k"), SEAL).alias("number"),
                         K.decrypt(F.lit(K.ERASED), SEAL).alias("erased"), K.decrypt(F.concat(F.lit("AAAA"), "n"), SEAL).alias("broken"),
                         K.decrypt(F.lit(""), SEAL).alias("empty"))


ROLES = [(0, 0, "primary_admin"), (1, 1, "moderator"), (2, 1, "moderator"), (2, 2, "moderator"), (7, 2, "moderator")]
ROLE_SQL = "roles(id, priority, role) as (values " + ", ".join(f"({i}, {p}, '{r}')" for i, p, r in ROLES) + ")"


@query(f"""with {ROLE_SQL}, r as (select id, arg_min(role, priority) as role from roles group by id)
  select l_suppkey as caller, 101 + c_custkey as anonymous_id, coalesce(role = 'primary_admin', false) as revealed,
   case when role = 'primary_admin' then c_name end as full_name, null as username, case when role = 'primary_admin' then c_custkey end as telegram_id
  from (select distinct l_suppkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey) a
  left join r on r.id = l_suppkey join customer on c_custkey = o_custkey""")
def identity_reveal(spark, sf):
    """K6: suppliers ask about the customers they delivered to."""
    asked = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("id"), (F.col("o_custkey") + 101).alias("anonymous_id")).distinct()
    callers = O.with_role(asked, spark.createDataFrame(ROLES, "id bigint, priority int, role string"), "id").select(
        F.col("id").alias("caller"), F.coalesce("role", F.lit("none")).alias("role"), F.lit(True).alias("session_ok"), "anonymous_id")
    return I.reveal(people(spark, sf), callers, SEAL)


@query(f"""with {ROLE_SQL}, r as (select id, arg_min(role, priority) as role from roles group by id),
  m as (select c_custkey as id, case c_nationkey % 6 when 0 then 'member' when 1 then 'administrator' when 2 then 'creator' when 3 then 'restricted' when 4 then 'left' end as status from customer)
  select u.c_custkey as id, role, coalesce(role in ('primary_admin', 'moderator'), false) as staff, coalesce(status in ('member', 'administrator', 'creator'), false) as member,
   coalesce(role is not null and c_acctbal >= 0, false) as live from customer u left join r on r.id = c_custkey left join m on m.id = c_custkey""")
def roles_and_members(spark, sf):
    """J8, F4, F5, F9."""
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    users = O.with_role(c, spark.createDataFrame(ROLES, "id bigint, priority int, role string"), "id")
    n = F.col("c_nationkey") % 6
    status = F.when(n == 0, "member").when(n == 1, "administrator").when(n == 2, "creator").when(n == 3, "restricted").when(n == 4, "left")
    inside = O.members_only(c.select("id"), c.select("id", status.alias("status")), "id").withColumn("member", F.lit(True))
    staff = O.only_roles(users, *O.STAFF).select("id", F.lit(True).alias("staff"))
    sessions = users.select("id", "role", (F.lit(AS_OF_US) - F.when(F.col("c_acctbal") >= 0, 60_000_000).otherwise(DAY)).alias("us"))
    live = O.live_sessions(sessions, F.lit(AS_OF_US)).select("id", F.lit(True).alias("live"))
    out = users.select("id", "role").join(staff, "id", "left").join(inside, "id", "left").join(live, "id", "left")
    return out.na.fill(False, ["staff", "member", "live"])


@query("""select event_id from events where not (user_id in (select s_suppkey from supplier where s_acctbal < 0)) and not starts_with(event_type, 'sign') and not starts_with(event_type, 'view')""")
def limited_messages(spark, sf):
    """Staff and two kinds of command are exempt."""
    staff = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    return O.limited(table(spark, sf, "events"), staff, "user_id", "event_type", ("sign", "view")).select("event_id")


# --- ledger -----------------------------------------------------------------------------

@query(f"""with {MESSAGES_SQL} select l_orderkey as message_id, l_linenumber, l_partkey, m.kind, m.anonymous_id, c_name from lineitem
  left join m on m.message_id = l_orderkey left join customer on c_custkey + 101 = m.anonymous_id""")
def author_lookup(spark, sf):
    posts, replies = posts_and_replies(spark, sf)
    asked = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("message_id"), "l_linenumber", "l_partkey")
    out = G.authors_of(asked, posts, replies, people(spark, sf).select("anonymous_id", "c_name"))
    return out.select("message_id", "l_linenumber", "l_partkey", "kind", "anonymous_id", "c_name")


@query(f"""with {MESSAGES_SQL}, q as (select c_custkey, c_custkey * 7 as number from customer)
  select q.c_custkey, q.number, coalesce(m.anonymous_id, s.c_custkey + 101) as anonymous_id,
    case when m.message_id is not null then m.kind when s.c_custkey is not null then 'student' end as found_as
  from q left join m on m.message_id = q.number left join customer s on s.c_custkey + 101 = q.number""")
def whois_lookup(spark, sf):
    """J2, X28."""
    asked = table(spark, sf, "customer").select("c_custkey", T.numeric_key(
        F.concat(F.lit(" #"), (F.col("c_custkey") * 7).cast("string"))).alias("number"))
    posts, replies = posts_and_replies(spark, sf)
    return G.whois(asked, posts, replies, people(spark, sf).select("anonymous_id"))


@query("""select l_orderkey as parent, l_linenumber, l_partkey, true as kept from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'P')
  union all select l_orderkey, l_linenumber, l_partkey, false from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')""")
def reply_parent_check(spark, sf):
    """J4."""
    replies = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), "l_linenumber", "l_partkey")
    live = messages(spark, sf).where(~F.col("is_deleted"))
    kept = G.with_parent(replies, live, "parent").withColumn("kept", F.lit(True))
    return kept.unionByName(G.with_parent(replies, live, "parent", keep=False).withColumn("kept", F.lit(False)))


@query("""select l_linenumber, l_partkey, case when o_orderkey is not null then l_orderkey end as parent, l_orderkey as asked from lineitem
  left join orders on o_orderkey = l_orderkey and o_orderstatus <> 'P'""")
def orphan_replies(spark, sf):
    """S10."""
    replies = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), "l_linenumber", "l_partkey", F.col("l_orderkey").alias("asked"))
    return G.root_if_orphan(replies, messages(spark, sf).where(~F.col("is_deleted")), "parent")


@query("select event_id, user_id as anonymous_id from events where user_id not in (select s_suppkey from supplier)")
def fk_audit(spark, sf):
    """J10."""
    owners = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("anonymous_id"))
    return G.without_owner(table(spark, sf, "events").select("event_id", F.col("user_id").alias("anonymous_id")), owners)


@query(f"""with {MESSAGES_SQL} select (select count(*) from customer) as students, (select count(*) from m where kind = 'post' and not is_deleted) as live_posts,
  (select count(*) from m where kind = 'reply' and not is_deleted) as live_replies, (select count(*) from customer where c_acctbal < 0) as banned, true as intake_open""")
def system_stats(spark, sf):
    posts, replies = posts_and_replies(spark, sf)
    settings = table(spark, sf, "region").select(F.lower("r_name").alias("key"), F.lit("false").alias("value"))
    return G.system_stats(people(spark, sf), posts, replies, settings)


@query(f"""with {MESSAGES_SQL} select anonymous_id, count(*) filter (status = 'published' and kind = 'post') as total_posts,
  count(*) filter (status = 'published' and kind = 'reply') as total_replies, max(ts) filter (status = 'published') as last_active_at from m group by 1""")
def student_counters(spark, sf):
    return G.student_counters(messages(spark, sf))


@query("""select o_orderkey as id, o_custkey as admin_id, case o_orderstatus when 'F' then 'BAN' when 'O' then 'MUTE' else 'WHOIS' end as action
  from orders order by o_orderkey desc limit 15 offset 30""")
def recent_audit(spark, sf):
    """O1, D9."""
    o = table(spark, sf, "orders")
    acts = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("admin_id"),
                    F.when(F.col("o_orderstatus") == "F", "ban").when(F.col("o_orderstatus") == "O", "mute").otherwise("whois").alias("action"))
    return G.recent_page(acts.withColumn("action", F.upper("action")), 15, 30)


@query("""select coalesce(case when o_orderstatus = 'F' then null else o_custkey end, 0) as admin_id, case o_orderstatus when 'F' then 'AUTO_MUTE' else 'BAN' end as action,
  o_custkey + 101 as target_anonymous_id, o_orderpriority as details, o_orderdate as created_at from orders""")
def audit_entries(spark, sf):
    """Automatic actions carry admin 0."""
    o = table(spark, sf, "orders")
    auto = F.col("o_orderstatus") == "F"
    return G.audit_entries(o.select(
        F.when(~auto, F.col("o_custkey")).alias("admin_id"), F.when(auto, "auto_mute").otherwise("ban").alias("action"),
        (F.col("o_custkey") + 101).alias("anonymous_id"), F.col("o_orderpriority").alias("details"), F.col("o_orderdate").alias("ts")))


@query("""with l as (select n_name as key, coalesce(r.r_name, 'unset') as value from nation left join region r on r.r_regionkey = n_nationkey)
  select * from l""")
def setting_lookup(spark, sf):
    """F1 with defaults."""
    settings = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_nationkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("key"), F.col("r_name").alias("value"))
    return G.setting(settings, table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.lit("unset").alias("default")))


@query("""with w as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders)
  select coalesce(c_custkey, o_custkey) as id, c_name as name, case when o_custkey is not null then o_orderpriority else c_mktsegment end as value
  from customer full join (select * from w where rn = 1) on c_custkey = o_custkey""")
def upsert_latest(spark, sf):
    """The last order of a customer rewrites one column."""
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("value"))
    source = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit(None).cast("string").alias("name"),
                                               F.col("o_orderpriority").alias("value"), "o_orderdate", "o_orderkey")
    return G.upsert(target, source, ["id"], ["value"], F.col("o_orderdate"), F.col("o_orderkey"))


@query("""with s as (select o_custkey as id, min(o_orderkey) as first from orders group by 1)
  select s_suppkey as id, -1 as first from supplier union all select id, first from s where id not in (select s_suppkey from supplier)""")
def insert_if_absent(spark, sf):
    """U2."""
    target = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(-1).cast("bigint").alias("first"))
    source = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first"))
    return G.insert_if_absent(target, source, ["id"], F.col("first"))


@query("""with e as (select o_custkey as id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s, max((o_orderdate, o_orderkey)) as x, count(*) as n from orders group by 1),
  l as (select id, case s when 'F' then 'published' when 'O' then 'pending' else 'failed' end as status, x[2] as k from e)
  select id, status, case when status = 'published' then k end as message_id, status = 'failed' as is_deleted from l""")
def submission_states(spark, sf):
    """The last event of each submission; of events at one time the one with the highest message id."""
    e = messages(spark, sf).select((F.col("anonymous_id") - 101).alias("id"), F.col("status").alias("event"),
                                   micros("ts").alias("us"), "message_id")
    return G.lifecycle(e)


@query("""with e as (select o_custkey as id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s, min(o_orderdate) as t from orders group by 1)
  select id, 'pending' as status from e where s = 'O' and t < timestamp '1997-01-01'""")
def stale_submissions(spark, sf):
    """Submissions still pending long after they came in."""
    e = messages(spark, sf).select((F.col("anonymous_id") - 101).alias("id"), F.col("status").alias("event"), micros("ts").alias("us"), "message_id")
    first = e.groupBy("id").agg(F.min("us").alias("us"))
    return G.stale_pending(G.lifecycle(e), first, F.lit(852_076_800_000_000 + DAY), DAY).select("id", "status")


@query("""select o_orderkey as message_id, o_orderstatus = 'P' or o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') as is_deleted from orders""")
def soft_delete(spark, sf):
    """D7."""
    asked = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("message_id"))
    return G.soft_delete(messages(spark, sf).select("message_id", "is_deleted"), asked)


@query("""with t as (select event_type as key, count(*) as n from events group by 1) select key, n % 2 = 0 as enabled from t""")
def settings_toggle(spark, sf):
    """Every event flips the switch of its type."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("key"))
    return G.toggled(ev.distinct().withColumn("enabled", F.lit(True)), ev)


@query("""select key, arg_max(value, (updated_at, event_id)) as value, max(updated_at) as updated_at from (select event_type as key, props as value, ts as updated_at, event_id from events) group by 1""")
def settings_write(spark, sf):
    """D8 / W8."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("ts").alias("updated_at"), "event_id")
    none = spark.createDataFrame([], "key string, value string, updated_at timestamp_ntz")
    return G.write_settings(none, ev, F.col("event_id"))


@query("select l_returnflag = 'N' as delivered, count(*) as n from lineitem group by 1")
def delivery_tally(spark, sf):
    return G.delivery_tally(table(spark, sf, "lineitem").select((F.col("l_returnflag") == "N").alias("delivered")), "delivered")


def _old_and_new(spark, sf):
    """Seven tables of an old store, which lack columns, and a new one that holds rows of five of them."""
    from modspark.sources.tables import align

    t = lambda name: table(spark, sf, name)
    source = {
        "students": t("customer").select(
            F.col("c_custkey").alias("anonymous_id"), F.col("c_name").alias("user_hash"), F.col("c_mktsegment").alias("enc_full_name"),
            (F.col("c_acctbal") < 0).alias("is_banned")),
        "banned_fingerprints": t("customer").where("c_acctbal < 0").select(F.md5("c_name").alias("id_hash"), F.col("c_mktsegment").alias("reason")),
        "admin_credentials": t("supplier").select(F.col("s_suppkey").alias("telegram_id"), F.md5("s_name").alias("password_hash")),
        "posts": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("anonymous_id"), F.col("o_orderkey").alias("channel_message_id")),
        # Many replies share a number: the first by id stays, so this table does not come out complete.
        "replies": t("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("parent_channel_msg_id"),
            F.col("l_partkey").alias("reply_channel_msg_id")),
        "audit_logs": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("action")),
        "system_settings": t("nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")),
    }
    target = {n: spark.createDataFrame([], ddl) for n, ddl in schemas.TABLES.items()} | {
        n: align(df, n, {}) for n, df in {
            "students": t("supplier").select(F.col("s_suppkey").alias("anonymous_id"), F.col("s_name").alias("user_hash"), F.lit(7).alias("total_posts")),
            "admin_credentials": t("nation").select(F.col("n_nationkey").alias("telegram_id"), F.lit("none").alias("password_hash"), F.lit("owner").alias("role")),
            "posts": t("part").select(F.col("p_partkey").alias("channel_message_id"), F.lit("kept").alias("status")),
            "audit_logs": t("part").select(F.col("p_partkey").alias("id"), F.lit("kept").alias("action")),
            "system_settings": t("region").select(F.col("r_name").alias("key"), F.lit("old").alias("value"))}.items()}
    return source, target


OLD_AND_NEW_SQL = """with students as (select coalesce(c_custkey, s_suppkey) as k, coalesce(s_name, c_name) || '|' || coalesce(c_mktsegment, '') || '|'
      || case when c_custkey is null then '' else (c_acctbal < 0)::varchar end || '|'
      || case when s_suppkey is null or c_custkey is not null then '0' else '7' end as v from customer full join supplier on c_custkey = s_suppkey),
  banned_fingerprints as (select md5(c_name) as k, arg_min(c_mktsegment, c_mktsegment) as v from customer where c_acctbal < 0 group by 1),
  admin_credentials as (select coalesce(s_suppkey, n_nationkey) as k, coalesce(md5(s_name), 'none') || '|' || case when n_nationkey is null then 'moderator' else 'owner' end as v
    from supplier full join nation on s_suppkey = n_nationkey),
  posts as (select coalesce(p_partkey, o_orderkey) as k, case when p_partkey is null then o_custkey || '|published' else '|kept' end as v
    from orders full join part on o_orderkey = p_partkey),
  replies as (select l_partkey as k, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber)::varchar as v from lineitem group by 1),
  audit_logs as (select coalesce(p_partkey, o_orderkey) as k, case when p_partkey is null then o_orderpriority else 'kept' end as v from orders full join part on o_orderkey = p_partkey),
  system_settings as (select coalesce(n_name, r_name) as k, coalesce(n_nationkey::varchar, 'old') as v from nation full join region on n_name = r_name)"""
MOVED_COLUMNS = {
    "students": ("user_hash", "enc_full_name", "is_banned", "total_posts"), "banned_fingerprints": ("reason",), "admin_credentials": ("password_hash", "role"),
    "posts": ("anonymous_id", "status"), "replies": ("parent_channel_msg_id",), "audit_logs": ("action",), "system_settings": ("value",)}
OLD_COUNTS = {
    "students": "customer", "banned_fingerprints": "customer where c_acctbal < 0", "admin_credentials": "supplier", "posts": "orders", "replies": "lineitem",
    "audit_logs": "orders", "system_settings": "nation"}


@query(OLD_AND_NEW_SQL + ", counted as (" + " union all ".join(
    f"select '{n}' as name, (select count(*) from {old}) as n_source, (select count(*) from {n}) as n_target" for n, old in OLD_COUNTS.items())
    + ") select *, n_target >= n_source as complete from counted")
def migrate_reconcile(spark, sf):
    """Seven tables staged, published and counted."""
    return M.migrate(spark, *_old_and_new(spark, sf), run_dir(spark, "migrated"))


@query(OLD_AND_NEW_SQL + " " + " union all ".join(f"select '{n}' as name, k::varchar as key, v as held from {n}" for n in OLD_COUNTS))
def migrated_rows(spark, sf):
    """What the seven published tables hold."""
    folder = run_dir(spark, "migrated")
    M.migrate(spark, *_old_and_new(spark, sf), folder)
    keys = {name: key[0] for name, key, *_ in M.STEPS}
    return reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(name).alias("name"), F.col(keys[name]).cast("string").alias("key"),
                  F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MOVED_COLUMNS[name]]).alias("held"))
        for name, df in M.published(spark, folder).items()])


@query("""select 'orders' as name, (select max(o_orderkey) from orders) as mark union all select 'none', 100 union all select 'events', (select max(event_id) from events)""")
def high_water_marks(spark, sf):
    """A5."""
    o, e = table(spark, sf, "orders"), table(spark, sf, "events")
    return M.high_water_marks(spark, {"orders": (o, "o_orderkey", 0), "none": (o.where("o_orderkey < 0"), "o_orderkey", 100), "events": (e, "event_id", 0)})


@query(f"""with s as (select *, datediff('minute', timestamp '2001-08-01', o_orderdate + interval 1 day) as left_ from orders)
  select o_orderkey, case when left_ > 0 then left_ end as minutes, strftime(o_orderdate, '%Y-%m-%d_%H') as bucket,
   case when o_orderstatus = 'P' then 'banned (' || o_orderpriority || ')' when left_ > 0 then 'muted (' || left_ || ' min)' else 'active' end as status,
   strftime(o_orderdate, '%Y-%m-%d') as joined, strftime(o_orderdate, '%Y-%m-%d %H:%M') as last_seen from s""")
def account_cards(spark, sf):
    """X24-X27."""
    o = table(spark, sf, "orders").withColumn("muted_until", F.col("o_orderdate") + F.expr("interval 1 day")).withColumn("as_of", F.expr(AS_OF))
    left = mute_minutes("muted_until", "as_of")
    carded = o.select("o_orderkey", left.cast("bigint").alias("minutes"), hour_label("o_orderdate").alias("bucket"),
                      O.account_status(F.col("o_orderstatus") == "P", F.col("o_orderpriority"), left).alias("status"),
                      F.col("o_orderkey").alias("anonymous_id"), F.lit(0).alias("total_posts"), F.lit(0).alias("total_replies"),
                      F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("last_active_at"))
    return carded.select("o_orderkey", "minutes", "bucket", "status",
                         *[c for c in (F.date_format("created_at", "yyyy-MM-dd").alias("joined"), F.date_format("last_active_at", "yyyy-MM-dd HH:mm").alias("last_seen"))])


@query("""with t as (select event_id, ts, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 2 then 'junk' end as raw from events)
  select event_id, case event_id % 4 when 0 then date_trunc('second', ts) - interval 2 hour when 1 then date_trunc('second', ts) when 2 then timestamp '2001-08-01' end as parsed from t""")
def parsed_times(spark, sf):
    """X23."""
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(
        n == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(n == 2, "junk")
    return table(spark, sf, "events").select("event_id", parse_timestamp(raw, F.expr(AS_OF)).alias("parsed"))


@query("""select c_custkey, ['ban', 'mute', 'del'][c_nationkey % 3 + 1] as verb, c_custkey as target, case when c_nationkey % 3 = 1 then c_nationkey end as minutes,
  case c_nationkey % 3 when 0 then c_mktsegment || ' spam' when 2 then 'unspecified' end as reason, case when c_nationkey % 3 = 2 then null else c_custkey end as link from customer""")
def parsed_commands(spark, sf):
    """X32, X33."""
    n = F.col("c_nationkey") % 3
    key = F.col("c_custkey").cast("string")
    line = F.when(n == 0, F.concat(F.lit("/ban #"), key, F.lit("  "), "c_mktsegment", F.lit(" spam"))).when(
        n == 1, F.concat(F.lit("/mute "), key, F.lit(" "), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("/del "), key))
    start = F.when(n == 2, F.concat(F.lit("/start reply_x"), key)).otherwise(F.concat(F.lit("/start reply_"), key))
    return table(spark, sf, "customer").select("c_custkey", F.inline(F.array(T.parse_command(line))), start.alias("s")).select(
        "c_custkey", "verb", "target", "minutes", "reason", T.link_target(F.col("s")).alias("link"))


@query("""select o_orderkey, case when o_orderstatus = 'F' then 'photo' when o_totalprice > 200000 then 'document' when o_orderpriority = '5-LOW' then 'video' else 'text' end as media from orders""")
def media_types(spark, sf):
    """X22."""
    present = {"text": F.lit(True), "video": F.col("o_orderpriority") == "5-LOW", "document": F.col("o_totalprice") > 200000, "photo": F.col("o_orderstatus") == "F"}
    return table(spark, sf, "orders").select("o_orderkey", T.pick_media_type(present).alias("media"))


@query(f"""with {MESSAGES_SQL} select * exclude (content_preview) from m where status <> 'published' order by message_id""")
def held_back(spark, sf):
    """Rows that did not pass, the published ones left to their own table."""
    return G.split_published(messages(spark, sf).withColumn("ok", F.col("status") == "published"), "ok")[1].drop("ok", "content_preview")
