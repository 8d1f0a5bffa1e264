"""Registered queries over files; contents are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspark.durable import run_dir
from modspark.functions import text as T
from modspark.operators import files as M
from modspark.plans.text_queries import table, texts
from modspark.plans.text_sql import redacted
from modspark.sources.files import entry_texts
from modspark.sources.tables import align, append, append_redacted, read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


ALLOWED = ", ".join(f"'{e}'" for e in T.ALLOWED_EXTENSIONS)
DENIED = ", ".join(f"'{e}'" for e in T.DENIED_EXTENSIONS)


@query(f"""with n as (select page_id, url || ['.PDF', '.tar.gz', '..exe', '', ' final.docx', '.js'][page_id % 6 + 1] as raw from pages),
  b as (select *, regexp_extract(raw, '([^/\\\\]*)$', 1) as base from n),
  c as (select *, trim(regexp_replace(regexp_replace(base, '[^\\p{{L}}\\p{{N}}_\\s.-]', '_', 'g'), '\\.{{2,}}', '.', 'g'), ' ._') as clean from b),
  e as (select *, lower(regexp_extract(clean, '[^./\\\\][^/\\\\]*?(\\.[^./\\\\]*)$', 1)) as ext from c)
  select page_id, raw, ext, ext in ({ALLOWED}) as ok, case when ext in ({ALLOWED}) then substr(clean, 1, least(60, length(clean) - length(ext))::int) || ext end as name,
   case when ext in ({ALLOWED}) then null when ext = '' then 'no extension' when ext in ({DENIED}) then 'denied extension' else 'unknown extension' end as error from e""")
def safe_filename(spark, sf):
    """X21, M1."""
    tail = F.get(F.array(*[F.lit(t) for t in (".PDF", ".tar.gz", "..exe", "", " final.docx", ".js")]), (F.col("page_id") % 6).cast("int"))
    named = table(spark, sf, "pages").select("page_id", F.concat("url", tail).alias("raw"))
    return named.select("page_id", "raw", F.inline(F.array(T.safe_file_name(F.col("raw"), F.col("raw")))))


HEADS = ("25504446", "4D5A", "89504E470D0A1A0A", "504B0304", "", "FFD8FF", "00000018667479706D703432", "5249464600000000574542505650")
EXTS = (".pdf", ".txt", ".png", ".mp4", ".jpg", ".webp", ".csv")
HEAD_SQL = "[" + ", ".join(f"'{h}'" for h in HEADS) + "]"
EXT_SQL = "[" + ", ".join(f"'{e}'" for e in EXTS) + "]"


def _files(spark, sf):
    head = F.get(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % len(HEADS)).cast("int"))
    ext = F.get(F.array(*[F.lit(e) for e in EXTS]), (F.col("doc_id") % len(EXTS)).cast("int"))
    docs = texts(spark, sf, "documents")
    content = F.concat(F.unhex(head), F.encode("text", "UTF-8"))
    return docs.select(
        F.concat(F.lit("/in/f"), F.col("doc_id").cast("string"), ext).alias("path"), F.length(content).cast("bigint").alias("length"),
        content.alias("content"), F.lit(None).cast("string").alias("declared_name"), "doc_id")


@query(f"""with f as (select doc_id, {HEAD_SQL}[doc_id % 8 + 1] as head, {EXT_SQL}[doc_id % 7 + 1] as ext, {HEAD_SQL}[doc_id % 8 + 1] || hex(text) as h from documents)
  select doc_id, '/in/f' || doc_id || ext as path, not starts_with(h, '4D5A') as no_program,
   case ext when '.pdf' then starts_with(h, '25504446') when '.png' then starts_with(h, '89504E470D0A1A0A') when '.jpg' then starts_with(h, 'FFD8FF')
    when '.mp4' then head = '00000018667479706D703432' when '.webp' then starts_with(head, '52494646')
    else not starts_with(h, '4D5A') and not contains(head, '000000') end as head,
   length(h) // 2 between 1 and 20000 and case ext when '.pdf' then starts_with(h, '25504446') when '.png' then starts_with(h, '89504E470D0A1A0A') when '.jpg' then starts_with(h, 'FFD8FF')
    when '.mp4' then head = '00000018667479706D703432' when '.webp' then starts_with(head, '52494646')
    else not starts_with(h, '4D5A') and not contains(head, '000000') end as safe from f""")
def file_screen(spark, sf):
    """M2, M3, M4, F8."""
    out = M.screen(_files(spark, sf), limit=20000)
    return out.select("doc_id", "path", F.col("check.no_program").alias("no_program"), F.col("check.head").alias("head"), "safe")


#: What every byte from 128 on stands for, for the SQL; from the codec, not from ours.
_HIGH = [chr(i) for i in range(128, 256)], [bytes([i]).decode("cp1256") for i in range(128, 256)]


@query(f"""with f as (select doc_id, {HEAD_SQL}[doc_id % 8 + 1] as head, {HEAD_SQL}[doc_id % 8 + 1] || hex(text) as h, text from documents),
  b as (select *, regexp_matches(head, '^([0-7][0-9A-F])*$') as plain, regexp_matches(h, '^(..)*00') as zero from f)
  select doc_id, case when zero then 'binary zero bytes in plain text' end as finding,
   case when zero then null when plain then md5(unhex(h))
    else md5(translate(array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: chr(('0x' || x)::int)), ''), '{"".join(_HIGH[0])}', '{"".join(_HIGH[1])}')) end as digest from b""")
def plain_text(spark, sf):
    """M7: decoded text of every file without zero bytes, in either encoding."""
    out = _files(spark, sf).select("doc_id", F.inline(F.array(M.plain_text(F.col("content")))))
    return out.select("doc_id", "finding", F.md5("text").alias("digest"))


@query(f"""with e as (select conv_id, turn, (['notes', '../up', 'run', '/abs', 'a.b'][length(text) % 5 + 1]) || (['.txt', '.exe', '.csv', '.md'][length(text) % 4 + 1]) as entry_name,
    length(text) as size, length(text) % 9 = 0 as prog from conversations),
  p as (select *, case when contains(entry_name, '..') or starts_with(entry_name, '/') then 'path traversal' when ends_with(entry_name, '.exe') then 'denied extension' when prog then 'program code' end as problem from e)
  select conv_id::varchar as path, count(*) as n, sum(size) as inflated, case when count(*) > 6 then 'too many entries' when sum(size) > 3000 then 'zip bomb expansion'
   else arg_min(problem, turn) filter (problem is not null) end as finding from p group by conv_id""")
def archive_findings(spark, sf):
    """M5: every conversation stands for an archive, its turns for the entries."""
    n = F.length("text")
    stem = F.get(F.array(*[F.lit(s) for s in ("notes", "../up", "run", "/abs", "a.b")]), n % 5)
    ext = F.get(F.array(*[F.lit(s) for s in (".txt", ".exe", ".csv", ".md")]), n % 4)
    entries = texts(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("position"), F.concat(stem, ext).alias("entry_name"),
        n.cast("bigint").alias("inflated_size"), F.when(n % 9 == 0, F.unhex(F.lit("4D5A90"))).otherwise(F.encode(F.substring("text", 1, 32), "UTF-8")).alias("head"))
    return M.entry_findings(entries, max_inflated=3000, max_entries=6)


@query("""with p as (select l_orderkey, (l_quantity * 5)::int as r, (l_extendedprice % 200)::int as g, (l_discount * 1000)::int as b from lineitem),
  s as (select l_orderkey, avg(case when r > 95 and g > 40 and b > 20 and greatest(r, g, b) - least(r, g, b) > 15 and abs(r - g) > 15 and r > g and r > b then 1.0 else 0.0 end) as share from p group by 1)
  select l_orderkey as image, round(share, 6) as share, share >= 0.65 as flagged, case when share >= 0.65 then round(least(1.0, 0.7 + 0.3 * share), 6) end as confidence from s""")
def skin_share(spark, sf):
    """Every order stands for an image, its lines for the pixels."""
    pixels = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.bround(F.col("l_quantity") * 5).cast("int").alias("r"),
        F.bround(F.col("l_extendedprice") % 200).cast("int").alias("g"), F.bround(F.col("l_discount") * 1000).cast("int").alias("b"))
    return M.skin_share(pixels, "image").select("image", F.round("share", 6).alias("share"), "flagged", F.round("confidence", 6).alias("confidence"))


@query("""with f as (select page_id, (['photo', 'document', 'voice', 'video', 'animation', 'sticker', 'other'])[page_id % 7 + 1] as kind, (['.png', '.zip', '.bin', '.gif', '.txt'])[page_id % 5 + 1] as ext from pages)
  select page_id, case when kind = 'photo' or ext = '.png' then 'photo' when kind = 'document' or ext in ('.zip', '.txt') then case when ext = '.zip' then 'archive' else 'document' end
   when kind = 'voice' then 'audio' when kind = 'video' then 'video' when kind = 'animation' or ext = '.gif' then 'animation' when kind = 'sticker' then 'sticker' else 'unknown' end as route,
   case when ext = '.txt' then 'txt' else 'unsupported' end as reader, case when kind = 'other' then 'photo' else kind end as coerced from f""")
def media_routes(spark, sf):
    """V5, V6, M9, M12."""
    kind = F.get(F.array(*[F.lit(k) for k in ("photo", "document", "voice", "video", "animation", "sticker", "other")]), (F.col("page_id") % 7).cast("int"))
    ext = F.get(F.array(*[F.lit(e) for e in (".png", ".zip", ".bin", ".gif", ".txt")]), (F.col("page_id") % 5).cast("int"))
    f = table(spark, sf, "pages").select("page_id", kind.alias("kind"), F.concat(F.lit("/in/a"), ext).alias("path"))
    return f.select("page_id", M.route(F.col("kind"), F.col("path")).alias("route"), M.document_route(F.col("path")).alias("reader"), M.known_type(F.col("kind")).alias("coerced"))


@query("""select page_id as payload_id, case when length(html) % 3 = 0 then 'media file not found' when length(html) % 3 = 1 then 'file is empty (0 bytes)' end as reason
  from pages where length(html) % 3 < 2""")
def intake_findings(spark, sf):
    """V5: fail-closed findings."""
    n = F.length("html") % 3
    f = table(spark, sf, "pages").select(F.col("page_id").alias("path_id"), F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"),
                                         F.lit("photo").alias("content_type"), F.when(n == 1, 0).when(n == 2, F.length("html")).alias("length"))
    out = M.intake_findings(f)
    return out.select(F.regexp_extract("payload_id", r"(\d+)", 1).cast("bigint").alias("payload_id"), "reason")


@query(r"""with t as (select page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') as t from pages),
  u as (select page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') as t from t),
  v as (select page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) as t from u)
  select page_id::varchar as path, md5(t) as digest from v""")
def package_parts(spark, sf):
    """M8: pages as the text parts of office packages."""
    parts = texts(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("path"), F.lit("word/document.xml").alias("entry_name"), F.encode("html", "UTF-8").alias("content"))
    return M.package_text(parts).select("path", F.md5("text").alias("digest"))


@query("""select doc_id::varchar as path, md5(replace(text, chr(65533), '')) as digest from documents where doc_id % 3 <> 2""")
def archive_texts(spark, sf):
    """M6: documents as archive entries; those that are no text by their name are passed over."""
    name = F.concat("source", F.get(F.array(F.lit("/a.txt"), F.lit("/b.JSON"), F.lit("/c.bin")), F.pmod("doc_id", F.lit(3)).cast("int")))
    entries = texts(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), name.alias("entry_name"), F.encode("text", "UTF-8").alias("content"))
    return entry_texts(entries).select("path", F.md5("text").alias("digest"))


@query(f"""select p_partkey, p_size * 700 > {M.MAX_SIDE} or length(p_name) * 400 > {M.MAX_SIDE} as oversized from part""")
def oversized_images(spark, sf):
    """Part sizes as image sides."""
    return table(spark, sf, "part").select("p_partkey", M.oversized(F.col("p_size") * 700, F.length("p_name") * 400).alias("oversized"))


@query(f"select doc_id, md5({redacted('text')}) as redacted, source from documents")
def redacted_sink(spark, sf):
    """Two appends of redacted rows, read back from the shared folder."""
    docs, folder = texts(spark, sf, "documents").select("doc_id", "text", "source"), run_dir(spark, "redacted")
    for part in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0")):
        append_redacted(part, folder, "text")
    return spark.read.parquet(folder).select("doc_id", F.md5("text").alias("redacted"), "source")


@query("""select o_orderkey as id, o_custkey + 101 as anonymous_id, o_orderkey as channel_message_id, o_orderpriority as content_preview,
  o_orderstatus = 'P' as is_deleted, 'published' as status from orders""")
def ledger_table(spark, sf):
    """Orders written as the posts table and read with its declared schema."""
    folder = run_dir(spark, "posts")
    posts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") + 101).alias("anonymous_id"), F.col("o_orderkey").alias("channel_message_id"),
        F.col("o_orderpriority").alias("content_preview"), (F.col("o_orderstatus") == "P").alias("is_deleted"))
    append(align(posts, "posts", {"status": "published"}), folder)
    return read_table(spark, folder, "posts").select("id", "anonymous_id", "channel_message_id", "content_preview", "is_deleted", "status")
