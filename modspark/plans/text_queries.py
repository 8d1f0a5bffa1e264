"""Registered queries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.durable import run_dir, written
from modspark.functions import distance as D
from modspark.functions import text as T
from modspark.functions.register import register
from modspark.operators import lexicon as L
from modspark.operators import phrases as P
from modspark.operators import rules as R
from modspark.operators import term_table as TT
from modspark.operators import verdict as V
from modspark.operators import verdict_store as VS

KEY = b"demo master key, never a real one"
FUZZY_TERMS = ("idiot", "moron", "clown", "loser", "worthless", "pathetic", "disgusting")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A text table; spread first when it has fewer splits than there are cores, which
    only happens with small files."""
    df = table(spark, sf, name)
    width = spark.sparkContext.defaultParallelism
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def documents(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", "text")


def normalize_bundle(spark, sf):
    made = T.with_bundle(documents(spark, sf))
    strings = ("cleaned", "homoglyphs", "folded", "leet", "latin_arabic", "compact_ar", "compact_collapsed", "compact_leet",
               "compact_leet_collapsed", "compact_arab", "compact_arab_collapsed", "letters_only")
    return made.select("doc_id", *[F.md5(c).alias(c) for c in strings],
                       F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("tokens"),
                       F.size("phonetic_variants").alias("n_phonetic"), F.size("compact_variants").alias("n_compact"))


def char_ngrams(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", F.explode(T.char_ngrams(T.compact(F.lower("text")))).alias("gram"))


def content_fingerprint(spark, sf):
    docs = documents(spark, sf).select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"), "text")
    talk = texts(spark, sf, "conversations").select(
        F.lit("conversations").alias("origin"), F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    both = docs.unionByName(talk)
    return both.select("origin", "id", T.content_hash(F.col("text")).alias("plain_hash"),
                       T.content_hash(F.col("text"), F.col("id")).alias("media_hash"))


def escaped_cards(spark, sf):
    pages = texts(spark, sf, "pages")
    return pages.select(
        "page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped"),
        F.md5(T.render_post(F.col("page_id"), F.col("html"))).alias("post_card"),
        F.md5(T.render_reply(F.col("page_id"), F.nullif(F.col("page_id"), F.lit(0)), F.col("html"))).alias("reply_card"),
        T.preview(F.col("html"), F.lit("document")).alias("preview"))


def redact_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted"))


def link_scan(spark, sf):
    pages = texts(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = documents(spark, sf).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    both = pages.unionByName(docs)
    return both.select("origin", "id", R.first_link(F.col("text")).alias("link"), R.has_plain_link(F.col("text")).alias("plain_link"))


def pii_scan(spark, sf):
    c = F.col("text")
    return documents(spark, sf).select(
        "doc_id", R.first_phone(c).alias("phone"), R.first_email(c).alias("email"), R.stated_name(c).alias("name"),
        R.stated_age(c).alias("age"), R.stated_place(c).alias("place"), R.personal_detail(c)["category"].alias("category"))


def phrase_hits(spark, sf):
    return P.long_phrases(documents(spark, sf), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


def _hit_rows(spark, sf, layers: tuple[int, ...]):
    hits = V.with_hits(documents(spark, sf), "text", V.lexicon_from(spark))
    rows = hits.select("doc_id", F.inline("hits"))
    return rows.where(F.col("layer").isin(*layers)).groupBy("doc_id", "rule_id", "term").agg(
        F.min_by("item", F.struct("variant", "ord")).alias("item"))


def lexicon_hits(spark, sf):
    return _hit_rows(spark, sf, (0, 5, 6, 7))


def part_lexicon(spark, sf) -> DataFrame:
    """S4 as a table: words of part names as words and stems, whole names as phrases, and the long
    words of the benchmark; ``ord`` and kind follow from the term alone."""
    names = table(spark, sf, "part").select(F.lower("p_name").alias("term"))
    words = names.select(F.explode(F.split("term", " ")).alias("term"))
    said = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where(F.length("term") >= 13)
    kind = F.element_at(F.array(*map(F.lit, ("stem", "exact", "legacy"))), (F.length("term") % 3 + 1).cast("int"))
    terms = words.unionByName(said).where("term != ''").distinct().withColumn("kind", kind).unionByName(names.distinct().withColumn("kind", F.lit("phrase")))
    return terms.select(
        F.conv(F.substring(F.md5(F.concat("kind", "term")), 1, 7), 16, 10).cast("int").alias("ord"), "term",
        F.when(F.col("kind") == "phrase", "harassment").otherwise("insult").alias("category"), F.lit("medium").alias("severity"), "kind",
        F.lit("en").alias("script"), F.lit(False).alias("fuzzy"), F.lit(False).alias("critical"))


def table_lexicon(spark, sf):
    hits = TT.table_hits(documents(spark, sf), "doc_id", "text", part_lexicon(spark, sf), L.DEMO_ALLOWED, L.HARD_TERMS)
    return hits.groupBy("doc_id", "rule_id", "term").agg(F.min_by("item", F.struct("variant", "ord")).alias("item"))


def disguised_words(spark, sf):
    return _hit_rows(spark, sf, (3, 4))


def custom_terms(spark, sf):
    """A tenant brings its own words; nation names stand for them."""
    extra = table(spark, sf, "nation").select(F.lower("n_name").alias("term"))
    lex = L.load(L.with_custom_terms(L.demo_lexicon(spark), extra), L.DEMO_ALLOWED, L.HARD_TERMS)
    return V.flat(V.moderate(documents(spark, sf), "doc_id", "text", lex), "doc_id").select("doc_id", "action", "item")


def profanity_test(spark, sf):
    lex = V.lexicon_from(spark)
    return documents(spark, sf).select("doc_id", L.profanity_word(F.col("text"), lex).alias("word"))


def moderate_documents(spark, sf):
    out = V.moderate(documents(spark, sf), "doc_id", "text", V.lexicon_from(spark))
    return V.flat(out, "doc_id").withColumn("message", F.when(F.col("is_allowed"), "").otherwise(V.category_message(F.col("category"))))


def moderate_open_links(spark, sf):
    """A policy that allows links and switches insults and bullying off."""
    off = V.disabled_categories(profanity=False, bullying=False)
    out = V.moderate(documents(spark, sf), "doc_id", "text", V.lexicon_from(spark), disabled=off, allow_links=True)
    return V.flat(out, "doc_id").select("doc_id", "action", "category", "rule_id")


def moderate_fuzzy(spark, sf):
    out = V.moderate(documents(spark, sf), "doc_id", "text", V.lexicon_from(spark), fuzzy=True)
    return V.flat(out, "doc_id")


def verdict_reuse(spark, sf):
    out = V.moderate_once(documents(spark, sf), "doc_id", "text", V.lexicon_from(spark))
    return out.select("doc_id", "verdict.action", "verdict.category", "verdict.rule_id", "verdict.item")


def verdict_store(spark, sf):
    """V2 over runs: the benchmark after the documents, then the benchmark under a policy nobody used yet."""
    folder, lex = run_dir(spark, "verdicts"), V.lexicon_from(spark)
    docs, items = documents(spark, sf), table(spark, sf, "benchmark")
    VS.moderate_kept(docs, "doc_id", "text", lex, folder)
    both = docs.select(F.concat(F.lit("d/"), "doc_id").alias("id"), "text").unionByName(items.select(F.concat(F.lit("b/"), "item_id").alias("id"), "text"))
    again = VS.moderate_kept(both, "id", "text", lex, folder)
    other = VS.moderate_kept(items.select(F.concat(F.lit("b/"), "item_id").alias("id"), "text"), "id", "text", lex, folder,
                             disabled=V.disabled_categories(profanity=False, bullying=False), allow_links=True)
    made = again.withColumn("policy", F.lit("strict")).unionByName(other.withColumn("policy", F.lit("open")))
    return made.select("policy", "id", "verdict.action", "verdict.category", "verdict.rule_id", "verdict.item", "reused")


def moderation_eval(spark, sf):
    docs = texts(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    judged = V.moderate(docs.select("doc_id", "text", "lang", "toxic"), "doc_id", "text", V.lexicon_from(spark))
    return V.confusion(judged.select("lang", (F.col("toxic") == 1).alias("expected"), (~F.col("verdict.is_allowed")).alias("blocked")),
                       "lang", "expected", "blocked")


def noisy_recall(spark, sf):
    bad = texts(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    width = spark.sparkContext.defaultParallelism
    noisy = written(V.noisy_copies(bad.select("doc_id", "text").repartition(width), "doc_id", "text", 3), "noisy")
    judged = V.moderate(noisy, "copy", "noisy", V.lexicon_from(spark))
    return V.confusion(judged.select("seed", F.lit(True).alias("expected"), (~F.col("verdict.is_allowed")).alias("blocked")),
                       "seed", "expected", "blocked")


def fuzzy_tokens(spark, sf):
    words = documents(spark, sf).select(F.explode(T.tokens(F.lower("text"))).alias("token"))
    short = [t for t in FUZZY_TERMS if len(t) <= 6]
    terms = spark.createDataFrame([(t,) for t in short], "term string")
    return V.fuzzy_pairs(words, terms).select("token", "term", F.round("sim", 6).alias("sim"))


def fuzzy_tokens_long(spark, sf):
    words = documents(spark, sf).select(F.explode(T.tokens(F.lower("text"))).alias("token"))
    terms = spark.createDataFrame([(t,) for t in FUZZY_TERMS if len(t) > 6], "term string")
    return V.fuzzy_pairs(words, terms).select("token", "term", F.round("sim", 6).alias("sim"))


def word_distances(spark, sf):
    """E1, E2 over neighbouring words."""
    words = table(spark, sf, "benchmark").select("item_id", T.tokens(F.lower("text")).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("p"))
    a, b = F.col("a"), F.col("b")
    return pairs.select("p.a", "p.b").distinct().select(
        "a", "b", F.least(D.bounded_distance(a, b, 1), F.lit(2)).alias("distance"), F.round(D.similarity(a, b), 6).alias("similarity"))


def sql_functions(spark, sf):
    """The SQL names (see functions/register.py)."""
    register(spark, KEY)
    return documents(spark, sf).selectExpr("doc_id", "content_hash(text) as content", "content_hash(text, cast(doc_id as string)) as media")


def _signals(spark, sf) -> DataFrame:
    """One finding per conversation turn, its fields read off the text."""
    size = F.length("text")
    kind = F.get(F.array(*[F.lit(c) for c in ("profanity", "hate", "link", "bullying", "media_unsafe")]), size % 5)
    grade = F.get(F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")]), size % 4)
    security = (F.col("role") == "system") & (size % 3 == 0)
    reason = F.get(F.array(*[F.lit(r) for r in ("unsupported type", "macro found", "wording")]), size % 3)
    return texts(spark, sf, "conversations").select(
        F.col("conv_id").alias("payload_id"), F.col("turn").cast("int").alias("ordinal"), F.upper("role").alias("source"),
        kind.alias("category"), grade.alias("severity"), ((size % 10) / 10.0).alias("confidence"),
        (size % 2 == 0).alias("is_violation"), security.alias("is_security"), reason.alias("reason"),
        F.md5("text").alias("detected_item"))


def signal_fusion(spark, sf):
    off = V.disabled_categories(links=False)
    return V.fuse(_signals(spark, sf), off, strict=False).select("payload_id", "verdict.*").drop("message")


def signal_reasons(spark, sf):
    return V.verdict_reasons(_signals(spark, sf), V.disabled_categories(links=False))


def policy_filter(spark, sf):
    policy = spark.createDataFrame(
        [("strict", "link", True), ("open", "link", False), ("open", "bullying", False)],
        "policy_id string, category string, enabled boolean")
    names = policy.select("policy_id").distinct()
    hits = _signals(spark, sf).select("payload_id", "ordinal", "category").withColumn(
        "policy_id", F.explode(F.array(F.lit("strict"), F.lit("open")))).join(names, "policy_id", "left_semi")
    return V.enabled_only(hits, policy)


def envelope_verdicts(spark, sf):
    talk = texts(spark, sf, "conversations")
    envelopes = talk.select(
        F.concat_ws("/", "conv_id", "turn").alias("id"),
        F.when(F.col("role") == "system", "document").otherwise("text").alias("content_type"),
        F.when(F.col("role") == "user", F.col("text")).alias("raw_source"),
        F.when(F.col("role") != "user", F.col("text")).alias("caption"),
        F.when(F.col("role") == "system", F.col("text")).alias("filename"))
    signals = V.envelope_signals(envelopes, "id", V.lexicon_from(spark))
    return V.judge_envelopes(envelopes.select("id"), "id", signals).select(
        "id", "verdict.action", "verdict.category", "verdict.detected_item")


def publish_gate(spark, sf):
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    flags = docs.select("doc_id", (~R.has_plain_link(F.col("text"))).alias("text_ok"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("media_ok"))
    return V.publish_gate(flags)


QUERIES = {f.__name__: f for f in (
    moderate_documents, normalize_bundle, char_ngrams, content_fingerprint, escaped_cards, redact_text, link_scan, pii_scan,
    phrase_hits, lexicon_hits, table_lexicon, disguised_words, custom_terms, profanity_test, moderate_open_links, moderate_fuzzy,
    verdict_reuse, verdict_store, moderation_eval, noisy_recall, fuzzy_tokens, fuzzy_tokens_long, word_distances, signal_fusion,
    signal_reasons, policy_filter, envelope_verdicts, publish_gate, sql_functions)}
