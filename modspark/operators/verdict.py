"""Cascade, fusion, gate, reuse and evaluation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.durable import cut, written
from modspark.functions import distance as D
from modspark.functions import text as T
from modspark.functions.bind import once, settle
from modspark.functions.noise import noisy
from modspark.operators import lexicon as L
from modspark.operators import rules as R
from modspark.operators import screen as S
from modspark.schemas import severity_score

VERDICT = ("struct<is_allowed:boolean,action:string,category:string,severity:string,confidence:double,"
           "rule_id:string,item:string>")

# Which switch governs which categories.
SWITCHES = {
    "profanity_filter": ("profanity", "insult"),
    "profanity": ("profanity", "insult"),
    "sexual": ("sexual", "explicit"),
    "harassment": ("harassment",),
    "bullying": ("bullying",),
    "threats": ("threat", "violence"),
    "hate": ("hate", "slur"),
    "links": ("link",),
}

# Fixed groups, own wording.
TEXT_MESSAGES = (
    (("explicit", "sexual"), "Rejected: sexual or explicit wording."),
    (("threat", "violence"), "Rejected: threats or incitement to violence."),
    (("self_harm",), "Rejected: signs of self-harm."),
    (("hate", "slur"), "Rejected: hate speech."),
    (("harassment", "bullying"), "Rejected: bullying or harassment."),
)
TEXT_DEFAULT = "Rejected: insulting or abusive wording."
CONTENT_MESSAGES = (
    (("profanity", "insult"), "Rejected: insulting or abusive wording."),
    (("explicit", "sexual"), "Rejected: indecent material."),
    (("harassment", "bullying"), "Rejected: disrespect, bullying or harassment."),
    (("threat",), "Rejected: threats of violence or harm."),
    (("hate", "slur"), "Rejected: hate speech or discrimination."),
    (("self_harm",), "Rejected: wording about self-harm."),
    (("pii_self_doxx", "phone_number", "email_address"), "Rejected to protect your privacy."),
    (("link",), "Rejected: outside links or handles."),
    (("media_unsafe",), "The safety of the upload could not be verified."),
)
CONTENT_DEFAULT = "Rejected: against the publishing rules."
SECURITY_MESSAGES = (
    (("zip bomb", "expansion"), "Archive rejected: inflates too far."),
    (("executable", "binary"), "File rejected: holds program code."),
    (("path traversal",), "File rejected: unsafe paths."),
    (("macro",), "Document rejected: holds a macro."),
    (("dimension", "decompression"), "Rejected: dimensions above the safe limit."),
    (("unsupported",), "Rejected: file type cannot be screened."),
)
SECURITY_DEFAULT = "File rejected: failed the safety checks."


def disabled_categories(**switches: bool) -> tuple[str, ...]:
    """Categories a policy turns off; personal details and self-harm never are."""
    off = [c for name, on in switches.items() if not on for c in SWITCHES[name]]
    return tuple(dict.fromkeys(off))


def enabled_only(hits: DataFrame, policy: DataFrame) -> DataFrame:
    """P16 with a policy table (policy_id, category, enabled): rows keep their policy."""
    off = policy.where(~F.col("enabled")).select("policy_id", "category")
    return hits.join(off, ["policy_id", "category"], "left_anti")


def category_message(category: Column, table=TEXT_MESSAGES, default: str = TEXT_DEFAULT) -> Column:
    """Message of a category."""
    out = F.lit(default)
    for names, text in reversed(table):
        out = F.when(category.isin(*names), text).otherwise(out)
    return out


def security_message(reason: Column) -> Column:
    """X29, ordered containment variant."""
    out = F.lit(SECURITY_DEFAULT)
    for marks, text in reversed(SECURITY_MESSAGES):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(reason), F.lit(m)) for m in marks]), text).otherwise(out)
    return out


def with_hits(df: DataFrame, text: str, lex: L.Lexicon, disabled: tuple[str, ...] = (),
              allow_links: bool = False, normalize: bool = True) -> DataFrame:
    """Every enabled, unexcused hit of layers 0-7 as one array column ``hits``.

    The whole text is searched, however long.  All of it is one chain of narrow
    projections over the messages; nothing is shuffled.  Only texts that a linear-time
    test suspects of a hit meet the folds and patterns.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    marked = df.withColumn("suspicion", S.suspicion(raw, lex, normalize))
    # A text that no layer can hit goes on as an empty one; only terms need more than the folded text.
    suspect = lambda bits: F.col("suspicion").bitwiseAND(F.lit(bits)) != 0
    worded = lambda c: F.when(suspect(S.WORDS), F.col(c)).otherwise("")
    shown = F.when(suspect(S.WORDS | S.PERSONAL), raw).otherwise("")
    base = T.with_folded(marked.withColumn("raw_text", shown), "raw_text", normalize).withColumns({
        "detail": F.when(suspect(S.PERSONAL), R.personal_detail(F.col("raw_text"))),
        "link_item": F.lit(None).cast("string") if allow_links else F.when(suspect(S.LINK), R.first_link(raw)),
    }).withColumn("detail", F.coalesce("detail", F.when(
        suspect(S.PERSONAL) & (F.col("folded") != F.col("raw_text")), R.personal_detail(F.col("folded")))))
    base = T.with_readings(base.withColumns({c: worded(c) for c in ("raw_text", "homoglyphs", "folded")}))
    base = base.withColumns({
        "raw_folded": T.fold_arabic(F.col("raw_text")), "squeezed": L.squeezed_texts(),
    }).withColumn("near", suspect(S.LISTED) & L.might_hit(L.listed(lex), F.col("squeezed")))
    # Read only where a hit has to be excused, so not columns of their own.
    excusers = L.allowed_words(T.token_union(), lex)
    raw_excusers = L.allowed_words(T.tokens(F.col("raw_text")), lex)

    def unexcused(hits: Column, words: Column) -> Column:
        # Words inside the filter's own lambda would be split anew for every hit.
        return once(hits, lambda found: F.when(F.size(found) > 0, once(words, lambda known: F.filter(
            found, lambda h: ~L.is_excused(h["term"], known, lex)))).otherwise(found))

    def only(bit: int, hits: Column) -> Column:
        return F.when(suspect(bit), hits).otherwise(F.array().cast(L.NO_HITS))

    def rule_hit(layer: str, category: Column, severity: Column, item: Column) -> Column:
        number, rule, confidence = L.LAYERS[layer]
        hit = F.array(F.struct(
            F.lit(number).alias("layer"), F.lit(0).alias("variant"), F.lit(0).alias("ord"),
            F.lit(rule).alias("rule_id"), category.alias("category"), severity.alias("severity"),
            F.lit(confidence).alias("confidence"), item.alias("item"), F.lit("").alias("term")))
        return F.when(item.isNotNull(), hit.cast(L.NO_HITS)).otherwise(F.array().cast(L.NO_HITS))

    hits = F.concat(
        only(S.LISTED, unexcused(L.quick_hits(lex, F.col("raw_folded"), lex.hard), raw_excusers)),
        rule_hit("pii", F.col("detail.category"), F.col("detail.severity"), F.col("detail.item")),
        rule_hit("link", F.lit("link"), F.lit("high"), F.col("link_item")),
        only(S.EVASIVE, L.evasive_hits(lex)),
        only(S.INSERTED, unexcused(L.insertion_hits(lex), excusers)),
        L.phrase_hits(lex),
        unexcused(L.arabic_hits(lex), excusers),
        unexcused(L.latin_hits(lex), excusers),
    )
    # A blank message has no hits; P16: categories switched off do not count.
    found = F.when(T.strip_spaces(raw) == "", F.array().cast(L.NO_HITS)).otherwise(hits)
    if disabled:
        found = F.filter(found, lambda h: ~h["category"].isin(*disabled))
    return settle(base, hits=found).select(*df.columns, "hits")


def verdict_of(hit: Column) -> Column:
    """A hit blocks; no hit allows."""
    none = hit.isNull()
    return F.struct(
        none.alias("is_allowed"),
        F.when(none, "ALLOW").otherwise("BLOCK").alias("action"),
        F.coalesce(hit["category"], F.lit("none")).alias("category"),
        F.coalesce(hit["severity"], F.lit("low")).alias("severity"),
        F.coalesce(hit["confidence"], F.lit(1.0)).alias("confidence"),
        hit["rule_id"].alias("rule_id"),
        hit["item"].alias("item"),
    )


def moderate(df: DataFrame, key: str, text: str, lex: L.Lexicon, disabled: tuple[str, ...] = (),
             allow_links: bool = False, fuzzy: bool = True, normalize: bool = True) -> DataFrame:
    """V1: first hit in (layer, form, list) order decides; adds column ``verdict``.

    Layers 0-7 are narrow.  The fuzzy layer (off on streams) folds and compares the distinct
    words between blanks, so its shuffle carries a vocabulary, not texts; only texts that hold
    a word it found meet it whole.  Both meet the messages by a digest of the text, so ``key``
    need not be unique.
    """
    hits = with_hits(df, text, lex, disabled, allow_links, normalize)
    first = hits.withColumn("hit", F.array_min("hits")).drop("hits")
    if fuzzy and any(e.fuzzy and e.category not in disabled for e in lex.entries):
        mark = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        near = written(fuzzy_hits(df.select(text), text, lex, disabled, normalize), "near")
        blank = T.strip_spaces(F.coalesce(F.col(text), F.lit(""))) == ""
        first = (
            first.withColumn("mark", mark).join(near, "mark", "left")
            .withColumn("hit", F.coalesce("hit", F.when(~blank, F.col("near_hit")))).drop("near_hit", "mark"))
    return settle(first, verdict=verdict_of(F.col("hit"))).drop("hit")


def _fuzzy_entries(lex: L.Lexicon, disabled: tuple[str, ...]) -> list:
    return [e for e in lex.entries if e.fuzzy and e.category not in disabled]


def _between_blanks(texts: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """``chunk``: what stands between blanks and has the letters of a word near one of ``terms``, each at least once."""
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = S.near_letters(terms)
        for batch in batches:
            chunks = pc.unique(pc.list_flatten(pc.split_pattern(batch.column(0).cast(pa.string()), " ")))
            chunks = chunks.filter(pc.not_equal(chunks, ""))
            yield pa.RecordBatch.from_arrays([chunks.filter(pa.array(near(chunks), pa.bool_()))], names=["chunk"])

    return texts.select(text).where(F.col(text) != "").mapInArrow(step, "chunk string")


def _holding(texts: DataFrame, text: str, chunks: DataFrame, width: int) -> DataFrame:
    """mark, text: once each, the texts in which one of the ``chunks`` stands between blanks."""
    spread = texts.select(F.sha2(text, 256).alias("mark"), F.explode(F.split(text, " ")).alias("chunk"))
    marks = written(spread.join(chunks, "chunk", "left_semi").select("mark").distinct(), "suspects")
    held = texts.select(F.sha2(text, 256).alias("mark"), text).join(marks, "mark", "left_semi")
    # Few texts but much work: an explicit width keeps Spark from gathering them into one task.
    return held.groupBy("mark").agg(F.any_value(text).alias(text)).repartition(width)


def fuzzy_hits(df: DataFrame, text: str, lex: L.Lexicon, disabled: tuple[str, ...] = (), normalize: bool = True) -> DataFrame:
    """E4 by SHA-256 of the text: mark, near_hit, a row per text that has a fuzzy match.

    No fold reaches across a blank, so the words of a text are those of what stands between its
    blanks.  That vocabulary is folded and compared once; the texts that hold a matching part of
    it are worked off whole, which tells the order of matches.
    """
    def tokens(rows: DataFrame, key: str, column: str) -> DataFrame:
        return written(T.with_bundle(rows, column, normalize).select(key, "tokens"), "words")

    spark, rows = df.sparkSession, df.where(F.col(text) != "")
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = _between_blanks(rows, text, [e.term.lower() for e in _fuzzy_entries(lex, disabled)]).distinct().repartition(width)
    vocabulary = tokens(chunks, "chunk", "chunk")
    best = written(best_terms(_fuzzy_seen(vocabulary, "chunk", lex), lex, disabled), "near-words")
    near = written(_fuzzy_seen(vocabulary, "chunk", lex).join(best, "token", "left_semi").select("chunk").distinct(), "near-chunks")
    held = tokens(_holding(rows, text, near, width), "mark", text)
    return fuzzy_layer(held, "mark", lex, disabled, best).withColumnRenamed("hit", "near_hit")


def fuzzy_pairs(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct ``token`` x ``term`` pairs that match under the length rules.

    Pairs meet on a shared deletion, an equality join that Spark may broadcast or
    sort as sizes tell at run time; nothing is compared with everything.  Words of a
    list are short, so a word yields a bounded number of deletions.
    """
    def keyed(df: DataFrame, word: str, shallow: Column, deep: Column) -> DataFrame:
        lists = [
            df.where(cond).select("*", F.lit(depth).alias("depth"), F.explode(D.deletions(F.col(word), depth)).alias("part"))
            for cond, depth in ((shallow, 1), (deep, 2))
        ]
        return lists[0].unionByName(lists[1])

    size, target = F.length("token"), F.length("term")
    terms = terms.where(target >= 4)
    longest = terms.agg(F.max(target)).first()[0] or 0
    few = [r.term for r in terms.select("term").limit(S.MOST_FUZZY + 1).collect()]
    spark = words.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A vocabulary is few bytes but much work: an explicit width keeps Spark from
    # gathering it into one task.
    words = words.where(size.between(4, longest + 2)).distinct().repartition(width)
    if len(few) <= S.MOST_FUZZY:
        def fitting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = S.near_words(few)
            for batch in batches:
                yield batch.filter(pa.array(near(batch.column(0).cast(pa.string())), pa.bool_()))

        words = words.mapInArrow(fitting, words.schema)
    left = keyed(words, "token", size <= 7, size >= 5)
    right = keyed(terms, "term", target <= 6, target > 6)
    pairs = left.join(right, ["depth", "part"]).select("token", *terms.columns).distinct()
    return settle(pairs, sim=D.fuzzy_similarity(F.col("token"), F.col("term"))).where(F.col("sim") >= 0.75)


def _fuzzy_seen(docs: DataFrame, key: str, lex: L.Lexicon) -> DataFrame:
    seen = docs.select(key, F.posexplode("tokens").alias("pos", "token")).withColumn("token", F.lower("token"))
    return seen.where((F.length("token") >= 4) & ~F.col("token").isin(*lex.allowed, ""))


def best_terms(seen: DataFrame, lex: L.Lexicon, disabled: tuple[str, ...] = ()) -> DataFrame:
    """token, best: the first fuzzy term that each matching word is near to."""
    terms = seen.sparkSession.createDataFrame(
        [(e.ord, e.term.lower(), e.category, e.severity) for e in _fuzzy_entries(lex, disabled)],
        "ord int, term string, category string, severity string")
    return fuzzy_pairs(seen.select("token"), terms).groupBy("token").agg(
        F.min(F.struct("ord", "term", "category", "severity", "sim")).alias("best"))


def fuzzy_layer(docs: DataFrame, key: str, lex: L.Lexicon, disabled: tuple[str, ...] = (), best: DataFrame | None = None) -> DataFrame:
    """First matching word, then first matching term, per message; ``best`` where words were compared already."""
    if not _fuzzy_entries(lex, disabled):
        return docs.limit(0).select(key, F.lit(None).cast(L.HIT).alias("hit"))
    seen = _fuzzy_seen(docs, key, lex)
    best = best_terms(seen, lex, disabled) if best is None else best
    number, rule, _ = L.LAYERS["fuzzy"]
    hit = F.struct(
        F.lit(number).alias("layer"), F.col("pos").alias("variant"), F.col("best.ord").alias("ord"),
        F.lit(rule).alias("rule_id"), F.col("best.category").alias("category"),
        F.col("best.severity").alias("severity"), F.round("best.sim", 2).alias("confidence"),
        F.col("best.term").alias("item"), F.col("best.term").alias("term"))
    return seen.join(best, "token").groupBy(key).agg(F.min(hit).cast(L.HIT).alias("hit"))


def flat(df: DataFrame, *keys: str) -> DataFrame:
    """The verdict as plain columns."""
    return df.select(*keys, "verdict.*")


SHARE = 1000  # a text is common when its copies are more than one in SHARE messages
SALTS = 64


def moderate_once(df: DataFrame, key: str, text: str, lex: L.Lexicon, share: int = SHARE, **options) -> DataFrame:
    """V2: each distinct text is judged once and the verdict handed to its copies.

    Only (hash, id) is shuffled to pick one message per text, with a partial minimum
    and count on the map side.  Fewer than ``share`` texts can be common, so their
    hashes fit in the plan; just their copies are spread by a salt taken from their own
    id, and just their verdicts are repeated once per salt.
    """
    keyed = df.withColumn("sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    chosen = cut(keyed.groupBy("sha").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")))
    total = chosen.agg(F.sum("copies")).first()[0] or 0
    common = [r.sha for r in chosen.where(F.col("copies") > max(total / share, SALTS)).select("sha").limit(share).collect()]
    is_common = F.col("sha").isin(*common, "")
    judged = moderate(keyed.join(chosen.select(key), key, "left_semi").select(key, text, "sha"), key, text, lex, **options)
    spread = judged.select("sha", "verdict", F.explode(F.when(
        is_common, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    salt = F.when(is_common, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).otherwise(0)
    return keyed.withColumn("salt", salt).join(spread, ["sha", "salt"], "left").drop("salt")


# --- fusion ---------------------------------------------------------------------

def _outcome(top: Column, n_security: Column, n_content: Column, strict: bool) -> Column:
    """ALLOW / REVIEW / BLOCK out of the leading finding."""
    score = top["score"]
    security, content = n_security > 0, n_content > 0
    action = (
        F.when(security, "BLOCK")
        .when(content & ((score >= 3) | F.lit(strict)), "BLOCK")
        .when(content, "REVIEW")
        .otherwise("ALLOW")
    )
    unsupported = F.contains(F.lower(top["reason"]), F.lit("unsupported"))
    return F.struct(
        (action != "BLOCK").alias("is_allowed"), action.alias("action"),
        F.when(security | content, top["category"]).otherwise("none").alias("category"),
        F.when(security | content, top["severity"]).otherwise("low").alias("severity"),
        F.when(security | content, top["confidence"]).otherwise(1.0).alias("confidence"),
        F.when(security, F.when(unsupported, "unsupported").otherwise("failed")).otherwise("safe").alias("status"),
        F.when(security | content, top["detected_item"]).alias("detected_item"),
        F.when(security, security_message(top["reason"]))
        .when(content, category_message(top["category"], CONTENT_MESSAGES, CONTENT_DEFAULT))
        .otherwise("").alias("message"),
    )


def _ranked() -> Column:
    """Struct ordered so that its maximum is the leading finding; first wins a tie."""
    return F.struct(
        F.col("is_security"), severity_score().alias("score"), F.col("confidence"),
        (-F.col("ordinal")).alias("neg_ordinal"), F.col("category"), F.col("severity"),
        F.col("source"), F.col("reason"), F.col("detected_item"))


def counted_signals(signals: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Violations that count: all security ones, and content of enabled categories."""
    counts = F.col("is_violation") & (F.col("is_security") | ~F.col("category").isin(*disabled, ""))
    return signals.where(counts)


def fuse(signals: DataFrame, disabled: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """V3: one verdict per payload that has signals.  Plain aggregates with partial
    sums on the map side: a payload with very many signals is no burden."""
    counts = F.col("is_violation") & (F.col("is_security") | ~F.col("category").isin(*disabled, ""))
    grouped = signals.groupBy("payload_id").agg(
        F.max(F.when(counts, _ranked())).alias("top"),
        F.count_if(counts & F.col("is_security")).alias("n_security"),
        F.count_if(counts & ~F.col("is_security")).alias("n_content"))
    verdict = _outcome(F.col("top"), F.col("n_security"), F.col("n_content"), strict)
    return grouped.select("payload_id", verdict.alias("verdict"))


def verdict_reasons(signals: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """V3: reasons and rule ids of a verdict, one row each in signal order.

    Security findings hide content findings of the same payload.  Rows, not a list:
    a list per payload has no bound."""
    counted = counted_signals(signals, disabled)
    alarmed = counted.where("is_security").select("payload_id").distinct()
    shown = counted.where("is_security").unionByName(
        counted.where(~F.col("is_security")).join(alarmed, "payload_id", "left_anti"))
    rule = F.when(F.col("is_security"), F.concat(F.lit("RULE_SECURITY_"), "source")).otherwise(
        F.concat(F.lit("RULE_"), "source", F.lit("_"), F.upper("category")))
    return shown.select(
        "payload_id", "ordinal", F.format_string("[%s] %s", "source", "reason").alias("reason"), rule.alias("rule_id"))


SIGNAL = ("struct<ordinal:int,source:string,category:string,severity:string,confidence:double,"
          "is_violation:boolean,is_security:boolean,reason:string,detected_item:string>")


def envelope_signals(df: DataFrame, key: str, lex: L.Lexicon, **options) -> DataFrame:
    """V4, first half: caption, file name and text of an envelope judged apart; a row
    per failing part.  ``df`` has key, content_type, raw_source, caption, filename."""
    is_text = F.col("content_type") == "text"
    body = F.coalesce(F.when(F.col("raw_source") != "", F.col("raw_source")), F.col("caption"), F.lit(""))
    parts = df.select(key, F.inline(F.array(
        F.struct(F.lit(0).alias("ordinal"), F.lit("CAPTION").alias("source"), F.col("caption").alias("part")),
        F.struct(F.lit(1).alias("ordinal"), F.lit("FILENAME").alias("source"), F.col("filename").alias("part")),
        F.struct(F.lit(2).alias("ordinal"), F.lit("TEXT").alias("source"), F.when(is_text, body).alias("part")),
    )))
    judged = moderate(parts.where(F.coalesce(F.col("part"), F.lit("")) != ""), key, "part", lex, **options)
    said = (
        F.when(F.col("source") == "CAPTION", F.lit("Prohibited caption content"))
        .when(F.col("source") == "FILENAME", F.concat(F.lit("Prohibited term in filename: "), "part"))
        .otherwise(F.lit("Prohibited text"))
    )
    return judged.where(~F.col("verdict.is_allowed")).select(
        F.col(key).alias("payload_id"), "ordinal", "source", "verdict.category", "verdict.severity",
        "verdict.confidence", F.lit(True).alias("is_violation"), F.lit(False).alias("is_security"),
        said.alias("reason"), F.col("verdict.item").alias("detected_item"))


def judge_envelopes(df: DataFrame, key: str, signals: DataFrame, disabled: tuple[str, ...] = (),
                    strict: bool = True) -> DataFrame:
    """V4, second half: fuse the signals; envelopes without any are allowed."""
    fused = fuse(signals, disabled, strict).withColumnRenamed("payload_id", key)
    allow = F.struct(
        F.lit(True).alias("is_allowed"), F.lit("ALLOW").alias("action"), F.lit("none").alias("category"),
        F.lit("low").alias("severity"), F.lit(1.0).alias("confidence"), F.lit("safe").alias("status"),
        F.lit(None).cast("string").alias("detected_item"), F.lit("").alias("message"))
    return df.join(fused, key, "left").withColumn("verdict", F.coalesce("verdict", allow))


def publish_gate(df: DataFrame, text_ok: str = "text_ok", media_ok: str = "media_ok") -> DataFrame:
    """V7: the text verdict comes first, then the media verdict."""
    return df.withColumn("published", F.col(text_ok) & F.col(media_ok)).withColumn(
        "stopped_by", F.when(~F.col(text_ok), "text").when(~F.col(media_ok), "media"))


def confusion(df: DataFrame, group: str, expected_block: str, blocked: str) -> DataFrame:
    """V9: counts, precision and recall per group."""
    want, got = F.col(expected_block), F.col(blocked)
    counts = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(want & got).alias("tp"), F.count_if(~want & got).alias("fp"),
        F.count_if(want & ~got).alias("fn"), F.count_if(~want & ~got).alias("tn"))
    return counts.withColumns({
        "precision": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6),
        "recall": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6)})


#: What follows a letter, by one hexadecimal digit: mostly nothing.
NOISE = ("",) * 8 + (".", "-", "_", " ") * 2


def noisy_copies(corpus: DataFrame, key: str, text: str, seeds: int) -> DataFrame:
    """Every row once per seed, letters repeated and separated; adds seed, copy (key and seed) and noisy.

    Same shape of noise as a shuffled keyboard would give, but reproducible: MD5 of the text's MD5,
    the seed and the letter's place decides (first digit: a quarter of all letters is doubled;
    second digit: what follows), so any engine with MD5 can follow. Null texts stay null."""
    copies = corpus.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn(
        "copy", F.concat_ws("/", key, "seed"))

    def noise(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), seeds.to_pylist(), strict=True)
        return pa.array([None if t is None else noisy(t, s, NOISE) for t, s in pairs], pa.string())

    return copies.withColumn("noisy", F.arrow_udf(noise, "string")(F.col(text), F.col("seed")))


def lexicon_from(spark: SparkSession, **options) -> L.Lexicon:
    """The demonstration lexicon, loaded."""
    return L.load(L.demo_lexicon(spark), L.DEMO_ALLOWED, L.HARD_TERMS, **options)
