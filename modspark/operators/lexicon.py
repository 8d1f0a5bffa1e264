"""Lexicons as tables (S4, S5) and the matchers over them.

A lexicon is a curated word list.  Its size is counted first; it is then matched
``CHUNK`` entries at a time as plan literals, so matching is a narrow projection
over the messages: no join, no shuffle, nothing broadcast.  A longer lexicon is
simply more chunks.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from modspark import schemas
from modspark.functions import text as T
from modspark.functions.bind import once

CHUNK = 2000
FEW = 48
MAX_TERMS = 200_000

HIT = ("struct<layer:int,variant:int,ord:int,rule_id:string,category:string,severity:string,"
       "confidence:double,item:string,term:string>")
NO_HITS = f"array<{HIT}>"

# Tie of a matching layer to its rule name and confidence.
LAYERS = {
    "legacy": (0, "RULE_LEGACY_FAST_PRECHECK", 1.0),
    "pii": (1, "RULE_PII_LEAK", 0.95),
    "link": (2, "RULE_ALL_LINKS", 1.0),
    "evasive": (3, "RULE_EVASIVE_REGEX", 0.98),
    "insertion": (4, "RULE_CHARACTER_INSERTION", 0.98),
    "phrase": (5, "RULE_ABUSIVE_PHRASE", 0.99),
    "ar_stem": (6, "RULE_AR_DICT_STEM", 0.95),
    "ar_exact": (6, "RULE_AR_DICT_EXACT", 0.95),
    "en_stem": (7, "RULE_EN_DICT_STEM", 0.95),
    "en_exact": (7, "RULE_EN_DICT_EXACT", 0.95),
    "fuzzy": (8, "RULE_BOUNDED_FUZZY", None),
}

# A small list of its own, mild on purpose; real deployments pass their tables.
DEMO_TERMS = (
    # term, category, severity, kind, script, fuzzy, critical
    ("idiot", "insult", "medium", "legacy", "en", False, False),
    ("shut up", "insult", "low", "phrase", "en", False, False),
    ("go away loser", "harassment", "high", "phrase", "en", False, False),
    ("worthless", "insult", "medium", "stem", "en", True, True),
    ("moron", "bullying", "low", "stem", "en", True, True),
    ("clown", "bullying", "low", "exact", "en", True, False),
    ("pathetic", "insult", "medium", "stem", "en", True, False),
    ("disgusting", "insult", "medium", "stem", "en", True, False),
    ("loser", "insult", "medium", "stem", "en", True, True),
    ("scum", "hate", "high", "exact", "en", False, False),
    ("hurt you", "threat", "critical", "stem", "en", False, False),
    ("murder", "violence", "high", "stem", "en", True, False),
    ("غبي", "insult", "medium", "stem", "ar", False, False),
    ("حمار", "insult", "medium", "exact", "ar", False, False),
    ("3abeet", "bullying", "low", "stem", "arabizi", False, False),
)
DEMO_ALLOWED = ("murderous", "compassion", "clownfish", "closer", "losers", "assessment")
HARD_TERMS = ("worthless",)


def demo_lexicon(spark: SparkSession) -> DataFrame:
    """The built-in demonstration lexicon."""
    rows = [(i, *entry) for i, entry in enumerate(DEMO_TERMS)]
    return spark.createDataFrame(rows, schemas.LEXICON)


def with_custom_terms(lexicon: DataFrame, terms: DataFrame) -> DataFrame:
    """Extra words (column ``term``) become high profanity stems after the others."""
    last = lexicon.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    extra = (
        terms.select("term").where(T.strip_spaces(F.col("term")) != "").distinct().crossJoin(last)
        .select(
            (F.col("last") + 1).cast("int").alias("ord"), "term", F.lit("profanity").alias("category"),
            F.lit("high").alias("severity"), F.lit("stem").alias("kind"),
            F.when(F.col("term").rlike(r"[\u0600-\u06ff]"), "ar").otherwise("en").alias("script"),
            F.lit(True).alias("fuzzy"), F.lit(False).alias("critical"),
        )
    )
    return lexicon.unionByName(extra)


def prepare(lexicon: DataFrame) -> DataFrame:
    """Fold every term the way messages are folded."""
    term = F.col("term")
    folded = F.when(F.col("script") == "ar", T.fold_arabic(term)).otherwise(F.lower(term))
    return (
        lexicon.withColumn("folded", F.lower(folded))
        .withColumn("collapsed", T.collapse_runs(F.col("folded")))
        .withColumn("squeezed", T.compact(F.col("folded")))
    )


@dataclass(frozen=True)
class Lexicon:
    """Prepared entries on the driver: bounded by ``MAX_TERMS`` and checked."""

    entries: tuple[Row, ...]
    allowed: tuple[str, ...] = ()
    hard: tuple[str, ...] = ()

    def of(self, *kinds: str, script: tuple[str, ...] | None = None) -> list[Row]:
        return [e for e in self.entries if e.kind in kinds and (script is None or e.script in script)]

    def critical(self) -> list[Row]:
        return [e for e in self.entries if e.critical]


def load(lexicon: DataFrame, allowed: tuple[str, ...] = (), hard: tuple[str, ...] = ()) -> Lexicon:
    rows = prepare(lexicon).orderBy("ord", "term").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a lexicon holds at most {MAX_TERMS} terms; split it by policy")
    return Lexicon(tuple(rows), tuple(sorted({a.lower() for a in allowed})), tuple(hard))


def chunks(entries: list[Row]) -> list[list[Row]]:
    return [entries[i:i + CHUNK] for i in range(0, len(entries), CHUNK)]


def any_of(words: list[str]) -> str:
    """One regex that finds any of ``words``, sharing common beginnings so that each
    position of a text is left after a few steps however long the list is."""
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def render(node: dict) -> str:
        if "" in node:  # a shorter word already decides
            return ""
        branches = [re.escape(char) + render(child) for char, child in sorted(node.items())]
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    if not tree:
        return r"(?!)"
    # A single class tells at most positions that no word begins there.
    return "(?=[" + "".join(re.escape(c) for c in sorted(tree)) + "])" + render(tree)


ENTRY = ("array<struct<ord:int,term:string,folded:string,collapsed:string,kind:string,category:string,"
         "severity:string,pattern:string>>")


def _literal_entries(entries: list[Row], pattern=None) -> Column:
    """Entries as one constant: Spark folds the parsed text into a literal when planning,
    so a long list costs one expression, not one per field."""
    fields = ("ord", "term", "folded", "collapsed", "kind", "category", "severity")
    rows = [{**{f: e[f] for f in fields}, **({"pattern": pattern(e.folded)} if pattern else {})} for e in entries]
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), ENTRY)


def _hit(layer: str, e: Column, item: Column, variant: Column | int = 0) -> Column:
    number, rule, confidence = LAYERS[layer]
    return F.struct(
        F.lit(number).alias("layer"), (F.lit(variant) if isinstance(variant, int) else variant).alias("variant"),
        e["ord"].alias("ord"), F.lit(rule).alias("rule_id"), e["category"].alias("category"),
        e["severity"].alias("severity"), F.lit(confidence).cast("double").alias("confidence"),
        item.alias("item"), e["folded"].alias("term"),
    )


def _none() -> Column:
    return F.array().cast(NO_HITS)


def _found(entries: list[Row], maybe: Column, found) -> Column:
    """Entries whose test holds, as hits; the tests run only where ``maybe`` holds."""
    if not entries:
        return _none()
    parts = [found(_literal_entries(part)) for part in chunks(entries)]
    return F.when(maybe, F.concat(*parts).cast(NO_HITS)).otherwise(_none())


def squeezed_texts() -> Column:
    """All compact forms side by side, for one any-hit test."""
    return F.array_join(F.array_distinct(F.transform("compact_variants", F.lower)), "\u0001")


def letter_runs(*forms: str) -> Column:
    """The letters alone of each form, side by side, each run of one letter taken once."""
    bare = [F.lower(F.regexp_replace(F.col(f), r"[^\p{L}]+", "")) for f in forms]
    return F.regexp_replace(F.array_join(F.array_distinct(F.array(*bare)), "\u0001"), r"(.)\1+", "$1")


def _collapse(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def might_hit(entries: list[Row], texts: Column) -> Column:
    """Cheap necessary test: a compact form holds some compact term."""
    words = sorted({w for e in entries for w in (e.squeezed, _collapse(e.squeezed)) if w})
    if any(not e.squeezed for e in entries):
        return F.lit(True)
    return holds_any(texts, words)


def holds_any(texts: Column, words: list[str]) -> Column:
    """Does the text hold any of the words?  A few words are plain substring scans; many
    are one shared pattern."""
    least = [w for w in words if not any(v != w and v in w for v in words)] if len(words) <= FEW else words
    if not least:
        return F.lit(False)
    if len(least) > FEW:
        return texts.rlike(any_of(words))
    return reduce(lambda a, b: a | b, [F.contains(texts, F.lit(w)) for w in least])


def listed(lex: Lexicon) -> list[Row]:
    """Entries found through compact forms."""
    return lex.of("stem", "exact", "phrase")


def framed(c: Column) -> Column:
    """Lower text in which every separator but a blank is one marker, so that a word
    edge is a plain substring test."""
    return F.concat(F.lit("\u0001"), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ ]", "\u0001"), F.lit("\u0001"))


def _starts_word(frame: Column, word: Column) -> Column:
    return F.contains(frame, F.concat(F.lit(" "), word)) | F.contains(frame, F.concat(F.lit("\u0001"), word))


def _whole_word(frame: Column, word: Column) -> Column:
    sides = [(a, b) for a in (" ", "\u0001") for b in (" ", "\u0001")]
    return reduce(lambda x, y: x | y, [F.contains(frame, F.concat(F.lit(a), word, F.lit(b))) for a, b in sides])


def _in_compact(word: Column, variants: Column) -> Column:
    return (F.length(word) >= 3) & F.exists(variants, lambda v: F.contains(v, word))


def arabic_hits(lex: Lexicon) -> Column:
    """Stems as substrings of the folded or any compact text, other terms as words."""
    entries = lex.of("stem", "exact", script=("ar",))
    folded, variants = F.lower("folded"), F.col("compact_variants")

    def matches(frame: Column):
        def test(e: Column) -> Column:
            stem = (
                F.contains(folded, e["folded"]) | F.contains(folded, e["collapsed"])
                | _in_compact(e["folded"], variants) | _in_compact(e["collapsed"], variants)
            )
            return F.when(e["kind"] == "stem", stem).otherwise(_whole_word(frame, e["folded"]))
        return test

    def found(lits: Column) -> Column:
        matched = once(framed(F.col("folded")), lambda frame: F.filter(lits, matches(frame)))
        return F.transform(matched, lambda e: F.when(
            e["kind"] == "stem", _hit("ar_stem", e, e["term"])).otherwise(_hit("ar_exact", e, e["term"])))

    return _found(entries, F.col("near"), found)


def latin_hits(lex: Lexicon) -> Column:
    """Stems as word beginnings in three forms or substrings of a compact form."""
    entries = lex.of("stem", "exact", script=("en", "arabizi"))
    variants = F.col("compact_variants")
    frames = F.array(*[framed(F.col(c)) for c in ("leet", "latin_arabic", "folded")])

    def matches(frames: Column):
        def test(e: Column) -> Column:
            begins = F.exists(frames, lambda f: _starts_word(f, e["folded"]) | _starts_word(f, e["collapsed"]))
            stem = begins | _in_compact(e["folded"], variants) | _in_compact(e["collapsed"], variants)
            return F.when(e["kind"] == "stem", stem).otherwise(
                F.exists(frames, lambda f: _whole_word(f, e["folded"])))
        return test

    def found(lits: Column) -> Column:
        matched = once(frames, lambda made: F.filter(lits, matches(made)))
        return F.transform(matched, lambda e: F.when(
            e["kind"] == "stem", _hit("en_stem", e, e["folded"])).otherwise(_hit("en_exact", e, e["folded"])))

    return _found(entries, F.col("near"), found)


def phrase_hits(lex: Lexicon) -> Column:
    """Phrases anywhere in five forms; both sides folded."""
    entries = lex.of("phrase")
    forms = F.array(*[F.lower(c) for c in ("raw_text", "folded", "leet", "latin_arabic", "compact_ar")])

    def found(lits: Column) -> Column:
        return F.flatten(F.transform(forms, lambda text, at: F.transform(
            F.filter(lits, lambda e: F.contains(text, e["folded"])),
            lambda e: _hit("phrase", e, e["folded"], at))))

    return _found(entries, F.col("near"), found)


def quick_hits(lex: Lexicon, text: Column, hard: tuple[str, ...] = ()) -> Column:
    """Whole words of the folded text; hard words of four letters or more also
    inside the text without blanks and signs.  ``text`` is folded by the caller."""
    entries = lex.of("legacy")
    if not entries:
        return _none()
    hard_words = [e.folded for e in entries if e.term in hard and len(e.folded) >= 4]
    joined = F.replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", ""), F.lit(" "), F.lit(""))
    maybe = holds_any(F.lower(text), sorted({e.folded for e in entries}))
    if hard_words:
        maybe = maybe | holds_any(joined, sorted(hard_words))
    hard_set = F.array(*[F.lit(w) for w in hard_words]).cast("array<string>")

    def matches(views: Column):
        return lambda e: _whole_word(views["frame"], e["folded"]) | (
            F.array_contains(hard_set, e["folded"]) & F.contains(views["joined"], e["folded"]))

    def found(lits: Column) -> Column:
        views = F.struct(framed(text).alias("frame"), joined.alias("joined"))
        matched = once(views, lambda made: F.filter(lits, matches(made)))
        return F.transform(matched, lambda e: F.struct(
            F.lit(0).alias("layer"), F.lit(0).alias("variant"), e["ord"].alias("ord"),
            F.lit("RULE_LEGACY_FAST_PRECHECK").alias("rule_id"), F.lit("profanity").alias("category"),
            F.lit("high").alias("severity"), F.lit(1.0).alias("confidence"),
            e["term"].alias("item"), F.lower(e["term"]).alias("term")))

    return _found(entries, maybe, found)


def profanity_word(text: Column, lex: Lexicon, normalize: bool = True) -> Column:
    """First listed word found as a word, or inside the joined text when it has
    four letters or more; null when none."""
    entries = list(lex.entries)
    if not entries:
        return F.lit(None).cast("string")
    words = any_of(sorted({e.folded for e in entries}))

    def first(folded: Column) -> Column:
        joined = F.replace(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s]+", ""), F.lit(" "), F.lit(""))
        views = F.struct(framed(folded).alias("frame"), joined.alias("joined"))
        return once(views, lambda v: F.when(
            folded.rlike(words) | v["joined"].rlike(words),
            F.get(F.concat(*[
                F.filter(_literal_entries(part), lambda e: _whole_word(v["frame"], e["folded"])
                         | ((F.length(e["folded"]) >= 4) & F.contains(v["joined"], e["folded"])))
                for part in chunks(entries)]), F.lit(0))["term"]))

    return once(T.fold_for_hash(text, normalize), first)


# Letters that stand in for one another in disguised words: built from the leet and
# Latin-Arabic folds, plus the mask sign.
def _stand_ins(letter: str) -> str:
    leet = "".join(a for a, b in zip(*T.LEET) if b == letter)
    digit = "".join(a for a, b in zip(*T.LATIN_ARABIC_DIGITS) if b == letter)
    mask = "*" if letter.isascii() and letter.isalpha() else ""
    return "[" + "".join(re.escape(c) for c in dict.fromkeys(letter + leet + digit + mask)) + "]"


def _evasive_body(stem: str) -> str:
    return r"[^\p{L}]*".join(_stand_ins(c) + "+" for c in stem)


def _insertion_body(stem: str) -> str:
    noise = r"(?:[^\p{L}\p{N}]|[\p{Nd}a-zA-Z\x{0640}])"
    return f"{noise}{{0,3}}?".join(re.escape(c) for c in stem)


def evasive_pattern(stem: str) -> str:
    """Letters may repeat, be replaced by a stand-in and be set apart by signs,
    blanks or digits; group 1 is the disguised word, bounded by word edges."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({_evasive_body(stem)})(?:$|[^\p{{L}}\p{{N}}_])"


def insertion_pattern(stem: str) -> str:
    """P10: up to three noise characters between any two letters."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}])({_insertion_body(stem)})(?:$|[^\p{{L}}\p{{N}}])"


def _any_body(bodies: list[str], firsts: str, edge: str) -> str:
    """One pattern for all bodies: a class of first letters, then the word edges."""
    return f"(?i)(?={firsts})(?<!{edge})(?:{'|'.join(bodies)})(?!{edge})"


def pattern_hits(layer: str, entries: list[Row], pattern, any_pattern: str, forms: list[str], maybe: Column) -> Column:
    """P9/P10 over several forms of the message.  One combined pattern on the distinct
    forms decides whether the single patterns are tried at all."""
    if not entries:
        return _none()
    texts = F.array(*[F.col(f) for f in forms])
    lits = _literal_entries(entries, pattern)
    hits = F.flatten(F.transform(texts, lambda text, at: F.transform(
        lits, lambda e: _hit(layer, e, F.call_function("regexp_extract", text, e["pattern"], F.lit(1)), at))))
    somewhere = F.exists(F.array_distinct(texts), lambda text: text.rlike(any_pattern))
    return F.when(maybe & somewhere, F.filter(hits, lambda h: h["item"] != "").cast(NO_HITS)).otherwise(_none())


def evasive_hits(lex: Lexicon) -> Column:
    """P9.  Without a digit or sign that can stand for a letter, a disguised word can
    only be repeated or spread letters, and then the bare letters, runs taken once, hold it."""
    entries = lex.critical()
    firsts = "[" + "".join(sorted({_stand_ins(e.folded[0])[1:-1] for e in entries})) + "]"
    together = _any_body([_evasive_body(e.folded) for e in entries], firsts, r"[\p{L}\p{N}_]")
    plain = holds_any(letter_runs("raw_text", "folded", "leet", "latin_arabic"), sorted({_collapse(e.folded.lower()) for e in entries}))
    maybe = F.col("folded").rlike(r"[0-9*@$|+!]") | F.col("raw_text").rlike(r"[*]") | plain
    return pattern_hits("evasive", entries, evasive_pattern, together,
                        ["raw_text", "folded", "leet", "latin_arabic", "compact_ar", "compact_collapsed",
                         "compact_leet", "compact_arab"], maybe)


def insertion_hits(lex: Lexicon) -> Column:
    entries = lex.critical()
    firsts = "[" + "".join(sorted({re.escape(e.folded[0]) for e in entries})) + "]"
    together = _any_body([_insertion_body(e.folded) for e in entries], firsts, r"[\p{L}\p{N}]")
    return pattern_hits("insertion", entries, insertion_pattern, together,
                        ["raw_text", "folded", "leet", "latin_arabic", "homoglyphs"], F.lit(True))


def is_excused(term: Column, words: Column, lex: Lexicon) -> Column:
    """An allowed word of the message holds the term and is more than the term;
    hard terms are never excused.  ``words`` are the message's allowed words."""
    return ~term.isin(*lex.hard, "") & F.exists(words, lambda w: F.contains(w, term) & (w != term))


def allowed_words(tokens: Column, lex: Lexicon) -> Column:
    if not lex.allowed:
        return F.array().cast("array<string>")
    return F.array_intersect(F.transform(tokens, F.lower), F.array(*[F.lit(a) for a in lex.allowed]))
