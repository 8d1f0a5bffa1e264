"""Lexicons of any size as tables (S4, S5; P11-P15), matched in time that hardly depends on their size.

The terms never stand in the plan. They are cut into chunks of bounded size by a hash; each chunk
makes one automaton that finds all of its terms in one walk over a text, in a narrow pass over the
messages: no join, no shuffle, nothing that grows with the lexicon but the number of passes. The
texts' forms are made once and, for more than one chunk, written once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.durable import written
from modspark.functions import text as X
from modspark.operators.lexicon import LAYERS, allowed_words, framed, prepare

#: Terms that a pass is meant to hold: some 100 bytes each on the driver and in every worker.
CHUNK = 100_000
#: How a term was found: anywhere, at the beginning of a word, as a whole word.
INSIDE, BEGINS, WHOLE = 1, 2, 4
EDGES = " \u0001"
HIT = T.StructType([
    T.StructField("layer", T.IntegerType()), T.StructField("variant", T.IntegerType()), T.StructField("ord", T.IntegerType()),
    T.StructField("rule_id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("item", T.StringType()), T.StructField("term", T.StringType())])
_FIELDS = ("ord", "term", "folded", "collapsed", "category", "severity", "kind", "script")


def _joined(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]+", ""), F.lit(" "), F.lit(""))


def views(df: DataFrame, key: str, text: str, allowed: tuple[str, ...], normalize: bool) -> DataFrame:
    """key, and the forms of the text that terms are looked for in; blank texts (P19) have none and are left out."""
    lex = _Allowed(allowed)
    raw = F.coalesce(F.col(text), F.lit(""))
    made = X.with_bundle(df.select(F.col(key).alias("key"), raw.alias("raw_text")), "raw_text", normalize).withColumn("raw_folded", X.fold_arabic(F.col("raw_text")))
    return made.where(X.strip_spaces(F.col("raw_text")) != "").select(
        "key", framed(F.col("raw_folded")).alias("quick"), _joined(F.col("raw_folded")).alias("joined"),
        F.array(*[framed(F.col(c)) for c in ("folded", "leet", "latin_arabic")]).alias("frames"),
        F.array(*[F.lower(c) for c in ("raw_text", "folded", "leet", "latin_arabic", "compact_ar")]).alias("forms"), F.col("compact_variants").alias("compact"),
        allowed_words(X.tokens(F.col("raw_text")), lex).alias("raw_excusers"), allowed_words(X.token_union(), lex).alias("excusers"))


class _Allowed:
    def __init__(self, words: tuple[str, ...]):
        self.allowed = tuple(sorted({w.lower() for w in words}))


class Matcher:
    """The terms of one chunk."""

    def __init__(self, entries: list[tuple], hard: tuple[str, ...]):
        self.entries = [dict(zip(_FIELDS, e, strict=True)) for e in entries]
        self.hard = set(hard)
        needles: dict[str, list[int]] = {}
        for i, e in enumerate(self.entries):
            for word in {e["folded"], e["collapsed"]}:
                if word:
                    needles.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, owners in needles.items():
            self.automaton.add_word(word, (word, owners))
        if needles:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[str, tuple[int, list[int]]]:
        """How each term of the chunk occurs in ``text``, and whose it is."""
        found: dict[str, tuple[int, list[int]]] = {}
        last = len(text) - 1
        for end, (word, owners) in self.automaton.iter(text):
            how, start = INSIDE, end - len(word)
            if start >= 0 and text[start] in EDGES:
                how |= BEGINS | (WHOLE if end < last and text[end + 1] in EDGES else 0)
            old = found.get(word)
            found[word] = (how | old[0] if old else how, owners)
        return found

    def _excused(self, word: str, words: list[str]) -> bool:
        return word != "" and word not in self.hard and any(word in w and word != w for w in words)

    def hits(self, row: dict) -> Iterator[tuple]:
        """(layer name, variant, entry, item, term) of one text."""
        known: dict[str, dict] = {}

        def seen(text: str) -> dict:
            if text not in known:
                known[text] = self.find(text)
            return known[text]

        quick, joined = seen(row["quick"]), seen(row["joined"])
        frames, forms = [seen(t) for t in row["frames"]], [seen(t) for t in row["forms"]]
        compact = [seen(t) for t in row["compact"]]
        met = {i for found in (quick, joined, *frames, *forms, *compact) for _, owners in found.values() for i in owners}
        how = lambda found, word: found[word][0] if word in found else 0
        for i in sorted(met):
            e = self.entries[i]
            word, short, kind, script = e["folded"], e["collapsed"], e["kind"], e["script"]
            packed = any(len(w) >= 3 and w in found for w in (word, short) for found in compact)
            if kind == "legacy":
                if how(quick, word) & WHOLE or (e["term"] in self.hard and len(word) >= 4 and word in joined):
                    if not self._excused(e["term"].lower(), row["raw_excusers"]):
                        yield "legacy", 0, e, e["term"], e["term"].lower()
            elif kind == "phrase":
                for at, found in enumerate(forms):
                    if word in found:
                        yield "phrase", at, e, word, word
            elif self._excused(word, row["excusers"]):
                continue
            elif script == "ar":
                if kind == "stem" and (word in forms[1] or short in forms[1] or packed):
                    yield "ar_stem", 0, e, e["term"], word
                elif kind == "exact" and how(frames[0], word) & WHOLE:
                    yield "ar_exact", 0, e, e["term"], word
            elif kind == "stem" and (packed or any(how(f, w) & BEGINS for f in frames for w in (word, short))):
                yield "en_stem", 0, e, word, word
            elif kind == "exact" and any(how(f, word) & WHOLE for f in frames):
                yield "en_exact", 0, e, word, word


def _struct(layer: str, variant: int, e: dict, item: str, term: str) -> tuple:
    number, rule, confidence = LAYERS[layer]
    category, severity = ("profanity", "high") if layer == "legacy" else (e["category"], e["severity"])
    return number, variant, e["ord"], rule, category, severity, confidence, item, term


def table_hits(df: DataFrame, key: str, text: str, lexicon: DataFrame, allowed: tuple[str, ...] = (), hard: tuple[str, ...] = (),
               normalize: bool = True, chunk: int = CHUNK) -> DataFrame:
    """``key`` and one row per hit of layers 0 and 5-7 by the terms of ``lexicon``, however many they are.

    The rules are those of ``quick_hits``, ``phrase_hits``, ``arabic_hits`` and ``latin_hits``. Terms that
    fold to nothing are nowhere. ``allowed`` and ``hard`` are short lists. Rows that share a key each
    have their own hits; null texts have none.
    """
    terms = prepare(lexicon).select(*_FIELDS).where("folded != ''")
    parts = max(1, math.ceil(terms.count() / chunk))
    made = views(df, key, text, allowed, normalize)
    if parts > 1:
        made = written(made, "term-views")
        terms = written(terms, "terms")
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *HIT.fields])
    spark, out = df.sparkSession, None
    for part in range(parts):
        held = spark.sparkContext.broadcast([tuple(r) for r in _part(terms, part, parts)])

        def step(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, hard)
            for batch in batches if matcher.entries else ():
                at, found = [], []
                for i, row in enumerate(batch.drop_columns(["key"]).to_pylist()):
                    made = [_struct(*h) for h in matcher.hits(row)]
                    at += [i] * len(made)
                    found += made
                columns = [pa.array(list(c)) for c in zip(*found, strict=True)]
                if found:
                    columns[:3] = [c.cast(pa.int32()) for c in columns[:3]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(at)), *[c.cast(pa.string()) if i in (3, 4, 5, 7, 8) else c for i, c in enumerate(columns)]],
                        names=[key, *HIT.names])

        hits = made.mapInArrow(step, schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def _part(terms: DataFrame, part: int, parts: int) -> list[Row]:
    """One chunk of the terms; of bounded size, as the hash deals them evenly."""
    if parts == 1:
        return terms.collect()
    return terms.where(F.pmod(F.xxhash64("term", "kind", "ord"), F.lit(parts)) == part).collect()
