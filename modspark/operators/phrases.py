"""P11 for phrase tables of any length: candidates by an equality join on word runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.functions import text as T

#: Words of the longest run that phrases and texts meet on, and letters where a phrase has no whole word inside.
RUN, LETTERS = 4, 4


def _runs(tokens: Column, size: int) -> Column:
    """Every run of ``size`` neighbouring words."""
    n = F.size(tokens)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " ")))


def _grams(tokens: Column, size: int) -> Column:
    """Every piece of ``size`` letters inside a word."""
    longer = F.filter(F.array_distinct(tokens), lambda w: F.length(w) >= size)
    return F.array_distinct(F.flatten(F.transform(
        longer, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substring(w, i, F.lit(size))))))


def _signs(text: Column) -> Column:
    """Distinct letters that belong to no word."""
    return F.array_distinct(F.split(F.regexp_replace(text, r"[\p{L}\p{N}]+", ""), ""))


def _labelled(kind: str, anchors: Column) -> Column:
    return F.transform(anchors, lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("anchor")))


def long_phrases(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str) -> DataFrame:
    """(key, phrase_key) where the lower-cased text holds the lower-cased phrase anywhere.

    The inner words of a phrase stand whole and in a row wherever it occurs, so texts and phrases of
    three words or more meet on a run of up to ``RUN`` inner words. A phrase of one or two words
    meets on the first letters of its first word, which some word of the text holds, and a phrase
    without words on its first sign. Spark broadcasts or sorts the phrase side by its size;
    candidates are verified on the whole text. Empty and null phrases are nowhere.
    """
    words = phrases.select(phrase_key, F.lower(phrase).alias("needle")).where("needle != ''").withColumn("words", T.tokens(F.col("needle")))
    n, first = F.size("words"), F.get("words", F.lit(0))
    run, letters = F.least(n - 2, F.lit(RUN)), F.least(F.length(first), F.lit(LETTERS))
    anchored = words.select(
        phrase_key, "needle",
        F.when(n >= 3, F.concat(F.lit("w"), run)).when(n >= 1, F.concat(F.lit("l"), letters)).otherwise("s").alias("kind"),
        F.when(n >= 3, F.array_join(F.slice("words", F.lit(2), F.greatest(run, F.lit(1))), " "))
        .when(n >= 1, F.substring(first, F.lit(1), letters)).otherwise(F.substring("needle", 1, 1)).alias("anchor"))
    texts = docs.select(key, F.lower(text).alias("hay")).withColumn("words", T.tokens(F.col("hay")))
    makers = {f"w{i}": _runs(F.col("words"), i) for i in range(1, RUN + 1)}
    makers |= {f"l{i}": _grams(F.col("words"), i) for i in range(1, LETTERS + 1)} | {"s": _signs(F.col("hay"))}
    # Only the kinds that some phrase has are made; there are at most nine.
    kinds = [r.kind for r in anchored.select("kind").distinct().collect()]
    if not kinds:
        return docs.select(key).limit(0).join(phrases.select(phrase_key).limit(0))
    made = F.flatten(F.array(*[_labelled(k, makers[k]) for k in sorted(kinds)]))
    spread = texts.select(key, F.inline(made))
    # Both orders matter here: anchors are narrowed to those of some phrase before texts move.
    pairs = spread.join(anchored, ["kind", "anchor"]).select(key, phrase_key, "needle").distinct()
    return pairs.join(texts.select(key, "hay"), key).where(F.contains("hay", F.col("needle"))).select(key, phrase_key)
