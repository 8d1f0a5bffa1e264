"""Lexicons as tables give the hits of the layers they replace, however long and however cut."""

import pytest
from pyspark.sql import functions as F

from modspark import schemas
from modspark.operators import lexicon as L
from modspark.operators import term_table as TT
from modspark.operators import verdict as V

TEXTS = ["you idiot!", "shut up, clown", "clownfish are no clowns", "w o r t h l e s s", "worthlesss and m0ron", "أنت غبي جدا", "يا حمار", "حمارة وغبيه",
         "go   away loser", "Go away loser", "3abeet", "murderous murder", "hurt-you hurt you", "", "  ", None, "closer", "idiots", "لا شيء", "p4thetic s.c.u.m",
         "x" * 50_000 + " scum", "İdiot ıdiot", "compassion pathetic losers", "dis gust ing"]


def rows_of(hits):
    names = ("layer", "variant", "ord", "rule_id", "category", "severity", "confidence", "item", "term")
    return sorted((r["id"], *[r[n] for n in names]) for r in hits.collect())


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


def narrow(spark, messages, lexicon, hard=L.HARD_TERMS):
    """The same layers as expressions over plan literals."""
    lex = L.load(lexicon, L.DEMO_ALLOWED, hard)
    return V.with_hits(messages, "text", lex).select("id", F.inline("hits")).where(F.col("layer").isin(0, 5, 6, 7))


@pytest.mark.parametrize("chunk", [100_000, 4])
def test_equals_the_layers(spark, messages, chunk):
    more = [(100, "idiot", "insult", "low", "stem", "en", False, False), (101, "حمار", "insult", "low", "stem", "ar", False, False),
            (102, "worthless", "insult", "low", "legacy", "en", False, False), (103, "hurt you", "threat", "low", "exact", "en", False, False),
            (104, "or", "insult", "low", "stem", "en", False, True), (105, "idiot", "insult", "low", "exact", "arabizi", False, False)]
    lexicon = L.demo_lexicon(spark).unionByName(spark.createDataFrame(more, schemas.LEXICON))
    got = TT.table_hits(messages, "id", "text", lexicon, L.DEMO_ALLOWED, L.HARD_TERMS, chunk=chunk)
    assert rows_of(got) == rows_of(narrow(spark, messages, lexicon))


def test_no_terms_no_texts_and_terms_that_fold_to_nothing(spark, messages):
    lexicon = L.demo_lexicon(spark)
    assert TT.table_hits(messages, "id", "text", lexicon.limit(0)).count() == 0
    assert TT.table_hits(messages.limit(0), "id", "text", lexicon).count() == 0
    empty = spark.createDataFrame([(1, "", "x", "low", "stem", "en", False, False), (2, None, "x", "low", "exact", "en", False, False)], schemas.LEXICON)
    assert TT.table_hits(messages, "id", "text", empty).count() == 0


def test_a_long_list_is_no_longer_plan(spark, messages):
    """Many terms make neither a longer plan nor other answers for the terms among them."""
    fill = spark.range(30_000).select(
        (F.col("id") + 1000).cast("int").alias("ord"), F.concat(F.lit("zq"), F.md5(F.col("id").cast("string"))).alias("term"), F.lit("insult").alias("category"),
        F.lit("low").alias("severity"), F.lit("stem").alias("kind"), F.lit("en").alias("script"), F.lit(False).alias("fuzzy"), F.lit(False).alias("critical"))
    lexicon = L.demo_lexicon(spark)
    few = TT.table_hits(messages, "id", "text", lexicon, L.DEMO_ALLOWED, L.HARD_TERMS)
    many = TT.table_hits(messages, "id", "text", lexicon.unionByName(fill), L.DEMO_ALLOWED, L.HARD_TERMS)
    plan = lambda df: len(df._jdf.queryExecution().toString())
    assert rows_of(many) == rows_of(few) and plan(many) < 1.1 * plan(few)
