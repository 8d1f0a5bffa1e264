import random

from pyspark.sql import functions as F

from modspark.functions import distance as D
from modspark.operators import verdict as V


def osa(a, b):
    """Plain dynamic programme, for comparison only."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def words(n, seed, alphabet="abcé"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(n)]


def test_distance_within_the_limit_is_exact(spark):
    pairs = [("ca", "abc"), ("ab", "ba"), ("same", "same"), ("x" * 61, "x" * 61 + "y")] + list(zip(words(300, 1), words(300, 2)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", D.bounded_distance(F.col("a"), F.col("b"), 2).alias("d")).collect():
        true = osa(r.a, r.b)
        if true <= 2:  # long words too
            assert r.d == true
        else:
            assert r.d > 2


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("", "x"), ("kitten", "sitting")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(D.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, round(1 - 3 / 7, 4)]


def test_length_rules(spark):
    cases = [("cat", "car", False), ("pahtetic", "pathetic", True), ("mroon", "moron", True), ("lsoer", "loser", True),
             ("worthles", "worthless", True), ("wrothles", "worthless", True), ("moon", "moron", True), ("maroons", "moron", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    for r in df.withColumn("sim", D.fuzzy_similarity(F.col("a"), F.col("b"))).collect():
        assert (r.sim is not None) == r.want, r


def test_candidate_join_misses_nothing(spark):
    tokens, terms = sorted(set(words(400, 3, "abc"))), sorted({w for w in words(60, 4, "abc") if len(w) >= 4})
    got = {(r.token, r.term) for r in V.fuzzy_pairs(
        spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}

    def match(a, b):
        if len(a) < 4 or len(b) < 4:
            return False
        limit, d = (1 if len(b) <= 6 else 2), osa(a, b)
        sim = 1 - d / max(len(a), len(b))
        enough = sim >= 0.8 or sorted(a) == sorted(b) if len(b) <= 6 else sim >= 0.75
        return d <= limit and enough and sim >= 0.75

    assert got == {(a, b) for a in tokens for b in terms if match(a, b)}
