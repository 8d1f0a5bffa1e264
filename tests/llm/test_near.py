"""Near dedup of the pipeline against exact Jaccard similarity by brute force."""

import itertools
import random

import corpus_pipeline
from modspark.llm import near_dedup
from tests.llm.test_dedup import ODD, Union

FOLDER = "/root/testdata/sf0.01"


def runs(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def components(texts):
    """Smallest id of each id's group."""
    u, sets = Union(), {i: runs(t) for i, t in texts.items()}
    for i in texts:
        u.find(i)
    for i, j in itertools.combinations(sorted(texts), 2):
        small, large = sorted((len(sets[i]), len(sets[j])))
        if 5 * small >= 4 * large and alike(sets[i], sets[j]):
            u.join(i, j)
    return {i: u.find(i) for i in texts}


def changed(rng, words, swaps):
    out = list(words)
    for at in rng.sample(range(len(words)), swaps):
        out[at] = f"new{rng.random()}"
    return out


def crafted():
    """Copies on either side of 0.8, short ones, chains, and one repeated line more or less often."""
    rng, texts = random.Random(5), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for n in (8, 9, 10, 12, 20, 60, 200, 900):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts += [base, [*base, word()], base[2:], *[changed(rng, base, s) for s in range(1, 1 + max(1, n // 30))]]
    for n in (30, 100, 400):
        chain = [word() for _ in range(n)]
        for k in range(5):
            texts.append(chain[k * n // 12:] + [word() for _ in range(k * n // 12)])
    line = [word() for _ in range(7)]
    texts += [line * 3, line * 40, line * 3 + [word()]]
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_pipeline_groups_are_those_of_exact_similarity(spark):
    made, docs = crafted(), spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    for texts in (made, {r.doc_id: r.text for r in docs.collect()}):
        want = components(texts)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, FOLDER).collect()}
        assert kept == set(want.values())
    for tile in (20, 10_000):
        got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(list(made.items()), "doc_id long, text string"), tile=tile).collect()}
        assert got == components(made)


def test_near_odd_rows(spark):
    odd = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in ODD], "doc_id long, text string, part int, digest string, kept int").repartition(3)
    rows = near_dedup.near_dedup(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    kept = near_dedup.drop_near(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [5, 7, 9]
    assert near_dedup.near_dedup(odd.limit(0)).count() == 0 and near_dedup.drop_near(odd.limit(0)).count() == 0


def test_look_alikes_that_do_not_link(spark, monkeypatch):
    """A group whose fingerprints are close but whose sets are mostly not alike: what leaves a task grows with nodes, not pairs."""
    monkeypatch.setattr(near_dedup, "CELL", 32)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {i: " ".join(base[: 100 - i % 3] + [f"x{i % 90}_{k}" for k in range(22 + i % 3)]) for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(df).collect()} == components(texts)
    made = near_dedup.fingerprints(df, "doc_id", "text", 5).withColumnRenamed("doc_id", "node")
    cells = near_dedup.proposed(made, 10_000)
    assert cells.count() == cells.distinct().count() <= 2 * len(texts) * (len(texts) // 32 + 1)
    assert cells.select("node").distinct().count() == len(texts)


def test_tiles_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE_BYTES", 3000)
    made = crafted()
    got = near_dedup.near_dedup(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == components(made)
