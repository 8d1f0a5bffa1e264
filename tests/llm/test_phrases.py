"""Collocations against brute force; the language model's counts against brute force and its probabilities by their sum."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from modspark.llm import collocations, language_model, word_blocks
from modspark.llm.language_model import END, ENDINGS, FREQUENT, OUTPUTS, START, Model, Trainer

KIND = "doc_id long, lang string, text string, block int, codes string, a int"
ODD = [(1, None, None), (None, "und", ""), (2, "en", "Big deal, big Deal"), (2, "en", "Big deal, big Deal"), (3, "en", " \t \n..!?"),
       (4, "en", "\x00 null\x0bvertical\x0cfeed\r\nÀB ÀB"), (5, None, "big deal " * 30_000), (6, "de", "x" * 300_000), (7, "fr", "a b a b " * 40)]


def phrases(rows, least=10, top=2000, held=50):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= held * found[q]}
        ranked = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("budget", [collocations.BUDGET, 700])
def test_phrases_given(spark, budget):
    """The same with groups of few suffixes, where frequent words and pairs are split over many."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = phrases([tuple(r) for r in df.select("lang", "text").collect()])
    assert sorted(map(tuple, collocations.collocations(df, budget=budget).collect())) == want


@pytest.mark.parametrize("least", [1, 2])
def test_phrases_odd(spark, monkeypatch, least):
    monkeypatch.setattr(word_blocks, "SLICE", 1000)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in ODD], KIND).repartition(3)
    got = collocations.collocations(df, least=least, top=5)
    assert sorted(map(tuple, got.collect())) == phrases([r[1:] for r in ODD], least, 5)


def test_phrases_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], KIND)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "en", None, 1, "x", 2)], KIND)).count() == 0


def test_one_word_holds_a_third(spark):
    """A word, a pair and a triple of words that hold much of the text, split over groups and merged."""
    rows = [(i, "en", f"of the same w{i % 5} of the w{i % 3} of") for i in range(600)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND).repartition(4)
    assert sorted(map(tuple, collocations.collocations(df, budget=20).collect())) == phrases([r[1:] for r in rows])


def test_leaves_of_wide_numbers():
    rng = np.random.default_rng(1)
    w = [rng.integers(1, 4, 500).astype(np.uint32) for _ in range(3)]
    narrow, wide = collocations.leaves(w, 20), collocations.leaves(w, 30)
    assert all((a == b).all() for a, b in zip([*narrow[0], narrow[1]], [*wide[0], wide[1]], strict=True))


def base(rows, parts=7, held=2):
    """Per row: held out, tokens, known ones, base score; and the number of training tokens."""
    said = [(zlib.crc32(b"" if i is None else str(i).encode()) % parts == held, [*(text or "").encode().lower().split(), None]) for i, text in rows]
    counts = Counter(w for out, words in said if not out for w in words)
    total = sum(counts.values())
    score = lambda words: sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words)
    return sorted((out, len(words), sum(counts[w] > 0 for w in words), total, round(score(words), 5)) for out, words in said)


def plain(rows):
    return sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)


def test_model_given(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_model.score(df).collect()
    assert plain(got) == base([tuple(r) for r in df.select("doc_id", "text").collect()])
    held = [r for r in got if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.05


def test_model_odd(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "SLICE", 1000)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in ODD], KIND).repartition(3)
    got = language_model.score(df).collect()
    assert plain(got) == base([(i, text) for i, _, text in ODD])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score(spark.createDataFrame([], KIND)).count() == 0


def test_model_without_training_texts(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    df = spark.createDataFrame([(i, "en", "some words", 1, "x", 2) for i in held], KIND)
    got = language_model.score(df).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 4 and all(math.isfinite(r.score) for r in got)


def test_probabilities_add_up():
    """Over all known words, the end and one unknown word of each class, in any context."""
    words = {f"w{i}".encode(): 3 + i % 50 for i in range(2000)}
    ranked = sorted(words.items(), key=lambda x: (-x[1], x[0]))
    frequent, rare = ranked[:FREQUENT], ranked[FREQUENT:]
    totals = Counter()
    for w, n in rare:
        totals[language_model.ending(w)] += n + 1
    known = language_model.Vocabulary(frequent, totals, 7, sum(words.values()) + 7, len(words) + 1)
    assert known.frequency.sum() == pytest.approx(1)
    model = Model.fresh(known.frequency)
    trainer = Trainer(model, known.frequency, 1)
    rng = np.random.default_rng(2)
    for _ in range(20):
        trainer.step(*rng.integers(0, OUTPUTS, (3, 64)), rng.integers(1, 5, 64).astype(float))
    for one, two in ((START, START), (5, 400), (OUTPUTS - 1, END)):
        outputs = np.arange(OUTPUTS)
        p = np.exp(model.log_probabilities(np.full(OUTPUTS, one), np.full(OUTPUTS, two), outputs))
        rest = sum(p[language_model.ending(w)] * (n + 1) / known.totals[language_model.ending(w)] for w, n in rare)
        unknown = sum(p[k] / known.totals[k] for k in range(1 + FREQUENT, 1 + FREQUENT + ENDINGS))
        assert p[:FREQUENT + 1].sum() + rest + unknown == pytest.approx(1, abs=1e-4)


def test_training_learns_the_context():
    """After a symbol that one output always follows, that output becomes near certain."""
    frequency = np.full(OUTPUTS, 1 / OUTPUTS)
    trainer = Trainer(Model.fresh(frequency), frequency, 3)
    rng = np.random.default_rng(4)
    for _ in range(400):
        one = rng.integers(0, 8, 256)
        trainer.step(one, rng.integers(0, OUTPUTS, 256), (one + 1) % 8, np.ones(256))
    p = trainer.model.log_probabilities(np.arange(8), np.full(8, 20), (np.arange(8) + 1) % 8)
    assert np.exp(p).min() > 0.5
