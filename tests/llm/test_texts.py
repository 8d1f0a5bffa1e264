"""Language ID, piece lattice, token files, toxicity: held-out accuracy, exact round trips, distributions."""

import collections
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modspark.llm import dac, langid, piece_lattice, token_files, toxicity

FOLDER = "/root/testdata/sf0.01"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(None, "a b"), (None, "a  b"), (5, "a\tb"), (5, "!!! 1"), (7, None), (8, ""), (9, "x " * 20000), (9, "x " * 20000), (10, "y" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1.0, [1]) for i, t in ODD], "doc_id long, text string, lang string, score double, ids array<int>").repartition(3)


def test_language_of_held_out_documents(docs):
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.01 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd, spark):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD)
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in rows if r.doc_id in (7, 8))
    kept = langid.known_language(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 5, 9, 10}
    assert langid.identify(odd.limit(0)).count() == 0
    unknown = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.rejected) for r in langid.identify(unknown).collect()] == [("und", True)]


def test_language_rejects_what_is_far(docs, spark):
    strange = spark.createDataFrame([(10**9, "ქართული ენა არის " * 50, "en", "s", 1)], docs.schema)
    model = langid.train(docs.select("text", "lang"))
    lang, score, rejected = model.predict([strange.first().text, docs.first().text])
    assert rejected.tolist() == [True, False]


def test_no_document_learnt_from_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    strange = spark.createDataFrame([(-1, "ქართული ენა არის " * 50, None)], docs.schema)
    known = {r.doc_id for r in docs.filter("lang is not null").collect() if any(c.isalpha() for c in r.text or "")}
    kept = {r.doc_id for r in langid.known_language(docs.unionByName(strange)).select("doc_id").collect()}
    assert not known - kept and -1 not in kept


@pytest.mark.parametrize("left", ["en", "fr", "de", "es"])
def test_a_language_left_out_is_rejected(spark, left):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs.filter(F.col("lang") != left).select("text", "lang"))
    rows = langid.predict(docs, model, {"own": F.col("lang") != left}).groupBy("own").agg(F.avg(F.col("rejected").cast("int")).alias("gone")).collect()
    gone = {r.own: r.gone for r in rows}
    assert gone[False] > 0.8 and gone[True] < 0.005


def test_one_odd_row_does_not_open_a_length(spark):
    words = "water river stone mountain forest winter summer garden window letter".split()
    plain = [(" ".join(random.Random(i).choices(words, k=20)), "en") for i in range(4000)]
    odd = ("zqx jvk wqz xkj " * 10, "en")
    rows = spark.createDataFrame([*plain, odd], "text string, lang string")
    assert langid.train(rows, sample=400).predict([odd[0], plain[0][0], "kzv qwj xxz vvk " * 10])[2].tolist() == [True, False, True]


def test_copies_count_once_in_the_sample(spark):
    rows = spark.createDataFrame([(f"some text number {chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(300)], "text string, lang string")
    copies = spark.range(3000).select(F.lit("una frase que se repite").alias("text"), F.lit("en").alias("lang"))
    heavy = langid.train(rows.unionByName(copies))
    assert heavy.predict(["una frase que se repite"])[1][0] < 0.5  # one text among many, not a centroid of its own
    assert heavy.predict(["some text number"])[1][0] > 0.5


def plain_vectors(texts, idf=None):
    """TF-IDF vectors by loops over letters; a dictionary per text."""
    def spots(text):
        letters = [c if c.isalpha() else " " for c in f" {text.lower()} "]
        letters = [c for i, c in enumerate(letters) if i == 0 or not (c == " " and letters[i - 1] == " ")]
        found = collections.Counter()
        for n in (2, 3):
            for i in range(len(letters) - n + 1):
                if any(c != " " for c in letters[i:i + n]):
                    h = n
                    for c in letters[i:i + n]:
                        h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
                        h ^= h >> 15
                    found[h >> 19] += 1
        return found
    counted = [spots(t) for t in texts]
    if idf is None:
        seen = collections.Counter(s for c in counted for s in c)
        idf = {s: math.log((1 + len(texts)) / (1 + n)) + 1 for s, n in seen.items()}
        idf[None] = math.log(1 + len(texts)) + 1
    rows = []
    for c in counted:
        v = np.zeros(langid.DIMENSIONS)
        for s, n in c.items():
            v[s] = math.sqrt(n) * idf.get(s, idf[None])
        rows.append(v / (np.linalg.norm(v) or 1))
    return np.array(rows), idf


def test_counts_do_not_hang_on_the_place_in_a_batch():
    texts = ["the sea", "...the sea", None, "the sea", "!", "a"]
    together = langid.counts(texts)
    assert all((together[i] == langid.counts([t])[0]).all() for i, t in enumerate(texts))
    assert (together[0] == together[1]).all() and not together[4].any()


def test_language_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text", "lang").collect())
    learnt = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text is not None]
    _, idf = plain_vectors([r.text for r in learnt])
    centres, owners = [], []
    for lang in sorted({r.lang for r in learnt}):
        texts = sorted({r.text for r in learnt if r.lang == lang and any(c.isalpha() for c in r.text)})
        mine, _ = plain_vectors(texts, idf=idf)
        made = langid.cluster(mine.astype(np.float32), langid.CLUSTERS)
        centres, owners = [*centres, *made], [*owners, *[lang] * len(made)]
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        like = np.array(centres) @ plain_vectors([r.text], idf=idf)[0][0]
        assert got[r.doc_id].score == pytest.approx(like.max(), abs=1e-4)
        assert got[r.doc_id].lang_pred in {o for o, x in zip(owners, like) if x > like.max() - 1e-4}


def test_bounds_of_rare_lengths():
    least, seen = np.ones((1, 8)), np.zeros((1, 8), np.int64)
    least[0, [2, 3, 5, 7]], seen[0, [2, 3, 5, 7]] = [0.3, 0.4, 0.95, 0.2], [1, 500, 3, 2]
    assert langid.bounds(least, seen).tolist() == [[0, 0, 0.2, 0.4, 0.4, 0.4, 0.4, 0.2]]


def awkward(n, seed):
    random.seed(seed)
    parts = [" ", "  ", "\n", "\t", "ab", "the", "ing", "é", "ß", "123", "!", "▁", "▁▁", "\x00", "\x1c", "\x85", "　", "😀", ".", "\r\n", "中", "x" * 30, "'s", "don't", "<|endoftext|>", "²", "a,", "b.;"]
    return ["".join(random.choice(parts) for _ in range(random.randrange(14))) for _ in range(n)]


def test_pieces_are_lossless():
    model = piece_lattice.Lattice(PIECES)
    texts = [*awkward(3000, 1), None, "", " ", "  "]
    ids, counts = model.encode(texts, np.arange(len(texts)))
    assert [b.decode() for b in model.decode(ids, counts)] == [t or "" for t in texts]
    # A row's ids depend on its text and key alone.
    some, n = model.encode(texts[40:60], np.arange(40, 60))
    begin = counts[:40].sum()
    assert (some == ids[begin:begin + len(some)]).all() and (n == counts[40:60]).all()


def test_pieces_are_drawn_by_their_share():
    model, word, n = piece_lattice.Lattice(PIECES), "there", 60_000
    names = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = {names.id_to_piece(i): i for i in range(names.get_piece_size()) if not names.is_byte(i)}

    def ways(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in known:
                yield from ((known[rest[:k]], *w) for w in ways(rest[k:]))

    all_ways = list(ways("▁" + word))
    share = np.exp([sum(model.weight[i] for i in w) for w in all_ways])
    share /= share.sum()
    ids, counts = model.encode([word] * n, np.arange(n))
    ends = np.cumsum(counts)
    seen = collections.Counter(tuple(ids[e - c:e].tolist()) for e, c in zip(ends, counts, strict=True))
    assert set(seen) <= set(all_ways)
    likely = [(w, p) for w, p in zip(all_ways, share, strict=True) if n * p > 5]
    assert sum((seen[w] - n * p) ** 2 / (n * p) for w, p in likely) < 3 * len(likely) + 10


@pytest.mark.parametrize("alpha", [1.0, 4.0])
def test_long_words_in_blocks_draw_as_the_plain_filter(monkeypatch, alpha):
    """The same hashes against the shares of the plain filter, over several stretches of blocks."""
    monkeypatch.setattr(piece_lattice, "BLOCK", 64)
    monkeypatch.setattr(piece_lattice, "BLOCKS", 3)
    model, r = piece_lattice.Lattice(PIECES, alpha), random.Random(3)
    letters = ["the", "re", "action", "ing", "s", "Ж", "漢", "字", "\U0001f600", "\u2581", "x", "aaaa", "0"]
    for size in (1, 192, 193, 1500):
        word = "".join(r.choice(letters) for _ in range(size))[:size]
        base = np.uint64(r.getrandbits(64))
        first, lengths, piece, share = model._filter([word])
        nodes = np.arange(int(lengths[0]) + 1, dtype=np.uint64)
        u = ((piece_lattice._mixed(base + nodes) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        node, want = int(lengths[0]), []
        while node:
            back = int((share[node] < u[node]).sum())
            want.append(piece[node, back])
            node -= back + 1
        assert model._long(word, base).tolist() == want[::-1]


def test_a_text_of_a_million_letters_without_a_space():
    model, r = piece_lattice.Lattice(PIECES), random.Random(5)
    text = "".join(r.choices("abcdefghij漢字語日本", k=1_000_000))
    begun = time.monotonic()
    ids, counts = model.encode(["short one", text, None, text], np.array([1, 2, 3, 2]))
    assert time.monotonic() - begun < 60  # a letter at a time, one text alone took 100 s
    assert model.decode(ids, counts) == [b"short one", text.encode(), b"", text.encode()]
    both = np.split(ids, np.cumsum(counts)[:-1])
    assert np.array_equal(both[1], both[3]) and np.array_equal(both[1], model.encode([text], np.array([2]))[0])


def test_pieces_odd_rows(odd):
    rows = piece_lattice.encode(odd, PIECES)
    got = rows.collect()
    assert len(got) == len(ODD) and all(r.lossless for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (7, 8)] == [0, 0]
    assert sorted((r.doc_id or 0, r.text) for r in piece_lattice.decode(rows, PIECES).collect()) == sorted((i or 0, t or "") for i, t in ODD)
    assert piece_lattice.encode(odd.limit(0), PIECES).count() == 0


def test_codes_are_addressable():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        for bits in (4, 9, 17, 32):
            ids = rng.integers(0, 2**bits, n).astype(np.uint32)
            held = dac.Segment(dac.segment(np.array([3]), np.array([False]), np.array([n]), ids))
            assert (held.tokens() == ids).all() and all(held.token(i) == ids[i] for i in range(0, n, 13))
            a, b = sorted(map(int, rng.integers(0, n + 1, 2)))
            assert (held.tokens(a, b) == ids[a:b]).all()


def test_words_give_the_librarys_ids():
    model, plain = token_files.Encoder(BPE), Tokenizer.from_file(BPE)
    texts = [*awkward(3000, 2), "Straße, straße. Ñandú; a, b", "ab  cd \n ef "]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_files_give_back_the_ids(spark, odd):
    for df in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd.filter("doc_id is not null")):
        plain, at, want = Tokenizer.from_file(BPE), 0, []
        for i, text in sorted((r.doc_id, r.text or "") for r in df.collect()):
            ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
            want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(df, BPE).collect())
        assert [r[1] for r in got] == [w[0] for w in want] and sorted(r[1:] for r in got) == sorted(want)
        for start, _, n, _ in got:
            assert start == at
            at += n
    assert token_files.round_trip(odd.limit(0), BPE).count() == 0


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    hits = sum(r.predicted and toxic[r.doc_id] for r in held)
    assert hits / sum(toxic[r.doc_id] for r in held) > 0.85 and hits / sum(r.predicted for r in held) > 0.8


def test_a_word_that_all_texts_share_makes_no_copies(spark):
    # The word of least hash among many, so that no other word of the texts is likely to be below it.
    header = spark.range(200_000).selectExpr("concat('h', id) as w").orderBy(F.xxhash64("w")).first().w
    rng = random.Random(7)
    rows = [(i, " ".join([header, *(f"w{rng.randrange(2000)}" for _ in range(30)), *["vile"] * (i % 4 == 0)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()} == {i: int(i % 4 == 0) for i, _ in rows}


def test_label_model_weighs_voters_by_accuracy():
    rng = np.random.default_rng(8)
    y = (rng.random(4000) < 0.2).astype(int)
    good = rng.random(4000) < np.where(y == 1, 0.7, 0.02)
    random_ = rng.random(4000) < 0.3
    fired = np.stack([good, good, good, random_], axis=1)  # three that repeat each other count about as one
    p = toxicity.label_model(fired, y, np.ones(4000))
    assert p[good].min() > 0.7 and p[~good].max() < 0.3
    w = toxicity.linear(fired, p, np.ones(4000))
    assert w[:3].sum() > 4 * abs(w[3])


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (9, 0, 0), (9, None, 0), (10, 0, 0)], "doc_id long, toxic int, text int")
    for some in (labels, labels.limit(0), labels.filter("toxic = 1")):
        rows = toxicity.score(odd, some).collect()
        assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id in (7, 8)}) == 1
    assert toxicity.score(odd.limit(0), labels).count() == 0


def test_labels_of_one_kind_meet_texts(spark):
    """Labels of both kinds, of which only one has documents, or none has: no crash, one answer for all."""
    docs = spark.createDataFrame([(i, f"some text {i % 9}") for i in range(40)], "doc_id long, text string")
    for toxic, answer in ((1, 1), (0, 0), (None, 0)):
        near = [(i, toxic) for i in range(40)] if toxic is not None else []
        far = [(1000 + i, t) for i in range(40) for t in (0, 1) if t != toxic]
        rows = toxicity.score(docs, spark.createDataFrame(near + far, "doc_id long, toxic int")).collect()
        assert len(rows) == 40 and {r.predicted for r in rows} == {answer}
