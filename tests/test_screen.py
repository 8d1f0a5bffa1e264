"""The necessary test before the cascade misses nothing and spares clean texts."""

import random

from pyspark.sql import functions as F

from modspark.functions import text as T
from modspark.operators import lexicon as L
from modspark.operators import screen as S
from modspark.operators import verdict as V

CLEAN = ("A quiet afternoon by the river, with nothing to report.", "Der Ofen glüht -- und alles schläft...", "", None)
PERSONAL = ("call 010-1234-5678 now", "mail a.b@example.org", "my name is  Karim", "اسمي محمد علي", "عمري ٢٠ سنة", "i'm 20 yo", "im\u000bKarim went",
            "see WWW.example.com/x", "at 10.1.2.3:80", "ask @someone", "０１０-１２３４-５６７８", "my​ name is Karim", "010--------1234-5678")


def _disguised(rng: random.Random) -> list[str]:
    terms = [t for t, *_ in L.DEMO_TERMS] + ["غ ب ي", "gh by", "l0ser", "3abeet"]
    alike = dict(zip(T.CYRILLIC_LOOKALIKES[1], T.CYRILLIC_LOOKALIKES[0]))
    out = []
    for _ in range(700):
        word = rng.choice(terms)
        made = ""
        for c in word:
            way = rng.random()
            leet = [a for a, b in zip(*T.LEET) if b == c]
            c = (rng.choice(leet) if leet and way < 0.2 else alike.get(c, c) if way < 0.3 else c.upper() if way < 0.4
                 else c * rng.randint(2, 5) if way < 0.5 else chr(ord(c) + 0xFEE0) if way < 0.53 and c.isascii() and c.isalpha()
                 else "*" if way < 0.56 else "İ" if c == "i" and way < 0.8 else c)
            made += c + (rng.choice((".", "-", " ", "_", "​", "ـ", "ً", "4", "x", "é", "......", "——————", "\n", "'", "ééé"))
                         if rng.random() < 0.25 else "")
        out.append(rng.choice(("", "say ", "sayx", "ة", "«", "_", "é", "4")) + made + rng.choice(("", " now", "x", "é", "_", ".", "ing", "’")))
    return out


def test_every_hit_is_suspected(spark, monkeypatch):
    lex = V.lexicon_from(spark)
    texts = [*CLEAN, *PERSONAL, *_disguised(random.Random(5))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    for normalize in (True, False):
        screened = {r.id: r.hits for r in V.with_hits(df, "text", lex, normalize=normalize).collect()}
        with monkeypatch.context() as m:
            m.setattr(S, "suspicion", lambda *_: F.lit(S.WORDS | S.PERSONAL | S.LINK))
            whole = {r.id: r.hits for r in V.with_hits(df, "text", lex, normalize=normalize).collect()}
        assert sum(bool(h) for h in whole.values()) > 200
        assert [(texts[i], whole[i]) for i in whole if screened[i] != whole[i]] == []


def test_clean_texts_are_spared(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    assert [r.bits for r in df.select(S.suspicion(F.col("text"), V.lexicon_from(spark)).alias("bits")).collect()] == [0] * len(CLEAN)


def test_letters_tell_no_near_word_away(spark):
    """Words one or two edits from a term, in any reading, pass both letter tests; most others do not."""
    import pyarrow as pa

    rng, terms = random.Random(3), ["moron", "worthless", "disgusting"]
    words = []
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(1 if len(word) <= 6 else 2):
            i, way = rng.randrange(len(word) - 1), rng.randrange(4)
            word[i:i + 2] = ([word[i + 1], word[i]], [rng.choice("abzq1é"), word[i + 1]], [word[i + 1]], [word[i], rng.choice("xyz7ß"), word[i + 1]])[way]
        words.append("".join(word))
    assert S.near_words(terms)(pa.array(words)).all() and S.near_letters(terms)(pa.array(words)).all()
    leet = [w.replace("o", "0").replace("i", "!").replace("s", "$") for w in words] + ["“mоron”", "ｍｏｒｏｎ", "x/moron/y"]
    assert S.near_letters(terms)(pa.array(leet)).all()
    assert not S.near_words(terms)(pa.array(["afternoon", "river", "moronically"])).any()
    assert not S.near_letters(terms)(pa.array(["quiet", "back"])).any()


def test_fuzzy_words_come_from_a_vocabulary(spark):
    """Signs, line breaks and look-alikes around and in a word; the text's first match counts."""
    texts = ["so wortless!\nand clwon", "(clwon) wortless", "a “pathétic pathetc” thing", "nothing here", "раthetik", None, "", "   ", "wo​rtless", "m clwon"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lex = V.lexicon_from(spark)
    mark = F.sha2(F.coalesce("text", F.lit("")), 256).alias("mark")
    whole = V.fuzzy_layer(T.with_bundle(df.select(mark, "text")).select("mark", "tokens"), "mark", lex)
    got = {r.mark: r.near_hit for r in V.fuzzy_hits(df, "text", lex).collect()}
    assert len(got) >= 5 and got == {r.mark: r.hit for r in whole.collect()}


def test_compact_keeps_the_same_letters(spark):
    """By code point: ASCII letters and digits and the Arabic block stay, all else goes."""
    points = [*range(1, 0x800), 0x2014, 0x4E00, 0xFFFD, 0x1F600]
    df = spark.createDataFrame([(p, f"a{chr(p)}ع") for p in points], "p int, t string")
    for r in df.select("p", T.compact(F.col("t")).alias("c")).collect():
        stays = (r.p < 128 and chr(r.p).isalnum()) or 0x600 <= r.p <= 0x6FF
        assert r.c == f"a{chr(r.p) if stays else ''}ع", hex(r.p)
