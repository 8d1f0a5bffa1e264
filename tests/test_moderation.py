import pytest
from pyspark.sql import functions as F

from modspark.operators import lexicon as L
from modspark.operators import rules as R
from modspark.operators import verdict as V
from modspark.operators import verdict_store as VS
from modspark.sources.tables import read_corpus


@pytest.fixture(scope="module")
def lex(spark):
    return V.lexicon_from(spark)


def judge(spark, lex, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r.text: r for r in V.flat(V.moderate(df, "id", "text", lex, **options), "id", "text").collect()}


CLEAN = ["please explain the third lesson", "murderous plots in the novel", "look closer at the graph", "", "   ", "a clownfish lives here"]
BAD = {
    "you IDIOT": "RULE_LEGACY_FAST_PRECHECK", "w.o.r.t.h.l.e.s.s": "RULE_EVASIVE_REGEX", "m0r0n": "RULE_EVASIVE_REGEX",
    "mmmooorrrooonnn": "RULE_EVASIVE_REGEX", "mxoxrxon": "RULE_CHARACTER_INSERTION", "now shut up please": "RULE_ABUSIVE_PHRASE",
    "disgustingly bad": "RULE_EN_DICT_STEM", "such a clown": "RULE_EN_DICT_EXACT", "انت غبــي": "RULE_AR_DICT_STEM",
    "يا حمار": "RULE_AR_DICT_EXACT", "ya 3abeet": "RULE_EN_DICT_STEM", "раthetic": "RULE_EN_DICT_STEM", "dis​gusting": "RULE_EN_DICT_STEM",
    "call 0101 2345 678": "RULE_PII_LEAK", "write a.b@c.org": "RULE_PII_LEAK", "my name is Bob": "RULE_PII_LEAK", "i am 21": "RULE_PII_LEAK",
    "see https://a.b/c": "RULE_ALL_LINKS", "ask @someone": "RULE_ALL_LINKS", "10.0.0.1:80/x": "RULE_ALL_LINKS",
}


def test_cascade(spark, lex):
    got = judge(spark, lex, CLEAN + list(BAD))
    for text in CLEAN:
        assert got[text].action == "ALLOW", text
    for text, rule in BAD.items():
        assert got[text].rule_id == rule, got[text]


def test_whole_text_is_read(spark, lex):
    assert judge(spark, lex, ["word " * 4000 + "scum"]).popitem()[1].rule_id == "RULE_EN_DICT_EXACT"


def test_fuzzy_layer_and_excuses(spark, lex):
    got = judge(spark, lex, ["mruder", "murderous", "pahtetic", "fine words", "murder"], fuzzy=True)
    assert got["mruder"].rule_id == "RULE_BOUNDED_FUZZY" and got["mruder"].confidence == 0.83
    assert got["pahtetic"].action == "BLOCK" and got["murder"].rule_id == "RULE_EN_DICT_STEM"
    assert got["murderous"].action == got["fine words"].action == "ALLOW"


def test_first_hit_order(spark, lex):
    got = judge(spark, lex, ["idiot a.b@c.org https://x.y scum", "a.b@c.org https://x.y.z scum"])
    assert [r.rule_id for r in got.values()] == ["RULE_LEGACY_FAST_PRECHECK", "RULE_PII_LEAK"]


def test_policy_switches(spark, lex):
    off = V.disabled_categories(profanity=False)
    got = judge(spark, lex, ["you idiot", "scum", "see https://a.b/c"], disabled=off, allow_links=True)
    assert [r.action for r in got.values()] == ["ALLOW", "BLOCK", "ALLOW"]
    assert "self_harm" not in V.disabled_categories(**{k: False for k in V.SWITCHES})


def test_custom_terms(spark):
    extra = spark.createDataFrame([("Blorp",), ("  ",)], "term string")
    lex = L.load(L.with_custom_terms(L.demo_lexicon(spark), extra), L.DEMO_ALLOWED)
    got = judge(spark, lex, ["such blorpy stuff"])
    assert got["such blorpy stuff"].category == "profanity" and got["such blorpy stuff"].severity == "high"


def test_long_lexicon_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 3)
    got = judge(spark, L.load(L.demo_lexicon(spark)), ["disgusting", "clown", "blue"])
    assert [r.action for r in got.values()] == ["BLOCK", "BLOCK", "ALLOW"]


def test_any_of_is_an_alternation():
    import re
    pattern = re.compile(L.any_of(["abc", "abd", "ab", "x.y"]))
    assert pattern.search("zzab") and pattern.search("x.y") and not pattern.search("xzy") and not pattern.search("a")


def test_noisy_copies_are_still_blocked(spark, lex):
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(["worthless", "moron", "loser"])], "id int, text string")
    noisy = V.noisy_copies(terms, "id", "text", 10)
    judged = V.moderate(noisy, "id", "noisy", lex)
    assert judged.where("verdict.is_allowed").count() == 0 and noisy.count() == 30


def test_copies_share_one_verdict(spark, lex):
    texts = ["scum"] * 500 + ["fine"] * 3 + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = V.moderate_once(df, "id", "text", lex)
    assert out.count() == 504 and out.where("not verdict.is_allowed").count() == 500


def test_verdicts_are_kept_over_runs(spark, lex, tmp_path):
    folder, hour = str(tmp_path / "store"), 3600 * 10**6
    schema = "id int, text string, sha string"
    first = spark.createDataFrame([(1, "scum", "x"), (1, "fine", "x"), (None, None, "x")], schema)
    later = spark.createDataFrame([(2, "scum", "x"), (3, "", "x"), (4, "you moron", "x"), (None, "you moron", "x")], schema)

    def answers(df, now, **options):
        out = VS.moderate_kept(df, "id", "text", lex, folder, now, ttl=10 * hour, **options).collect()
        return sorted((str(r.id), r.verdict.is_allowed, r.reused) for r in out)

    assert answers(first, hour) == [("1", False, False), ("1", True, False), ("None", True, False)]
    assert answers(later, 2 * hour) == [("2", False, True), ("3", True, True), ("4", False, False), ("None", False, False)]
    assert all(reused for _, _, reused in answers(later, 3 * hour))
    # What was judged in the first hour has expired, what came an hour later has not.
    assert answers(later, 11 * hour) == [("2", False, False), ("3", True, False), ("4", False, True), ("None", False, True)]
    # Another policy shares nothing.
    assert not any(reused for _, _, reused in answers(later, 3 * hour, allow_links=True))
    assert answers(later.limit(0), 3 * hour) == []
    assert VS.policy_digest(lex) != VS.policy_digest(lex, allow_links=True)


def test_links_and_details(spark):
    df = spark.createDataFrame([("go to www.x.com",), ("t.me/abc",), ("@abcd",), ("nothing. here",), ("1234 567 8901",), ("12 34",)], "t string")
    rows = df.select(R.has_plain_link(F.col("t")).alias("a"), R.first_link(F.col("t")).alias("b"), R.first_phone(F.col("t")).alias("c")).collect()
    assert [r.a for r in rows] == [True, True, True, False, False, False]
    assert [r.b for r in rows] == ["www.x.com", "t.me/abc", "@abcd", None, None, None]
    assert [r.c for r in rows][4:] == ["1234 567 8901", None]


SIGNAL = "payload_id int, ordinal int, source string, category string, severity string, confidence double, is_violation boolean, is_security boolean, reason string, detected_item string"


def test_fusion(spark):
    rows = [
        (1, 0, "TEXT", "hate", "critical", 1.0, True, False, "x", None), (1, 1, "FILE", "media_unsafe", "high", 1.0, True, True, "Unsupported type", None),
        (2, 0, "TEXT", "insult", "low", 0.5, True, False, "x", "w"), (2, 1, "CAPTION", "insult", "low", 0.5, True, False, "y", "v"),
        (3, 0, "TEXT", "hate", "high", 0.9, False, False, "x", None), (4, 0, "TEXT", "link", "high", 0.9, True, False, "x", None),
        (5, 0, "TEXT", "threat", "medium", 0.9, True, False, "x", None), (5, 1, "TEXT", "threat", "high", 0.1, True, False, "z", None)]
    s = spark.createDataFrame(rows, SIGNAL)
    got = {r.payload_id: r.verdict for r in V.fuse(s, ("link",), strict=False).collect()}
    assert (got[1].action, got[1].status, got[1].category) == ("BLOCK", "unsupported", "media_unsafe")
    assert (got[2].action, got[2].is_allowed, got[2].detected_item) == ("REVIEW", True, "w")
    assert got[3].action == got[4].action == "ALLOW" and got[5].action == "BLOCK"
    assert V.fuse(s, (), strict=True).where("payload_id = 2").first().verdict.action == "BLOCK"
    reasons = [(r.payload_id, r.rule_id) for r in V.verdict_reasons(s, ("link",)).orderBy("payload_id", "ordinal").collect()]
    assert reasons == [(1, "RULE_SECURITY_FILE"), (2, "RULE_TEXT_INSULT"), (2, "RULE_CAPTION_INSULT"), (5, "RULE_TEXT_THREAT"), (5, "RULE_TEXT_THREAT")]


def test_corpus_and_confusion(spark, lex, tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text('[{"category": "insult", "text": "such scum", "expected_allowed": false},\n {"category": "clean", "text": "good day", "expected_allowed": true}]')
    corpus = read_corpus(spark, str(path), "category").withColumn("id", F.monotonically_increasing_id())
    judged = V.moderate(corpus, "id", "text", lex).select("group", (~F.col("expected_allowed")).alias("want"), (~F.col("verdict.is_allowed")).alias("got"))
    rows = {r.group: r for r in V.confusion(judged, "group", "want", "got").collect()}
    assert rows["insult"].recall == 1.0 and rows["clean"].tn == 1


def test_filter_on_a_verdict_does_not_repeat_the_work(spark, lex):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    plan = V.moderate(df, "id", "text", lex, fuzzy=False).where("not verdict.is_allowed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(array_distinct(array(raw_text") <= 2
