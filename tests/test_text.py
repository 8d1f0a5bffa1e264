import hashlib
import hmac
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from modspark.functions import crypto as K
from modspark.functions import text as T
from modspark.functions.times import from_micros, hour_label, micros, mute_minutes, parse_timestamp


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_stable_letters_survive_nfkc():
    stable = re.compile(f"[{T.NFKC_STABLE}]")
    followers = [chr(c) for c in range(sys.maxunicode + 1) if stable.match(chr(c))]
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in followers)
    # no pair of stable letters may melt together
    assert unicodedata.normalize("NFKC", "".join(followers)) == "".join(followers)
    assert unicodedata.normalize("NFKC", "".join(reversed(followers))) == "".join(reversed(followers))


@pytest.mark.parametrize("text", ["ﬁne", "½ x", "é", "plain", "Ｆｕｌｌ", "كِتاب", "日本​ﾃｽﾄ", "آ"])
def test_nfkc_equals_python(spark, text):
    assert value(spark, T.nfkc(F.lit(text))) == unicodedata.normalize("NFKC", text)


@pytest.mark.parametrize("fold, given, wanted", [
    (T.strip_zero_width, "a​b﻿c­", "abc"),
    (T.fold_lookalikes, "раураl ΑΒ", "paypal AB"),
    (T.fold_arabic, "شَرْح ـــ أإآ ىئي ةه ؤ", "شرح  اا" + " يي" + " هه" + " و"),
    (T.fold_arabic, "ككككلمة", "ككلمه"),
    (T.fold_leet, "H4ck3r V1s!t $0", "hacker uisit so"),
    (T.fold_latin_arabic, "3abeet 7' kh3", "عabeet خ خع"),
    (T.compact, "a-b.c é1 ش_", "abc1ش"),
    (T.letters_only, "a1b2 ش3", "abش"),
    (T.collapse_runs, "fuuunnn", "fun"),
    (T.cap_runs, "aaaa\n\n\n\n", "aa\n\n\n\n"),
    (T.escape_html, " <b a=\"1\">'&'</b> ", "&lt;b a=&quot;1&quot;&gt;&#x27;&amp;&#x27;&lt;/b&gt;"),
])
def test_folds(spark, fold, given, wanted):
    assert value(spark, fold(F.lit(given))) == wanted


def test_separators_give_one_compact_form(spark):
    forms = spark.createDataFrame([(s.join("word"),) for s in ("", " ", ".", "-", "/", "_")], "t string")
    assert forms.select(T.compact(F.col("t"))).distinct().count() == 1


def test_bundle_of_empty_and_null(spark):
    rows = T.with_bundle(spark.createDataFrame([("",), (None,)], "text string")).collect()
    for r in rows:
        assert r.cleaned == r.folded == r.compact_ar == "" and r.tokens == []


def test_tokens_keep_order_and_whole_text(spark):
    long = "word " * 5000 + "last"
    row = T.with_bundle(spark.createDataFrame([(long,)], "text string")).first()
    assert row.tokens[:2] == ["word", "last"]


def test_ngrams(spark):
    assert value(spark, T.char_ngrams(F.lit("abcd"))) == ["abc", "bcd", "abcd"]
    assert value(spark, T.char_ngrams(F.lit("ab"))) == []


def test_fingerprint(spark):
    same = [value(spark, T.content_hash(F.lit(t))) for t in ("كِتَاب", "كتاب ")]
    assert same[0] == same[1] == hashlib.sha256("كتاب".encode()).hexdigest()
    assert value(spark, T.content_hash(F.lit(""))) == ""
    assert value(spark, T.content_hash(F.lit("Ab"), F.lit("m1"))) == hashlib.sha256(b"ab_m1").hexdigest()


@pytest.mark.parametrize("given, wanted", [
    ("tok 123456789:ABCDEFGHIJKLMNOPQRSTUV.", "tok [REDACTED_BOT_TOKEN]."),
    ("Key = abcdefghijabcdefghijk", "Key = [REDACTED_KEY]"),
    ("password: hunter2, next", "password: [REDACTED_PASSWORD], next"),
    ("+201012345678 and a+201012345678", "+[REDACTED_PHONE] and a[REDACTED_PHONE]"),
    ("@bobby 123456789 12345678", "[REDACTED_USERNAME] [REDACTED_ID] 12345678"),
])
def test_redaction(spark, given, wanted):
    assert value(spark, T.redact(F.lit(given))) == wanted


@pytest.mark.parametrize("raw, name, ok", [
    ("../../etc/report.pdf", "report.pdf", True), ("..\\..\\x y<1>.DOCX", "x y_1_.docx", True),
    ("run.exe", None, False), ("noext", None, False), ("a" * 80 + ".txt", "a" * 60 + ".txt", True), (".pdf", None, False),
])
def test_file_names(spark, raw, name, ok):
    got = value(spark, T.safe_file_name(F.lit(raw), F.lit("seed")))
    assert (got["name"], got["ok"]) == (name, ok)


def test_missing_file_name_is_derived(spark):
    got = value(spark, T.safe_file_name(F.lit(None).cast("string"), F.lit("seed")))
    assert got["ok"] and got["name"] == "document_" + hashlib.sha256(b"seed").hexdigest()[:8] + ".pdf"


def test_commands_and_links(spark):
    ban = value(spark, T.parse_command(F.lit("/ban #12  rude words")))
    assert (ban.verb, ban.target, ban.minutes, ban.reason) == ("ban", 12, None, "rude words")
    mute = value(spark, T.parse_command(F.lit("/mute 7 30")))
    assert (mute.target, mute.minutes, mute.reason) == (7, 30, None)
    assert value(spark, T.parse_command(F.lit("/ban 5"))).reason == "unspecified"
    assert value(spark, T.link_target(F.lit("/start reply_44"))) == 44
    assert value(spark, T.link_target(F.lit("/start reply_x"))) is None
    assert value(spark, T.numeric_key(F.lit(" #12 "))) == 12 and value(spark, T.numeric_key(F.lit("1a"))) is None


def test_keyed_functions(spark):
    key = K.derive_key(b"master", b"index")
    assert key != K.derive_key(b"master", b"seal") and len(key) == 32
    for k in (key, b"x" * 100):
        assert value(spark, K.blind_index(F.lit(42), k)) == hmac.new(k, b"42", hashlib.sha256).hexdigest()
    seal = K.derive_key(b"master", b"seal")
    assert value(spark, K.decrypt(K.encrypt(F.lit("name"), seal), seal)) == "name"
    assert value(spark, K.decrypt_int(K.encrypt(F.lit(77), seal), seal)) == 77
    assert value(spark, K.decrypt(F.lit("rubbish!"), seal)) == K.UNREADABLE
    assert value(spark, K.decrypt(F.lit(K.ERASED), seal)) == K.ERASED
    assert value(spark, K.decrypt(F.lit(""), seal)) is None and value(spark, K.encrypt(F.lit(None).cast("string"), seal)) is None


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            df = spark.range(1).select(F.expr("timestamp_ntz'2024-07-01 12:34:56.789012'").alias("ts")).withColumn("us", micros("ts"))
            row = df.withColumn("back", from_micros("us")).first()
            assert row.us == 1719837296789012 and row.back == row.ts
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_time_labels(spark):
    now = F.expr("timestamp_ntz'2024-01-01 10:00:00'")
    df = spark.range(1).select(now.alias("now"), F.expr("timestamp_ntz'2024-01-01 10:00:30'").alias("soon"), F.expr("timestamp_ntz'2024-01-01 09:00:00'").alias("past"))
    row = df.select(mute_minutes("soon", "now").alias("a"), mute_minutes("past", "now").alias("b"), hour_label("now").alias("h"),
                    parse_timestamp(F.lit("bad"), F.col("now")).alias("p"), parse_timestamp(F.lit(None).cast("string"), F.col("now")).alias("q")).first()
    assert (row.a, row.b, row.h, row.q) == (1, None, "2024-01-01_10", None) and row.p.hour == 10
