"""Nothing is cut, capped or gated away."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from modspark import schemas
from modspark.functions import crypto as K
from modspark.functions import distance as D
from modspark.functions import text as T
from modspark.functions.register import register
from modspark.operators import files, phrases, verdict
from modspark.plans import migrate
from modspark.plans.text_queries import V
from modspark.sources.files import entry_texts, list_entries
from modspark.sources.tables import align


def test_arabic_signs_between_letters_disguise_nothing(spark):
    texts = ["l،؛؟،؛؟o،s،e،r", "l,;?,;?o,s,e,r", "l٣٣٣٣o٣٣٣٣s٣٣٣٣e٣٣٣٣r", "a calm sentence"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.verdict.action, r.verdict.rule_id) for r in verdict.moderate(rows, "id", "text", V.lexicon_from(spark)).collect()}
    assert got[0] == got[1] == ("BLOCK", "RULE_EVASIVE_REGEX") and got[2][0] == "BLOCK" and got[3][0] == "ALLOW"


def test_large_parts_are_read_whole(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<p>" + "word " * 300_000 + "last</p>")
        z.writestr("notes.txt", "text " * 300_000 + "end")
        z.writestr("more.txt", "short")
    entries = list_entries(spark.createDataFrame([("a.docx", bytearray(held.getvalue()))], "path string, content binary"))
    assert files.package_text(entries).first().text.endswith("last")
    assert sorted(r.text[-5:] for r in entry_texts(entries).collect()) == ["short", "t end"]


def test_late_zero_byte_is_found(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a" * 5000 + b"\0")), (2, bytearray(b"a" * 5000)), (3, bytearray(b""))], "id int, content binary")
    got = {r.id: r.t.finding for r in rows.select("id", files.plain_text(F.col("content")).alias("t")).collect()}
    assert got[1] and got[2] is None and got[3] is None


def test_phrases_of_any_length(spark):
    docs = ["one two three four five six seven", "the quick brown-fox jumps", "prefixed words, suffix!", "hello???", "", None, "x"]
    asked = ["two three four", "quick brown-fox", "fix", "ed wor", "???", "one two three four five six", "x", "absent", "", None, "seven eight", "-"]
    got = phrases.long_phrases(
        spark.createDataFrame(list(enumerate(docs)), "id int, text string"), spark.createDataFrame(list(enumerate(asked)), "p int, phrase string"), "id", "text", "p", "phrase")
    want = {(i, p) for i, d in enumerate(docs) for p, a in enumerate(asked) if d and a and a in d}
    assert {tuple(r) for r in got.collect()} == want
    assert phrases.long_phrases(spark.createDataFrame([(1, "a")], "id int, text string"), spark.createDataFrame([], "p int, phrase string"), "id", "text", "p", "phrase").count() == 0


def test_sql_functions_answer_as_columns_do(spark):
    key = K.derive_key(b"m", b"b")
    register(spark, key)
    random.seed(3)
    words = ["".join(random.choice("abcde") for _ in range(random.randrange(1, 9))) for _ in range(40)] + ["worthless", "worhtlses", "x" * 80, "x" * 79 + "y", ""]
    pairs = spark.createDataFrame([(a, b) for a in words[:25] + words[40:] for b in words[15:]], "a string, b string")
    for most in (1, 2):
        assert pairs.where(F.expr(f"plain_distance(a, b, {most})") != F.least(D.bounded_distance(F.col("a"), F.col("b"), most), F.lit(most + 1))).count() == 0
    assert pairs.where(F.expr("fuzzy_match(a, b)") != D.fuzzy_similarity(F.col("a"), F.col("b")).isNotNull()).count() == 0
    texts = spark.createDataFrame([("Ｆｕｌｌ width", "m1"), ("plain", None), ("", "m2"), ("", ""), (None, None)], "t string, m string")
    assert texts.where(F.expr("content_hash(t, m)") != T.content_hash(F.col("t"), F.col("m"))).count() == 0
    assert texts.where(F.expr("content_hash(t)") != T.content_hash(F.col("t"))).count() == 0


def test_migration_changes_only_its_columns(spark):
    def students(rows):
        return align(spark.createDataFrame(rows, "id long, anonymous_id long, user_hash string, ban_reason string, enc_full_name string, is_banned boolean, total_posts long"), "students", {})

    known = students([(1, 101, "kept", "old", "name", False, 1), (9, None, "n0", None, None, False, 0)])
    moved = students([(5, 101, "other", "new", "second", True, 7), (2, 101, "other", "new", "first", False, 3), (3, 102, "h3", "r", "a", False, 1),
                      (4, 102, "h4", "s", "b", True, 2), (6, None, "n1", None, None, False, 0), (7, None, "n2", None, None, False, 0)])
    empty = {n: spark.createDataFrame([], ddl) for n, ddl in schemas.TABLES.items()}
    got = migrate.plan({"students": moved}, empty | {"students": known})["students"]
    rows = {(r.anonymous_id, r.user_hash): (r.id, r.ban_reason, r.enc_full_name, r.is_banned, r.total_posts) for r in got.collect()}
    assert rows == {(101, "kept"): (1, "old", "second", True, 7), (102, "h3"): (3, "r", "b", True, 2),
                    (None, "n0"): (9, None, None, False, 0), (None, "n1"): (6, None, None, False, 0), (None, "n2"): (7, None, None, False, 0)}
