from pyspark.sql import functions as F

from modspark.functions import crypto as K
from modspark.functions import text as T
from modspark.functions.register import register


def test_sql_names(spark):
    key = K.derive_key(b"m", b"b")
    register(spark, key)
    df = spark.createDataFrame([("  Heeeello كِتَابة\n",), ("",)], "t string")
    for r in df.select(F.expr("content_hash(t)").alias("a"), T.content_hash(F.col("t")).alias("b")).collect():
        assert r.a == r.b
    row = spark.sql("select blind_index('42') as h, plain_distance('ab', 'ba', 1) as d, plain_distance('kitten', 'sitting', 2) as e, "
                    "fuzzy_match('mroon', 'moron') as f, fuzzy_match('cat', 'car') as g").first()
    assert row.h == spark.range(1).select(K.blind_index(F.lit(42), key)).first()[0]
    assert (row.d, row.e, row.f, row.g) == (1, 3, True, False)
