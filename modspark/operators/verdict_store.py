"""V2 across runs: verdicts kept on storage by policy and text, with expiry.

Each run writes the verdicts of the texts it had to judge to a folder of its own below the policy's.
What is on storage is all there is: a new session reuses it, and a run that broke off left either
whole verdicts or none, so starting it again judges what is missing.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.durable import cut
from modspark.functions.times import SECOND
from modspark.operators import lexicon as L
from modspark.operators import verdict as V

STORED = f"sha string, verdict {V.VERDICT}, judged_us bigint"
#: Microseconds a verdict holds.
TTL = 24 * 3600 * SECOND


def policy_digest(lex: L.Lexicon, **options) -> str:
    """Names a policy by its entries, lists and options; the same in every session."""
    told = {"entries": [e.asDict(True) for e in lex.entries], "allowed": lex.allowed, "hard": lex.hard, "options": options}
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def stored(spark: SparkSession, folder: str, policy: str, now_us: int, ttl: int = TTL) -> DataFrame:
    """sha, verdict: the last verdict of each text under ``policy`` that has not expired."""
    try:
        rows = spark.read.schema(STORED).parquet(f"{folder}/policy={policy}")
    except AnalysisException:  # nothing was judged yet
        return spark.createDataFrame([], "sha string, verdict " + V.VERDICT)
    live = rows.where(F.col("judged_us") > now_us - ttl)
    return live.groupBy("sha").agg(F.max_by("verdict", "judged_us").alias("verdict"))


def moderate_kept(df: DataFrame, key: str, text: str, lex: L.Lexicon, folder: str, now_us: int | None = None, ttl: int = TTL, **options) -> DataFrame:
    """key, verdict, reused: one row per row of ``df``; only texts without a live verdict are judged.

    ``reused`` tells whether the verdict was there before this run. Keys may repeat or be null; a null
    text is an empty one. Texts are told apart by SHA-256. Digests alone are shuffled to find what is
    new, one copy of each new text meets the cascade, and verdicts are handed back to (key, digest), a
    join whose skewed parts AQE splits; no text travels for it.
    """
    spark, now = df.sparkSession, int(time.time() * SECOND) if now_us is None else now_us
    policy = policy_digest(lex, **options)
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("sha", F.sha2("t", 256))
    # Cut: what was new is asked again once the store has changed.
    new = cut(rows.select("sha").distinct().join(stored(spark, folder, policy, now, ttl).select("sha"), "sha", "left_anti"))
    texts = rows.select("sha", "t").join(new, "sha", "left_semi").groupBy("sha").agg(F.any_value("t").alias("t"))
    judged = V.moderate(texts, "sha", "t", lex, **options).select("sha", F.col("verdict").cast(V.VERDICT).alias("verdict"), F.lit(now).cast("bigint").alias("judged_us"))
    judged.write.parquet(f"{folder}/policy={policy}/run={uuid.uuid4().hex}")
    known = stored(spark, folder, policy, now, ttl).join(new.withColumn("fresh", F.lit(True)), "sha", "left")
    return rows.select("k", "sha").join(known, "sha", "left").select(F.col("k").alias(key), "verdict", F.col("fresh").isNull().alias("reused"))
