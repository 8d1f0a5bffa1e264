"""Mixing sources to target weights by capped water-filling.  DataFrame functions only.

Each source's target is ``min(cap, level * weight)``, with one level for all: what a source cannot
give (its cap is ``max_epochs`` times its size) is shared anew by weight among the rest until none
is above its cap. A source then gives whole repetitions of all its documents, and a fractional one:
the documents first in a seeded order, up to the one whose middle passes what is left. So the words
taken miss a target by at most half a document.

The running sum in that order never sorts a source in one task: sums per hash bucket find the
bucket in which the target falls, and only that bucket's rows are looked at one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from modspark.llm.base import WORD, staged

#: Bits of a draw.
DRAW = 60
#: Rows that the bucket in which a source's target falls is meant to hold, and least bits of buckets.
BUCKET, LEAST_BITS = 50_000, 10


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draw(key: Column, text: Column, seed: int) -> Column:
    """A whole number of ``DRAW`` bits from the key (null counts as empty), the text's digest and the seed."""
    spelled = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(spelled), 1, DRAW // 4), 16, 10).cast("bigint")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, weight: weights in turn along the sources' code point order, null last."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    return sources.select("source", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, weights: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """source, source_size, target for sources (source, source_size): the water level is the first
    at which the next source, by cap over weight, is not above its cap."""
    every = W.partitionBy(F.lit(0))
    order = every.orderBy("ratio", F.col("source").asc_nulls_last())
    filled = (
        sources.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")))
        .select("s.source", "source_size", "weight", (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (
            F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
            / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)))
    return filled.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5,
        max_epochs: float = 2.0, cycle: tuple[int, ...] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats, digest (of the text): one row per row of ``docs``.

    ``size`` is the number of words (null: 0); ``share`` times all sizes is shared out by weight, a
    source's target stops at ``max_epochs`` times its size. A null source is a source, last in the
    order. Rows that share an id (null, too) draw apart by their texts; of rows repeated whole some may
    be taken and others not, whichever they are. Sources without words get target 0; an empty table gives no rows.
    """
    rows = staged(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
        digest(F.col(text_col)).alias("digest")).withColumn("draw", draw(F.col("doc_id"), F.col("digest"), seed))
        .withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sources = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = targets(sources, cyclic_weights(sources, cycle), share, max_epochs)
    plan = (
        plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    plan = staged(plan, "mix-plan")

    bits = max(LEAST_BITS, math.ceil(math.log2(rows.count() / BUCKET + 1)))
    rows = rows.withColumn("bucket", F.shiftright("draw", DRAW - bits))
    along = W.partitionBy("source").orderBy("bucket")  # one row per source and bucket
    sums = (
        rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
        .withColumn("upto", F.sum("held").over(along.rowsBetween(W.unboundedPreceding, 0))))
    last = (
        sums.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
        .filter((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")))
        .groupBy("p.source").agg(F.min(F.struct("bucket", "upto", "held", "rest")).alias("x")).select("source", "x.*")
        .withColumn("before", F.col("upto") - F.col("held")))
    inside = W.partitionBy("source").orderBy("draw", "doc_id", "row").rowsBetween(W.unboundedPreceding, 0)
    cut = (
        rows.alias("r").join(last.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")) & (F.col("r.bucket") == F.col("l.bucket")))
        .select("r.source", "r.draw", "r.doc_id", "r.row", "r.size", "l.before", "l.rest")
        .withColumn("upto", F.col("before") + F.sum("size").over(inside))
        .filter(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
        .groupBy("source").agg(F.max(F.struct("draw", "doc_id", "row")).alias("cut")))
    limits = (
        plan.alias("p").join(last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
        .join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
        .select("p.source", "source_size", "target", "whole", "cut", "bucket", (F.col("l.bucket").isNull() & (F.col("p.rest") > 0)).alias("all")))
    one = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("draw", "doc_id", "row")])
    more = F.coalesce(F.col("m.all") | (F.col("r.bucket") < F.col("m.bucket")) | (one <= F.col("m.cut")), F.lit(False))
    return (
        rows.alias("r").join(staged(limits, "mix-limits").alias("m"), F.col("r.source").eqNullSafe(F.col("m.source")))
        .withColumn("repeats", F.col("whole") + more.cast("bigint"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "digest"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0, 1 or more times).

    A row is known by its id and text. Rows that share both are taken as often as all of them
    together; which of them stands for a repetition is not told apart.
    """
    often = mix(docs, id_col, text_col, **options).groupBy("doc_id", "digest").agg(F.sum("repeats").alias("often"), F.count(F.lit(1)).alias("rows"))
    # No column of the table can clash with these.
    spare = {f"column_{i}": name for i, name in enumerate(docs.columns)}
    kept = docs.select(*[F.col(f"`{old}`").alias(new) for new, old in spare.items()], F.col(id_col).alias("key"), digest(F.col(text_col)).alias("text_digest"))
    joined = kept.join(often, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("text_digest") == F.col("digest"))).filter("often > 0")
    # Rows repeated whole: the first of them by number take one repetition more where the sum doesn't divide.
    turns = F.floor(F.col("often") / F.col("rows"))
    alone = joined.filter("rows = 1 or often % rows = 0").withColumn("turns", turns)
    twins = joined.filter("rows > 1 and often % rows != 0").withColumn(
        "place", F.row_number().over(W.partitionBy("key", "text_digest").orderBy(*spare)))
    both = alone.unionByName(twins.withColumn("turns", turns + (F.col("place") <= F.col("often") % F.col("rows")).cast("bigint")).drop("place"))
    return both.filter("turns > 0").withColumn("turn", F.explode(F.array_repeat(F.lit(0), F.col("turns").cast("int")))).select(
        *[F.col(new).alias(old) for new, old in spare.items()])
