"""Sequences per key without one task per key.

A busy key may hold a third of all rows, so no operator here sorts or gathers the
rows of a key as a whole.  Time is cut into slices; rows are sorted within (key,
slice) only, and what a slice needs from earlier ones is either a handful of rows
(``with_recent``) or one summary row per slice (``carry_*``), made with partial
aggregation before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modspark.functions.times import micros


def with_micros(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("us", micros(ts))


def with_recent(df: DataFrame, keys: list[str], order: str, depth: int, span: int, slices: int = 1) -> DataFrame:
    """Add ``recent``: times (column ``us``) of the up to ``depth`` preceding rows of
    the key that are at most ``span`` microseconds old, newest first.

    A limit of the form "more than n in a window" only asks for the n-th row before,
    so ``depth`` rows of context decide it however many rows the window holds.  The
    last ``depth`` rows of a slice are lent to the next ``slices`` slices.
    """
    width = max(1, span // slices)
    reach = -(-span // width)
    cut = df.withColumn("slice", F.floor(F.col("us") / F.lit(width)).cast("bigint"))
    newest = W.partitionBy(*keys, "slice").orderBy(F.col("us").desc(), F.col(order).desc())
    # Spark keeps only the first ``depth`` rows of a group before the shuffle.
    tail = cut.select(*keys, "us", order, "slice").withColumn("rank", F.row_number().over(newest)).where(
        F.col("rank") <= depth).drop("rank")
    lent = tail.withColumn("slice", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(reach)), lambda i: F.col("slice") + i)))
    both = cut.withColumn("own", F.lit(True)).unionByName(
        lent.withColumn("own", F.lit(False)), allowMissingColumns=True)
    line = W.partitionBy(*keys, "slice").orderBy("us", order)
    back = F.array(*[F.lag("us", i).over(line) for i in range(1, depth + 1)])
    return (
        both.withColumn("recent", back).where("own")
        .withColumn("recent", F.filter("recent", lambda t: t.isNotNull() & (F.col("us") - t <= span)))
        .drop("own", "slice")
    )


def _sliced(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("slice", F.floor(F.col("us") / F.lit(width)).cast("bigint"))


def carry_last(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int) -> DataFrame:
    """As-of: the last non-null ``value`` of the key up to and including the row.

    Sorted within slices; what precedes a slice is one ``max_by`` row per slice.
    """
    cut = _sliced(df.withColumn("carried", value), width)
    summary = cut.where(F.col("carried").isNotNull()).groupBy(*keys, "slice").agg(
        F.max_by("carried", F.struct("us", order)).alias("closing"))
    every = cut.select(*keys, "slice").distinct().join(summary, [*keys, "slice"], "left")
    chain = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    opening = every.withColumn("opening", F.last("closing", ignorenulls=True).over(chain)).drop("closing")
    line = W.partitionBy(*keys, "slice").orderBy("us", order).rowsBetween(W.unboundedPreceding, 0)
    return (
        cut.withColumn(name, F.last("carried", ignorenulls=True).over(line))
        .join(opening, [*keys, "slice"], "left")
        .withColumn(name, F.coalesce(name, "opening")).drop("carried", "opening", "slice")
    )


def carry_next(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int) -> DataFrame:
    """The ``value`` of the key's next row (lead), across slices."""
    cut = _sliced(df.withColumn("carried", value), width)
    summary = cut.groupBy(*keys, "slice").agg(F.min_by("carried", F.struct("us", order)).alias("first_value"))
    ahead = summary.withColumn("following", F.lead("first_value").over(W.partitionBy(*keys).orderBy("slice"))).drop("first_value")
    line = W.partitionBy(*keys, "slice").orderBy("us", order)
    return (
        cut.withColumn(name, F.lead("carried").over(line))
        .join(ahead, [*keys, "slice"], "left")
        .withColumn(name, F.coalesce(name, "following")).drop("carried", "following", "slice")
    )


def carry_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int) -> DataFrame:
    """Running total of ``value`` per key up to and including the row."""
    cut = _sliced(df.withColumn("carried", value), width)
    summary = cut.groupBy(*keys, "slice").agg(F.sum("carried").alias("amount"))
    chain = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = summary.withColumn("before", F.coalesce(F.sum("amount").over(chain), F.lit(0))).drop("amount")
    line = W.partitionBy(*keys, "slice").orderBy("us", order).rowsBetween(W.unboundedPreceding, 0)
    return (
        cut.withColumn(name, F.sum("carried").over(line))
        .join(before, [*keys, "slice"])
        .withColumn(name, F.col(name) + F.col("before")).drop("carried", "before", "slice")
    )


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the last by ``order``; pruned before the shuffle."""
    return _first_of(df, keys, [o.desc() for o in order])


def earliest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``."""
    return _first_of(df, keys, [o.asc() for o in order])


def _first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
