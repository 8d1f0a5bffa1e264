"""Bounded edit distance with adjacent swaps (E1-E3), JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modspark.functions.bind import once


def _swap_distance(a: Column, b: Column, limit: Column) -> Column:
    """Optimal string alignment distance; ``limit + 1`` once a whole row exceeds it."""
    left, right = F.split(a, ""), F.split(b, "")
    zero_row = F.sequence(F.lit(0), F.length(b))
    start = F.struct(zero_row.alias("older"), zero_row.alias("last"), F.lit(False).alias("cut"))

    def next_row(acc: Column, i: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            same = F.get(left, i - 1) == F.get(right, j - 1)
            swap = (i > 1) & (j > 1) & (F.get(left, i - 1) == F.get(right, j - 2)) & (F.get(left, i - 2) == F.get(right, j - 1))
            best = F.least(
                F.get(acc["last"], j) + 1,
                F.get(row, j - 1) + 1,
                F.get(acc["last"], j - 1) + F.when(same, 0).otherwise(1),
                F.when(swap, F.get(acc["older"], j - 2) + 1),
            )
            return F.concat(row, F.array(best))

        row = F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell)
        # A row already above the limit can never come back below it.
        cut = acc["cut"] | (F.array_min(acc["last"]) > limit)
        return F.struct(acc["last"].alias("older"), row.alias("last"), cut.alias("cut"))

    return F.aggregate(
        F.sequence(F.lit(1), F.length(a)), start, next_row,
        lambda acc: F.when(acc["cut"] | (F.array_min(acc["last"]) > limit), limit + 1)
        .otherwise(F.element_at(acc["last"], -1)),
    )


def bounded_distance(a: Column, b: Column, limit: Column | int = 2) -> Column:
    """E1.  Cheap tests first: equality, length gap, plain distance at twice the limit."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    la, lb = F.length(a), F.length(b)
    return (
        F.when(a == b, 0)
        .when(F.abs(la - lb) > limit, limit + 1)
        .when(F.least(la, lb) == 0, F.greatest(la, lb))
        .otherwise(_swap_distance(a, b, limit))
    )


def similarity(a: Column, b: Column) -> Column:
    """E2."""
    longest = F.greatest(F.length(a), F.length(b))
    dist = bounded_distance(a, b, F.greatest(F.lit(3), F.floor(longest / 3).cast("int")))
    return (
        F.when(F.coalesce(F.least(F.length(a), F.length(b)), F.lit(0)) == 0, F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - dist / longest))
    )


def same_letters(a: Column, b: Column) -> Column:
    return F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))


def fuzzy_similarity(token: Column, target: Column, threshold: float | None = None) -> Column:
    """Similarity when the pair matches under the length rules, else null."""
    lt, lg = F.length(token), F.length(target)
    limit = F.when(lg <= 6, 1).otherwise(2)

    def judged(dist: Column) -> Column:
        sim = 1.0 - dist / F.greatest(lt, lg)
        enough = sim >= F.when(lg <= 6, threshold or 0.80).otherwise(threshold or 0.75)
        return F.when((dist <= limit) & (enough | ((lg <= 6) & same_letters(token, target))), sim)

    return (
        F.when(F.coalesce(F.least(lt, lg), F.lit(0)) == 0, F.lit(None).cast("double"))
        .when((lt < 4) | (lg < 4), F.when(token == target, F.lit(1.0)))
        .otherwise(once(bounded_distance(token, target, limit), judged))
    )


def deletions(word: Column, depth: int) -> Column:
    """The word and every word left after up to ``depth`` (0-2) single deletions.

    Two words within swap distance d share an entry of their depth-d lists, so an
    equality join on the entries finds every candidate pair.
    """
    def drop_one(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(w)),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
        )

    if depth == 0:
        return F.array(word)
    return once(
        F.array_distinct(F.concat(F.array(word), drop_one(word))),
        lambda shorter: shorter if depth == 1 else F.array_distinct(
            F.concat(shorter, F.flatten(F.transform(shorter, drop_one)))),
    )
