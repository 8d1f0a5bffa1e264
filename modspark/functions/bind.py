"""Evaluate a costly expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time per row.

    Spark does not share sub-expressions that sit in different branches of CASE or
    coalesce, so a regex named twice there would run twice.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters cannot be pushed through.

    Spark moves a filter below a projection by copying the expression it tests; for a
    filter on the outcome of dozens of regexes that repeats all of them.  A one-row
    generator keeps the filter above and its test a plain comparison.
    """
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*[c for c in df.columns if c not in columns], F.inline(made))
