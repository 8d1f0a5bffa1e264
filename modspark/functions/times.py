"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(name: str) -> Column:
    """Microseconds since the epoch of a timestamp column (with or without zone).

    Taken from the parts of an interval between zoneless times: a difference in units
    would pass through the session zone and its clock changes.
    """
    since = f"(cast({name} as timestamp_ntz) - {_EPOCH})"
    return F.expr(
        f"extract(DAY FROM {since}) * 86400000000L + extract(HOUR FROM {since}) * 3600000000L"
        f" + extract(MINUTE FROM {since}) * 60000000L + cast(extract(SECOND FROM {since}) * 1000000 as bigint)"
    )


def from_micros(name: str) -> Column:
    """Timestamp without zone from a column of microseconds."""
    return F.expr(
        f"{_EPOCH} + make_dt_interval(0, 0, 0, cast({name} as decimal(20, 0)) / 1000000)"
    )


def hour_label(name: str) -> Column:
    """Hour bucket such as ``2024-01-31_07``."""
    return F.date_format(F.date_trunc("hour", F.col(name)), "yyyy-MM-dd_HH")


def parse_timestamp(value: Column, as_of: Column) -> Column:
    """Null stays null, unreadable text becomes ``as_of``; naive means UTC."""
    zoned = F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{2})$", "")
    offset = F.regexp_extract(value, r"([+-])(\d{2}):?(\d{2})$", 0)
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(offset, r"[^0-9]", "")
    minutes = F.when(
        offset != "",
        sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")),
    ).otherwise(0)
    parsed = F.try_to_timestamp(F.regexp_replace(zoned, "T", " ")).cast("timestamp_ntz")
    utc = parsed - F.make_dt_interval(mins=minutes)
    return F.when(value.isNull(), F.lit(None)).otherwise(F.coalesce(utc, as_of))


def mute_minutes(muted_until: str, as_of: str) -> Column:
    """Whole minutes of mute left, at least one; null when not muted."""
    left = micros(muted_until) - micros(as_of)
    return F.when(
        left > 0, F.greatest(F.lit(1), F.floor(left / F.lit(60 * SECOND)).cast("int"))
    )
