"""Roles, sessions and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Role names and which of them a filter admits.
PRIMARY, MODERATOR = "primary_admin", "moderator"
STAFF = (PRIMARY, MODERATOR)
MEMBER_STATUSES = ("member", "administrator", "creator")


def with_role(users: DataFrame, roles: DataFrame, user: str) -> DataFrame:
    """Role by priority (primary, moderator, administrator list as moderator)."""
    ranked = roles.groupBy(user).agg(F.min(F.struct("priority", "role")).alias("best"))
    return users.join(ranked.select(user, F.col("best.role").alias("role")), user, "left")


def only_roles(users: DataFrame, *admitted: str) -> DataFrame:
    """F5."""
    return users.where(F.col("role").isin(*admitted))


def members_only(users: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """restricted, left, banned or unknown people do not pass."""
    return users.join(members.where(F.col("status").isin(*MEMBER_STATUSES)).select(user), user, "left_semi")


def live_sessions(sessions: DataFrame, as_of_us: Column, expiry_minutes: int = 120) -> DataFrame:
    """sessions of known roles no older than the expiry."""
    return sessions.where(F.col("role").isin(*STAFF) & (as_of_us - F.col("us") <= expiry_minutes * 60_000_000))


def limited(messages: DataFrame, staff: DataFrame, user: str, text: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Messages the limits apply to."""
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.coalesce(F.startswith(text, F.lit(p)), F.lit(False))
    return messages.join(staff.select(user), user, "left_anti").where(~starts)


def account_status(is_banned: Column, reason: Column, minutes_left: Column) -> Column:
    """X26."""
    return (
        F.when(is_banned, F.concat(F.lit("banned ("), F.coalesce(reason, F.lit("-")), F.lit(")")))
        .when(minutes_left.isNotNull(), F.concat(F.lit("muted ("), minutes_left.cast("string"), F.lit(" min)")))
        .otherwise("active")
    )


def account_card(df: DataFrame) -> DataFrame:
    """Profile fields, dates cut to the day and to the minute."""
    return df.select(
        "anonymous_id", "status", "total_posts", "total_replies",
        F.date_format("created_at", "yyyy-MM-dd").alias("joined"),
        F.date_format("last_active_at", "yyyy-MM-dd HH:mm").alias("last_seen"))
