"""Declared schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that appear in results.
CATEGORIES = (
    "none", "explicit", "sexual", "profanity", "insult", "harassment", "bullying", "threat", "violence",
    "hate", "slur", "self_harm", "link", "phone_number", "email_address", "pii_self_doxx", "spam", "media_unsafe",
)
SEVERITY_SCORE = {"critical": 4, "high": 3, "medium": 2, "low": 1}
CONTENT_TYPES = ("text", "photo", "document", "voice", "audio", "video", "animation", "sticker")
AUDIT_ACTIONS = (
    "BAN", "UNBAN", "MUTE", "UNMUTE", "DELETE_POST", "WHOIS", "WIPE_STUDENT", "DM_STUDENT",
    "TOGGLE_SUBMISSIONS", "SET_ADMIN_PASSWORD", "AUTO_MUTE", "AUTO_MUTE_EXTENDED",
)

TABLES = {
    "students": """id bigint, anonymous_id bigint, user_hash string, enc_telegram_id string, enc_full_name string,
        enc_username string, is_banned boolean, ban_reason string, muted_until timestamp, total_posts bigint,
        total_replies bigint, created_at timestamp, last_active_at timestamp""",
    "banned_fingerprints": "id_hash string, reason string, banned_at timestamp",
    "admin_credentials": "telegram_id bigint, password_hash string, role string, created_at timestamp, last_login_at timestamp",
    "security_events": "id bigint, user_id bigint, event_type string, created_at timestamp",
    "admin_login_attempts": "id bigint, user_id bigint, attempted_at timestamp",
    "admin_sessions": "user_id bigint, authenticated_at timestamp, role string",
    "posts": """id bigint, anonymous_id bigint, channel_message_id bigint, user_msg_id bigint, media_type string,
        media_file_id string, content_preview string, content_hash string, created_at timestamp,
        is_deleted boolean, status string, enc_original_filename string""",
    "replies": """id bigint, anonymous_id bigint, parent_channel_msg_id bigint, reply_channel_msg_id bigint,
        user_msg_id bigint, media_type string, media_file_id string, content_preview string,
        content_hash string, created_at timestamp, is_deleted boolean, status string, enc_original_filename string""",
    "submission_quotas": "user_hash string, window_hour string, count bigint",
    "audit_logs": "id bigint, admin_id bigint, action string, target_anonymous_id bigint, details string, created_at timestamp",
    "system_settings": "key string, value string, updated_at timestamp",
}

LEXICON = """ord int, term string, category string, severity string, kind string, script string,
    fuzzy boolean, critical boolean"""
CORPUS = "`group` string, text string, expected_allowed boolean"
MESSAGES = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

IDENTITY_COLUMNS = ("user_hash", "enc_telegram_id", "enc_full_name", "enc_username")


def students_public(students: DataFrame) -> DataFrame:
    """K7: the view without any identity column."""
    return students.drop(*IDENTITY_COLUMNS)


def severity_score(column: str = "severity"):
    """4 critical .. 1 low, 0 for anything else."""
    name = F.lower(F.col(column))
    out = F.lit(0)
    for label, score in SEVERITY_SCORE.items():
        out = F.when(name == label, score).otherwise(out)
    return out
