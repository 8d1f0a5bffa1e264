"""Text folds (X1-X15, X17, X19-X21): native expressions plus one Arrow UDF."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from modspark.functions.bind import once



def _points(*ranges: tuple[int, int]) -> str:
    return "".join(chr(p) for first, last in ranges for p in range(first, last + 1))


# The code points and letters below decide the result of a fold.
ZERO_WIDTH = _points((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFEFF, 0xFEFF), (0x00AD, 0x00AD),
                     (0xFE00, 0xFE0F), (0xFFF9, 0xFFFB))
ARABIC_MARKS = _points((0x064B, 0x065F), (0x0670, 0x0670), (0x0610, 0x061A), (0x06D6, 0x06DC), (0x06DF, 0x06E8),
                       (0x06EA, 0x06ED))
ARABIC_MARKS_NARROW = _points((0x064B, 0x065F), (0x0670, 0x0670))
TATWEEL = "\u0640"
CYRILLIC_LOOKALIKES = ("аАеЕєЄоОрРсСуУхХіІїЇјЈѕЅһҺВКМНТ", "aAeEeEoOpPcCyYxXiIiIjJsShHBKMHT")
GREEK_LOOKALIKES = ("αΑβΒεΕοΟρΡτΤυΥχΧ", "aAbBeEoOpPtTuYxX")
LEET = ("4@31!|05$7+89v", "aaeiiiossttbgu")
LATIN_ARABIC_PAIRS = (
    ("3'", "غ"), ("7'", "خ"), ("6'", "ظ"), ("2'", "ض"), ("s'", "ص"), ("t'", "ط"),
    ("d'", "ض"), ("th", "ث"), ("kh", "خ"), ("gh", "غ"), ("sh", "ش"),
)
LATIN_ARABIC_DIGITS = ("375892641", "عحخغقءطشي")
# End of fixed values.

SPACES = _points((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                 (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

# Letters met in most texts; deleting them first leaves little for a slow pattern.
_COMMON = _points((0x00, 0x9F), (0xBF, 0x131))
_COMMON_DROPPED = "".join(c for c in _COMMON if not (c.isascii() and c.isalnum()))
# Letters NFKC leaves alone wherever they stand: anything outside goes to the UDF.
NFKC_STABLE = (
    r"\u0000-\u009f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb"
    r"\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01f0"
    r"\u01f4-\u02af\u0621-\u064a\u0660-\u066f"
)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def strip_spaces(c: Column) -> Column:
    """Trim every Unicode white space, not only blanks."""
    return F.btrim(c, F.lit(SPACES))


def strip_zero_width(c: Column) -> Column:
    """X1."""
    return F.when(_is_ascii(c), c).otherwise(F.translate(c, ZERO_WIDTH, ""))


def nfkc(c: Column) -> Column:
    """Only texts holding a letter NFKC may change travel to Python; the others
    go as nulls and keep their JVM value."""
    rare = F.translate(c, _COMMON, "")
    unstable = F.when(~_is_ascii(c) & rare.rlike(f"[^{NFKC_STABLE}]"), c)
    return F.coalesce(_nfkc(unstable), c)


def fold_lookalikes(c: Column) -> Column:
    """X3."""
    return F.translate(c, CYRILLIC_LOOKALIKES[0] + GREEK_LOOKALIKES[0],
                       CYRILLIC_LOOKALIKES[1] + GREEK_LOOKALIKES[1])


def cap_runs(c: Column) -> Column:
    """Runs of three or more of one character become two."""
    return F.regexp_replace(c, r"([^\n])\1{2,}", "$1$1")


def collapse_runs(c: Column) -> Column:
    """Every run becomes one character."""
    return F.regexp_replace(c, r"([^\n])\1+", "$1")


def fold_arabic(c: Column) -> Column:
    """X4."""
    # One pass: the letters are replaced, everything after them is deleted.
    return cap_runs(F.translate(c, "أإآٱىئةؤ" + ZERO_WIDTH + ARABIC_MARKS + TATWEEL, "ااااييهو"))


def fold_leet(c: Column) -> Column:
    """X5."""
    return F.translate(F.lower(c), *LEET)


def fold_latin_arabic(c: Column) -> Column:
    """Composites in order, then single digits."""
    paired = reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])),
        LATIN_ARABIC_PAIRS, F.lower(c),
    )
    return F.translate(paired, *LATIN_ARABIC_DIGITS)


def compact(c: Column) -> Column:
    """X7."""
    # Named by what goes, not by what stays: Java is slow at negated classes of several ranges.
    return once(F.translate(c, _COMMON_DROPPED, ""), lambda x: F.when(_is_ascii(x), x).otherwise(
        F.regexp_replace(x, r"[\u00a0-\u00be\u0132-\u05ff\u0700-\x{10ffff}]+", "")))


def letters_only(c: Column) -> Column:
    """X8."""
    return F.regexp_replace(compact(c), r"[0-9]+", "")


def tokens(c: Column) -> Column:
    """X10."""
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def char_ngrams(c: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Distinct character n-grams."""
    def of(n: int) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
        return F.when(F.length(c) >= n, cuts).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in sizes]
    return F.array_distinct(F.concat(*grams))


def token_union() -> Column:
    """X11: words of the four readings of a message, in order, without repeats."""
    return F.array_distinct(F.concat(*[
        tokens(c) for c in (F.col("folded"), F.col("leet"), F.col("latin_arabic"), F.lower("homoglyphs"))]))


BUNDLE = (
    "cleaned", "homoglyphs", "folded", "leet", "latin_arabic", "compact_ar", "compact_collapsed",
    "compact_leet", "compact_leet_collapsed", "compact_arab", "compact_arab_collapsed",
    "letters_only", "phonetic_variants", "compact_variants", "tokens",
)


def with_bundle(df: DataFrame, text: str = "text", normalize: bool = True) -> DataFrame:
    """Add every representation of ``text``.

    Steps are separate projections on purpose: Spark keeps a projection apart when
    its costly result is used more than once, so no regex runs twice.  With
    ``normalize=False`` the NFKC step is left out (input already normalised).
    """
    return with_readings(with_folded(df, text, normalize))


def with_folded(df: DataFrame, text: str = "text", normalize: bool = True) -> DataFrame:
    """The first half of the bundle: cleaned, homoglyphs, folded."""
    raw = F.coalesce(F.col(text), F.lit(""))
    bare = strip_zero_width(raw)
    return (
        df.withColumn("cleaned", strip_spaces(nfkc(bare) if normalize else bare))
        .withColumn("homoglyphs", fold_lookalikes(F.col("cleaned")))
        .withColumn("folded", fold_arabic(F.col("homoglyphs")))
    )


def with_readings(df: DataFrame) -> DataFrame:
    """The second half of the bundle, made of homoglyphs and folded."""
    return (
        df.withColumn("leet", fold_leet(F.col("homoglyphs")))
        .withColumn("latin_arabic", fold_latin_arabic(F.col("folded")))
        .withColumns({
            "compact_ar": compact(F.col("folded")),
            "compact_leet": compact(F.col("leet")),
            "compact_arab": compact(F.col("latin_arabic")),
            "letters_only": letters_only(F.col("folded")),
        })
        .withColumns({
            "compact_collapsed": collapse_runs(F.col("compact_ar")),
            "compact_leet_collapsed": collapse_runs(F.col("compact_leet")),
            "compact_arab_collapsed": collapse_runs(F.col("compact_arab")),
        })
        .withColumns({
            # X11, X13
            "tokens": token_union(),
            "phonetic_variants": F.array_distinct(F.array(
                "folded", "leet", "latin_arabic", F.lower("homoglyphs"), F.col("letters_only"))),
            "compact_variants": F.array_distinct(F.array(
                "compact_ar", "compact_collapsed", "compact_leet", "compact_leet_collapsed",
                "compact_arab", "compact_arab_collapsed")),
        })
    )


def fold_for_hash(c: Column, normalize: bool = True) -> Column:
    """The fold under a content fingerprint."""
    base = nfkc(c) if normalize else c
    folded = F.translate(F.lower(base), "أإآٱىة" + ARABIC_MARKS_NARROW + TATWEEL, "اااايه")
    return strip_spaces(cap_runs(folded))


def content_hash(text: Column, media_id: Column | None = None, normalize: bool = True) -> Column:
    """sha256 over the folded text and the media id; '' when both are empty."""
    base = F.coalesce(fold_for_hash(text, normalize), F.lit(""))
    if media_id is not None:
        base = F.concat(base, F.when(F.coalesce(media_id, F.lit("")) != "", F.concat(F.lit("_"), media_id)).otherwise(""))
    return F.when(base == "", F.lit("")).otherwise(F.sha2(base, 256))


def escape_html(c: Column) -> Column:
    """X17."""
    out = strip_spaces(F.coalesce(c, F.lit("")))
    # The five HTML escapes, ampersand first.
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def render_post(author_no: Column, body: Column) -> Column:
    """Card of a root message."""
    return F.concat(F.lit("<b>New question</b> from #"), author_no.cast("string"), F.lit("\n"), escape_html(body))


def render_reply(author_no: Column, parent_id: Column, body: Column) -> Column:
    """Card of a reply; a missing parent leaves the reference line out."""
    line = F.when(parent_id.isNotNull(), F.concat(F.lit(" to "), parent_id.cast("string"))).otherwise("")
    return F.concat(F.lit("<b>Reply</b> from #"), author_no.cast("string"), line, F.lit("\n"), escape_html(body))


def preview(text: Column, media_type: Column, width: int = 150) -> Column:
    """The shown excerpt, or the media type in brackets when there is no text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.substring(text, 1, width)).otherwise(
        F.concat(F.lit("["), media_type, F.lit("]")))


# Shapes and markers of the six redaction steps, in order.
_NO_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
_NO_WORD_AFTER = r"(?![\p{L}\p{N}_])"
REDACTIONS = (
    (_NO_WORD_BEFORE + r"\d{6,12}:(?:[a-zA-Z0-9_-]{19,49}[a-zA-Z0-9_]" + _NO_WORD_AFTER
     + r"|[a-zA-Z0-9_-]{19,49}-(?=[\p{L}\p{N}_]))", "[REDACTED_BOT_TOKEN]"),
    (r"(?i)(ENCRYPTION_KEY\s*[:=]\s*|key\s*[:=]\s*|EncryptionKey\s*[:=]\s*)([A-Za-z0-9+/=_-]{20,80})", "$1[REDACTED_KEY]"),
    (r"(?i)(password\s*[:=]\s*)([^\s,]+)", "$1[REDACTED_PASSWORD]"),
    (r"(?:(?<=[\p{L}\p{N}_])\+|" + _NO_WORD_BEFORE + ")[0-9]{10,15}" + _NO_WORD_AFTER, "[REDACTED_PHONE]"),
    (r"@[a-zA-Z0-9_]{4,32}", "[REDACTED_USERNAME]"),
    (_NO_WORD_BEFORE + r"[1-9]\d{8,10}" + _NO_WORD_AFTER, "[REDACTED_ID]"),
)


def redact(c: Column) -> Column:
    """Six ordered replacements."""
    return reduce(lambda acc, step: F.regexp_replace(acc, *step), REDACTIONS, F.coalesce(c, F.lit("")))


# Extensions refused and accepted (M1).
DENIED_EXTENSIONS = (
    ".exe", ".bat", ".cmd", ".com", ".pif", ".scr", ".vbs", ".js", ".jar", ".apk", ".app", ".msi",
    ".dll", ".sys", ".sh", ".bash", ".ps1", ".py", ".php", ".pl", ".cgi", ".asp", ".aspx", ".elf",
    ".bin", ".reg", ".deb", ".rpm", ".dmg", ".iso", ".img", ".vhd", ".class", ".action", ".wsf",
)
ALLOWED_EXTENSIONS = (
    ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".txt", ".csv", ".zip", ".rar",
    ".7z", ".png", ".jpg", ".jpeg", ".webp", ".ogg", ".mp3", ".mp4",
)


def extension(c: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(c, r"[^./\\][^/\\]*?(\.[^./\\]*)$", 1))


def safe_file_name(raw: Column, seed: Column) -> Column:
    """struct(name, ext, ok, error).  A missing name is derived from ``seed``."""
    base = F.regexp_extract(raw, r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_\s.-]", "_"), r"\.{2,}", ".")
    clean = F.regexp_replace(clean, r"^[ ._]+|[ ._]+$", "")
    ext = extension(clean)
    stem = F.substring(clean, F.lit(1), F.least(F.lit(60), F.length(clean) - F.length(ext)))
    missing = F.coalesce(raw, F.lit("")) == ""
    made = F.concat(F.lit("document_"), F.substring(F.sha2(seed, 256), 1, 8), F.lit(".pdf"))
    ok = missing | (ext.isin(*ALLOWED_EXTENSIONS) & ~ext.isin(*DENIED_EXTENSIONS))
    return F.struct(
        F.when(missing, made).when(ok, F.concat(stem, ext)).alias("name"),
        F.when(missing, F.lit(".pdf")).otherwise(ext).alias("ext"),
        ok.alias("ok"),
        F.when(~ok, F.when(ext == "", F.lit("no extension")).when(ext.isin(*DENIED_EXTENSIONS), F.lit("denied extension"))
               .otherwise(F.lit("unknown extension"))).alias("error"),
    )


def link_target(command: Column) -> Column:
    """Message id of a ``reply_<digits>`` start argument, else null."""
    return F.regexp_extract(command, r"^\S+\s+reply_(\d+)\s*$", 1).try_cast("bigint")


def numeric_key(query: Column) -> Column:
    """Optional leading '#', then digits only."""
    stripped = F.regexp_replace(strip_spaces(query), r"^#+", "")
    return F.when(stripped.rlike(r"^\d+$"), stripped.try_cast("bigint"))


def parse_command(line: Column, default_reason: str = "unspecified") -> Column:
    """struct(verb, target, minutes, reason) of one staff command."""
    head = r"^/(\S+)\s+#?(\d+)"
    tail = strip_spaces(F.regexp_extract(line, head + r"\s+([\s\S]+)$", 3))
    verb = F.lower(F.regexp_extract(line, r"^/(\S+)", 1))
    timed = verb == "mute"
    return F.struct(
        verb.alias("verb"),
        F.regexp_extract(line, head, 2).try_cast("bigint").alias("target"),
        F.when(timed, F.regexp_extract(tail, r"^(\d+)$", 1).try_cast("int")).alias("minutes"),
        F.when(~timed, F.when(tail == "", F.lit(default_reason)).otherwise(tail)).alias("reason"),
    )


# Priority of message parts.
MEDIA_PRIORITY = ("photo", "animation", "audio", "voice", "video_note", "sticker", "document", "video", "text")


def pick_media_type(present: dict[str, Column]) -> Column:
    """First part present, by fixed priority; null when none is."""
    return F.coalesce(*[F.when(present[m], F.lit(m)) for m in MEDIA_PRIORITY if m in present])
