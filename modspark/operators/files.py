"""File screening over binary columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.functions import text as T

MB = 1024 * 1024

# File heads as hex.
PROGRAM_HEADS = ("4D5A", "7F454C46", "CAFEBABE", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "2321", "4D534346")
ARCHIVED_PROGRAM_HEADS = ("4D5A", "7F454C46", "CAFEBABE", "FEEDFACE", "FEEDFACF", "2321")
FORMAT_HEADS = {
    (".jpg", ".jpeg"): ("FFD8FF",),
    (".png",): ("89504E470D0A1A0A",),
    (".pdf",): ("25504446",),
    (".docx", ".xlsx", ".pptx", ".zip"): ("504B0304",),
    (".rar",): ("526172211A07",),
    (".7z",): ("377ABCAF271C",),
    (".ogg",): ("4F676753",),
    (".mp3",): ("494433", "FFFB", "FFF3"),
}
ROUTES = {
    "photo": ("photo", (".png", ".jpg", ".jpeg", ".webp")),
    "document": ("document", (".pdf", ".docx", ".txt", ".xlsx", ".pptx", ".zip", ".tar")),
}
ARCHIVES = (".zip", ".tar", ".gz")
READABLE = (".txt", ".docx", ".xlsx", ".xlsm", ".pptx", ".pdf")
MAX_ENTRIES, MAX_INFLATED, MAX_SIDE = 100, 50 * MB, 8192


# The upper half of a byte read as latin-1, and what it means in cp1256.
_CP1256 = (bytes(range(128, 256)).decode("latin-1"), bytes(range(128, 256)).decode("cp1256"))


def _starts(content: Column, *heads: str) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(content, F.unhex(F.lit(h))) for h in heads])


def is_program(content: Column, heads: tuple[str, ...] = PROGRAM_HEADS) -> Column:
    """M2."""
    return F.coalesce(_starts(content, *heads), F.lit(False))


def head_matches(content: Column, ext: Column) -> Column:
    """M3: no program head, and the head the extension promises."""
    start = F.substring(content, 1, 64)
    out = F.lit(False)
    for exts, heads in FORMAT_HEADS.items():
        out = F.when(ext.isin(*exts), _starts(start, *heads)).otherwise(out)
    webp = _starts(start, "52494646") & (F.position(F.lit("57454250"), F.hex(F.substring(start, 1, 16))) % 2 == 1)
    mp4 = F.position(F.lit("66747970"), F.hex(F.substring(start, 5, 8))) % 2 == 1
    # A zero byte is two zero digits on a byte boundary.
    no_zero = ~F.exists(F.sequence(F.lit(1), F.length(start)), lambda i: F.hex(F.substring(start, i, F.lit(1))) == "00")
    out = F.when(ext == ".webp", webp).when(ext == ".mp4", mp4).when(ext.isin(".txt", ".csv"), no_zero).otherwise(out)
    return F.coalesce((F.length(content) > 0) & ~is_program(start) & out, F.lit(False))


def size_ok(length: Column, limit: int = 20 * MB) -> Column:
    """F8."""
    return length.between(1, limit)


def screen(files: DataFrame, archive_ok: DataFrame | None = None, limit: int = 20 * MB) -> DataFrame:
    """M4: struct ``check`` of the single tests and ``safe``.  ``files`` has path, length,
    content, declared_name; ``archive_ok`` (path, ok) comes from the entry checks."""
    name = T.safe_file_name(F.coalesce("declared_name", F.regexp_extract("path", r"([^/]*)$", 1)), F.col("path"))
    named = files.withColumn("named", name)
    out = named.withColumn("check", F.struct(
        size_ok(F.col("length"), limit).alias("size"), F.col("named.ok").alias("name"),
        (~is_program(F.substring("content", 1, 64))).alias("no_program"),
        head_matches(F.col("content"), F.col("named.ext")).alias("head")))
    if archive_ok is not None:
        out = out.join(archive_ok.withColumnRenamed("ok", "entries_ok"), "path", "left")
    else:
        out = out.withColumn("entries_ok", F.lit(True))
    inside = F.when(F.col("named.ext") == ".zip", F.coalesce("entries_ok", F.lit(False))).otherwise(True)
    return out.withColumn("safe", F.col("check.size") & F.col("check.name") & F.col("check.no_program") & F.col("check.head") & inside)


def entry_findings(entries: DataFrame, max_inflated: int = MAX_INFLATED, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """M5: one finding per archive, the first that applies: entry count, inflated size,
    then by entry order path, extension, program head.  ``entries`` has path, position,
    entry_name, inflated_size, head (null in a tar)."""
    # .. anywhere, or an absolute path
    leaves = F.contains("entry_name", F.lit("..")) | F.col("entry_name").rlike(r"^[/\\]")
    denied = T.extension(F.lower("entry_name")).isin(*T.DENIED_EXTENSIONS)
    program = is_program(F.col("head"), ARCHIVED_PROGRAM_HEADS)
    problem = F.when(leaves, "path traversal").when(denied, "denied extension").when(program, "program code")
    sized = entries.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("inflated_size").alias("inflated"),
        F.min(F.when(problem.isNotNull(), F.struct(F.col("position"), problem.alias("problem")))).alias("first"))
    return sized.select("path", "n", "inflated", F.when(F.col("n") > max_entries, "too many entries").when(
        F.col("inflated") > max_inflated, "zip bomb expansion").otherwise(F.col("first.problem")).alias("finding"))


def package_findings(entries: DataFrame) -> DataFrame:
    """M8: macro code inside an office package."""
    ext = T.extension(F.col("path"))
    macro = F.contains("entry_name", F.lit("vbaProject.bin")) | ((ext == ".docx") & F.endswith("entry_name", F.lit(".bin")))
    return entries.withColumn("ext", ext).groupBy("path", "ext").agg(F.bool_or(macro).alias("macro")).withColumn(
        "macro", F.col("macro") | (F.col("ext") == ".xlsm"))


def package_text(entries: DataFrame) -> DataFrame:
    """M8: text parts of office packages, one row per part; tags become blanks."""
    part = F.col("entry_name")
    wanted = part.isin("word/document.xml", "word/header1.xml", "word/footer1.xml") | F.contains(part, F.lit("sharedStrings.xml")) | (
        part.rlike(r"(sheet|slide).*\.xml$"))
    body = F.regexp_replace(F.col("content").cast("string"), r"<[^>]*>", " ")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(mark), F.lit(char))
    return entries.where(wanted).select("path", "entry_name", T.strip_spaces(F.regexp_replace(body, r"\s+", " ")).alias("text"))


def plain_text(content: Column) -> Column:
    """M7: struct(text, finding): utf-8, else cp1256; a zero byte anywhere is a
    finding.  The whole text is decoded."""
    binary = F.contains(content, F.lit(b"\x00"))
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    # cp1256 assigns every byte, so it never fails and latin-1 is not needed after it.
    text = F.coalesce(utf8, F.translate(F.decode(content, "ISO-8859-1"), *_CP1256))
    return F.struct(F.when(~binary, text).alias("text"),
                    F.when(binary, "binary zero bytes in plain text").alias("finding"))


def route(content_type: Column, path: Column) -> Column:
    """Which screen a file goes to; 'unknown' is a security finding."""
    ext = T.extension(path)
    kind = F.lower(content_type)
    document = F.when(ext.isin(*ARCHIVES), "archive").otherwise("document")
    return (
        F.when((kind == "photo") | ext.isin(*ROUTES["photo"][1]), "photo")
        .when((kind == "document") | ext.isin(*ROUTES["document"][1]), document)
        .when(kind.isin("voice", "audio"), "audio")
        .when(kind == "video", "video")
        .when((kind == "animation") | (ext == ".gif"), "animation")
        .when(kind == "sticker", "sticker")
        .otherwise("unknown")
    )


def document_route(path: Column) -> Column:
    """M9: reader of a document; anything else is unsupported."""
    ext = T.extension(path)
    return F.when(ext.isin(*READABLE), F.substring(ext, 2, 8)).otherwise("unsupported")


def known_type(declared: Column) -> Column:
    """V6: a type name is kept; else 'doc' inside means document, all others photo."""
    name = F.lower(declared)
    return F.when(name.isin("text", "photo", "document", "voice", "audio", "video", "animation", "sticker"), name).when(
        F.contains(declared, F.lit("doc")), "document").otherwise("photo")


def intake_findings(files: DataFrame) -> DataFrame:
    """V5: fail-closed findings before any reader runs, as signal rows."""
    where_to = route(F.col("content_type"), F.col("path"))
    reason = (
        F.when(F.col("length").isNull(), F.lit("media file not found"))
        .when(F.col("length") == 0, F.lit("file is empty (0 bytes)"))
        .when(where_to == "unknown", F.concat(F.lit("unknown intake type: "), F.lower("content_type")))
    )
    return files.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        F.col("path").alias("payload_id"), F.lit(0).alias("ordinal"), F.lit("FILE_SECURITY").alias("source"),
        F.lit("media_unsafe").alias("category"), F.lit("high").alias("severity"), F.lit(1.0).alias("confidence"),
        F.lit(True).alias("is_violation"), F.lit(True).alias("is_security"), "reason",
        F.lit(None).cast("string").alias("detected_item"))


def oversized(width: Column, height: Column) -> Column:
    """M10."""
    return (width > MAX_SIDE) | (height > MAX_SIDE)


def is_skin(r: Column, g: Column, b: Column) -> Column:
    """The colour rule of one pixel."""
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    return (r > 95) & (g > 40) & (b > 20) & (spread > 15) & (F.abs(r - g) > 15) & (r > g) & (r > b)


def skin_share(pixels: DataFrame, image: str, threshold: float = 0.65) -> DataFrame:
    """M11 over a pixel table (image, r, g, b)."""
    share = F.avg(F.when(is_skin(F.col("r"), F.col("g"), F.col("b")), 1.0).otherwise(0.0))
    return pixels.groupBy(image).agg(share.alias("share")).withColumn("flagged", F.col("share") >= threshold).withColumn(
        "confidence", F.when(F.col("flagged"), F.least(F.lit(1.0), 0.7 + 0.3 * F.col("share"))))


def image_pixels(images: DataFrame, grid: int = 120) -> DataFrame:
    """Pixels of Spark's image source on an even grid of at most ``grid`` per side
    (stored blue, green, red), one row each, built by native functions."""
    w, h, ch = F.col("image.width"), F.col("image.height"), F.col("image.nChannels")
    stride = F.greatest(F.lit(1), F.ceil(F.greatest(w, h) / F.lit(grid)).cast("int"))
    spots = images.select(F.col("image.origin").alias("path"), F.col("image.data").alias("data"), w.alias("w"), ch.alias("ch"),
                          F.explode(F.sequence(F.lit(0), h - 1, stride)).alias("y"), stride.alias("stride"))
    spots = spots.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1, F.col("stride"))))
    at = (F.col("y") * F.col("w") + F.col("x")) * F.col("ch") + 1

    def byte(offset: Column) -> Column:
        return F.conv(F.hex(F.substring(F.col("data"), offset, F.lit(1))), 16, 10).cast("int")

    grey = F.col("ch") == 1
    return spots.select("path", byte(F.when(grey, at).otherwise(at + 2)).alias("r"),
                        byte(F.when(grey, at).otherwise(at + 1)).alias("g"), byte(at).alias("b"))
