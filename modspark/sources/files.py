"""File sources (S3) and the archive reader (M5, M6, M8)."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = """path string, position int, entry_name string, inflated_size bigint, head binary, content binary,
    error string"""
TEXT_ENTRIES = (".txt", ".md", ".csv", ".json", ".xml")
#: Bytes of entry texts handed on together.
BATCH = 8_000_000


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """S3: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def heads(files: DataFrame, size: int = 64) -> DataFrame:
    return files.select("path", "length", F.substring("content", 1, size).alias("content"))


def _zip_rows(path: str, data: bytes, head: int) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for position, info in enumerate(archive.infolist()):
            start = body = None
            try:
                with archive.open(info) as entry:
                    start = entry.read(head)
                if info.filename.lower().endswith(TEXT_ENTRIES):
                    body = archive.read(info)
            except (RuntimeError, zipfile.BadZipFile, NotImplementedError, OSError):
                pass  # an unreadable entry is still listed
            yield path, position, info.filename, info.file_size, start, body, None


def _tar_rows(path: str, data: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
        for position, member in enumerate(archive):
            yield path, position, member.name, member.size, None, None, None


def list_entries(files: DataFrame, head: int = 32) -> DataFrame:
    """M5: one row per archive entry.  Only the listing needs Python; every check on the
    rows is relational.  A file that cannot be read yields one row with ``error``."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "position", "entry_name", "inflated_size", "head", "content", "error"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"position": "Int32", "inflated_size": "Int64"})

        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                try:
                    for row in _zip_rows(path, data, head) if data[:2] == b"PK" else _tar_rows(path, data):
                        rows.append(row)
                        held += len(row[5] or b"") + 200
                        if held > BATCH:
                            yield frame(rows)
                            rows, held = [], 0
                except Exception as e:  # fail closed: the reason becomes a finding
                    rows.append((path, None, None, None, None, None, f"archive cannot be read: {type(e).__name__}"))
                if rows:
                    yield frame(rows)

    return files.select("path", "content").mapInPandas(work, ENTRIES)


def entry_texts(entries: DataFrame) -> DataFrame:
    """M6: whole text of the text entries, bad bytes dropped."""
    readable = F.col("entry_name").rlike(r"(?i)\.(txt|md|csv|json)$") & F.col("content").isNotNull()
    return entries.where(readable).select(
        "path", "entry_name", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"))
