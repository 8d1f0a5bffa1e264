"""Texts as codes: blocks of texts with the list of their different words.

A block's words meet counts over the whole corpus once each, not once per occurrence, and what is
known of them is handed back to the block as arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a block is meant to hold (a longer text is a block of its own), and bytes split at once.
BLOCK, SLICE = 8_000_000, 1_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slices(text: bytes, limit: int = SLICE) -> Iterator[bytes]:
    """``text`` in parts of about ``limit`` bytes, cut behind a space so that no word is cut."""
    start = 0
    while len(text) - start > limit:
        end = text.find(b" ", start + limit)
        if end < 0:
            break
        yield text[start:end + 1]
        start = end + 1
    yield text[start:] if start else text


def coded(words: Iterable[bytes], codes: Codes, count: int) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, words), np.uint32, count)


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK) -> Iterator[list[tuple]]:
    """Rows (text last) in lists of about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held.append(row)
            size += len(row[-1] or b"")
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def word_rows(staged_blocks: DataFrame, *columns: str) -> DataFrame:
    """block, place and the list ``columns`` of a block, a row per word."""
    return staged_blocks.select("block", F.posexplode(F.arrays_zip(*columns)).alias("place", "w")).select(
        "block", "place", *[F.col(f"w.{c}").alias(c) for c in columns])


def known_by_block(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per block with the lists place and ``columns`` (without nulls), in the same order; no longer than the block's different words."""
    return rows.groupBy("block").agg(*[F.collect_list(c).alias(c) for c in ("place", *columns)])


def flat(row: pa.Scalar) -> np.ndarray:
    """The numbers of a list cell."""
    return row.values.to_numpy(zero_copy_only=False) if row.values is not None else np.empty(0, np.int64)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed: sorted numbers share their high bytes."""
    x = np.ascontiguousarray(x)
    flipped = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return pa.compress(flipped.tobytes(), codec="zstd", asbytes=True)


def unplaned(data: bytes, count: int, dtype: np.dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flipped = np.frombuffer(pa.decompress(data, count * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flipped.reshape(size, count).T).reshape(-1).view(dtype)
