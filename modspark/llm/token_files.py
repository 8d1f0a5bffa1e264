"""Documents as files of token ids, in the order of their ids, and back.

Texts are range-partitioned by id, encoded where they then are, and written as segments of directly
addressable codes (``dac``): one binary image per row of a Parquet folder below the cluster's shared
folder. The number of ids before a partition is known once all are written: one number per
partition, the only thing that is gathered.
"""

from __future__ import annotations

import array
import functools
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from modspark.llm import dac
from modspark.llm.base import check_file, pieces, staged, width

#: Ids after which a segment is closed (with the document at hand).
SEGMENT = 1_000_000
#: Words whose ids a worker remembers in either of two generations, and the longest that is worth it.
REMEMBERED, LONGEST = 600_000, 48


class Encoder:
    """A byte-level BPE file of the tokenizers library, asked once per word.

    Byte-level BPE never merges over the place before a single space that precedes a visible
    letter, so a text's ids are those of its pieces cut there. Texts for which that isn't plain
    (special tokens, separators that the libraries class differently) are encoded whole.
    """

    #: A space that white space or the end follows, so that plain cutting at spaces won't do.
    UNEVEN = re.compile(r" (?=\s|$)")
    CUT = re.compile(r" (?=\S)")
    ODD = re.compile(r"[\x1c-\x1f\x85]")
    #: Letters are cut apart from the punctuation behind them.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(check_file(path))
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.tokenize = self.model.model.tokenize
        # Byte-level models spell a byte as itself if that is visible, else as the next letter from 256 on.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.spelling = {b: 256 + i for i, b in enumerate(hidden)}
        self.space = chr(self.spelling[32])
        self.known, self.ends = _Known(self), {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, word: str) -> bytes:
        """Ids of a space and ``word``, which is letters only: one piece, so the model's merges without its cutting."""
        spelled = self.space + word if word.isascii() else f" {word}".encode().decode("latin-1").translate(self.spelling)
        return array.array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _cut(self, text: str) -> list[str] | None:
        if self.ODD.search(text) or any(s in text for s in self.special):
            return None
        words = self.CUT.split(text) if self.UNEVEN.search(text) else text.split(" ")
        return words

    def ids(self, word: str) -> bytes:
        """Ids of ``word`` behind a space."""
        plain = self.PLAIN.fullmatch(word)
        if plain is None:
            return self._ask([f" {word}"])[0]
        letters, tail = plain.groups()
        if not tail:
            return self._piece(letters)
        if tail not in self.ends:
            if len(self.ends) > REMEMBERED:
                self.ends = {}
            self.ends[tail] = self._ask([tail])[0]
        return self.known[letters] + self.ends[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        self.known.renew()
        cut = [self._cut(t) for t in texts]
        heads = self._ask([w[0] if w else t for w, t in zip(cut, texts, strict=True)])
        of = self.known.__getitem__
        return [head + b"".join(map(of, words[1:])) if words else head for head, words in zip(heads, cut, strict=True)]


class _Known(dict):
    """Ids of words as they are met, in two generations; words that are too long are not kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.before = encoder, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.encoder.ids(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def renew(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def _writer(path: str, end: int):
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, model, tail = TaskContext.get().partitionId(), encoder(path), np.array([end], "<u4").tobytes()
        held: list[bytes] = []
        docs: list[int | None] = []
        size = before = 0

        def close() -> pa.RecordBatch:
            missing = np.array([d is None for d in docs])
            image = dac.segment(
                np.array([d or 0 for d in docs], np.int64), missing, np.array([len(h) // 4 for h in held]), np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before]), pa.array([size]), pa.array([image], pa.binary())], names=["part", "before", "tokens", "image"])

        for batch in pieces(batches, "text"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), model.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                held.append(ids + tail)
                docs.append(doc)
                size += len(ids) // 4 + 1
                if size >= SEGMENT:
                    yield close()
                    held, docs, before, size = [], [], before + size, 0
        if docs:
            yield close()

    return step


def write(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, before, tokens, image: the segments, written; part and before (ids before it in its
    part) give their order. Null ids come first, rows with one id in the order of their texts' hash."""
    parts = width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return staged(ranged.mapInArrow(_writer(tokenizer, end), "part int, before bigint, tokens bigint, image binary"), "token-files")


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, image in zip(batch.column("start").to_pylist(), batch.column("image"), strict=True):
            held = dac.Segment(image.as_py())
            ids = held.tokens()
            begins = np.concatenate([[0], held.ends[:-1]])
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, held.ends, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(held.doc_ids, pa.int64(), mask=held.missing), pa.array(begins + start), pa.array(held.ends - begins), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the images alone."""
    behind = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = (
        files.groupBy("part").agg(F.sum("tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("ahead")))
    # As many rows as the write had partitions, which bounds what is broadcast.
    return (
        files.join(F.broadcast(starts), "part").select((F.col("ahead") + F.col("before")).alias("start"), "image")
        .mapInArrow(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``read`` finds in what ``write`` wrote: one row per row of ``docs``.

    Null texts count as empty: they have the end id only. Texts of any length are encoded whole.
    No rows in, no rows out.
    """
    return read(write(docs, tokenizer, end, id_col, text_col))
