"""Passages that repeat across documents, by a sparse suffix array.

1. Of a document's suffixes (by word) only those at content-selected places are retained: the
   smallest hash of ``GRAM`` words in each run of ``SPAN`` places. Equal passages of ``words`` words
   retain the same place, at most ``SPAN - 1`` words behind their start, so ``words - SPAN + 1``
   words of the passage follow it.
2. The suffixes are sorted over the cluster by the hash of that many words, and neighbours are
   compared: places whose words follow in another document too are kept. A range sort by suffix
   and document splits even a suffix that a third of all documents have.
3. What is kept is extended left and right: every run of ``words`` words that holds a kept place is
   hashed and looked for in other documents, and runs found are joined to the longest passages.

Hashes have 64 bits; words are compared by hash only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.base import pieces, staged, width

#: Least words of a passage, words hashed to select a place, places of which one is retained.
WORDS, GRAM, SPAN = 50, 8, 26
BASE = 0x9E3779B97F4A7C15
#: Stands for a null id.
NO_ID = -(2**63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts as hashes, one text after the other, with hashes of runs of them."""

    def __init__(self, texts: list[bytes | None]):
        found = [(t or b"").split() for t in texts]
        self.counts = np.array([len(w) for w in found], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        digest = xxhash.xxh64_digest
        self.hashes = np.frombuffer(b"".join([digest(w) for words in found for w in words]), np.uint64)
        n = len(self.hashes)
        inverse = pow(BASE, -1, 2**64)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)
        self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * self.powers[:n], dtype=np.uint64)])

    def runs(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of ``length`` words from each place (of all texts' words)."""
        return _mixed((self.sums[at + length] - self.sums[at]) * self.inverses[at])

    def left(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Words from a place to the end of its text."""
        return self.starts[text] + self.counts[text] - at


def retained(w: Words, words: int, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the suffixes retained, of those followed by enough words."""
    n = len(w.hashes)
    if n < span + gram - 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    grams = w.runs(np.arange(n - gram + 1), gram)
    first = np.arange(len(grams) - span + 1)
    whole = text[first] == text[first + span + gram - 2]  # runs that lie in one text
    first = first[whole]
    view, best = sliding_window_view(grams, span), []
    for i in range(0, len(first), 1 << 16):
        part = first[i:i + (1 << 16)]
        best.append(part + view[part].argmin(axis=1))
    places = np.unique(np.concatenate(best)) if best else np.empty(0, np.int64)
    owner = text[places]
    enough = w.left(places, owner) >= words - span + 1
    return owner[enough], places[enough]


def _suffixes(words: int):
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            w = Words(batch.column("text").to_pylist())
            text, place = retained(w, words)
            doc = batch.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array(w.runs(place, words - SPAN + 1).view(np.int64)), pa.array(doc[text]), pa.array((place - w.starts[text]).astype(np.int32))],
                names=["suffix", "doc", "at"])

    return step


#: Kinds of rows that the comparison of neighbours hands on.
SHARED, UNSURE, EDGE = 0, 1, 2


def _rows(kind: int, rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), kind, np.int32)), *map(pa.array, rows)], names=["kind", "suffix", "doc", "at"])


class _Block:
    """Neighbours with one suffix, documents ascending. Rows wait only while all are of one document."""

    def __init__(self, suffix: int, low: int, edge: bool):
        self.suffix, self.low, self.high, self.edge, self.waiting = suffix, low, low, edge, []

    def feed(self, rows: tuple) -> Iterator[pa.RecordBatch]:
        self.high = rows[1][-1]
        self.waiting.append(rows)
        if self.high != self.low:
            yield from (_rows(SHARED, r) for r in self.waiting)
            self.waiting = []

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.edge:
            yield _rows(EDGE, (np.full(2, self.suffix), np.array([self.low, self.high]), np.zeros(2, np.int32)))
            yield from (_rows(UNSURE, r) for r in self.waiting)


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by suffix, document and place, those whose suffix two documents have. What a
    partition's first and last suffix lack here may be in the next partition: their rows are handed
    on as unsure, with the documents they were seen in as edges."""
    block = None
    for batch in batches:
        if not batch.num_rows:
            continue
        s, d, a = (batch.column(c).to_numpy() for c in ("suffix", "doc", "at"))
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        ends = np.append(starts[1:], len(s))
        if block is None or s[0] != block.suffix:
            if block:
                yield from block.close()
            block = _Block(s[0], d[0], edge=block is None)
        yield from block.feed((s[:ends[0]], d[:ends[0]], a[:ends[0]]))
        if len(starts) == 1:
            continue
        yield from block.close()
        whole = np.repeat((d[starts] != d[ends - 1])[1:-1], (ends - starts)[1:-1])
        inner = slice(ends[0], starts[-1])
        if whole.any():
            yield _rows(SHARED, (s[inner][whole], d[inner][whole], a[inner][whole]))
        tail = slice(starts[-1], len(s))
        block = _Block(s[-1], d[starts[-1]], edge=False)
        yield from block.feed((s[tail], d[tail], a[tail]))
    if block:
        block.edge = True
        yield from block.close()


def _extended(words: int):
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            w = Words(batch.column("text").to_pylist())
            kept, doc = batch.column("places"), batch.column("doc").to_numpy()
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(kept).to_numpy(zero_copy_only=False))
            place = kept.flatten().to_numpy().astype(np.int64)
            starts = (place[:, None] - np.arange(SPAN)[None, :]).reshape(-1)
            text = np.repeat(text, SPAN)
            fits = (starts >= 0) & (starts + words <= w.counts[text])
            # One number per text and place, so that each run is taken once.
            runs = np.unique(w.starts[text[fits]] + starts[fits])
            text = np.searchsorted(w.starts + w.counts, runs, side="right")
            hashes = w.runs(runs, words)
            order = np.lexsort((hashes, text))  # stable, so in a text's order of places
            again = np.zeros(len(runs), bool)
            again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(doc[text]), pa.array((runs - w.starts[text]).astype(np.int32)), pa.array(again)],
                names=["run", "doc", "at", "again"])

    return step


def _joined(words: int):
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("doc", "start_word", "end_word", "n_words", "later_words")}
            for doc, found in zip(batch.column("doc").to_pylist(), batch.column("found"), strict=True):
                at = found.values.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
                later = found.values.field("later").to_numpy(zero_copy_only=False)
                order = np.argsort(at, kind="stable")
                at, later = at[order], later[order]
                size = int(at[-1]) + words + 1
                covered = np.zeros(size, np.int64)
                np.add.at(covered, at[later], 1)
                np.add.at(covered, at[later] + words, -1)
                upto = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
                first = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + words]))
                last = np.append(first[1:], len(at)) - 1
                for a, b in zip(at[first].tolist(), (at[last] + words).tolist(), strict=True):
                    for k, v in zip(out, (doc, a, b, b - a, int(upto[b] - upto[a])), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return step


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, start_word, end_word, n_words, later_words: one row per longest stretch of a document
    in which every run of ``words`` words is in another document too; words start_word to end_word
    (not included), split at ASCII white space and compared as they are. ``later_words`` counts the
    words in runs whose first occurrence (smallest id, then its first place) is elsewhere: those that would go.

    Rows with one id are one document, and so are those with a null id; repeats inside a document
    don't count. Null, empty and short texts have no passages. Stretches that touch are one.
    """
    if words < SPAN + GRAM:
        raise ValueError(f"passages need {SPAN + GRAM} words or more")
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    suffixes = staged(rows.mapInArrow(_suffixes(words), "suffix bigint, doc bigint, at int"), "suffixes")
    order = ["suffix", "doc", "at"]
    compared = staged(
        suffixes.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order)
        .mapInArrow(_neighbours, "kind int, suffix bigint, doc bigint, at int"), "suffixes-compared")
    # At most four rows per partition of the sort.
    over = compared.filter(F.col("kind") == EDGE).groupBy("suffix").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low != high").select("suffix")
    kept = (
        compared.filter(F.col("kind") == SHARED).select("doc", "at")
        .unionByName(compared.filter(F.col("kind") == UNSURE).join(F.broadcast(over), "suffix").select("doc", "at")))
    # A document's places are bounded by its words.
    places = kept.groupBy("doc").agg(F.collect_list("at").alias("places"))
    runs = staged(rows.join(places, "doc").mapInArrow(_extended(words), "run bigint, doc bigint, at int, again boolean"), "suffixes-runs")
    shared = (
        runs.groupBy("run").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        .filter("low != high").select("run", "low"))
    found = runs.join(shared, "run").select("doc", F.struct("at", ((F.col("doc") != F.col("low")) | F.col("again")).alias("later")).alias("run"))
    out = found.groupBy("doc").agg(F.collect_list("run").alias("found")).mapInArrow(
        _joined(words), "doc bigint, start_word bigint, end_word bigint, n_words bigint, later_words bigint")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).cast(kind).alias("doc_id"), "start_word", "end_word", "n_words", "later_words")
