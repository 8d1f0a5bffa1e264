"""Phrases that occur together more often than their parts, by vertical partitioning of suffixes.

1. Words are counted per language; those under ``least`` occurrences end a suffix (no phrase that
   holds one can be a candidate). The others are numbered in order.
2. Prefixes of one word are put into groups by their counts, one after the other, so that a group's
   suffixes fit a memory budget. A prefix beyond the budget is extended by its next word, and
   where that is not enough by the one after it: its subtree is split over several groups.
3. Every task sends its suffixes, cut at ``longest`` words and added up, to their groups. A group
   sorts them and builds its subtree on its own: equal suffixes are leaves, and a node of two words
   counts what its leaves total (over all its groups, if it is split).
4. Candidates, their cuts and what longer phrases hold are joins of nodes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modspark.llm.base import staged, width
from modspark.llm.ordered import ordered, running
from modspark.llm.word_blocks import LOWER, Codes, blocks, coded, flat, known_by_block, planes, slices, unplaned, word_rows

#: Suffixes that a group is meant to hold, and groups' worth that one pair of words may fill before it is split.
BUDGET, PAIR = 1_000_000, 8
#: Parts in which a language's phrases are ranked before the last ranking.
PARTS = 64
#: Ends of pieces and white space, told apart after this.
_TABLE = bytearray(LOWER)
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0x0A
_TABLE[0x09] = 0x20
_TABLE = bytes(_TABLE)
#: Codes of the empty word (between spaces) and of a piece's end.
GAP, END = 0, 1


def piece_codes(text: bytes, codes: Codes) -> Iterator[np.ndarray]:
    """Codes of a text's words, with END between pieces and behind the last."""
    for part in slices(text.translate(_TABLE)):
        words = part.replace(b"\n", b" \n ").split(b" ")
        made = coded(words, codes, len(words))
        yield made[made != GAP]
    yield np.array([END], np.uint32)


def _code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for i, rows in enumerate(blocks(batches)):
        langs, made, table = Codes(), [], {}
        for lang, text in rows:
            codes = table.get(lang)
            if codes is None:
                codes = table[lang] = Codes({b"": GAP, b"\n": END})
            made.append((lang, list(piece_codes(text or b"", codes))))
        # The words of one language after those of the other.
        base, at, words, names = {}, 2, [], []
        for lang, codes in table.items():
            base[lang] = at - 2
            found = list(codes)[2:]
            words += found
            names += [lang] * len(found)
            at += len(found)
        flat_codes = [np.where(c > END, c + base[lang], c).astype(np.uint32) for lang, parts in made for c in parts]
        all_codes = np.concatenate(flat_codes) if flat_codes else np.empty(0, np.uint32)
        counts = np.bincount(all_codes, minlength=at)[2:]
        yield pa.RecordBatch.from_arrays([
            pa.array([(part << 32) + i]), pa.array([planes(all_codes)], pa.binary()), pa.array([len(all_codes)]), pa.array([names], pa.list_(pa.string())),
            pa.array([[w.decode(errors="replace") for w in words]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
            names=["block", "codes", "size", "lang", "word", "n"])


def leaves(w: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different suffixes (sorted) and how often each occurs; a suffix is a row of the columns ``w`` of ``bits`` bits."""
    if not len(w[0]):
        return w, np.empty(0, np.int64)
    if bits * len(w) <= 64:
        key = w[0].astype(np.uint64)
        for x in w[1:]:
            key = (key << np.uint64(bits)) | x.astype(np.uint64)
        key, counts = np.unique(key, return_counts=True)
        mask = np.uint64((1 << bits) - 1)
        return [((key >> np.uint64(bits * (len(w) - 1 - i))) & mask).astype(w[0].dtype) for i in range(len(w))], counts
    order = np.lexsort(w[::-1])
    return summed([x[order] for x in w], np.ones(len(order), np.int64))


def summed(w: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted rows that are equal become one, with their counts' total."""
    if not len(counts):
        return w, counts
    starts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in w], axis=0)])
    return [x[starts] for x in w], np.add.reduceat(counts, starts)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def group_of(w: list[np.ndarray], low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The group of each suffix: that of its first word, or of the words behind it where that has several."""
    share = -(-span // PAIR)
    far = (_spread(w[1]) >> np.uint64(1)).astype(np.int64)
    further = (_spread(w[2] + _spread(w[1])) >> np.uint64(1)).astype(np.int64)
    return low + (far + further % share) % span


def _send(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    dtype = np.uint32 if bits <= 32 else np.uint64
    for batch in batches:
        for k in range(batch.num_rows):
            codes = unplaned(batch.column("codes")[k].as_py(), batch.column("size")[k].as_py(), np.uint32)
            place, ids = flat(batch.column("place")[k]), flat(batch.column("id")[k])
            size = max(int(codes.max(initial=0)), int(place.max(initial=0)) + 2) + 1
            table = np.zeros(size, dtype)
            table[place + 2] = ids
            met = np.concatenate([table[codes], np.zeros(2, dtype)])
            w = [met[:-2], met[1:-1], met[2:]]
            some = (w[0] > 0) & (w[1] > 0)
            (a, b, c), counts = leaves([x[some] for x in w], bits)
            if not len(counts):
                continue
            back = np.argsort(ids)
            at = back[np.searchsorted(ids, a, sorter=back)]
            span = flat(batch.column("span")[k])[at]
            group = 2 * group_of([a, b, c], flat(batch.column("low")[k])[at], span) + (span > PAIR)
            order = np.argsort(group, kind="stable")
            group = group[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            cols = [x[order] for x in (a, b, c)]
            counts = counts[order].astype(np.uint32)
            for s, e in zip(starts, np.r_[starts[1:], len(group)], strict=True):
                yield pa.RecordBatch.from_arrays([
                    pa.array([group[s]], pa.int64()), pa.array([e - s], pa.int64()),
                    *[pa.array([planes(x[s:e])], pa.binary()) for x in (*cols, counts)]], names=["group", "rows", "a", "b", "c", "n"])


def subtree(group: pa.Table, bits: int, least: int) -> pa.Table:
    """Nodes of two and three words of a group's subtree, read off its leaves, with ``least`` occurrences or more.

    In odd groups are the words whose pairs are split over groups: there all pairs are handed on, to be added up.
    """
    dtype = np.uint32 if bits <= 32 else np.uint64
    sizes = group.column("rows").to_pylist()
    read = lambda name, kind: np.concatenate([unplaned(x, n, kind) for x, n in zip(group.column(name).to_pylist(), sizes, strict=True)])
    w, counts = [read(c, dtype) for c in "abc"], read("n", np.uint32).astype(np.int64)
    order = np.lexsort(w[::-1])
    w, counts = summed([x[order] for x in w], counts[order])
    pairs, totals = summed(w[:2], counts)
    if group.column("group")[0].as_py() % 2 == 0:
        pairs, totals = [x[totals >= least] for x in pairs], totals[totals >= least]
    often = (counts >= least) & (w[2] > 0)
    columns = [np.concatenate([p, x[often]]).astype(np.int64) for p, x in zip([*pairs, np.zeros(len(totals), dtype)], w, strict=True)]
    return pa.table({"a": columns[0], "b": columns[1], "c": columns[2], "n": np.concatenate([totals, counts[often]])})


def words_of(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Blocks of coded texts (block, codes, size, lang, word, n), written once."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return staged(rows.mapInArrow(_code, "block bigint, codes binary, size bigint, lang array<string>, word array<string>, n array<bigint>"), "phrase-blocks")


def nodes_of(coded_blocks: DataFrame, often: DataFrame, bits: int, least: int, budget: int) -> DataFrame:
    """a, b, c, n: phrases of two (c is 0) and three frequent words by their numbers, with counts of ``least`` or more."""
    groups = often.select("lang", "word", "id", F.floor(F.col("start") / budget).alias("low"), F.ceil(F.col("f") / budget).alias("span"))
    met = word_rows(coded_blocks, "lang", "word").join(groups, ["lang", "word"])
    known = known_by_block(met, "id", "low", "span")
    sent = coded_blocks.select("block", "codes", "size").join(known, "block").mapInArrow(
        lambda batches: _send(batches, bits), "group bigint, rows bigint, a binary, b binary, c binary, n binary")
    made = sent.groupBy("group").applyInArrow(lambda t: subtree(t, bits, least), "a bigint, b bigint, c bigint, n bigint")
    # Only pairs of words whose subtree was split come more than once.
    return staged(made.groupBy("a", "b", "c").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrase-nodes")


def _score(a: str, left: str, right: str) -> Column:
    big = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(1000000 * {big(a)} * {big(a)}) div ({big(left)} * {big(right)})")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, top: int = 2000, held: int = 50, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two or three words of each language.

    Texts in A-Z lower-cased are split at ``.,;:!?`` and line ends, then at spaces and tabs; null
    texts count as empty, a null language as ``und``. Phrases with ``least`` occurrences (a) are
    scored by 1,000,000 * a^2 / (l * r), rounded down, at the cut that scores lowest (the first
    such cut); those within a longer candidate that has at least ``held`` percent of their
    occurrences are left out. n counts the language's words. Equal scores go by a, then by the
    phrase's bytes. Repeated rows count each time; no rows give none. Other columns are not read.
    """
    coded_blocks = words_of(docs, lang_col, text_col)
    words = staged(word_rows(coded_blocks, "lang", "word", "n").groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("size"))
    often = words.filter(F.col("f") >= least).withColumn("one", F.lit(1).cast("bigint"))
    often = staged(running(ordered(often, "lang", "word"), {"id": "one", "end": "f"}).select("lang", "word", "f", "id", (F.col("end") - F.col("f")).alias("start")), "phrase-often")
    bits = max(1, often.count().bit_length())
    nodes = nodes_of(coded_blocks, often, bits, least, budget)
    of = lambda c, *more: often.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"), F.col("f").alias(f"f_{c}"), *more)
    pairs = nodes.filter("c = 0").drop("c")
    threes = nodes.filter("c > 0")
    threes = staged(
        threes.join(pairs.select("a", "b", F.col("n").alias("f_ab")), ["a", "b"])
        .join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("f_bc")), ["b", "c"]), "phrase-threes")
    holds = (
        threes.select("a", "b", "n").unionByName(threes.select(F.col("b").alias("a"), F.col("c").alias("b"), "n"))
        .groupBy("a", "b").agg(F.max("n").alias("longer")))
    kept = pairs.join(holds, ["a", "b"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * held))
    none = F.lit(None).cast("bigint")
    both = kept.select("a", "b", none.alias("c"), "n", none.alias("f_ab"), none.alias("f_bc")).unionByName(threes.select("a", "b", "c", "n", "f_ab", "f_bc"))
    named = both.join(of("a", "lang"), "a").join(of("b"), "b").join(of("c"), "c", "left")
    first = F.struct(_score("n", "f_a", "coalesce(f_bc, f_b)").alias("score"), F.lit(1).alias("k"), F.col("f_a").alias("l"), F.coalesce("f_bc", "f_b").alias("r"))
    second = F.when(F.col("c").isNotNull(), F.struct(_score("n", "f_ab", "f_c").alias("score"), F.lit(2).alias("k"), F.col("f_ab").alias("l"), F.col("f_c").alias("r")))
    scored = named.select(
        "lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), F.least(first, second).alias("best"))
    best = (F.desc("best.score"), F.desc("a"), "phrase")
    first_of = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best)).cast("bigint")
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = part.withColumn("rank", first_of("lang", "part")).filter(F.col("rank") <= top)
    return (
        few.withColumn("rank", first_of("lang")).filter(F.col("rank") <= top).join(sizes, "lang")
        .select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("size").alias("n"), F.col("best.score").alias("score")))
