"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Documents are written once to the shared folder, bucketed by the part (scan partition) they
   came in, with a short fingerprint of the normalised text.
2. Each part sends its sorted distinct fingerprints, Golomb-coded, to the owners of the
   fingerprint ranges: some two to four bytes per document.
3. An owner decodes what all parts sent and answers each with a bitmap: which of its
   fingerprints another part has too.
4. A part takes those, and fingerprints it holds twice itself, as suspects. The buckets make the
   meeting of a part with its bitmaps free of any shuffle of texts.
5. Suspects only are shuffled with their texts, one row per part and text, and compared byte by
   byte. A text held by a third of all rows travels once per part.

Fingerprints are short (bits to tell the rows apart plus ``SPARE``): chance equals merely become
suspects, and the comparison of the texts decides.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.durable import run_dir
from modspark.llm import golomb
from modspark.llm.base import SPACE, staged, width

#: Fingerprint bits beyond those that number the rows: one text in 2**SPARE is a suspect by chance.
SPARE = 8
#: Fingerprints that one owner is meant to hold.
OWNED = 1_000_000

SENT = "owner int, part int, n int, shift int, unary binary, rest binary"
ANSWER = "part int, owner int, n int, bitmap binary"
SEEN = "part int, doc_ids array<bigint>, keep_id bigint, nulls bigint, n bigint, fp bigint, sha string, text string"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _owners(short: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """The owner of each fingerprint: equal ranges of the top 31 bits."""
    top = short >> np.uint64(bits - 31) if bits > 31 else short << np.uint64(31 - bits)
    return ((top * np.uint64(owners)) >> np.uint64(31)).astype(np.int64)


def _cuts(short: np.ndarray, bits: int, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners present, first, behind last) for ascending fingerprints."""
    own, first = np.unique(_owners(short, bits, owners), return_index=True)
    return own, first, np.append(first[1:], len(short))


def _sender(bits: int, owners: int):
    def send(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        values = np.unique(t["fp"].to_numpy().astype(np.uint64))
        rows = {k: [] for k in ("owner", "part", "n", "shift", "unary", "rest")}
        for owner, a, b in zip(*_cuts(values, bits, owners), strict=True):
            base = -(-(int(owner) << bits) // owners) if bits <= 31 else -(-(int(owner) << 31) // owners) << (bits - 31)
            own = values[a:b] - np.uint64(base)
            shift = golomb.best_shift(own)
            unary, rest = golomb.encode(own, shift)
            for k, v in zip(rows, (int(owner), part, len(own), shift, unary, rest), strict=True):
                rows[k].append(v)
        return pa.table(rows, schema=pa.schema([
            ("owner", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("shift", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())]))

    return send


def _answer(t: pa.Table) -> pa.Table:
    """What one owner tells each part about the fingerprints that the part sent it."""
    messages = t.to_pylist()
    sent = [golomb.decode(m["unary"], m["rest"], m["n"], m["shift"]) for m in messages]
    _, place, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    twice, at, out = count[place] > 1, 0, []
    for values in sent:
        out.append(np.packbits(twice[at:at + len(values)]).tobytes())
        at += len(values)
    return pa.table({
        "part": pa.array([m["part"] for m in messages], pa.int32()), "owner": pa.array([m["owner"] for m in messages], pa.int32()),
        "n": pa.array([m["n"] for m in messages], pa.int32()), "bitmap": pa.array(out, pa.binary())})


_SEEN = pa.schema([
    ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("keep_id", pa.int64()), ("nulls", pa.int64()), ("n", pa.int64()),
    ("fp", pa.int64()), ("sha", pa.string()), ("text", pa.string())])


def _receive(docs: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """A part's documents: one row per suspect text (with the text), one per other document."""
    if not docs.num_rows:
        return _SEEN.empty_table()
    values, place, count = np.unique(docs["fp"].to_numpy().astype(np.uint64), return_inverse=True, return_counts=True)
    order = np.argsort(bitmaps["owner"].to_numpy())
    answers = bitmaps.take(pa.array(order))
    bits = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for b, n in zip(answers["bitmap"], answers["n"], strict=True)]
    suspect = ((count > 1) | np.concatenate(bits).astype(bool))[place]
    alone = docs.filter(pa.array(~suspect))
    n = alone.num_rows
    ids = alone["doc_id"].combine_chunks()
    single = pa.table([
        alone["part"], pa.LargeListArray.from_arrays(np.arange(n + 1), ids).cast(pa.list_(pa.int64())), ids, ids.is_null().cast(pa.int64()),
        pa.array(np.ones(n, np.int64)), alone["fp"], alone["sha"], pa.nulls(n, pa.string())], schema=_SEEN)
    some = docs.filter(pa.array(suspect)).sort_by([("doc_id", "ascending")])
    if not some.num_rows:
        return single
    g = some.group_by(["fp", "text"], use_threads=False).aggregate([
        ("doc_id", "list"), ("doc_id", "min"), ("doc_id", "count"), ("sha", "min"), ("part", "min"), ("part", "count")])
    rows = g["part_count"]
    several = pa.table([
        g["part_min"], g["doc_id_list"].cast(pa.list_(pa.int64())), g["doc_id_min"], pc.subtract(rows, g["doc_id_count"]),
        rows, g["fp"], g["sha_min"], g["text"].cast(pa.string())], schema=_SEEN)
    return pa.concat_tables([single, several])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when identical after every run of ASCII white space became one space; null
    counts as empty. Of equal texts the row with the smallest id stays; a null id comes last. Of
    rows repeated whole, exactly one is kept. An empty table gives no rows; other columns are not
    looked at.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.spark_partition_id().alias("part"), text.alias("text"))
    home, name = run_dir(spark, "exact"), f"exact_{uuid.uuid4().hex}"
    (rows.select("doc_id", "part", "text", F.xxhash64("text").alias("hash"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
     .write.option("compression", "zstd").option("path", home).bucketBy(width(spark), "part").saveAsTable(name))
    placed = spark.table(name)
    count = placed.count()
    bits = min(63, max(1, count).bit_length() + SPARE)
    owners = max(width(spark), math.ceil(count / OWNED))
    placed = placed.withColumn("fp", F.shiftrightunsigned("hash", 64 - bits))

    sent = placed.select("part", "fp").groupBy("part").applyInArrow(_sender(bits, owners), SENT)
    answers = sent.groupBy("owner").applyInArrow(_answer, ANSWER)
    seen = staged(
        placed.select("part", "doc_id", "fp", "sha", "text").groupBy("part")
        .cogroup(answers.groupBy("part")).applyInArrow(_receive, SEEN), "exact-seen")

    spark.sql(f"drop table {name}")  # the name only: nothing below reads it, and its files stay in the shared folder

    alone = seen.filter(F.col("text").isNull()).select(
        F.col("keep_id").alias("doc_id"), "keep_id", F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    suspects = seen.filter(F.col("text").isNotNull())
    best = F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "part"))
    groups = suspects.groupBy("fp", "text").agg(best.alias("best"), F.sum("n").alias("group_size"))
    spread = (
        suspects.join(groups, ["fp", "text"])
        .select("part", "sha", "group_size", "best", F.posexplode("doc_ids").alias("pos", "doc_id")))
    # Ids ascend within a part, null last, so the row that stays comes first in its part.
    together = spread.select(
        "doc_id", F.col("best.keep_id").alias("keep_id"), "group_size",
        ((F.col("part") == F.col("best.part")) & (F.col("pos") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))
    out = alone.unionByName(together)
    return out.withColumns({"doc_id": F.col("doc_id").cast(kind), "keep_id": F.col("keep_id").cast(kind)})


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies are taken away by an anti join on id and digest. Rows repeated whole (same id and text) leave one.
    """
    verdict = exact_dedup(docs, id_col, text_col)
    pairs = verdict.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = staged(pairs.filter(~F.col("kept") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"), "exact-odd").withColumnRenamed("kept", "__kept")
    marked = docs.withColumn("__digest", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha"))
    # Sorted at every size: a side that is broadcast while small would make the plan change with the data.
    clear = marked.join(odd.hint("merge"), on, "left_anti").drop("__digest")
    twins = odd.filter("__kept")
    if twins.isEmpty():
        return clear
    return clear.unionByName(marked.join(twins, on, "left_semi").dropDuplicates([id_col, "__digest"]).drop("__digest"))
