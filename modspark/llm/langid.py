"""Language ID by nearest centroid: TF-IDF vectors of letter n-grams against several clustered
centroids per language, by cosine, with rejection by distance.

Document frequencies are counted over all rows that may be learnt from. Centroids come from a
bounded sample of them, ``sample`` different texts of a language in expectation, each language's
clustered in one task. The similarities below which texts are rejected come from all rows again: a low
quantile per language and length. Model and statistics are all that leaves the executors: a vector of
``DIMENSIONS`` numbers per centroid, whatever the size of the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modspark.llm.base import pieces, remainder

DIMENSIONS = 1 << 13
#: Centroids per language, rounds of clustering, and sampled texts per language (expected).
CLUSTERS, ROUNDS, SAMPLE = 4, 8, 800
#: Share of a language's sample that is set aside as freaks, and least share of a cluster.
FREAKS = 0.05
#: A text is rejected below SLACK times the similarity that all but a share STRAY of the rows learnt from
#: reach at its length (all of them where they are fewer than 1 / STRAY). So of these rows fewer than STRAY go.
STRAY, SLACK = 0.0005, 0.9
#: Steps in which similarities are counted.
STEPS = 400
#: Length classes, and texts from which the bound of a class stands on its own.
CLASSES, FEW = 32, 30
UNKNOWN = "und"
#: Bytes and rows that are made into vectors at once.
BYTES, ROWS = 500_000, 256


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _hash(parts: list[np.ndarray], salt: int) -> np.ndarray:
    out = np.full(len(parts[0]), salt, np.uint32)
    for p in parts:
        out = (out ^ p) * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return (out >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


def counts(texts: list[str | None]) -> np.ndarray:
    """(texts, DIMENSIONS) counts of hashed pairs and triples of letters; whatever is no letter
    is one space, and texts begin and end with one. All zero if there is no letter."""
    spelled = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in spelled])
    letter = _letters()[codes]
    keep = letter | np.concatenate([[True], letter[:-1] | (owner[1:] != owner[:-1])])
    codes, owner, letter = np.where(letter, codes, np.uint32(32))[keep], owner[keep], letter[keep]
    spots = []
    for n in (2, 3):
        if len(codes) < n:
            continue
        some = letter[:len(codes) - n + 1].copy()
        for i in range(1, n):
            some |= letter[i:len(codes) - n + 1 + i]
        some &= owner[:len(codes) - n + 1] == owner[n - 1:]
        spots.append((owner[:len(codes) - n + 1] * DIMENSIONS + _hash([codes[i:len(codes) - n + 1 + i] for i in range(n)], n))[some])
    flat = np.concatenate(spots) if spots else np.empty(0, np.int64)
    return np.bincount(flat, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)


def vectors(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, term frequencies under a square root."""
    out = np.sqrt(raw.astype(np.float32)) * idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def cluster(points: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from slabs along the widest direction; fewer centroids where points are fewer or alike.

    The share FREAKS of the points farthest from their mean is set aside first, and clusters of a
    smaller share go: a few texts of another language under a wrong label make no centroid.
    """
    order = np.argsort(points @ points.mean(axis=0), kind="stable")
    points = points[np.sort(order[int(FREAKS * len(points)):])]
    middle = points.mean(axis=0)
    way = points[0] - middle
    for _ in range(ROUNDS):  # the direction in which points differ most
        way = (points @ way - middle @ way) @ points
        way = way / (np.linalg.norm(way) or 1)
    slabs = np.array_split(np.argsort(points @ way, kind="stable"), min(k, len(points)))
    centres = np.stack([points[i].mean(axis=0) for i in slabs])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for _ in range(ROUNDS):
        near = np.argmax(points @ centres.T, axis=1)
        sums = np.stack([points[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    held = np.bincount(np.argmax(points @ centres.T, axis=1), minlength=len(centres))
    return centres[held >= max(1, FREAKS * len(points))]


def _length_class(raw: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(raw.sum(axis=1), 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    langs: tuple[str, ...]
    #: Rows of centroids, the language of each, and low quantile of similarity per language and length class.
    centroids: np.ndarray
    owners: np.ndarray
    least: np.ndarray

    def nearest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, similarity, length class, whether there is no letter) of each text."""
        raw = counts(texts)
        empty = raw.sum(axis=1) == 0
        like = vectors(raw, self.idf) @ self.centroids.T
        best = np.argmax(like, axis=1)
        score = np.clip(like[np.arange(len(texts)), best].astype(float), 0, 1)
        score[empty] = 0
        return self.owners[best], score, np.minimum(_length_class(raw), CLASSES - 1), empty

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, similarity, rejected) of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        lang, score, size, empty = self.nearest(texts)
        far = score < SLACK * self.least[lang, size]
        return [UNKNOWN if e else self.langs[i] for i, e in zip(lang, empty, strict=True)], score, far | empty


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each dimension occurs, and the number of texts; counted over all of them."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in pieces(batches, "text", BYTES, ROWS):
            total[:-1] += (counts(batch.column("text").to_pylist()) > 0).sum(axis=0)
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(total)], names=["spot", "n"])

    rows = train.select("text").mapInArrow(step, "spot bigint, n bigint").groupBy("spot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:  # one row per dimension
        out[r.spot] = r.n
    return out[:-1], int(out[-1])


def _centroids(idf: np.ndarray, clusters: int):
    def learn(group: pa.Table) -> pa.Table:
        texts = sorted(group["text"].to_pylist())
        raw = np.concatenate([counts(texts[i:i + ROWS]).astype(np.uint32) for i in range(0, len(texts), ROWS)])
        raw = raw[raw.sum(axis=1) > 0]
        found = vectors(raw, idf)
        centres = cluster(found, clusters) if len(found) else found
        lang = group["lang"][0].as_py()
        return pa.table({
            "lang": pa.array([lang] * len(centres), pa.string()),
            "centroid": pa.array([c.astype(np.float32) for c in centres], pa.list_(pa.float32()))})

    return learn


def bounds(least: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Bounds per language and length class from the low quantiles and the numbers of texts.

    A class of fewer than FEW texts takes the next shorter one's bound if that is lower or it has no
    text at all; the first such classes take the language's least. Below all texts none is rejected.
    """
    out = np.where(seen > 0, least, np.inf)
    lowest = out.min(axis=1, initial=np.inf)
    for i in range(out.shape[1]):
        before = out[:, i - 1] if i else np.zeros(len(out))
        begun = seen[:, :i].sum(axis=1) > 0
        out[:, i] = np.where(seen[:, i] >= FEW, out[:, i], np.where(begun, np.minimum(out[:, i], before), np.where(seen[:, i] > 0, lowest, 0.0)))
    return out


def _least(rows: DataFrame, model: Model) -> np.ndarray:
    """The model's bounds, from all rows: low quantile of the similarities of those nearest to a language, by length class."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    shape = (len(model.langs), CLASSES, STEPS)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shape, np.int64)
        for batch in pieces(batches, "text", BYTES, ROWS):
            lang, score, size, empty = held.value.nearest(batch.column("text").to_pylist())
            at = np.minimum((score * STEPS).astype(np.int64), STEPS - 1)
            np.add.at(seen, (lang[~empty], size[~empty], at[~empty]), 1)
        spots = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([*map(pa.array, spots), pa.array(seen[spots])], names=["lang", "size", "at", "n"])

    kind = W.partitionBy("lang", "size")  # STEPS rows at most
    found = (
        rows.select("text").mapInArrow(step, "lang bigint, size bigint, at bigint, n bigint").groupBy("lang", "size", "at").agg(F.sum("n").alias("n"))
        .select("lang", "size", "at", F.sum("n").over(kind.orderBy("at")).alias("upto"), F.sum("n").over(kind).alias("total"))
        .filter(F.col("upto") > F.floor(F.col("total") * STRAY))
        .groupBy("lang", "size").agg(F.min("at").alias("at"), F.first("total").alias("total")).collect())  # one row per language and class
    least, seen = np.ones(shape[:2]), np.zeros(shape[:2], np.int64)
    for r in found:
        least[r.lang, r["size"]], seen[r.lang, r["size"]] = r["at"] / STEPS, r.total
    return bounds(least, seen)


def train(labelled: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """A model from rows (text, lang). Null languages and texts are passed over."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    seen, n = _frequencies(rows)
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    # A seeded hash of the text decides; copies count once, however many there are.
    sign = F.xxhash64("text", F.lit("sample"))
    sizes = rows.select("lang", sign.alias("__sign")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    lot = F.shiftrightunsigned(sign, 11) * F.lit(2.0**-53)
    # One row per language, as the model has: the texts need no shuffle to meet their count.
    drawn = rows.join(F.broadcast(sizes), "lang").filter(lot * F.col("__n") < sample).select("text", "lang").distinct()
    learnt = drawn.groupBy("lang").applyInArrow(_centroids(idf, clusters), "lang string, centroid array<float>").collect()
    learnt.sort(key=lambda r: (r.lang, r.centroid))
    langs = tuple(sorted({r.lang for r in learnt}))
    model = Model(
        idf, langs, np.array([r.centroid for r in learnt], np.float32).reshape(-1, DIMENSIONS), np.array([langs.index(r.lang) for r in learnt], np.int64),
        np.zeros((len(langs), CLASSES)))
    return replace(model, least=_least(rows, model)) if langs else model


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, lang_pred, score and rejected for each row."""
    rows = docs.select(*[c.alias(name) for name, c in keep.items()], F.col(text_col).alias("__text"))
    held, names = docs.sparkSession.sparkContext.broadcast(model), [*keep, "lang_pred", "score", "rejected"]

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", BYTES, ROWS):
            lang, score, rejected = held.value.predict(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang), pa.array(score), pa.array(rejected)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(step, f"{schema}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per row of ``docs``.

    Learns from rows outside the held-out fold (crc32 of the id modulo ``folds`` is ``held``; a null
    id counts as empty text) whose language is known. Texts that are null or have no letter are
    ``und`` with score 0 and rejected; so is every text if there is nothing to learn from. The score
    is the cosine with the nearest centroid; ``rejected`` marks texts far from all of them (STRAY,
    SLACK). Equal texts get equal answers.
    """
    out = remainder(F.col(id_col), folds) == held
    model = train(docs.filter(~out).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    return predict(docs, model, {"doc_id": F.col(id_col), "held_out": out}, text_col)


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all their columns kept."""
    model = train(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    spare = {f"column_{i}": name for i, name in enumerate(docs.columns)}  # no column of the table can clash with these
    marked = predict(docs, model, {new: F.col(f"`{old}`") for new, old in spare.items()}, text_col)
    return marked.filter(~F.col("rejected")).select(*[F.col(new).alias(old) for new, old in spare.items()])
