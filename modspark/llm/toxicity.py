"""Toxicity by weak supervision.

Voters say "toxic" of a text that has their word, word beginning or pattern; one says "clean" of a
text that no lexicon voter knows. Which words vote is learnt from a bounded sample of labelled rows
(``sample`` per label, in expectation). A generative label model then finds, by expectation
maximisation over the votes alone, how often each voter fires on either kind of text, and how
voters go together beyond that; voters that repeat each other count for less. A linear classifier
is trained on the label model's posteriors, and it scores every whole text.

Lexicon, rates and weights are all that leaves the executors, bounded by ``VOTERS``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm import near_dedup
from modspark.llm.base import pieces, remainder, staged

#: Labelled rows sampled per label (expected), and lexicon voters at most.
SAMPLE, VOTERS = 8_000, 240
#: Texts that are compared together when copies are looked for in the sample.
COPIES_TILE = 1024
#: Lengths of word beginnings that may vote.
BEGINNINGS = (4, 5, 6)
#: A term votes if so great a part of the labelled texts that have it are toxic, and if that is no chance: its G statistic
#: beats what the best of the terms in LEAST toxic texts would reach by chance, 2 ln(terms).
PURE, LEAST = 0.85, 3
#: Score from which a text is called toxic.
TOXIC = 0.3
#: Tokens whose terms a worker remembers.
REMEMBERED = 1_000_000

LETTERS = re.compile(r"[^\W\d_]+")
#: Patterns that vote, by token.
PATTERNS = {
    "shouting": re.compile(r"^\W*[A-Z]{4,}\W*$"),
    "exclaiming": re.compile(r"[!?]{2,}$"),
    "masked": re.compile(r"[a-z]\*+[a-z]|[a-z]+[@$][a-z]+", re.I),
    "stretched": re.compile(r"([a-z])\1{3,}", re.I),
}


def terms(token: str) -> list[str]:
    """What a token may be known by: its words, their beginnings and the patterns it shows."""
    out = [f"={name}" for name, pattern in PATTERNS.items() if pattern.search(token)]
    for word in LETTERS.findall(token.lower()):
        out.append(word)
        out.extend(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)
    return out


class Spotter:
    """Finds voters in texts; looks at each distinct token once while it remembers it."""

    def __init__(self, spots: dict[str, int]):
        self.spots, self.seen, self.hot = spots, set(), {}

    def find(self, text: str | None) -> set[int]:
        tokens = set((text or "").split())
        if len(self.seen) > REMEMBERED:
            self.seen = set()
        for token in tokens - self.seen:
            held = [self.spots[t] for t in terms(token) if t in self.spots]
            if held:
                self.hot[token] = held
        self.seen |= tokens
        if len(self.hot) > REMEMBERED:
            self.hot = {t: self.hot[t] for t in tokens & self.hot.keys()}
            self.seen = set(tokens)
        return {i for t in tokens & self.hot.keys() for i in self.hot[t]}


def label_model(fired: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 25, anchor: float = 0.5) -> np.ndarray:
    """Posterior of "toxic" per row of ``fired`` (rows, voters): a two-class model of the votes.

    Estimates each voter's rate of firing in either class, and the correlations of what is left;
    a voter's evidence is shared with the voters it goes together with. It starts from the rates
    by label, and ``anchor`` times those stay in every estimate, so that the classes keep their
    meaning; the rest of the evidence is the votes alone.
    """
    votes = fired.astype(np.float64)
    prior = float((weights * labels).sum() + 0.5) / float(weights.sum() + 1)
    p, share = labels.astype(np.float64), np.ones(votes.shape[1])
    for r in range(rounds):
        on, off = weights * (p + anchor * labels), weights * (1 - p + anchor * (1 - labels))
        a = (on @ votes + 0.1) / (on.sum() + 1)
        b = (off @ votes + 0.1) / (off.sum() + 1)
        if r % 5 == 0:  # correlations given the class
            left = (votes - p[:, None] * a - (1 - p)[:, None] * b) * np.sqrt(weights)[:, None]
            cov = left.T @ left
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            share = 1 / np.maximum(np.maximum(cov / scale[:, None] / scale[None, :], 0).sum(axis=0), 1)
        # A silent voter abstains. Voters that go together add little to the strongest of them, but take nothing from it.
        says = np.log(a / b)
        odds = np.log(prior / (1 - prior)) + votes @ (says * share) + (votes * np.maximum(says * (1 - share), 0)).max(axis=1)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def linear(x: np.ndarray, target: np.ndarray, weights: np.ndarray, penalty: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Weights, bias last, of a logistic regression on soft targets (Newton's method)."""
    x = np.concatenate([x.astype(np.float64), np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (p - target)) + ridge * w
        bend = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return w


@dataclass(frozen=True)
class Model:
    spots: dict[str, int]
    weights: np.ndarray  # one per voter, several-hits, bias
    lexicon: int


def features(found: list[set[int]], voters: int, lexicon: int) -> np.ndarray:
    """Voters, then the votes "three or more of the lexicon" and "none of it"."""
    out = np.zeros((len(found), voters + 2), bool)
    for i, held in enumerate(found):
        out[i, list(held)] = True
    hits = out[:, :lexicon].sum(axis=1)
    out[:, voters], out[:, voters + 1] = hits >= 3, hits == 0
    return out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold a term: one row per term and task."""
    counts, known = {0: Counter(), 1: Counter()}, {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            held = set()
            for token in set((text or "").split()):
                if token not in known:
                    known[token] = terms(token)
                held.update(known[token])
            counts[toxic].update(held)
    # Terms of clean texts only never vote.
    some = list(counts[1] | counts[0])
    yield pa.RecordBatch.from_arrays([
        pa.array(some, pa.string()), pa.array([counts[1][t] for t in some], pa.int64()), pa.array([counts[0][t] for t in some], pa.int64())],
        names=["term", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from texts (id, text) and labels (id, toxic). Labels that are neither 0 nor 1 are
    passed over, null texts count as empty.

    The sample is drawn from the labels, so that few rows, bounded by ``sample``, go to the texts.
    """
    known = labels.select("id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    one_sided = Model({}, np.array([0.0, 0.0, 30.0 if 1 in sizes and 0 not in sizes else -30.0]), 0)
    if len(sizes) < 2:
        return one_sided
    rate = {k: min(1.0, sample / n) for k, n in sizes.items()}
    lot = F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 11) * F.lit(2.0**-53)
    few = known.filter(lot < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    met = docs.join(F.broadcast(few), "id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    drawn = staged(met.withColumn("row", F.monotonically_increasing_id()), "toxic-drawn")

    # Copies tell of themselves, not of toxic words: of texts whose sets of words are alike, the least of each label counts.
    groups = near_dedup.near_dedup(drawn, "row", words=1, tile=COPIES_TILE).select(F.col("doc_id").alias("row"), "component_id")
    apart = staged(drawn.join(groups, "row").groupBy("component_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-sample")
    n = {0: 0.0, 1: 0.0} | {r.toxic: float(r.n) for r in apart.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows

    seen = staged(
        apart.mapInArrow(_counted, "term string, toxic bigint, clean bigint").groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-terms")
    part = n[1] / max(1.0, n[0] + n[1])
    both = F.col("toxic") + F.col("clean")
    less = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * p))).otherwise(0.0)
    pure = F.col("toxic") / rate[1] / (F.col("toxic") / rate[1] + F.col("clean") / rate[0])
    top = (
        seen.filter(~F.col("term").startswith("=") & (pure >= PURE) & (F.col("toxic") >= LEAST))
        .filter(2 * (less("toxic", part) + less("clean", 1 - part)) >= 2 * math.log(max(1, seen.filter(F.col("toxic") >= LEAST).count())))
        .orderBy(F.desc("toxic"), "term").limit(VOTERS).collect())
    spots = {r.term: i for i, r in enumerate(top)}
    lexicon = len(spots)
    for name in PATTERNS:
        spots[f"={name}"] = len(spots)

    def votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(spots)
        for batch in batches:
            found = [sorted(spotter.find(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    found = drawn.select("text", "toxic").mapInArrow(votes, "toxic int, found array<int>").collect()  # bounded by the sample
    found.sort(key=lambda r: (r.toxic, r.found))
    if (met := {r.toxic for r in found}) != {0, 1}:  # labels of one kind, or none, have a text
        return Model({}, np.array([0.0, 0.0, 30.0 if met == {1} else -30.0]), 0)
    fired = features([set(r.found) for r in found], len(spots), lexicon)
    weights = np.array([1 / rate[r.toxic] for r in found])
    posterior = label_model(fired, np.array([r.toxic for r in found]), weights / weights.mean())
    return Model(spots, linear(fired, posterior, weights / weights.mean()), lexicon)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2,
          sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Learns from labelled rows outside the held-out fold (crc32 of the id modulo ``folds`` is
    ``held``). Null and empty texts are scored like texts in which nobody finds anything. With one
    label only, or none, every text has the score of that label (0 for none). A label given twice
    counts twice. Equal texts get equal scores.
    """
    out = remainder(F.col(id_col), folds) == held
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).filter(~(remainder(F.col("id"), folds) == held))
    model = train(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known, sample)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(model.spots)
        for batch in pieces(batches, "text", rows=4096):
            x = features([spotter.find(t) for t in batch.column("text").to_pylist()], len(model.spots), model.lexicon)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= TOXIC).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        step, f"doc_id {kind}, held_out boolean, score double, predicted int")
