"""Texts scored by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Outputs are the end of a text, the ``FREQUENT`` most frequent words and ``ENDINGS`` classes that take
in all other words by their last letters. The two tokens before give a predicted vector (each
vector times its place's matrix, added up); an output's score is that vector's product with the
output's own, plus a bias. Training tells true outputs from noise drawn by their frequency, so
no sum over outputs is needed; scoring normalises over all outputs by matrix products over the
different contexts of a block. A word within a class has its share of the class's training tokens,
one occurrence added for each word and for the unknown, so that all known words and the
unknown of each class add up to one.

Every training text takes part: words are counted over all, and each task trains on the different
(context, output) examples of its blocks, weighted by how often they occur. Each round trains
on its own share of the examples from the mean of the tasks' models so far. Only the model, of a
size that these parameters fix, visits the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.base import remainder, staged, width
from modspark.llm.word_blocks import LOWER, Codes, blocks, coded, flat, known_by_block, planes, slices, unplaned, word_rows

#: Outputs besides the end, numbers a vector, rounds, noise words and examples a step, and the step's size.
FREQUENT, ENDINGS, DIM, ROUNDS, NOISE, STEP, RATE = 383, 128, 24, 4, 64, 1024, 0.1
#: Number of outputs; one more symbol stands before a text.
OUTPUTS = 1 + FREQUENT + ENDINGS
START = OUTPUTS
#: Contexts or tokens worked on at once.
AT_ONCE = 4096
END = 0


def ending(word: bytes) -> int:
    """The class of a word that is not among the frequent ones."""
    return 1 + FREQUENT + zlib.crc32(word[-2:]) % ENDINGS


def _code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for i, rows in enumerate(blocks(batches)):
        codes, made, lengths = Codes({b"": END}), [], []
        train = np.array([t for _, t, _ in rows], bool)
        for _, _, text in rows:
            parts = [coded(w, codes, len(w)) for w in (s.split() for s in slices((text or b"").translate(LOWER)))]
            parts.append(np.array([END], np.uint32))
            made += parts
            lengths.append(sum(map(len, parts)))
        stream = np.concatenate(made)
        seen = np.bincount(stream[np.repeat(train, lengths)], minlength=len(codes))
        yield pa.RecordBatch.from_arrays([
            pa.array([(part << 32) + i]), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([train.tolist()], pa.list_(pa.bool_())),
            pa.array([lengths], pa.list_(pa.int64())), pa.array([planes(stream)], pa.binary()),
            pa.array([list(codes)], pa.list_(pa.binary())), pa.array([seen], pa.list_(pa.int64()))],
            names=["block", "doc_id", "train", "lengths", "codes", "word", "n"])


def contexts(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs one and two places before each token, START before a text's first."""
    first = np.cumsum(lengths) - lengths
    one = np.r_[START, classes[:-1]]
    one[first] = START
    two = np.r_[START, one[:-1]]
    two[first] = START
    return one, two


class Model:
    """Vectors of symbols and outputs, a matrix for each place of the context, biases."""

    def __init__(self, arrays: list[np.ndarray]):
        self.symbols, self.places, self.outputs, self.bias = arrays

    @classmethod
    def fresh(cls, frequency: np.ndarray) -> Model:
        rng = np.random.default_rng(13)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return cls([small(OUTPUTS + 1, DIM), np.stack([np.eye(DIM, dtype=np.float32)] * 2), small(OUTPUTS, DIM), np.log(frequency).astype(np.float32)])

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.symbols, self.places, self.outputs, self.bias]

    @classmethod
    def read(cls, data: bytes, dtype: type = np.float32) -> Model:
        shapes, numbers, out, at = [(OUTPUTS + 1, DIM), (2, DIM, DIM), (OUTPUTS, DIM), (OUTPUTS,)], np.frombuffer(data, dtype), [], 0
        for shape in shapes:
            size = math.prod(shape)
            out.append(numbers[at:at + size].reshape(shape).astype(np.float32))
            at += size
        return cls(out)

    def written(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays]).astype(np.float64).tobytes()

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.symbols[one] @ self.places[0] + self.symbols[two] @ self.places[1]

    def log_sums(self, predicted: np.ndarray) -> np.ndarray:
        """Natural logarithms of the sums over all outputs."""
        out = np.empty(len(predicted))
        for i in range(0, len(predicted), AT_ONCE):
            scores = predicted[i:i + AT_ONCE] @ self.outputs.T + self.bias
            top = scores.max(axis=1, keepdims=True)
            out[i:i + AT_ONCE] = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1, dtype=np.float64))
        return out

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's output, normalised."""
        key, back = np.unique(one.astype(np.int64) * (OUTPUTS + 1) + two, return_inverse=True)
        predicted = self.predicted(key // (OUTPUTS + 1), key % (OUTPUTS + 1))
        sums, out = self.log_sums(predicted), np.empty(len(target))
        for i in range(0, len(target), 16 * AT_ONCE):
            c, t = back[i:i + 16 * AT_ONCE], target[i:i + 16 * AT_ONCE]
            out[i:i + 16 * AT_ONCE] = np.einsum("ij,ij->i", predicted[c], self.outputs[t]) + self.bias[t] - sums[c]
        return out


def _gathered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that share a place."""
    out = np.zeros((size, *rows.shape[1:]), np.float32)
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
    out[at[order][starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Trainer:
    """Steps by noise-contrastive estimation, each number's step scaled by its gradients so far."""

    def __init__(self, model: Model, frequency: np.ndarray, seed: int):
        self.model, self.frequency, self.rng = model, frequency, np.random.default_rng(seed)
        self.squares = [np.full(a.shape, 1e-6, np.float32) for a in model.arrays]
        self.log_noise = np.log(NOISE * frequency).astype(np.float32)
        self.seen = 0.0

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        m, share = self.model, (weight / weight.sum()).astype(np.float32)
        noise, times = np.unique(self.rng.choice(OUTPUTS, NOISE, p=self.frequency), return_counts=True)
        x, y = m.symbols[one], m.symbols[two]
        r = x @ m.places[0] + y @ m.places[1]
        true = np.einsum("ij,ij->i", r, m.outputs[target]) + m.bias[target] - self.log_noise[target]
        false = r @ m.outputs[noise].T + (m.bias - self.log_noise)[noise]
        g_true = share / (1 + np.exp(np.clip(true, -30, 30)))
        g_false = -share[:, None] * times / (1 + np.exp(np.clip(-false, -30, 30)))
        g_r = g_true[:, None] * m.outputs[target] + g_false @ m.outputs[noise]
        g_outputs = _gathered(target, g_true[:, None] * r, OUTPUTS)
        g_outputs[noise] += g_false.T @ r
        g_bias = _gathered(target, g_true, OUTPUTS)
        g_bias[noise] += g_false.sum(axis=0)
        g_symbols = _gathered(np.r_[one, two], np.concatenate([g_r @ m.places[0].T, g_r @ m.places[1].T]), OUTPUTS + 1)
        g_places = np.stack([x.T @ g_r, y.T @ g_r])
        for value, square, g in zip(m.arrays, self.squares, (g_symbols, g_places, g_outputs, g_bias), strict=True):
            square += g * g
            value += RATE * g / np.sqrt(square)
        self.seen += float(weight.sum())


def examples_of(classes: np.ndarray, lengths: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (one, two, output) of training texts as single numbers, in order, and how often each occurs."""
    one, two = contexts(classes, lengths)
    key = (one.astype(np.int64) * (OUTPUTS + 1) + two) * OUTPUTS + classes
    return np.unique(key[np.repeat(train, lengths)], return_counts=True)


def _trained(batches: Iterable[pa.RecordBatch], start: bytes, frequency: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
    """The model after this task's examples of a round, times the tokens they stand for."""
    trainer = Trainer(Model.read(start, np.float64), frequency, 1000 * turn + TaskContext.get().partitionId())
    for batch in batches:
        for k in range(batch.num_rows):
            n = batch.column("rows")[k].as_py()
            key, count = unplaned(batch.column("key")[k].as_py(), n, np.int64), unplaned(batch.column("count")[k].as_py(), n, np.int64)
            at = np.random.default_rng(17 + n).permutation(n)[turn::ROUNDS]
            for i in range(0, len(at), STEP):
                part = at[i:i + STEP]
                context, target = np.divmod(key[part], OUTPUTS)
                trainer.step(context // (OUTPUTS + 1), context % (OUTPUTS + 1), target, count[part].astype(np.float64))
    if trainer.seen:
        yield _weighed(trainer.seen, np.frombuffer(trainer.model.written()) * trainer.seen)


def _weighed(weight: float, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([numbers.tobytes()], pa.binary())], names=["weight", "model"])


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, total = 0.0, None
    for batch in batches:
        for w, m in zip(batch.column("weight").to_pylist(), batch.column("model").to_pylist(), strict=True):
            weight, total = weight + w, np.frombuffer(m) + (0 if total is None else total)
    if total is not None:
        yield _weighed(weight, total)


class Vocabulary:
    """What scoring needs of the training texts besides each word's count: the frequent words, their and the classes' totals."""

    def __init__(self, frequent: list[tuple[bytes, int]], totals: dict[int, int], ends: int, tokens: int, types: int):
        self.at = {w: i + 1 for i, (w, _) in enumerate(frequent)}
        self.ends, self.tokens, self.types = ends, tokens, types
        #: Per output, what its words' counts with one added come to, the unknown included.
        self.totals = np.ones(OUTPUTS)
        for k, n in totals.items():
            self.totals[k] = n + 1
        seen = self.totals.copy()
        seen[END] = ends + 1
        for i, (_, n) in enumerate(frequent):
            seen[i + 1] = n + 1
        self.frequency = seen / seen.sum()

    def classes(self, words: list[bytes]) -> np.ndarray:
        """Outputs of a block's words, the end first."""
        return np.array([END, *[self.at.get(w) or ending(w) for w in words[1:]]], np.int64)


def vocabulary(coded_blocks: DataFrame, counts: DataFrame) -> Vocabulary:
    ends = coded_blocks.agg(F.sum(F.size(F.filter("train", lambda x: x))).alias("n")).first()[0] or 0
    size = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    frequent = [(bytes(r.word), r.c) for r in counts.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
    last = F.expr("substring(word, -2)")
    rare = counts.filter(~F.col("word").isin([bytearray(w) for w, _ in frequent])) if frequent else counts
    totals = {1 + FREQUENT + r.k: r.n for r in rare.groupBy((F.crc32(last) % ENDINGS).alias("k")).agg(F.sum(F.col("c") + 1).alias("n")).collect()}
    return Vocabulary(frequent, totals, ends, (size[0] or 0) + ends, size[1] + (ends > 0))


def fitted(coded_blocks: DataFrame, known: Vocabulary) -> bytes:
    """The model's numbers after ROUNDS rounds over the training texts."""

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = flat(batch.column("lengths")[k])
                codes = unplaned(batch.column("codes")[k].as_py(), int(lengths.sum()), np.uint32)
                classes = known.classes(batch.column("word")[k].as_py())[codes]
                key, count = examples_of(classes, lengths, flat(batch.column("train")[k]).astype(bool))
                if len(key):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([len(key)]), pa.array([planes(key)], pa.binary()), pa.array([planes(count.astype(np.int64))], pa.binary())], names=["rows", "key", "count"])

    examples = staged(
        coded_blocks.select("train", "lengths", "codes", "word").mapInArrow(prepare, "rows bigint, key binary, count binary"), "model-examples")
    model = Model.fresh(known.frequency).written()
    few = max(1, math.isqrt(width(coded_blocks.sparkSession)))
    kind = "weight double, model binary"
    for turn in range(ROUNDS):
        own = examples.mapInArrow(lambda batches, start=model, turn=turn: _trained(batches, start, known.frequency, turn), kind)
        mean = own.repartition(few).mapInArrow(_added, kind).repartition(1).mapInArrow(_added, kind).collect()
        if not mean:
            break
        model = (np.frombuffer(mean[0].model) / mean[0].weight).tobytes()
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Texts whose id's crc32 modulo ``parts`` is ``held`` are held out from training (a null id counts
    as the empty text). Words are runs of other than ASCII white space, A-Z in lower case; an end follows
    each text, so that null, empty and blank texts have one token. Scores are base-10 logarithms of the
    text's probability. Repeated rows train and are scored each on their own; without training
    texts all words are unknown. No rows in, none out. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    out_of = remainder(F.col(id_col), parts) == held
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (~out_of).alias("train"), F.col(text_col).cast("binary").alias("text"))
    coded_blocks = staged(
        rows.mapInArrow(_code, "block bigint, doc_id array<bigint>, train array<boolean>, lengths array<bigint>, codes binary, word array<binary>, n array<bigint>"), "model-blocks")
    words = word_rows(coded_blocks, "word", "n").filter("place > 0")
    counts = staged(words.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "model-words")
    known = vocabulary(coded_blocks, counts)
    model = fitted(coded_blocks, known)
    found = known_by_block(words.select("block", "place", "word").join(counts, "word"), "c")

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, base_total = Model.read(model, np.float64), known.tokens + known.types + 1
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                classes, lengths = known.classes(row["word"].as_py()), flat(row["lengths"])
                c = np.zeros(len(classes), np.int64)
                c[flat(row["place"]).astype(np.int64)] = flat(row["c"])
                c[END] = known.ends
                base = np.log10((c + 1) / base_total)
                share = np.where(classes > FREQUENT, np.log10((c + 1) / known.totals[classes]), 0.0)
                codes = unplaned(row["codes"].as_py(), int(lengths.sum()), np.uint32)
                tokens = classes[codes]
                made = net.log_probabilities(*contexts(tokens, lengths), tokens) / math.log(10) + share[codes]
                first = np.cumsum(lengths) - lengths
                total = lambda x, first=first: pa.array(np.add.reduceat(x, first))
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([
                    row["doc_id"].values, pa.array(~flat(row["train"]).astype(bool)), pa.array(lengths), total((c > 0).astype(np.int64)[codes]),
                    pa.array([known.tokens] * n, pa.int64()), total(base[codes]), total(made)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = coded_blocks.select("block", "doc_id", "train", "lengths", "codes", "word").join(found, "block", "left").drop("block").mapInArrow(
        step, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))
