"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and decoding.

A text is cut at its spaces; each word, with the space before it as U+2581 (one is put before the
text), is a lattice whose edges are the pieces that match there. Forward filtering sums the weights
of all ways to reach a place; backward sampling walks from the word's end to its start and draws
each piece in proportion to what its start has summed. So a segmentation is drawn with exactly its
share of all segmentations, and draws are hashes of row key, word number and step: a row's
segmentation depends on nothing else.

The distinct words of a batch are filtered together, place by place, and all their occurrences are
sampled together, step by step, as numpy arrays. Words of more than ``LONG`` letters (texts without
spaces) are filtered in blocks side by side, and drawn place by place.

Decoding is lossless: letters without a piece, and U+2581 itself, go as their UTF-8 bytes.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.llm.base import check_file, pieces

SPACE = "▁"
#: Stands for a U+2581 of the text itself; no piece has it.
OWN_SPACE = 0x110000
#: Bytes of text whose words are filtered together.
TOGETHER = 1_000_000
SALT = 11
#: Letters from which a word is filtered in blocks, letters of a block, and blocks that are filtered side by side.
LONG, BLOCK, BLOCKS = 512, 256, 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + code.astype(np.uint64) + np.uint64(1))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials; no way at all is minus infinity."""
    top = x.max(axis=axis, keepdims=True)
    top[np.isneginf(top)] = 0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Prefixes:
    """Piece ids by hashed prefix: ``NONE`` where no piece starts so, ``OPEN`` where one goes on."""

    NONE, OPEN = -2, -1
    BITS = 21

    def __init__(self, ids: dict[str, int]):
        held = {p[:k]: self.OPEN for p in ids for k in range(1, len(p))} | ids
        keys = np.zeros(len(held), np.uint64)
        for k in range(max(map(len, held))):
            at = np.array([i for i, p in enumerate(held) if len(p) > k])
            keys[at] = _step(keys[at], np.array([ord(p[k]) for p in held if len(p) > k]))
        known = dict(zip(keys.tolist(), held.values(), strict=True))
        if len(known) < len(held):
            raise ValueError("pieces that hash alike")
        left = known
        self.tables = []
        while left:  # what finds its slot taken goes to a further table, by other bits
            keys, held = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, self.NONE, np.int32)
            over = {}
            for key, i in left.items():
                slot = self._slot(key)
                if held[slot] == self.NONE:
                    keys[slot], held[slot] = key, i
                else:
                    over[key] = i
            self.tables.append((keys, held))
            if over and len(self.tables) == 3:
                raise ValueError("pieces that hash alike")
            left = over

    def _slot(self, key):
        shift = 20 * len(self.tables)
        return (key >> shift) & ((1 << self.BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.NONE, np.int32)
        for k, (keys, held) in enumerate(self.tables):
            slot = (h >> np.uint64(20 * k)) & np.uint64((1 << self.BITS) - 1)
            hit = keys[slot] == h
            out = np.where(hit & (held[slot] != self.NONE), held[slot], out)
        return out


class Lattice:
    """A SentencePiece model with byte pieces, as a sampler and a decoder.

    A BPE model has ranks, no probabilities: a piece weighs ``-alpha * log(2 + rank)``, as words
    of that rank do by Zipf's law. Larger ``alpha`` draws closer to the best segmentation.
    """

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=check_file(path))
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        spelled, ids = [b""] * n, {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                spelled[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and SPACE not in name[1:]:
                ids[name] = i
                spelled[i] = name.replace(SPACE, " ").encode()
        if SPACE not in ids or sum(model.is_byte(i) for i in range(n)) != 256:
            raise ValueError("the model needs a piece for the space and for every byte")
        ranks = np.array([max(0.0, -model.get_score(i)) for i in range(n)])
        self.weight = -alpha * np.log(2 + ranks)
        self.byte_weight = -alpha * np.log(2 + ranks.max(initial=n, where=ranks < 1e8))
        self.longest = max(map(len, ids))
        self.prefixes = Prefixes(ids)
        self.single = np.zeros(0x110001, bool)
        self.single[[ord(p) for p in ids if len(p) == 1]] = True
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(s) for s in spelled])
        self.places = np.cumsum(self.sizes) - self.sizes

    def _filter(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first node of each word, its letters, piece and running share of each (node, length) edge)."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        codes = np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        starts = np.cumsum(lengths) - lengths
        inner = np.ones(len(codes), bool)
        inner[starts] = False
        codes[inner & (codes == ord(SPACE))] = OWN_SPACE
        word = np.repeat(np.arange(len(words)), lengths)
        first = starts + np.arange(len(words))  # a word has one node more than letters
        nodes = len(codes) + len(words)
        piece = np.full((nodes, self.longest), -1, np.int32)
        weight = np.full((nodes, self.longest), -np.inf, np.float32)
        for n, at, found in self._matches(codes, np.repeat(starts + lengths, lengths) - np.arange(len(codes))):
            ends = at + word[at] + n
            piece[ends, n - 1], weight[ends, n - 1] = found, self.weight[found]
        bare = np.flatnonzero(~self.single[codes])  # letters that go as bytes
        own = np.where(codes[bare] == OWN_SPACE, ord(SPACE), codes[bare]).astype(np.int64)
        piece[bare + word[bare] + 1, 0] = -2 - own
        weight[bare + word[bare] + 1, 0] = self.byte_weight * self._utf8(own)

        order = np.argsort(-lengths, kind="stable")
        sums = np.zeros(nodes, np.float64)
        share = np.full((nodes, self.longest), 2, np.float32)
        alive = len(words)
        sorted_lengths, sorted_first = lengths[order], first[order]
        back = np.arange(1, self.longest + 1)
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            while alive and sorted_lengths[alive - 1] < depth:
                alive -= 1
            node = sorted_first[:alive] + depth
            reach = min(depth, self.longest)
            score = sums[node[:, None] - back[:reach]] + weight[node, :reach]
            top = score.max(axis=1, keepdims=True)
            run = np.cumsum(np.exp(score - top), axis=1)
            total = run[:, -1:]
            sums[node] = (top + np.log(total))[:, 0]
            share[node, :reach] = np.where(run >= total, 2, run / total)
        return first, lengths, piece, share

    def _matches(self, codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, where they start, pieces) of all pieces in ``codes``; no more than ``left`` letters from a place."""
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(1, self.longest + 1):
            fits = left[at] >= n
            at, h = at[fits], h[fits]
            h = _step(h, codes[at + n - 1])
            found = self.prefixes.find(h)
            hit = found >= 0
            yield n, at[hit], found[hit]
            goes = found != Prefixes.NONE
            at, h = at[goes], h[goes]

    def _stretch(self, codes: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece, weight) of each (node, length) edge that ends at nodes ``a`` + 1 to ``b``."""
        low = max(0, a - self.longest + 1)
        piece, weight = np.full((b - a, self.longest), -1, np.int32), np.full((b - a, self.longest), -np.inf)
        for n, at, found in self._matches(codes[low:b], b - low - np.arange(b - low)):
            end = at + low + n - a - 1
            at, found, end = at[end >= 0], found[end >= 0], end[end >= 0]
            piece[end, n - 1], weight[end, n - 1] = found, self.weight[found]
        bare = np.flatnonzero(~self.single[codes[a:b]])
        own = np.where(codes[a:b][bare] == OWN_SPACE, ord(SPACE), codes[a:b][bare]).astype(np.int64)
        piece[bare, 0], weight[bare, 0] = -2 - own, self.byte_weight * self._utf8(own)
        return piece, weight

    def _long(self, word: str, base: np.uint64) -> np.ndarray:
        """The pieces drawn for one long word.

        A node's sum is a linear map of those of the ``longest`` nodes before. So every block
        first finds its map, side by side with others; the maps are applied one after the other, and
        each block then knows the sums before it. A node's draw hashes its place, not the number of
        the step, so a block draws for all its nodes at once and needs no share of them later.
        """
        codes = np.frombuffer((SPACE + word).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[1:][codes[1:] == ord(SPACE)] = OWN_SPACE
        total, width = len(codes), self.longest
        back, drawn = np.empty(total, np.int64), np.empty(total, np.int32)
        window = np.r_[np.full(width - 1, -np.inf), 0.0]  # logarithms throughout, the oldest node first
        for a in range(0, total, BLOCK * BLOCKS):
            b = min(total, a + BLOCK * BLOCKS)
            piece, weight = self._stretch(codes, a, b)
            n = -(-(b - a) // BLOCK)
            edges = np.full((n * BLOCK, width), -np.inf)
            edges[:b - a], edges[b - a:, 0] = weight, 0
            edges = edges.reshape(n, BLOCK, width)
            older = np.ascontiguousarray(edges[:, :, ::-1])
            maps = np.full((n, BLOCK + width, width), -np.inf)
            maps[:, np.arange(width), np.arange(width)] = 0
            for j in range(BLOCK):
                maps[:, j + width] = _log_sum(older[:, j, :, None] + maps[:, j:j + width], 1)
            sums = np.empty((n, BLOCK + width))
            for i in range(n):
                sums[i, :width] = window
                window = _log_sum(maps[i, BLOCK:] + window, 1)
                window -= window.max()
            places = np.arange(a + 1, a + 1 + n * BLOCK, dtype=np.uint64)
            u = (((_mixed(base + places) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53).reshape(n, BLOCK)
            lengths = np.empty((n, BLOCK), np.int64)
            for j in range(BLOCK):
                score = edges[:, j] + sums[:, j:j + width][:, ::-1]
                top = score.max(axis=1)
                run = np.cumsum(np.exp(score - top[:, None]), axis=1)
                sums[:, j + width] = top + np.log(run[:, -1])
                lengths[:, j] = (run < (u[:, j] * run[:, -1])[:, None]).sum(axis=1)
            chosen = lengths.reshape(-1)[:b - a]
            back[a:b], drawn[a:b] = chosen + 1, piece[np.arange(b - a), chosen]
        node, path, steps = total, [], back.tolist()
        while node:
            path.append(node - 1)
            node -= steps[node - 1]
        return drawn[path[::-1]]

    @staticmethod
    def _utf8(codes: np.ndarray) -> np.ndarray:
        return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)

    def encode(self, texts: list[str | None], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null and empty texts have none."""
        cut = [t.split(" ") if t else [] for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        flat = [w for c in cut for w in c]
        if not flat:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        index = {w: i for i, w in enumerate(dict.fromkeys(w for w in flat if len(w) <= LONG))}
        word = np.fromiter((index.get(w, -1) for w in flat), np.int64, len(flat))
        first, lengths, piece, share = self._filter(list(index))
        text = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        base = _mixed(seeds.astype(np.uint64)[text] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

        walker = np.flatnonzero(word >= 0)
        node, goal = first[word[walker]] + lengths[word[walker]], first[word[walker]]
        steps, who, what = np.zeros(len(flat), np.int64), [], []
        drawn = {i: self._long(flat[i], base[i]) for i in np.flatnonzero(word < 0).tolist()}
        for i, found in drawn.items():
            steps[i] = len(found)
        k = 0
        while len(walker):
            k += 1
            u = ((_mixed(base[walker] + np.uint64(k)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            back = (share[node] < u[:, None]).sum(axis=1)
            who.append(walker)
            what.append(piece[node, back])
            steps[walker] += 1
            node = node - back - 1
            on = node != goal
            walker, node, goal = walker[on], node[on], goal[on]
        places = np.cumsum(steps)
        ids = np.empty(int(places[-1]), np.int64)
        for i, (w, p) in enumerate(zip(who, what, strict=True), 1):  # drawn from the end to the start
            ids[places[w] - i] = p
        for i, found in drawn.items():
            ids[places[i] - len(found):places[i]] = found
        per_text = np.add.reduceat(np.append(steps, 0), np.minimum(np.cumsum(counts) - counts, len(steps))) * (counts > 0)
        if (ids < 0).any():
            own = -2 - ids
            sizes = np.where(ids < 0, self._utf8(own), 1)
            wide = np.repeat(ids, sizes)
            begins = np.cumsum(sizes) - sizes
            letters = np.flatnonzero(ids < 0)
            codes, where = np.unique(own[letters], return_inverse=True)
            for j, c in enumerate(codes):
                for b, value in enumerate(chr(c).encode("utf-8", "surrogatepass")):
                    wide[begins[letters[where == j]] + b] = self.byte_ids[value]
            owner = np.repeat(np.arange(len(texts)), per_text)
            per_text = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
            ids = wide
        return ids.astype(np.int32), per_text

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of runs of ``counts`` ids."""
        sizes = self.sizes[ids]
        begins = np.cumsum(sizes) - sizes
        spot = np.arange(int(sizes.sum())) + np.repeat(self.places[ids] - begins, sizes)
        whole = self.bytes[spot].tobytes()
        ends = np.cumsum(counts)
        upto = np.append(begins, len(whole))
        return [whole[upto[e - n] + 1:upto[e]] if n else b"" for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


@functools.cache
def lattice(path: str, alpha: float) -> Lattice:
    """One per Python worker."""
    return Lattice(path, alpha)


def _encoder(path: str, alpha: float, names: list[str]):
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, alpha)
        for batch in pieces(batches, "__text", TOGETHER, 20_000):
            texts = batch.column("__text").to_pylist()
            ids, counts = model.encode(texts, batch.column("__seed").to_numpy())
            back = model.decode(ids, counts)
            begins = np.concatenate([[0], np.cumsum(counts)])
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-2], pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids)), pa.array(counts),
                pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins, begins[1:], strict=False)], pa.int64()),
                pa.array([b == (t or "").encode() for b, t in zip(back, texts, strict=True)])], names=names)

    return step


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = SALT,
           keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id (or the columns of ``keep``), ids, n_tokens, ids_crc32, lossless: one row per row of
    ``docs``, ``lossless`` from decoding the ids again.

    The key and ``seed`` decide the draws: equal rows get equal ids, and a null key is one key.
    Null and empty texts have no ids. Words are as long as the text makes them: a text without
    spaces is one word, worked off in memory that grows by some 60 bytes a letter. No rows in, none out.
    """
    keep = keep or {"doc_id": F.col(id_col)}
    rows = docs.select(
        *[c.alias(name) for name, c in keep.items()], F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("__seed"), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    names = [*keep, "ids", "n_tokens", "ids_crc32", "lossless"]
    return rows.mapInArrow(_encoder(model, alpha, names), f"{schema}, ids array<int>, n_tokens bigint, ids_crc32 bigint, lossless boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of the ids; no ids (or null) give the empty text."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lattice(model, 1.0)
        for batch in batches:
            ids = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(held.decode(ids.flatten().to_numpy(), counts), pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(step, f"doc_id {kind}, text string")
