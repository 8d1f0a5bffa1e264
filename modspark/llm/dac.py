"""Directly addressable codes: any of a sequence of ids can be read without decoding a block.

An id is split into chunks of eight bits, lowest first. Level 0 has the first chunk of every id,
level k the k-th chunk of those ids that reach so far. A bitmap per level says which ids go on;
where an id goes on at position p, its next chunk is at the number of set bits before p, which a
rank directory (a count every ``RANK`` bits) gives with one look and a short bit count.

A segment is one binary image: head, ids and ends of its documents, then the levels.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
#: Bits between two entries of a rank directory.
RANK = 512


def encode(ids: np.ndarray) -> bytes:
    """The levels of ``ids`` (unsigned, below 2**32)."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK // 8), np.uint8)])
        counts = np.bitwise_count(bits).reshape(-1, RANK // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.cumsum(counts, dtype=np.uint32) - counts
        out.append(struct.pack("<II", len(rest), len(ranks)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return struct.pack("<I", len(out)) + b"".join(out)


def segment(doc_ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The image of a run of documents; ``missing`` marks null document ids."""
    ends = np.cumsum(lengths, dtype=np.uint64)
    return b"".join([
        MAGIC, struct.pack("<I", len(doc_ids)), doc_ids.astype("<i8").tobytes(), missing.astype(np.uint8).tobytes(), ends.astype("<u8").tobytes(), encode(ids)])


class Segment:
    """A view of an image; nothing is decoded until asked for."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token segment")
        (n,), at = struct.unpack_from("<I", image, 4), 8
        self.doc_ids = np.frombuffer(image, "<i8", n, at)
        self.missing = np.frombuffer(image, np.uint8, n, at + 8 * n).astype(bool)
        self.ends = np.frombuffer(image, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        (levels,), at = struct.unpack_from("<I", image, at), at + 4
        self.levels = []
        for _ in range(levels):
            (size, entries), at = struct.unpack_from("<II", image, at), at + 8
            chunks = np.frombuffer(image, np.uint8, size, at)
            bits = np.frombuffer(image, np.uint8, entries * RANK // 8, at + size)
            ranks = np.frombuffer(image, "<u4", entries, at + size + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += size + len(bits) + 4 * entries

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, p: int) -> int:
        """Set bits before position p."""
        if p // RANK >= len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bits[-(RANK // 8):]).sum()) if len(ranks) else 0
        first = p // RANK * (RANK // 8)
        whole = int(np.bitwise_count(bits[first:p // 8]).sum())
        part = int(bits[p // 8]) & ((1 << p % 8) - 1)
        return int(ranks[p // RANK]) + whole + part.bit_count()

    def token(self, p: int) -> int:
        """Id number p of the segment: one chunk and one rank per level."""
        if not 0 <= p < len(self):
            raise IndexError(p)
        out = shift = 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[p]) << shift
            if not bits[p // 8] >> p % 8 & 1:
                break
            p, shift = self._rank(bits, ranks, p), shift + 8
        return out

    def tokens(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop: a run of ids is a run of chunks on every level."""
        stop = len(self) if stop is None else stop
        out = np.zeros(max(0, stop - start), np.uint32)
        spots, shift = np.arange(len(out)), 0
        for chunks, bits, ranks in self.levels:
            if stop <= start:
                break
            out[spots] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            first = start // 8
            more = np.unpackbits(bits[first:-(-stop // 8)], bitorder="little")[start - 8 * first:][:stop - start].astype(bool)
            spots, shift = spots[more], shift + 8
            start = self._rank(bits, ranks, start)
            stop = start + len(spots)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))
