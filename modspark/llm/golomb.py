"""Golomb-Rice codes of sorted integers, coded and decoded as whole numpy arrays.

A code is the gaps of the sorted values: quotients in unary (ones closed by a zero) in one bit
string, remainders of ``shift`` bits each in another.
"""

from __future__ import annotations

import numpy as np


def best_shift(values: np.ndarray) -> int:
    """Remainder bits that suit the mean gap."""
    if not len(values):
        return 0
    mean = int(values[-1]) // len(values)
    return max(0, mean.bit_length() - 1)


def encode(values: np.ndarray, shift: int) -> tuple[bytes, bytes]:
    """(unary, remainders) of ascending, non-negative values."""
    n = len(values)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 0
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(rest.reshape(-1)).tobytes()


def decode(unary: bytes, rest: bytes, n: int, shift: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(unary, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * shift).reshape(n, shift).astype(np.uint64)
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(shift)) + (low << places).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)
