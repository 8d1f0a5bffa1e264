"""Noise drawn by MD5 for a whole text at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_START = [np.array([v], np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_STEP = 1 << 14


def _first_byte(words: list[np.ndarray]) -> np.ndarray:
    """First byte of the MD5 of messages of one block, given as its sixteen words."""
    a, b, c, d = _START
    for i in range(64):
        kind, k = divmod(i, 16)
        if kind == 0:
            f, g = d ^ (b & (c ^ d)), k
        elif kind == 1:
            f, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif kind == 2:
            f, g = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * k % 16
        f = f + a + _SINES[i] + words[g]
        turn = _TURNS[kind, i % 4]
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    return ((a + _START[0]) & np.uint32(255)).astype(np.uint8)


def draws(head: str, size: int) -> np.ndarray:
    """First byte of MD5(head/i) for each place i below ``size``; the head has 32 letters or more, 40 at most."""
    start = head.encode() + b"/"
    out = np.empty(size, np.uint8)
    low = 0
    while low < size:
        digits = len(str(low))
        high = min(size, 10**digits, low + _STEP)
        places, length = np.arange(low, high, dtype=np.int64), len(start) + digits
        block = np.zeros((high - low, 24), np.uint8)
        tail = start[32:]
        block[:, :len(tail)] = np.frombuffer(tail, np.uint8)
        for k in range(digits):
            block[:, len(tail) + k] = places // 10 ** (digits - 1 - k) % 10 + 48
        block[:, len(tail) + digits] = 0x80
        words = [np.array([w], np.uint32) for w in np.frombuffer(start[:32], "<u4")]
        words += list(np.ascontiguousarray(block.view("<u4").T))
        words += [np.array([8 * length], np.uint32), np.zeros(1, np.uint32)]
        out[low:high] = _first_byte(words)
        low = high
    return out


def noisy(text: str, seed: int, marks: tuple[str, ...]) -> str:
    """The text with letters doubled (first digit of the draw below 4) and ``marks`` behind them (second digit)."""
    drawn = draws(f"{hashlib.md5(text.encode()).hexdigest()}/{seed}", max(1, len(text))).tobytes()
    times = [2 if b < 0x40 else 1 for b in range(256)]
    after = [marks[b & 15] for b in range(256)]
    return "".join([c * times[b] + after[b] for c, b in zip(text or ("",), drawn)])
