"""Noise of a whole text at once."""

import hashlib
import time

from modspark.functions.noise import draws, noisy
from modspark.operators.verdict import NOISE


def test_draws_are_md5():
    head = hashlib.md5("é text".encode()).hexdigest() + "/12"
    got = draws(head, 20_111)
    for i in (*range(120), 999, 1000, 9999, 10_000, 16_383, 16_384, 20_110):
        assert got[i] == hashlib.md5(f"{head}/{i}".encode()).digest()[0]


def test_noise_by_letter():
    for text in ("", "a", "größer\n\U0001f600 x" * 9):
        head, want = f"{hashlib.md5(text.encode()).hexdigest()}/2", ""
        for i, c in enumerate(text or ("",)):
            drawn = hashlib.md5(f"{head}/{i}".encode()).hexdigest()
            want += (c * 2 if drawn[0] < "4" else c) + NOISE[int(drawn[1], 16)]
        assert noisy(text, 2, NOISE) == want


def test_a_million_letters_take_seconds():
    start = time.time()
    noisy("letters " * 125_000, 0, NOISE)
    assert time.time() - start < 10
