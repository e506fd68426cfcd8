"""Hashes of words and of runs of words, over many texts at once, as numpy arrays.

A text's bytes are read once. The hash of a word is a polynomial in a random power series, taken from prefix sums and
shifted back to the word's start, so equal words have equal hashes wherever they stand. Everything wraps at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_ODD))
_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n of them."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of several texts, one after the other: text k has words first[k] to first[k + 1] - 1."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    space = _IS_SPACE[data]
    turn = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    start, end = turn[0::2], turn[1::2]
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=U, out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    return Words(data, start, end, hashed, first)


def runs(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 words of the array begin none."""
    count = len(hashed) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    up, down = _power(len(hashed) + 1)
    total = np.zeros(len(hashed) + 1, U)
    np.cumsum(hashed * up[: len(hashed)], dtype=U, out=total[1:])
    return mix((total[n:] - total[:-n]) * down[:count] + U(n))


def pieces(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Split a batch into stretches of about ``most`` bytes (a longer text stands alone), each with its first index."""
    begin = size = 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > most:
            yield begin, texts[begin:k]
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]
