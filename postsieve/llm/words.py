"""Word and shingle hashes of whole texts, computed on the bytes of a batch with numpy.

All hashes are 64 bits wide and depend on nothing but the words, so they are equal in every task and
session. Texts are handled in groups of about a megabyte (one text at a time where it is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2^64."""
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 2 * GROUP_BYTES)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size <= 4 * GROUP_BYTES:
            _powers[kind] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that together have about GROUP_BYTES."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def encoded(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is the empty text."""
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the bounds of each text's words in that array."""
    joined = b" ".join(texts) + b" "
    b = np.frombuffer(joined, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    word = ~space
    start = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(word[:-1] & space[1:]) + 1
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(b)), out=total[1:])
    h = (total[end] - total[start]) * _power("down", _BASE_INVERSE, len(b))[start]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    return mixed(h), bounds


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; of all words where there are fewer; none without words. Not made distinct."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j : n - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mixed(h)


def texts_words(column) -> Iterator[tuple[int, np.ndarray]]:
    """(row in the column, its word hashes), row by row."""
    texts = encoded(column)
    for i, j in groups(texts):
        hashes, bounds = word_hashes(texts[i:j])
        for row in range(i, j):
            yield row, hashes[bounds[row - i] : bounds[row - i + 1]]
