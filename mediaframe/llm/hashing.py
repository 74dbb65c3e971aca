"""Hashes of words and of their parts, for many words at a time."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX2
    h = (h ^ (h >> np.uint64(27))) * MIX
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse modulo 2 ** 64, for k up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end] (bytes), the same wherever the bytes stand."""
    up, down = powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX)


def flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words in a row, and where each word begins (with the end as the last)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def gram_hashes(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-byte grams that lie inside one word, and the word of each."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + data[k: len(data) - n + 1 + k].astype(np.uint64) + np.uint64(1)
    inside = owner[: len(data) - n + 1] == owner[n - 1:]
    return mix(h[inside] + np.uint64(n * int(MIX) % (1 << 64))), owner[: len(data) - n + 1][inside]
