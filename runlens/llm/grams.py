"""Character n-grams of many texts at once, as numpy arrays; what the classifiers share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Texts are handled in groups of about this many characters, so that memory follows the longest
# text, not the batch.
GROUP_CHARS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about GROUP_CHARS characters each, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, one after the other, and where each text begins (and the last ends)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def hashed(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each place the n-gram that begins there, as a number of `bits` bits; the last n-1 places have none."""
    size = max(0, len(points) - n + 1)
    value = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        value *= np.uint64(0x100000001B3)
        value ^= points[j : j + size]
    value *= MIX
    return (value >> np.uint64(64 - bits)).astype(np.int64)


class Distinct:
    """The distinct numbers of an array, in linear time, for numbers below 2**bits."""

    def __init__(self, bits: int):
        self.last = np.zeros(1 << bits, dtype=np.int64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        places = np.arange(len(ids))
        self.last[ids] = places
        return ids[self.last[ids] == places]
