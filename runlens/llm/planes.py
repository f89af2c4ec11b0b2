"""Many (value, owner) postings as one binary, for shuffles of very many small numbers.

Numbers are stored byte plane by byte plane: of sorted or small numbers the high planes hardly
change, and the shuffle's compression removes them.
"""

from __future__ import annotations

import numpy as np


def packed(values: np.ndarray, width: int) -> bytes:
    """Non-negative integers below 256**width, `width` bytes each, high plane first."""
    if not len(values):
        return b""
    wide = np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return np.ascontiguousarray(wide.T).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    size = len(data) // width
    wide = np.zeros((size, 8), dtype=np.uint8)
    if size:
        wide[:, 8 - width :] = np.frombuffer(data, dtype=np.uint8).reshape(width, size).T
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number (uint64)."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def slice_of(values: np.ndarray, slices: int) -> np.ndarray:
    """Which of `slices` equal ranges of 64-bit hashes each value is in; rests on the high 32 bits alone."""
    return ((values >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
