"""Suffix order by induced sorting, with queues that go to disk.

The order of the leftmost S suffixes of a text induces the order of all others: one sweep upward
over the symbols for the L suffixes, one downward for the S suffixes. The queues of a sweep are keyed
by symbol and served first in, first out, so together they are a priority queue; blocks that do not
fit the memory given wait in an unlinked file. A sweep handles a whole block of suffixes at once.

Suffixes are told apart by their first `depth` symbols; where these are equal, they come in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 64 << 20


class Queues:
    """First-in first-out blocks of positions per symbol; beyond `memory` bytes they are written to a file."""

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, symbol: int, positions: np.ndarray) -> None:
        if self.held + positions.nbytes <= self.memory:
            self.held += positions.nbytes
            self.blocks[symbol].append(positions)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(positions.tobytes())
        self.blocks[symbol].append((at, len(positions)))

    def deal(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Each position to the queue of its symbol, the order kept."""
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        edges = np.flatnonzero(np.diff(symbols)) + 1
        for a, b in zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(symbols)]]).tolist()):
            if b > a:
                self.put(int(symbols[a]), positions[a:b].copy())

    def take(self, symbol: int) -> np.ndarray:
        out = []
        for block in self.blocks[symbol]:
            if isinstance(block, tuple):
                self.file.seek(block[0])
                out.append(np.frombuffer(self.file.read(4 * block[1]), dtype=np.int32))
            else:
                self.held -= block.nbytes
                out.append(block)
        self.blocks[symbol] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next one; the last symbol must be the only least one."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    rising = text[differs] < text[differs + 1]
    out = np.zeros(n, dtype=bool)
    out[: n - 1] = np.repeat(rising, np.diff(np.concatenate([[-1], differs])))[: n - 1]
    out[n - 1] = True
    return out


def induce(text: np.ndarray, s_type: np.ndarray, leftmost: np.ndarray, symbols: int, memory: int = MEMORY) -> np.ndarray:
    """All positions in the order that `leftmost`, the leftmost S positions in order, induces."""
    seeds = Queues(symbols, memory)
    seeds.deal(text[leftmost], leftmost.astype(np.int32))
    queues, larger = Queues(symbols, memory), Queues(symbols, memory)
    for c in range(symbols):
        block = queues.take(c)
        done = []
        while len(block):
            done.append(block)
            before = block[block > 0] - 1
            before = before[~s_type[before]]
            same = text[before] == c
            queues.deal(text[before[~same]], before[~same])
            block = before[same]
        if done:
            larger.put(c, np.concatenate(done))
        seed = seeds.take(c)
        before = seed[seed > 0] - 1
        before = before[~s_type[before]]
        queues.deal(text[before], before)
    # Downward: S suffixes of a symbol come from the greatest to the least, then its L suffixes.
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        block = queues.take(c)
        while len(block):
            out.append(block)
            before = block[block > 0] - 1
            before = before[s_type[before]]
            same = text[before] == c
            queues.deal(text[before[~same]], before[~same])
            block = before[same]
        large = larger.take(c)[::-1]
        out.append(large)
        before = large[large > 0] - 1
        before = before[s_type[before]]
        queues.deal(text[before], before)
    last = np.array([len(text) - 1], dtype=np.int32)
    return np.concatenate([last, np.concatenate(out)[::-1]])


def suffix_order(data: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """The positions of `data` (bytes) ordered by the `depth` bytes that begin there, at least."""
    text = np.concatenate([data.astype(np.int16) + 1, [0]]).astype(np.int16)
    if len(text) < 3:
        return np.argsort(text[:-1], kind="stable").astype(np.int32)
    s_type = s_types(text)
    leftmost = np.flatnonzero(s_type[1:] & ~s_type[:-1]).astype(np.int32) + 1
    # Any order of the leftmost S suffixes induces the order of the substrings between them.
    rough = induce(text, s_type, leftmost, 257, memory)
    marked = np.zeros(len(text), dtype=bool)
    marked[leftmost] = True
    by_substring = rough[marked[rough]]
    del rough, marked
    # Names: equal substrings, to the next leftmost S position, get equal numbers.
    ends = np.full(len(text), len(text) - 1, dtype=np.int32)
    ends[leftmost[:-1]] = leftmost[1:]
    lengths = ends[by_substring] - by_substring + 1
    new = np.ones(len(by_substring), dtype=bool)
    # The two substrings that hold the last symbol are like no other; eight symbols of the others are looked at at once.
    unlike = np.isin(by_substring, leftmost[-2:])
    same = np.flatnonzero((lengths[1:] == lengths[:-1]) & ~unlike[1:] & ~unlike[:-1])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    within = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    at = 0
    while len(same):
        differ = eight[by_substring[same] + at] ^ eight[by_substring[same + 1] + at]
        room = lengths[same] - at
        equal = (differ & within[np.minimum(room, 8)]) == 0
        new[same[equal & (room <= 8)] + 1] = False
        same = same[equal & (room > 8)]
        at += 8
    # Substrings with equal names share the rank of the first; the leftmost S suffixes are told apart by one name, two, four,
    # until `depth` symbols are. A name covers two symbols at least before the next one. Only shared ranks are looked at again.
    slots = np.arange(len(by_substring))
    rank = np.zeros(len(text), dtype=np.int32)
    rank[by_substring] = np.maximum.accumulate(np.where(new, slots, 0))
    rank = rank[leftmost].astype(np.int64)
    place = np.zeros(len(text), dtype=np.int32)
    place[leftmost] = slots
    order = place[by_substring]
    del ends, place, lengths, unlike, eight
    shared = np.flatnonzero(~(new & np.append(new[1:], True)))
    width = 1
    while 2 * width + 1 < depth and len(shared):
        some = order[shared]
        after = some.astype(np.int64) + width
        both = rank[some] * np.int64(len(rank) + 1)
        inner = after < len(rank)
        both[inner] += rank[after[inner]] + 1
        by_both = np.argsort(both, kind="stable")
        some, both = some[by_both], both[by_both]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        order[shared] = some
        rank[some] = np.maximum.accumulate(np.where(new, shared, 0))
        shared = shared[~(new & np.append(new[1:], True))]
        width *= 2
    result = induce(text, s_type, leftmost[order], 257, memory)
    return result[result < len(data)]
