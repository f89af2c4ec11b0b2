"""Suffix-array dedup: bytes that a repeated string of `length` bytes covers are removed, but for its first place.

1. Anchors: in every window of `length` bytes the 16-byte string of least hash, the leftmost of equal
   ones. Equal windows have equal anchors at the same place, so windows need only be compared where
   an anchor comes twice. Anchors meet by hash range as packed postings, and those met once end here.
2. The windows of a repeated anchor in a row make a piece, with the bytes they need. Pieces of one
   anchor meet in one shard. A piece that comes again, byte for byte, in a task or a shard is removed
   whole there and goes no further.
3. In a shard, pieces that share an anchor and differ are ordered by external induced sorting
   (`induced`); neighbours in suffix order with a common prefix of `length` are one string, and all its
   windows but the first in the table are removed.
4. Anchors that very many rows have travel window by window, dealt by the whole window's hash: equal
   windows still meet, and no shard gathers what lies around a common passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import KEY, in_buckets, keyed, numbered, shuffles_freed, text_of, written
from runlens.llm.induced import suffix_order
from runlens.llm.planes import mixed, packed, slice_of, unpacked

LENGTH = 100
RUNS = ("start", "windows", "anchor", "common")
GRAM = 16
SEGMENT = 1 << 20
POSTINGS_PER_BLOB = 500_000
POSTINGS_PER_SLICE = 500_000
# Text per shard; pieces are at most three to four times the repeated text. Sorting takes some 50 bytes of memory a byte.
BYTES_PER_SHARD = 6 << 20
# Rows of one anchor from which its windows are dealt one by one.
COMMON = 5_000
# Bytes of runs of such anchors whose windows are hashed at once.
TOGETHER = 64 << 10
# Anchors go by the upper 56 bits of their hash.
REST = np.uint64(8)


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes that begin at each place."""
    eight = words8(data)
    return mixed(eight[:-8] * np.uint64(0xD6E8FEB86659FD93) + mixed(eight[8:]))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values: of a block's end and the next one's beginning."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, dtype=values.dtype)])
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, windows, anchor hash) of the runs of windows that have one anchor, segment by segment."""
    width = length - GRAM + 1
    place = np.uint64((1 << 24) - 1)
    for base in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        hashes = gram_hashes(part)
        order = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
        owner = (sliding_least(order, width) & place).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        # Least hashes are small ones; mixed again they spread evenly over the slices.
        yield base + starts, np.diff(np.concatenate([starts, [len(owner)]])), mixed(hashes[owner[starts]])


POSTINGS = "slice bigint, hashes binary, base bigint, keys binary, starts binary, windows binary"


def anchor_postings(rows: DataFrame, length: int, slices: int) -> DataFrame:
    """Packed postings (anchor, row, start, windows) by slice of the anchor's hash."""

    def blob(found: list) -> pd.DataFrame:
        keys, starts, windows, hashes = (np.concatenate([f[i] for f in found]) for i in range(4))
        base = int(keys.min())
        order = np.argsort(hashes)
        keys, starts, windows, hashes = keys[order], starts[order], windows[order], hashes[order]
        slice_ = slice_of(hashes, slices)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(slice_)) + 1, [len(slice_)]])
        return pd.DataFrame([
            {"slice": int(slice_[a]), "hashes": packed(hashes[a:b] >> REST, 7), "base": base,
             "keys": packed((keys[a:b] - base).astype(np.uint64), 7), "starts": packed(starts[a:b].astype(np.uint64), 5),
             "windows": packed(windows[a:b].astype(np.uint64), 3)} for a, b in zip(edges[:-1], edges[1:])])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for batch in batches:
            for key, text in zip(batch[KEY], batch["text"]):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                for starts, windows, hashes in runs_of(data, length):
                    found.append((np.full(len(starts), key, dtype=np.int64), starts, windows, hashes))
                    held += len(starts)
                if held >= POSTINGS_PER_BLOB:
                    yield blob(found)
                    found, held = [], 0
        if held:
            yield blob(found)

    return rows.mapInPandas(work, POSTINGS)


def repeated_runs(blobs: DataFrame, common: int) -> DataFrame:
    """KEY, start, windows, anchor, common: runs whose anchor comes twice or more."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([unpacked(b, 7) for b in part["hashes"]])
        keys = np.concatenate([unpacked(b, 7).astype(np.int64) + base for b, base in zip(part["keys"], part["base"])])
        starts = np.concatenate([unpacked(b, 5) for b in part["starts"]]).astype(np.int64)
        windows = np.concatenate([unpacked(b, 3) for b in part["windows"]]).astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        edges = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]])
        times = np.repeat(np.diff(edges), np.diff(edges))
        chosen = order[times > 1]
        anchor = mixed(hashes[chosen]).view(np.int64)
        return pd.DataFrame({KEY: keys[chosen], "start": starts[chosen], "windows": windows[chosen], "anchor": anchor,
                             "common": times[times > 1] >= common})

    return blobs.groupBy("slice").applyInPandas(work, f"{KEY} bigint, start bigint, windows int, anchor bigint, common boolean")


PIECES = "shard bigint, anchors binary, keys binary, starts binary, windows binary, bytes binary"


def window_hashes(data: np.ndarray, count: int, length: int) -> np.ndarray:
    eight = words8(data)
    out = np.zeros(count, dtype=np.uint64)
    for at in [*range(0, length - 8, 8), length - 8]:
        out = mixed(out * np.uint64(3) + eight[at : at + count])
    return out


def pieces(suspects: DataFrame, length: int, shards: int) -> DataFrame:
    """Packed pieces by shard; without bytes, for any shard to pass on, the runs of windows that a
    piece of the same task repeats."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, tuple[int, int, int, int]] = {}
        gone: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> pd.DataFrame:
            rows = []

            def row(shard, anchors, keys, starts, windows, content) -> None:
                rows.append({"shard": int(shard), "anchors": packed(anchors, 8), "keys": packed(keys, 8),
                             "starts": packed(starts, 5), "windows": packed(windows, 3), "bytes": content})

            if kept:
                anchors = np.array([v[0] for v in kept.values()], dtype=np.int64).view(np.uint64)
                shard = slice_of(mixed(anchors), shards).astype(np.int64)
                keys, starts, windows = (np.array([v[i] for v in kept.values()], dtype=np.int64).astype(np.uint64) for i in (1, 2, 3))
                contents = list(kept)
                order = np.argsort(shard, kind="stable")
                edges = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]])
                for a, b in zip(edges[:-1], edges[1:]):
                    at = order[a:b]
                    row(shard[at[0]], anchors[at], keys[at], starts[at], windows[at], b"".join([contents[i] for i in at]))
            if gone:
                lost = np.array(gone, dtype=np.int64)
                for i, part in enumerate(np.array_split(lost, max(1, len(lost) // 10_000))):
                    row((int(lost[0, 0]) + i) % shards, np.zeros(len(part), np.uint64), *(part[:, j].astype(np.uint64) for j in range(3)), b"")
            return pd.DataFrame(rows, columns=["shard", "anchors", "keys", "starts", "windows", "bytes"])

        def add(anchor: int, key: int, start: int, windows: int, content: bytes) -> int:
            old = kept.get(content)
            if old is None:
                kept[content] = (anchor, key, start, windows)
                return len(content) + 200
            if (key, start) < (old[1], old[2]):
                kept[content] = (anchor, key, start, windows)
                key, start = old[1], old[2]
            gone.append((key, start, windows))
            return 50

        def one_by_one(waiting: list[tuple[int, int, int, bytes]]) -> int:
            """The windows of runs of common anchors, hashed together."""
            data = b"".join([content for *_, content in waiting])
            names = window_hashes(np.frombuffer(data, dtype=np.uint8), len(data) - length + 1, length).view(np.int64)
            at = taken = 0
            for key, start, windows, content in waiting:
                for i, name in enumerate(names[at : at + windows].tolist()):
                    taken += add(name, key, start + i, 1, content[i : i + length])
                at += len(content)
            return taken

        waiting, wait = [], 0
        for batch in batches:
            for key, text, *runs in zip(batch[KEY], batch["text"], *(batch[c] for c in RUNS)):
                data = text.encode("utf-8", "surrogatepass")
                for start, windows, anchor, common in zip(*(r.tolist() for r in runs)):
                    content = data[start : start + windows + length - 1]
                    if common:
                        waiting.append((key, start, windows, content))
                        wait += len(content)
                    else:
                        held += add(anchor, key, start, windows, content)
                if wait > TOGETHER:
                    held += one_by_one(waiting)
                    waiting, wait = [], 0
                if held > 32 << 20:
                    yield flush()
                    kept, gone, held = {}, [], 0
        if waiting:
            one_by_one(waiting)
        yield flush()

    return suspects.mapInPandas(work, PIECES)


def repeated_windows(packed_pieces: DataFrame, length: int) -> DataFrame:
    """KEY, start, last: runs of windows that begin earlier too, found shard by shard in suffix order."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        known = part["bytes"].map(len) == 0

        def numbers(rows: pd.DataFrame, column: str, width: int) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.uint64), *[unpacked(b, width) for b in rows[column]]])

        out = []
        begins, count = numbers(part[known], "starts", 5).astype(np.int64), numbers(part[known], "windows", 3).astype(np.int64)
        out.append((numbers(part[known], "keys", 8).astype(np.int64), begins, begins + count - 1))
        part = part[~known]
        anchors = numbers(part, "anchors", 8)
        keys = numbers(part, "keys", 8).astype(np.int64)
        starts = numbers(part, "starts", 5).astype(np.int64)
        windows = numbers(part, "windows", 3).astype(np.int64)
        data = b"".join(part["bytes"])
        sizes = windows + length - 1
        offsets = np.cumsum(sizes) - sizes
        # Pieces in the table's order, so that of equal ones the first is met first.
        order = np.lexsort((starts, keys))
        first: dict[bytes, int] = {}
        gone = []
        for i in order.tolist():
            content = data[offsets[i] : offsets[i] + sizes[i]]
            if first.setdefault(content, i) != i:
                gone.append(i)
        left = np.array(list(first.values()), dtype=np.int64)
        # An anchor with one piece left has nothing to compare.
        _, number, times = np.unique(anchors[left], return_inverse=True, return_counts=True)
        left = left[times[number] > 1]
        if gone:
            out.append((keys[gone], starts[gone], starts[gone] + windows[gone] - 1))
        if len(left):
            text = np.frombuffer(b"".join([data[offsets[i] : offsets[i] + sizes[i]] for i in left.tolist()]), dtype=np.uint8)
            del first, data, part
            begins = np.cumsum(sizes[left]) - sizes[left]
            whole = np.ones(len(text), dtype=bool)
            for i in range(1, length):
                whole[begins + sizes[left] - i] = False
            suffixes = suffix_order(text, length)
            suffixes = suffixes[whole[suffixes]]
            eight = words8(text)
            same = np.arange(len(suffixes) - 1)
            for at in [*range(0, length - 8, 8), length - 8]:
                same = same[eight[suffixes[same] + at] == eight[suffixes[same + 1] + at]]
            new = np.ones(len(suffixes), dtype=bool)
            new[same + 1] = False
            # Pieces lie in the table's order, so of equal windows the first in the text is the first in the table.
            whole[np.minimum.reduceat(suffixes, np.flatnonzero(new))] = False
            again = np.flatnonzero(whole)
            if len(again):
                owner = np.searchsorted(begins, again, side="right") - 1
                row, place = keys[left][owner], starts[left][owner] + again - begins[owner]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
                begin = np.flatnonzero(new)
                end = np.concatenate([begin[1:], [len(row)]]) - 1
                out.append((row[begin], place[begin], place[end]))
        columns = [np.concatenate([o[i] for o in out]) for i in range(3)]
        return pd.DataFrame(dict(zip((KEY, "start", "last"), columns)))

    return packed_pieces.groupBy("shard").applyInPandas(work, f"{KEY} bigint, start bigint, last bigint")


def removed(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs of bytes (begin, end), and the bytes that stay; `runs` of windows in order."""
    spans: list[tuple[int, int]] = []
    for start, last in runs:
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], last + length))
        else:
            spans.append((start, last + length))
    kept, at = [], 0
    for begin, end in spans:
        kept.append(text[at:begin])
        at = end
    return spans, b"".join([*kept, text[at:]])


RESULT = f"{KEY} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<begin: bigint, end: bigint>>"


def suffix_dedup(docs: DataFrame, length: int = LENGTH, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end in bytes) of every row of `docs`.

    A byte is removed if a string of `length` bytes that covers it also starts earlier: in a row of
    smaller doc_id, or earlier in the same one. Strings are judged on the input. A null text is
    empty; texts shorter than `length` lose nothing; null ids come first and repeated ids in some
    fixed order; an empty table gives no row. Texts are read whole and matches never cross them.
    """
    rows = keyed(docs, "text")
    if rows.where(F.col(KEY) != F.col("doc_id")).limit(1).count() or rows.where("doc_id is null").limit(1).count():
        # Ids that repeat or are missing: number the rows in the order of their ids.
        rows = written(numbered(rows.drop(KEY), [F.col("doc_id").asc_nulls_first(), "text"], "ordered", KEY), "in-order")
    rows = rows.select(KEY, F.col("doc_id").cast("bigint"), text_of().alias("text"))
    whole = written(rows.select(KEY, "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"),
                                F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")), "whole")
    total = whole.agg(F.sum("n_bytes")).first()[0] or 0
    slices = max(1, -(-total // (40 * POSTINGS_PER_SLICE)))
    # A run has about 43 windows, so a slice gets about POSTINGS_PER_SLICE anchors.
    runs = repeated_runs(anchor_postings(rows.select(KEY, "text"), length, slices), common)
    shards = max(1, -(-total // BYTES_PER_SHARD))
    # A row's runs as arrays side by side: the text's own length bounds them.
    own = runs.groupBy(KEY).agg(F.collect_list(F.struct(*RUNS)).alias("runs")).select(KEY, *[F.col(f"runs.{c}").alias(c) for c in RUNS])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows_ = []
            for key, text, starts, lasts in zip(batch[KEY], batch["text"], batch["starts"], batch["lasts"]):
                data = text.encode("utf-8", "surrogatepass")
                spans, kept = removed(data, sorted(zip(starts.tolist(), lasts.tolist())), length)
                rows_.append((key, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                              [{"begin": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(rows_, columns=[KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    # Texts are shuffled once: their buckets serve the pieces as well as the cutting, and no shuffle outlives its write.
    with in_buckets(rows.select(KEY, "text").join(own.hint("merge"), KEY), "suspects", KEY) as suspects:
        found = repeated_windows(pieces(suspects, length, shards), length)
        again = found.groupBy(KEY).agg(F.collect_list(F.struct("start", "last")).alias("found"))
        again = again.select(KEY, F.col("found.start").alias("starts"), F.col("found.last").alias("lasts"))
        with shuffles_freed(docs.sparkSession):
            changed = written(suspects.select(KEY, "text").join(again.hint("merge"), KEY).mapInPandas(work, RESULT), "changed")
    other = changed.select(KEY, F.col("n_removed").alias("__removed"), F.col("n_spans").alias("__spans"),
                           F.col("kept_sha256").alias("__sha"), "spans")
    none = F.array().cast("array<struct<begin: bigint, end: bigint>>")
    return whole.join(other, KEY, "left").select(
        "doc_id", "n_bytes", F.coalesce("__removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("__spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("__sha", "kept_sha256").alias("kept_sha256"),
        F.coalesce("spans", none).alias("spans"))
