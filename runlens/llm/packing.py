"""Packing token sequences: non-negative least squares over shallow combinations of lengths.

Every document is cut into full windows and one remainder. The histogram of remainder lengths has
as many bins as the window has tokens, whatever the corpus. Combinations of up to three lengths that
fill a window are the unknowns; projected gradient steps find repeat counts that explain the
histogram best; rounded down they pack most pieces without a gap, and what is left over is packed
greedily, again by counts per length. The plan so far holds no document: it is a list of
combinations with repeat counts. Pieces then take the places of their length by rank.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import KEY, kept_by_worker, keyed, small_batches, text_of, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
WINDOW = 2048
# Units of text with their ids that a worker remembers; a full memory is kept as the one before, once.
REMEMBERED = 400_000
# New units that go to the tokenizer as one text.
TOGETHER = 1_000
# Characters of text that are cut before what is new in them is learned.
TEXT_AT_ONCE = 4_000_000
ROWS_PER_BUCKET = 4_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian 32-bit integers, with a memory of units.

    Texts are cut where the tokenizer's pattern always ends a match and begins the next as at the beginning of a text:
    before the last blank of a gap, around its last character if that is another white space, and between letters or digits
    and punctuation but the apostrophe. Places are found on bytes, many texts at once, and Arrow finds the distinct units,
    so Python sees each unit once a portion. Units not met before go to the tokenizer many in one text, set apart by the
    blank they begin with or by line ends; single words of Latin letters go to its model past the pattern, as they are one
    match of it. The memory only saves time. A text with a special token's string in it is encoded
    whole, as the tokenizer does it, and so is any text where the tokenizer has another pattern.
    """

    BEFORE_FIRST, BETWEEN = 1, 2

    def __init__(self, path: str, remembered: int | None = None):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        # The same model; it gets words in the letters that stand for their bytes.
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = CharDelimiterSplit(" ")
        self.is_word = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
        pattern = self.tokenizer.pre_tokenizer and json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        self.cuttable = bool(pattern and pattern["type"] == "ByteLevel" and pattern["use_regex"] and not pattern["add_prefix_space"]
                             and self.tokenizer.normalizer is None)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        # Byte-level tokens write a blank and a line end as these letters.
        self.after_blank = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.after_blank[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.line_end = vocabulary.get("\u010a")
        # Whether a cut lies before or between two neighbouring bytes. Visible beyond ASCII are first bytes of which no white space has one.
        byte = np.arange(256)
        shown = ((byte > 32) & (byte < 127)) | ((byte > 160) & (byte != 173))
        self.shown = np.where(shown, byte, 255 + np.cumsum(~shown)).astype("<u2")
        plain = np.array([chr(i).isascii() and chr(i).isalnum() for i in range(256)])
        self.marks = (byte > 32) & (byte < 127) & ~plain & (byte != ord("'"))
        space = (byte == 32) | ((byte >= 9) & (byte <= 13))
        visible = ((byte > 32) & (byte < 127)) | ((byte >= 0xC3) & (byte <= 0xE0)) | ((byte >= 0xE4) & (byte <= 0xF4))
        gap = space[:, None] & visible
        between = (gap & (byte != 32)[:, None]) | (plain[:, None] & self.marks) | (self.marks[:, None] & plain)
        self.cuts = (self.BEFORE_FIRST * gap + self.BETWEEN * between).astype(np.uint8).reshape(-1)
        # Second bytes of the letters from \u00c0 to \u00ff.
        self.letters = (byte >= 0x80) & (byte <= 0xBF) & (byte != 0x97) & (byte != 0xB7)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}

    def age(self) -> None:
        """A full memory becomes the one before; what is met again moves over, so that only rare words are forgotten."""
        if len(self.known) > (REMEMBERED if self.remembered is None else self.remembered):
            self.known, self.known_before = {}, self.known

    def units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The units of texts in a row, and how many come before each text and before the end."""
        column = pa.array(texts, pa.string())
        _, edges, data = column.buffers()
        edges = np.frombuffer(edges, dtype=np.int32, count=len(texts) + 1)
        size = int(edges[-1])
        if not size:
            return pa.array([], pa.string()), np.zeros(len(texts) + 1, dtype=np.int64)
        content = np.frombuffer(data, dtype=np.uint8, count=size)
        flags = self.cuts[(content[:-1].astype(np.uint16) << 8) | content[1:]]
        # A text ends as if nothing followed it.
        flags[edges[(edges > 0) & (edges < size)] - 1] = 0
        cut = np.zeros(size, dtype=bool)
        cut[:-1] = flags & self.BEFORE_FIRST
        cut[1:] |= (flags & self.BETWEEN) > 0
        accented = np.flatnonzero(content[:-2] == 0xC3)
        accented = accented[self.letters[content[accented + 1]] & self.marks[content[accented + 2]]]
        cut[accented + 2] = True
        cut[edges[edges < size]] = True
        starts = np.flatnonzero(cut).astype(np.int32)
        places = pa.py_buffer(np.append(starts, np.int32(size)))
        return pa.Array.from_buffers(pa.string(), len(starts), [None, places, data]), np.searchsorted(starts, edges)

    def learn(self, units: list[str]) -> None:
        """Ids of units that are not in the memory."""
        known, before = self.known, self.known_before.get
        words, begins, blank, plain, alone = [], [], [], [], []
        for unit in units:
            coded = before(unit)
            if coded is not None:
                known[unit] = coded
            elif self.line_end is not None and self.is_word(unit):
                (words if unit[0] == " " else begins).append(unit)
            elif unit[0] == " " and not unit[1:2].isspace() and unit.rfind(" ") == 0 and len(unit) > 1:
                blank.append(unit)
            elif self.line_end is not None and not (unit[0].isspace() or unit[-1].isspace() or "\n" in unit):
                plain.append(unit)
            else:
                alone.append(unit)
        for many, between, past_pattern in ((words, "", True), (begins, "\n", True), (blank, "", False), (plain, "\n", False)):
            encode = (self.of_words if past_pattern else self.tokenizer).encode_batch_fast
            groups = [many[at : at + TOGETHER] for at in range(0, len(many), TOGETHER)]
            for at in range(0, len(groups), 10):
                some = groups[at : at + 10]
                texts = [between.join(group) for group in some]
                if past_pattern:
                    texts = [self.in_letters(text) for text in texts]
                for group, coded in zip(some, encode(texts, add_special_tokens=False)):
                    ids = np.array(coded.ids, dtype="<u4")
                    if between:
                        ends = 4 * np.flatnonzero(ids == self.line_end)
                        starts, ends = [0, *(ends + 4).tolist()], [*ends.tolist(), 4 * len(ids)]
                    else:
                        starts = (4 * np.flatnonzero(self.after_blank[ids])).tolist()
                        ends = [*starts[1:], 4 * len(ids)]
                    if len(starts) != len(group) or starts[0]:
                        alone.extend(group)
                    else:
                        known.update(zip(group, map(ids.tobytes().__getitem__, map(slice, starts, ends))))
        for at in range(0, len(alone), 10_000):
            some = alone[at : at + 10_000]
            for unit, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[unit] = array("I", coded.ids).tobytes()

    def in_letters(self, text: str) -> str:
        """Words, each beginning with a blank or set apart by line ends, as the model has them: a letter for each byte, a blank between."""
        letters = self.shown[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")
        return letters.replace("\u0120", " \u0120").replace("\u010a", " \u010a ")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def by_units(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens; what is new in any of them is learned at once."""
        units, edges = self.units(texts)
        units = units.dictionary_encode()
        names, at = units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy()
        found = list(map(self.known.get, names))
        new = [name for name, coded in zip(names, found) if coded is None]
        if new:
            self.learn(new)
            learned = map(self.known.__getitem__, new)
            found = [next(learned) if coded is None else coded for coded in found]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        ends = np.cumsum(sizes[at])
        first = (np.cumsum(sizes) - sizes)[at]
        # The place in `ids` of each token of the texts: its unit's, and how far it is in the unit.
        first[1:] -= ends[:-1]
        place = np.repeat(first, sizes[at])
        place += np.arange(len(place))
        coded = ids[place].tobytes()
        edges = 4 * np.concatenate([[0], ends])[edges]
        return [coded[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        self.age()
        cuttable = [self.cuttable and not any(token in text for token in self.special) for text in texts]
        coded = iter(self.by_units([text for text, yes in zip(texts, cuttable) if yes]))
        return [next(coded) if yes else self.whole(text) for text, yes in zip(texts, cuttable)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def portions(texts: Sequence[str], size: int = TEXT_AT_ONCE) -> Iterator[slice]:
    """Neighbouring texts of about `size` characters together."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield slice(start, at + 1)
            start, held = at + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def pieces_of(coded: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the windows of a document's ids."""
    step = 4 * window
    for at in range(0, len(coded), step):
        part = coded[at : at + step]
        yield at // 4, len(part) // 4, zlib.crc32(part)


def cut_documents(docs: DataFrame, path: str, window: int, remembered: int) -> DataFrame:
    """KEY, doc_id, start, length, ids_crc32, doc_tokens: full windows and the remainder of each document."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = kept_by_worker(f"encoder {path} {remembered}", lambda: Encoder(path, remembered))
        for batch in batches:
            keys, ids, starts, lengths, crcs, tokens = [], [], [], [], [], []
            texts = batch["text"].tolist()
            encoded = (coded + end for portion in portions(texts) for coded in encoder.encode_all(texts[portion]))
            for key, doc_id, coded in zip(batch[KEY], batch["doc_id"], encoded):
                for start, length, crc in pieces_of(coded, window):
                    keys.append(key), ids.append(doc_id), starts.append(start)
                    lengths.append(length), crcs.append(crc), tokens.append(len(coded) // 4)
            yield pd.DataFrame({KEY: keys, "doc_id": pd.array(ids, dtype="Int64"), "start": starts, "length": lengths,
                                "ids_crc32": crcs, "doc_tokens": tokens})

    schema = f"{KEY} bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    rows = keyed(docs, "text").select(KEY, F.col("doc_id").cast("bigint"), text_of().alias("text"))
    return rows.mapInPandas(work, schema)


def combinations(window: int) -> np.ndarray:
    """All ways to fill the window with one, two or three lengths, as rows of three, 0 for none."""
    first = np.arange(1, window + 1)
    a, b = np.meshgrid(first, np.arange(0, window), indexing="ij")
    c = window - a - b
    good = (c >= 0) & (a >= b) & (b >= c)
    return np.stack([a[good], b[good], c[good]], axis=1)


def repeat_counts(histogram: np.ndarray, ways: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative repeat counts x with A x close to the histogram in the least-squares sense.

    A has a column per way and counts the lengths in it. Accelerated projected gradient; the step
    is the inverse of a bound on the largest eigenvalue of A'A (at most 3 times the most ways a length is in).
    """
    size = len(histogram)
    used = ways > 0
    inside = np.bincount(ways[used], minlength=size)
    step = 1.0 / (3.0 * max(1, inside.max()))
    x = np.zeros(len(ways))
    y, momentum = x, 1.0
    for _ in range(rounds):
        have = sum(np.bincount(ways[:, j], weights=y, minlength=size) for j in range(3))
        gap = have - histogram
        gap[0] = 0.0
        new = np.maximum(0.0, y - step * (gap[ways[:, 0]] + gap[ways[:, 1]] + gap[ways[:, 2]]))
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y, x, momentum = new + (momentum - 1) / after * (new - x), new, after
    return x


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with repeat counts that hold every piece of the histogram once.

    `counts[length]` is the number of pieces. The least-squares counts are rounded down, and cut
    where a length runs out; what is left over is filled from the longest down, with the longest
    that still fits, as many times at once as the lengths last.
    """
    left = counts.astype(np.int64).copy()
    steps: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            left[length] -= times
        steps.append((lengths, times))

    if left[window]:
        take((window,), int(left[window]))
    ways = combinations(window)
    ways = ways[(left[ways[:, 0]] > 0) & ((ways[:, 1] == 0) | (left[ways[:, 1]] > 0)) & ((ways[:, 2] == 0) | (left[ways[:, 2]] > 0))]
    if len(ways):
        solved = repeat_counts(left.astype(float), ways)
        for way in np.flatnonzero(solved >= 1):
            lengths = tuple(int(v) for v in ways[way] if v)
            fits = min(int(left[v]) // lengths.count(v) for v in lengths)
            times = min(int(solved[way]), fits)
            if times > 0:
                take(lengths, times)
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        lengths, room = [longest], window - longest
        need = {longest: 1}
        while room:
            fitting = [v for v in np.flatnonzero(left[: room + 1]).tolist() if left[v] > need.get(v, 0)]
            if not fitting:
                break
            best = fitting[-1]
            lengths.append(best)
            need[best] = need.get(best, 0) + 1
            room -= best
        take(tuple(lengths), int(min(left[v] // n for v, n in need.items())))
    return steps


def places(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list, list, list]]:
    """For each length: first rank, first sequence and offset of the places that the plan has for it."""
    out: dict[int, tuple[list, list, list]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for lengths, times in steps:
        offset = 0
        for length in lengths:
            ranks, sequences, offsets = out.setdefault(length, ([], [], []))
            ranks.append(filled.get(length, 0))
            sequences.append(sequence)
            offsets.append(offset)
            filled[length] = filled.get(length, 0) + times
            offset += length
        sequence += times
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """`pieces` with their rank, from 0, among those of the same length, in two steps: buckets by hash, then rows."""
    most = pieces.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, most // ROWS_PER_BUCKET)
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(KEY, "start"), F.lit(buckets)))
    ahead = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(KEY, "start"))
    return (dealt.withColumn("__inside", inside - 1).join(counts, ["length", "__bucket"])
            .withColumn("rank", F.col("__ahead") + F.col("__inside")).drop("__bucket", "__inside", "__ahead"))


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens, with little padding.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    document is its ids and an end id; a null text is an empty one, which is its end id alone. Each
    id lies in one piece; a document longer than the window is cut into full windows and a
    remainder. Repeated rows are packed each; an empty table gives no row. A worker process remembers
    twice `remembered` units, also while it serves other stages.
    """
    with small_batches(docs.sparkSession):
        pieces = written(cut_documents(docs, path or tokenizer_path(), window, remembered), "pieces")
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, count in pieces.groupBy("length").count().collect():
        counts[length] = count
    table = places(plan(counts, window))
    # The table has at most three entries per combination in use; it depends on the window, not on the corpus.
    table = {length: tuple(np.array(v, dtype=np.int64) for v in value) for length, value in table.items()}

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, edges) if len(order) else []:
            first, sequences, offsets = table[int(lengths[group[0]])]
            at = np.searchsorted(first, ranks[group], side="right") - 1
            sequence[group] = sequences[at] + ranks[group] - first[at]
            offset[group] = offsets[at]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked(pieces).withColumn("__place", place(F.col("length"), F.col("rank")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "__place.sequence_id", "__place.offset")
