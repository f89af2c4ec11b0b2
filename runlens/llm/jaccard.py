"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Every document becomes its set of hashed word n-grams. Documents with one and the same set form a
   class, and only classes are joined.
2. Shingles meet by hash range, as packed postings. Those of one class only are rare beyond help: no
   pair shares them. A class goes on only if its other shingles could still make a partner similar
   enough; nearly all documents end here.
3. The rest order their shingles rare first, and join on the prefix that no similar pair can miss. A
   pair must pass the length and the positional filter to leave the join, then the suffix filter
   (sizes of the two sets in fixed ranges of the hash), and is verified once, on the sets.
4. Groups of near copies are not expanded into all pairs: two rounds join each shingle's list to one
   leader only and merge what is linked; the last, exhaustive round joins in each list what is not in
   its largest component with all the others, so no link between components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import KEY, few_files, keyed, only, small_batches, text_of, with_key, written, names_kept
from runlens.llm.planes import mixed, packed, slice_of, unpacked

POSTINGS_PER_BLOB = 1_000_000
POSTINGS_PER_SLICE = 1_000_000
GROUP_BYTES = 1 << 18
RANGES = 64
# Shingles go by the upper 56 bits of their hash.
REST = np.uint64(8)


@dataclass(frozen=True)
class Likeness:
    """Sets are linked when 100 * intersection >= percent * union, over shingles of `n` words."""

    n: int = 3
    percent: int = 90

    def least(self, size):
        """The fewest shingles that a set of `size` shares with any set it is linked with."""
        return -((-self.percent * size) // 100)

    def shared(self, a: Column, b: Column) -> Column:
        """The fewest shingles that linked sets of these sizes share, as a column."""
        return F.ceil(F.lit(self.percent) * (a + b) / F.lit(100 + self.percent))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in UTF-8 bytes, A-Z as a-z, and where each begins."""
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    first, after = edges[0::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    lengths = after - first
    inside = np.flatnonzero(~space)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(begins, lengths)
    marks = mixed(data[inside].astype(np.uint64) | (place.astype(np.uint64) + np.uint64(1)) << np.uint64(8))
    return mixed(np.add.reduceat(marks, begins) ^ lengths.astype(np.uint64)), first


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than n words, but one, is one shingle."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    words, first = word_hashes(np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8))
    bounds = np.searchsorted(first, np.concatenate([[0], ends]))
    whole = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for j in range(n):
        whole = mixed(whole + words[j : j + len(whole)] * np.uint64(2 * j + 3))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for at in range(a, b):
                short = mixed(short + words[at : at + 1])
            yield short
        else:
            yield np.zeros(0, dtype=np.uint64)


def grouped_texts(texts: list) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        group.append(("" if text is None else text).encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=8).digest() if len(hashes) else b""


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """KEY, doc_id, n_shingles, digest (8 bytes that, with the size, tell sets apart; empty for an empty set)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, digests = [], []
            for texts in grouped_texts(batch["text"].tolist()):
                for hashes in shingle_sets(texts, n):
                    sizes.append(len(hashes))
                    digests.append(set_digest(hashes))
            yield pd.DataFrame({KEY: batch[KEY], "doc_id": batch["doc_id"], "n_shingles": sizes, "digest": digests})

    rows = docs.select(KEY, F.col("doc_id").cast("bigint"), text_of().alias("text"))
    return rows.mapInPandas(work, f"{KEY} bigint, doc_id bigint, n_shingles bigint, digest binary")


POSTINGS = "slice bigint, hashes binary, owners binary, digests binary, sizes binary"


def postings(docs: DataFrame, n: int, slices: int) -> DataFrame:
    """Packed postings by slice of the hash: each hash, in order, and which set of the blob has it."""

    def blob(sets: dict[bytes, np.ndarray]) -> Iterator[dict]:
        digests = np.frombuffer(b"".join(sets), dtype=">u8")
        sizes = np.array([len(s) for s in sets.values()], dtype=np.uint64)
        hashes = np.concatenate(list(sets.values()))
        sets.clear()
        owners = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes.astype(np.int64))
        order = np.argsort(hashes)
        hashes, owners = hashes[order], owners[order]
        del order
        slice_ = slice_of(hashes, slices).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(slice_)) + 1, [len(slice_)]])
        numbers = slice_[edges[:-1]].tolist()
        del slice_
        for number, a, b in zip(numbers, edges[:-1], edges[1:]):
            there, local = np.unique(owners[a:b], return_inverse=True)
            yield {"slice": number, "hashes": packed(hashes[a:b] >> REST, 7), "owners": packed(local.astype(np.uint64), 3),
                   "digests": digests[there].tobytes(), "sizes": packed(sizes[there], 5)}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            for texts in grouped_texts(batch["text"].tolist()):
                for hashes in shingle_sets(texts, n):
                    digest = set_digest(hashes)
                    if len(hashes) and digest not in sets:
                        sets[digest] = hashes
                        held += len(hashes)
                if held >= POSTINGS_PER_BLOB:
                    yield pd.DataFrame(list(blob(sets)))
                    held = 0
        if sets:
            yield pd.DataFrame(list(blob(sets)))

    return docs.select(text_of().alias("text")).mapInPandas(work, POSTINGS)


SHARED = "bucket bigint, digests binary, sizes binary, counts binary, ids binary"


def shared_postings(blobs: DataFrame, buckets: int) -> DataFrame:
    """Of each slice the shingles that two sets or more have, by bucket of the set's digest."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([unpacked(b, 7) for b in part["hashes"]])
        digests = np.concatenate([np.frombuffer(b, dtype=">u8") for b in part["digests"]]).astype(np.uint64)
        sizes = np.concatenate([unpacked(b, 5) for b in part["sizes"]])
        shift = np.cumsum([0] + [len(b) // 8 for b in part["digests"]])
        owners = np.concatenate([unpacked(b, 3).astype(np.int64) + s for b, s in zip(part["owners"], shift)])
        # One number per set, also where several blobs have it.
        order = np.lexsort((sizes, digests))
        digests, sizes = digests[order], sizes[order]
        new = np.concatenate([[True], (digests[1:] != digests[:-1]) | (sizes[1:] != sizes[:-1])])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        digests, sizes, owners = digests[new], sizes[new], number[owners]
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])
        hashes, owners = hashes[new], owners[new]
        edges = np.concatenate([[0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1, [len(hashes)]])
        often = np.repeat(np.diff(edges) > 1, np.diff(edges))
        ids, owners = hashes[often], owners[often]
        bucket = (digests % np.uint64(buckets)).astype(np.int64)[owners]
        order = np.lexsort((owners, bucket))
        ids, owners, bucket = ids[order], owners[order], bucket[order]
        rows = []
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]))):
            if b > a:
                there, counts = np.unique(owners[a:b], return_counts=True)
                rows.append({"bucket": int(bucket[a]), "digests": digests[there].astype(">u8").tobytes(), "sizes": packed(sizes[there], 5),
                             "counts": packed(counts.astype(np.uint64), 4), "ids": packed(ids[a:b], 7)})
        return pd.DataFrame(rows, columns=["bucket", "digests", "sizes", "counts", "ids"])

    return blobs.groupBy("slice").applyInPandas(work, SHARED)


LIVE = "digest binary, n bigint, ids array<bigint>"


def live_sets(shared: DataFrame, like: Likeness) -> DataFrame:
    """The sets that share enough shingles with others at all to be linked with one, with those shingles."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        digests = np.concatenate([np.frombuffer(b, dtype=">u8") for b in part["digests"]])
        sizes = np.concatenate([unpacked(b, 5) for b in part["sizes"]])
        counts = np.concatenate([unpacked(b, 4) for b in part["counts"]]).astype(np.int64)
        ids = np.concatenate([unpacked(b, 7) for b in part["ids"]])
        both = np.stack([digests, sizes.astype(">u8")], axis=1).view("V16").reshape(-1)
        _, first, number = np.unique(both, return_index=True, return_inverse=True)
        digests, sizes = digests[first].astype(">u8"), sizes[first].astype(np.int64)
        live = np.bincount(number, weights=counts, minlength=len(first)) >= like.least(sizes)
        owner = np.repeat(number, counts)
        chosen = live[owner]
        owner, ids = owner[chosen], ids[chosen]
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else np.array([0])
        rows = [(digests[owner[a] : owner[a] + 1].tobytes(), int(sizes[owner[a]]), ids[a:b].view(np.int64)) for a, b in zip(edges[:-1], edges[1:])]
        return pd.DataFrame(rows, columns=["digest", "n", "ids"])

    return shared.groupBy("bucket").applyInPandas(work, LIVE)


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (set, comp) after links (a, b) between components: each gets the least label it can reach.

    Every round each component takes the least label next to it, and the labels of labels thrice
    over; links inside a component go. The number of rounds is logarithmic in the longest chain.
    """
    edges = written(links.select("a", "b").where("a != b").distinct(), "edges")
    sets = labels.count()
    while left := edges.count():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("comp"), F.least("a", "b").alias("to"))
        step = written(few_files(step, 2 * left), "step")
        for _ in range(2):
            on = step.select(F.col("comp").alias("to"), F.col("to").alias("__next"))
            step = step.join(on, "to", "left").select("comp", F.coalesce("__next", "to").alias("to"))
        step = written(few_files(step, 2 * left), "parents")
        labels = labels.join(step, "comp", "left").select("set", F.coalesce("to", "comp").alias("comp"))
        labels = written(few_files(labels, sets), "labels")
        for end in ("a", "b"):
            moved = step.select(F.col("comp").alias(end), "to")
            edges = edges.join(moved, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = written(few_files(edges.where("a != b").distinct(), left), "edges")
    return labels


def prefixes(sets: DataFrame, like: Likeness) -> DataFrame:
    """id, set, n, place: the prefix of each set in rare-first order. `place` counts the rarer
    shingles before, those that no other set has among them."""
    own = sets.select("set", F.explode("ids").alias("id"))
    often = own.groupBy("id").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = own.join(often, "id").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("df", "id"))).alias("ordered"))
    ordered = ordered.join(sets.select("set", "n"), "set")
    least = F.ceil(F.lit(like.percent) * F.col("n") / 100).cast("int")
    first = F.slice("ordered", 1, F.greatest(F.lit(0), F.size("ordered") - least + 1))
    return (ordered.select("set", "n", F.size("ordered").alias("u"), F.posexplode(first).alias("k", "shingle"))
            .select(F.col("shingle.id").alias("id"), "set", "n", (F.col("n") - F.col("u") + F.col("k")).alias("place")))


def may_link(like: Likeness, a: str, b: str) -> Column:
    """Length and positional filter for two entries of one shingle's list."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n1 - F.col(f"{a}.place"), n2 - F.col(f"{b}.place"))
    return (100 * F.least(n1, n2) >= like.percent * F.greatest(n1, n2)) & (left >= like.shared(n1, n2))


def verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that are linked: suffix filter on small summaries, then the sets themselves."""
    small = sets.select("set", "n", (F.col("n") - F.size("ids")).alias("alone"), "ranges")
    for end in ("a", "b"):
        pairs = pairs.join(small.select(F.col("set").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "alone", "ranges")]), end)
    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    room = F.col("n_a") + F.col("n_b") - 2 * like.shared(F.col("n_a"), F.col("n_b"))
    left = written(pairs.where(F.col("alone_a") + F.col("alone_b") + apart <= room).select("a", "b", "n_a", "n_b"), "candidates")
    for end in ("a", "b"):
        left = left.join(sets.select(F.col("set").alias(end), F.col("ids").alias(f"ids_{end}")), end)
    common = F.size(F.array_intersect("ids_a", "ids_b"))
    linked = 100 * common >= like.percent * (F.col("n_a") + F.col("n_b") - common)
    return left.where(linked).select("a", "b")


def leaders(entries: DataFrame, labels: DataFrame, like: Likeness, seed: int) -> DataFrame:
    """Pairs (a, b) of each list's leader, the same for a seed, with the list's sets of other components."""
    placed = entries.join(labels, "set")
    first = placed.groupBy("id").agg(
        F.min_by(F.struct("set", "n", "place", "comp"), F.struct("place", F.xxhash64("set", F.lit(seed)), "set")).alias("lead"))
    pairs = placed.alias("x").join(first.select("id", "lead.*").alias("y"), "id")
    pairs = pairs.where((F.col("x.comp") != F.col("y.comp")) & may_link(like, "x", "y"))
    return pairs.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()


def others(entries: DataFrame, labels: DataFrame, like: Likeness) -> DataFrame:
    """All pairs (a, b) of different components that some list holds and the filters let pass.

    In each list, sets outside its largest component are joined with the whole list.
    """
    placed = written(entries.join(labels, "set"), "placed")
    parts = placed.groupBy("id", "comp").agg(F.count(F.lit(1)).alias("__n"))
    major = parts.groupBy("id").agg(F.max_by("comp", F.struct("__n", "comp")).alias("major"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed_lists = written(placed.join(major.select("id", "major"), "id"), "mixed")
    rest = mixed_lists.where("comp != major")
    pairs = rest.alias("x").join(mixed_lists.alias("y"), F.col("x.id") == F.col("y.id"))
    # Two sets outside the major component meet twice; once is enough.
    once = (F.col("y.comp") == F.col("y.major")) | (F.col("x.set") < F.col("y.set"))
    pairs = pairs.where((F.col("x.comp") != F.col("y.comp")) & once & may_link(like, "x", "y"))
    return pairs.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()


def in_components(links: DataFrame, labels: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("set").alias(end), F.col("comp").alias(f"c_{end}")), end)
    return links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))


def near_copies(docs: DataFrame, like: Likeness = Likeness(), leader_rounds: int = 2) -> DataFrame:
    """KEY, doc_id, n_shingles, component_id, component_key of every row of `docs`.

    component_id is the smallest doc_id that links lead to, component_key the key of its row. Texts without a word, and null ones, have
    no shingle and are linked with nothing; texts with fewer words than a shingle have one, the whole
    sequence. Rows with equal sets are linked, repeated rows among them; a null doc_id is passed over
    where there is another. Texts of any length are read whole; an empty table gives no row.
    """
    rows = keyed(docs, "text")
    with small_batches(rows.sparkSession):
        sets = written(set_table(rows, like.n), "sets")
        size = (sets.agg(F.sum("n_shingles")).first()[0] or 0)
        slices = max(1, -(-size // POSTINGS_PER_SLICE))
        shared = shared_postings(postings(rows, like.n, slices), slices)
        live = written(live_sets(shared, like), "live")
        numbered = written(with_ranges(live.withColumn("set", F.monotonically_increasing_id())), "numbered")
    entries = written(prefixes(numbered, like), "prefixes")
    labels = written(numbered.select("set", F.col("set").alias("comp")), "labels")
    for seed in range(leader_rounds):
        links = in_components(verified(leaders(entries, labels, like, seed), numbered, like), labels)
        labels = merged_labels(labels, links)
    links = in_components(verified(others(entries, labels, like), numbered, like), labels)
    labels = merged_labels(labels, links)

    # The row that names a component: smallest doc_id, null last, then smallest key.
    name = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY))
    same = ["digest", "n_shingles"]
    classes = sets.where("n_shingles > 0").groupBy(*same).agg(name.alias("first"))
    member = numbered.select("set", "digest", F.col("n").alias("n_shingles")).join(labels, "set").join(classes, same)
    least = member.groupBy("comp").agg(F.min("first").alias("least"))
    linked = member.join(least, "comp").select(*same, "least")
    classes = written(classes.join(linked, same, "left").select(*same, F.coalesce("least", "first").alias("first")), "classes")
    full = sets.where("n_shingles > 0").join(classes, same)
    full = full.select(KEY, "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), F.col("first")[KEY].alias("component_key"))
    empty = sets.where("n_shingles = 0").select(KEY, "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col(KEY).alias("component_key"))
    return full.unionAll(empty)


def with_ranges(sets: DataFrame) -> DataFrame:
    """`sets` with `ranges`: how many of the shingles lie in each of RANGES ranges of the hash."""

    @F.pandas_udf("array<int>")
    def count(ids: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(i) >> 50, minlength=RANGES).astype(np.int32) for i in ids])

    return sets.withColumn("ranges", count("ids"))


@names_kept
def one_of_each(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """`docs` with one row of each group of linked documents, all columns as they were.

    The row that names the component stays: the one of smallest doc_id, of repeated ones the one with
    the least key. A row without shingles is a group of its own.
    """
    rows = with_key(docs)
    return only(rows, near_copies(rows, like).where(F.col(KEY) == F.col("component_key")))
