"""Comparing artifact trees and their files, and finding copies.

A snapshot has `name` (relative to its root), `sha256` and `size`; an unreadable file
keeps its row with nulls. Where contents are compared they are columns of the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numbers import count_if
from runlens.functions.text import base_name, compound_extension
from runlens.operators.ordered import along, join_on, rank, top_per_group
from runlens.session import checkpointed

# What ends a line, and keys that say nothing about a result.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
VOLATILE_KEYS = ["duration", "duration_seconds", "elapsed", "timestamp", "date", "job_id"]
MAX_LINES = 40
MAX_LINE_CHARS = 200
# No limit: an array of bytes is never longer.
WHOLE = 2**31 - 1
CHUNK = 4096
MAX_EXTENSIONS = 8
WALK_BUDGET = 5000


def snapshot(files: DataFrame, content: str = "content") -> DataFrame:
    """Name, hash and size of every file, hashed where the file is read."""
    return files.select("name", F.sha2(F.col(content).cast("binary"), 256).alias("sha256"),
                        F.octet_length(content).cast("long").alias("size"))


def compare_artifacts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each name with where it is and whether it is the same: identical, differing, only_left, only_right."""
    both = left.select("name", F.col("sha256").alias("_l"), F.lit(True).alias("_in_l")).join(
        right.select("name", F.col("sha256").alias("_r"), F.lit(True).alias("_in_r")), "name", "full")
    status = (F.when(F.col("_in_r").isNull(), "only_left").when(F.col("_in_l").isNull(), "only_right")
              .when(F.col("_l").eqNullSafe(F.col("_r")), "identical").otherwise("differing"))
    return both.select("name", status.alias("status"))


def parity_summary(compared: DataFrame) -> DataFrame:
    """How many names of each status, and whether the trees are the same."""
    counts = compared.agg(*[count_if(F.col("status") == s).alias(s)
                            for s in ("identical", "differing", "only_left", "only_right")])
    return counts.withColumn("ok", F.col("differing") + F.col("only_left") + F.col("only_right") == 0)


def pair_renamed(left: DataFrame, right: DataFrame, substitutions: Sequence[tuple[str, str]]) -> DataFrame:
    """Second pass over unmatched names: a left name rewritten by the substitutions, in order, is
    looked up on the right. Each row says whether the contents agree; `content_ok` sums it up."""
    # Hashes only, met once and kept: every later step works on what one full join found.
    both = checkpointed(left.select("name", F.col("sha256").alias("_l"), F.lit(True).alias("_in_l")).join(
        right.select("name", F.col("sha256").alias("_r"), F.lit(True).alias("_in_r")), "name", "full"))
    rewritten = F.col("name")
    for old, new in substitutions:
        rewritten = F.replace(rewritten, F.lit(old), F.lit(new))
    alone = both.filter(F.col("_in_r").isNull()).select("name", "_l", rewritten.alias("candidate"))
    there = both.filter(F.col("_in_l").isNull()).select(F.col("name").alias("candidate"), F.col("_r").alias("_there"),
                                                        F.lit(True).alias("_found"))
    # Of several left names leading to one candidate the first by name takes it.
    takers = alone.filter(F.col("candidate") != F.col("name")).groupBy("candidate").agg(F.min("name").alias("_taker"))
    meant = alone.join(takers, "candidate", "left").join(there, "candidate", "left")
    paired = F.col("_found") & (F.col("name") == F.col("_taker"))
    lefts = meant.select(
        F.col("name").alias("left_name"), F.when(paired, F.col("candidate")).alias("right_name"),
        F.when(~F.coalesce(paired, F.lit(False)), "unpaired_left").when(F.col("_l").eqNullSafe(F.col("_there")), "identical")
        .otherwise("differing").alias("status"))
    rights = there.join(takers, "candidate", "left_anti").select(
        F.lit(None).cast("string").alias("left_name"), F.col("candidate").alias("right_name"), F.lit("unpaired_right").alias("status"))
    rows = lefts.unionByName(rights)
    strict = both.agg(count_if(F.col("_in_l") & F.col("_in_r") & ~F.col("_l").eqNullSafe(F.col("_r"))).alias("_strict"))
    judged = rows.agg(count_if(F.col("status") != "identical").alias("_bad")).join(F.broadcast(strict)).select(
        (F.col("_bad") + F.col("_strict") == 0).alias("content_ok"))
    return rows.join(F.broadcast(judged))


def _kind(value: str) -> Column:
    shape = F.schema_of_variant(value)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("value")


def _same_values(one: str, two: str) -> Column:
    """Equal as JSON values; numbers by what they are worth, not by how they are written."""
    number = lambda v: F.try_variant_get(v, "$", "double")
    digits = lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return (F.to_json(one) == F.to_json(two)) | F.coalesce(digits(one) & digits(two) & (number(one) == number(two)), F.lit(False))


def json_key_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Which keys differ between two JSON documents of the same name, as dotted paths.

    A list of another length is named once and not descended into; a document that does not parse
    has a null path and `readable` false. Only documents of another text meet: hashes are joined
    first. Both are then opened a level at a time, all documents at once, for as many levels as there
    are; parts that are equal go no further.
    """
    hashed = lambda side, to: side.select("name", F.sha2("content", 256).alias(to), F.try_parse_json("content").isNull().alias(f"{to}_bad"))
    meant = hashed(left, "_lh").join(hashed(right, "_rh"), "name")
    meant = checkpointed(meant.filter(~F.col("_lh").eqNullSafe(F.col("_rh")) | F.col("_lh_bad")).select("name", (F.col("_lh_bad") | F.col("_rh_bad")).alias("bad")))
    parsed = lambda side, to: side.join(meant.filter(~F.col("bad")).select("name"), "name", "left_semi").select(
        "name", F.parse_json("content").alias(to))
    found = [meant.filter("bad").select("name", F.lit(False).alias("readable"), F.lit(None).cast("string").alias("path"))]
    level = parsed(left, "_l").join(parsed(right, "_r"), "name").withColumn("_path", F.lit(""))
    while True:
        # Variants are written as text, which every file format holds.
        level = level.filter(~_same_values("_l", "_r")).select("name", "_path", F.to_json("_l").alias("_l"), F.to_json("_r").alias("_r"))
        level = checkpointed(level).withColumns({"_l": F.parse_json("_l"), "_r": F.parse_json("_r")})
        if level.isEmpty():
            break
        level = level.withColumns({"_kind": F.when(_kind("_l") == _kind("_r"), _kind("_l")).otherwise("value")})
        below = lambda part: F.when(F.col("_path") == "", part).otherwise(F.concat("_path", F.lit("."), part))
        leaves = level.filter("_kind = 'value'").select(
            "name", F.lit(True).alias("readable"), F.when(F.col("_path") == "", "<root>").otherwise(F.col("_path")).alias("path"))
        maps = level.filter("_kind = 'object'").select(
            "name", "_path", *[F.try_variant_get(c, "$", "map<string,variant>").alias(c) for c in ("_l", "_r")])
        keys = maps.select("*", F.explode(F.array_union(F.map_keys("_l"), F.map_keys("_r"))).alias("_key"))
        both = F.map_contains_key("_l", F.col("_key")) & F.map_contains_key("_r", F.col("_key"))
        alone = keys.filter(~both).select("name", F.lit(True).alias("readable"), below(F.col("_key")).alias("path"))
        inner = keys.filter(both).select("name", *[F.element_at(c, F.col("_key")).alias(c) for c in ("_l", "_r")], below(F.col("_key")).alias("_path"))
        lists = level.filter("_kind = 'array'").select(
            "name", "_path", *[F.try_variant_get(c, "$", "array<variant>").alias(c) for c in ("_l", "_r")])
        uneven = lists.filter(F.size("_l") != F.size("_r")).select(
            "name", F.lit(True).alias("readable"), F.concat("_path", F.lit("[length]")).alias("path"))
        items = lists.filter(F.size("_l") == F.size("_r")).select("name", "_path", F.posexplode(F.arrays_zip("_l", "_r")).alias("_i", "_x")).select(
            "name", F.col("_x._l").alias("_l"), F.col("_x._r").alias("_r"), F.concat("_path", F.lit("["), "_i", F.lit("]")).alias("_path"))
        found += [leaves, alone, uneven]
        level = inner.unionByName(items)
    return reduce(DataFrame.unionByName, found)


def lines_of(text: Column) -> Column:
    """The lines of a text; a final line end starts no further line."""
    lines = F.split(text, LINE_ENDS)
    return F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def text_line_diff(left: DataFrame, right: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """Lines that differ at equal positions, the first `max_lines` of each file, with both line counts.

    Files without a difference have one row with a null line.
    """
    pairs = left.select("name", F.col("content").alias("_a")).join(
        right.select("name", F.col("content").alias("_b")), "name").select(
        "name", (F.col("_a") == F.col("_b")).alias("_same"), lines_of(F.col("_a")).alias("_l"), lines_of(F.col("_b")).alias("_r"))
    shared = F.least(F.size("_l"), F.size("_r"))
    numbers = F.when(~F.col("_same") & (shared > 0), F.sequence(F.lit(1), shared)).otherwise(F.array().cast("array<int>"))
    changed = F.filter(numbers, lambda i: F.get(F.col("_l"), i - 1) != F.get(F.col("_r"), i - 1))
    found = pairs.withColumn("_changed", F.slice(changed, 1, max_lines))
    return found.select(
        "name", F.size("_l").alias("left_lines"), F.size("_r").alias("right_lines"),
        (F.size("_changed") >= max_lines).alias("truncated"), "_l", "_r",
        F.explode_outer("_changed").alias("line")).select(
        "name", "left_lines", "right_lines", "truncated", "line",
        F.substring(F.get("_l", F.col("line") - 1), 1, MAX_LINE_CHARS).alias("left"),
        F.substring(F.get("_r", F.col("line") - 1), 1, MAX_LINE_CHARS).alias("right"))


def byte_diff(left: DataFrame, right: DataFrame, limit: int = WHOLE) -> DataFrame:
    """Where two files first differ and how many of their common bytes do.

    Equal blocks are skipped whole; only the bytes of differing ones are looked at. Past
    `limit` bytes, if one is given, only sizes and the first difference are reported.
    """
    pairs = left.select("name", F.col("content").cast("binary").alias("_l")).join(
        right.select("name", F.col("content").cast("binary").alias("_r")), "name")
    sized = pairs.withColumns({"left_size": F.octet_length("_l"), "right_size": F.octet_length("_r")}).withColumn(
        "compared_bytes", F.least("left_size", "right_size", F.lit(limit)))

    def part(side: str, start: Column, length) -> Column:
        return F.substring(F.col(side), start + 1, F.lit(length) if isinstance(length, int) else length)

    starts = F.when(F.col("compared_bytes") > 0, F.sequence(F.lit(0), F.col("compared_bytes") - 1, F.lit(CHUNK))).otherwise(
        F.array().cast("array<int>"))
    width = lambda s: F.least(F.lit(CHUNK), F.col("compared_bytes") - s)
    blocks = F.filter(starts, lambda s: part("_l", s, width(s)) != part("_r", s, width(s)))
    marked = sized.withColumn("_blocks", blocks)

    def unequal(start: Column) -> Column:
        return F.filter(F.sequence(start, start + width(start) - 1), lambda i: part("_l", i, 1) != part("_r", i, 1))

    count = F.aggregate("_blocks", F.lit(0), lambda total, s: total + F.size(unequal(s)))
    first = F.when(F.size("_blocks") > 0, F.array_min(unequal(F.get("_blocks", 0)))).when(
        (F.col("left_size") != F.col("right_size")) & (F.col("compared_bytes") < limit), F.col("compared_bytes"))
    truncated = F.greatest("left_size", "right_size") > limit
    return marked.select(
        "name", *[F.col(c).cast("long").alias(c) for c in ("left_size", "right_size", "compared_bytes")],
        truncated.alias("truncated"), first.cast("long").alias("first_differing_offset"),
        F.when(~truncated, count).cast("long").alias("differing_bytes")).withColumn(
        "differing_fraction", F.when(~truncated, F.when(F.col("compared_bytes") > 0, F.col("differing_bytes") / F.col(
            "compared_bytes")).otherwise(0.0)))


def numeric_distance(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """How far two arrays of a row are apart, element by element; null with a reason when sizes differ."""
    same = F.size(left) == F.size(right)
    gaps = F.when(same, F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    n = F.size("_gaps")

    def over(value: Column) -> Column:
        return F.when(n > 0, value).when(n == 0, 0.0)

    def total(f) -> Column:
        return F.aggregate("_gaps", F.lit(0.0), lambda s, x: s + f(x))

    return pairs.withColumn("_gaps", gaps).withColumns({
        "size_equal": same, "elements": F.when(same, n).cast("long"),
        "differing": F.when(same, F.size(F.filter("_gaps", lambda x: x != 0))).cast("long"),
        "max_abs": over(F.array_max("_gaps")), "mean_abs": over(total(lambda x: x) / n),
        "rms": over(F.sqrt(total(lambda x: x * x) / n)),
        "reason": F.when(~same, "the two do not have the same size")}).withColumn(
        "differing_fraction", F.when(F.col("elements") > 0, F.col("differing") / F.col("elements")).when(
            F.col("elements") == 0, 0.0)).drop("_gaps", left, right)


def exact_dedup(files: DataFrame, min_bytes: int = 1 << 20) -> DataFrame:
    """Copies to relink: every file but the first of those with one size and one content.

    The first is the one that a walk of the tree meets first: in each folder its files by name, then its
    folders by name.

    `files` has (path, size, sha256). Only the hash travels, so a group of copies is reduced
    to its keeper before the keepers are joined back.
    """
    # Kept, so that contents are read and hashed once: a row is a path and a hash from here on.
    big = checkpointed(files.filter(F.col("size") >= min_bytes).select("path", "size", "sha256"))
    parts = F.split("path", "/")
    walk = F.transform(parts, lambda part, i: F.struct((i < F.size(parts) - 1).alias("folder"), part.alias("name")))
    keepers = big.groupBy("size", "sha256").agg(F.min_by("path", walk).alias("keeper"), F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > 1).drop("_n")
    return join_on(big, keepers, ["size", "sha256"]).filter(F.col("path") != F.col("keeper")).select(
        "path", "keeper", F.col("size").alias("freed"))


def shared_copies(entries: DataFrame, min_bytes: int = 1024) -> DataFrame:
    """Files of one distribution found in several environments: bytes saved by one inode, or wasted by several."""
    groups = entries.groupBy("distribution", "path").agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct("inode").alias("inodes"),
        F.min_by("size", "environment").alias("size")).filter(F.col("copies") > 1)
    extra = F.col("size") * (F.col("copies") - 1)
    return groups.select(
        "distribution", "path", "copies", "inodes", F.when(F.col("inodes") == 1, extra).otherwise(0).alias("saved"),
        F.when((F.col("inodes") > 1) & (F.col("size") >= min_bytes), extra).otherwise(0).alias("wasted"))


def _digests(batches: Iterator[pyarrow.RecordBatch], keys: list[str]) -> Iterator[pyarrow.RecordBatch]:
    """The digest of each tree of a partition sorted by tree and path, its files streamed through one hash."""
    tree, files, digest, schema, found = None, 0, None, None, []

    def rows() -> pyarrow.RecordBatch:
        columns = [pyarrow.array([f[0][i] for f in found], schema.field(k).type) for i, k in enumerate(keys)]
        return pyarrow.record_batch([*columns, pyarrow.array([f[1] for f in found], pyarrow.int64()),
                                     pyarrow.array([f[2] for f in found], pyarrow.string())], names=[*keys, "files", "digest"])

    for batch in batches:
        schema = batch.schema
        for *name, path, content in zip(*[batch.column(c).to_pylist() for c in [*keys, "path", "content"]]):
            if digest is None or name != tree:
                if digest is not None:
                    found.append((tree, files, digest.hexdigest()))
                tree, files, digest = name, 0, hashlib.sha256()
            files += 1
            for piece in (path, b"\0", content, b"\0"):
                digest.update(piece)
        if found:
            yield rows()
            found = []
    if digest is not None:
        found = [(tree, files, digest.hexdigest())]
        yield rows()


def tree_fingerprint(files: DataFrame, stored: DataFrame | None = None, keys: Sequence[str] = ("tree",)) -> DataFrame:
    """One sha256 per tree: of every file its path, a zero byte, its bytes and a zero byte, in the order of path parts.

    What a Python interpreter generates does not count. The digest is sequential by its definition, so the files
    of a tree go through one task, sorted, and are streamed: it holds a batch of them. With `stored`
    digests a tree is `stale` when its own differs. A null content counts as an empty file.
    """
    keys = list(keys)
    counted = files.filter(~F.concat(F.lit("/"), "path").contains("/__pycache__/") & ~F.col("path").rlike(r"[^/]\.(pyc|pyo)$"))
    rows = counted.select(*keys, F.col("path").cast("binary").alias("path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"),
                          F.split("path", "/").alias("_parts"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "_parts").drop("_parts")
    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], "files bigint", "digest string"])
    out = ordered.mapInArrow(lambda batches: _digests(batches, keys), schema)
    if stored is None:
        return out
    return join_on(out, stored.select(*keys, F.col("digest").alias("_stored")), keys, "left").select(
        *keys, "files", "digest", (~F.col("digest").eqNullSafe(F.col("_stored"))).alias("stale"))


def input_shape(files: DataFrame, budget: int = WALK_BUDGET, order: Sequence[str] = ("path",)) -> DataFrame:
    """Per run and argument: files, bytes, up to eight extensions, and whether the walk was cut short.

    `files` has (run_id, argument, hosted, path, size). A hosted name is kept, an uploaded one never.
    """
    keys = ["run_id", "argument"]
    placed = along(files, keys, order, _number=rank())
    walked = placed.filter(F.col("_number") <= budget)
    counts = placed.filter(F.col("_number") <= budget + 1).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("_number") <= budget, F.col("size"))).alias("bytes"),
        F.max("hosted").alias("_root"), (F.max("_number") > budget).alias("partial"))
    kinds = walked.select(*keys, compound_extension(F.col("path")).alias("_e")).filter(F.col("_e") != "").distinct()
    listed = top_per_group(kinds, keys, [F.col("_e")], MAX_EXTENSIONS).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("_e")), " ").alias("extensions"))
    return join_on(counts, listed, keys, "left").select(
        *keys, "files", "bytes", F.coalesce("extensions", F.lit("")).alias("extensions"), "partial",
        F.when(F.col("_root").isNotNull(), base_name(F.rtrim(F.col("_root"), F.lit("/")))).alias("hosted"))


def term_counts(texts: DataFrame, terms: Sequence[str], budget: int | None = None, text: str = "text") -> DataFrame:
    """Whole-word hits of a list of terms in each text, in any case, and which terms were found."""
    pattern = F.lit(r"(?Ui)\b(" + "|".join(sorted(terms, key=len, reverse=True)) + r")\b")
    found = texts.withColumn("_hits", F.transform(F.regexp_extract_all(F.col(text), pattern, F.lit(1)), F.lower))
    return found.withColumns({
        "hits": F.size("_hits"), "words": F.array_join(F.array_sort(F.array_distinct("_hits")), " "),
        "over_budget": F.lit(False) if budget is None else F.size("_hits") > budget}).drop("_hits", text)


def normalize_paths(rows: DataFrame, roots: Sequence[str], ignored: Sequence[str] = tuple(VOLATILE_KEYS)) -> DataFrame:
    """Result rows (key, value) with absolute paths named by what they point at, volatile keys left out."""
    value = F.col("value")
    named = F.lit(None).cast("string")
    for root in reversed(list(roots)):
        bare = root.rstrip("/")
        named = (F.when(value == root, "<output root>").when(
            F.startswith(value, F.lit(bare + "/")),
            F.concat(F.lit("<artifact:"), F.substring(value, F.lit(len(bare) + 2), F.char_length(value)), F.lit(">")))
            .otherwise(named))
    return rows.filter(~F.col("key").isin(list(ignored))).withColumn(
        "value", F.when(F.startswith(value, F.lit("/")), F.coalesce(named, F.lit("<path>"))).otherwise(value))


def only_right(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names on the right that the left does not have."""
    return right.select("name").join(left.select("name"), "name", "left_anti").distinct()


def key_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """The names of either side."""
    return left.select("name").union(right.select("name")).distinct()


def ordered_distinct(rows: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Distinct values with their place in first-seen order."""
    firsts = rows.groupBy(value).agg(F.min(F.struct(*order)).alias("_place"))
    return along(firsts, [], ["_place"], position=rank()).select(value, "position")
