"""Spelling variants: PartEnum signatures of letter multisets, equi-joined and verified.

A word is seen as a binary vector with one dimension per letter and occurrence. One code point put
in or taken out changes one dimension, one replaced changes two. Letters are dealt to parts; words
of one length at a distance of two agree on all but two parts, words whose lengths differ by one on
all but one. Each choice of the parts that agree is a signature, kept with the length, so no near
pair is missed. One edit also leaves the first or the second half of a word as it is; a signature
is taken once with either half, so that words of a few frequent syllables do not meet in one group.
Words that share a signature are compared in the join itself: no pair leaves it unverified.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ascii_lower, text_of, written

RUN = "([a-zÀ-ÿ]+)"
LEAST_LENGTH = 7
LEAST_COUNT = 2
TYPO_MODULUS = 31
RATIO = 10
SAME_PARTS, OTHER_PARTS = 4, 2


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts with their number of occurrences.

    Words are runs of Latin letters with A to Z in lower case. Where 31 divides the crc32 of
    `<doc_id>:<run>`, the code point at that crc32 modulo the length is left out. A null text has no
    word; a null doc_id counts as an empty one.
    """
    pattern = RUN.replace("+", "{%d,}" % least_length)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                       F.explode(F.regexp_extract_all(ascii_lower(text_of()), F.lit(pattern), F.lit(1))).alias("run"))
    mark = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (F.col("mark") % F.length("run")).cast("int")
    word = F.when(F.col("mark") % TYPO_MODULUS == 0,
                  F.concat(F.col("run").substr(F.lit(1), at), F.expr("substring(run, int(mark % length(run)) + 2)"))).otherwise(F.col("run"))
    words = runs.withColumn("mark", mark).select(word.alias("word"))
    counts = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least_count)


def letter_parts(words: DataFrame, parts: int) -> list[str]:
    """The letters that occur, dealt to `parts` strings so that each holds about as many occurrences.

    One row per letter comes to the driver, as many as the alphabet has.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    load, dealt = [0] * parts, [""] * parts
    for letter, count in sorted(((r[0], r[1]) for r in letters.collect()), key=lambda x: (-x[1], x[0])):
        least = load.index(min(load))
        load[least] += count
        dealt[least] += letter
    return dealt


def signatures(parts: list[str], differ: int, tag: str, length: Column, first: Column, second: Column) -> Column:
    """The hashes of a word for every choice of `differ` parts that are left out, with either half."""
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    everything = "".join(parts)

    def held(part: str) -> Column:
        rest = "".join(c for c in everything if c not in part)
        return F.translate(ordered, rest, "") if rest else ordered

    chosen = list(combinations(range(len(parts)), len(parts) - differ))
    return F.array(*[F.xxhash64(F.lit(f"{tag} {keep} {side}"), length, half, *[held(parts[p]) for p in keep])
                     for keep in chosen for side, half in (("first", first), ("second", second))])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: the pairs of `words` one code point apart, in both directions, once each."""
    length = F.length("word")

    def keys(parts: list[str], differ: int, tag: str, shorter: Column) -> DataFrame:
        middle = F.floor(shorter / 2)
        found = signatures(parts, differ, tag, shorter, F.left("word", middle), F.right("word", shorter - middle))
        return words.select("word", "n", F.explode(found).alias("signature"))

    def renamed(df: DataFrame) -> DataFrame:
        return df.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("signature"))

    close = F.levenshtein("word", "other", 1) == 1
    four, two = letter_parts(words, SAME_PARTS), letter_parts(words, OTHER_PARTS)
    same = keys(four, 2, "same", length)
    left, right = same.alias("l"), renamed(same).alias("r")
    swapped = left.join(right, (F.col("l.signature") == F.col("r.signature")) & (F.col("word") < F.col("other")) & close)
    short, long = keys(two, 1, "other", length).alias("l"), renamed(keys(two, 1, "other", length - 1)).alias("r")
    longer = short.join(long, (F.col("l.signature") == F.col("r.signature")) & close)
    pairs = swapped.select("word", "n", "other", "other_n").unionAll(longer.select("word", "n", "other", "other_n"))
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"),
                             F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                      F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(both.alias("p")).select("p.*").repartition("word").dropDuplicates(["word", "other"])


def roots(linked: DataFrame, depth: int) -> DataFrame:
    """word, root of the rows word, form of `linked`: forms followed to the last, twice as far each time."""
    reached = linked.select("word", F.col("form").alias("root"))
    for step in range(max(0, math.ceil(math.log2(max(1, depth))))):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("__onward"))
        further = reached.join(onward, "root", "left")
        reached = written(further.select("word", F.coalesce("__onward", "root").alias("root")), f"roots-{step}")
    return reached


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of `words` (word, n; each word once).

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's
    form is its near word of largest n, of ties the first in code-point order, if that n is at least
    `ratio` times the word's; root is where forms lead to, the word itself without one. A word
    without near words has n_near 0. An empty table gives no row.
    """
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    best_n = -F.col("best.minus")
    enough = best_n >= F.lit(ratio) * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, best_n).alias("form_n"))
    table = written(table, "forms")
    most = table.agg(F.max("n")).first()[0] or 1
    # Every step multiplies n by the ratio or more, which bounds the length of a chain.
    depth = int(math.log(most, ratio)) + 1
    last = roots(table.filter("form is not null"), depth)
    return table.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of all `docs` (doc_id, text) with their forms; see `word_counts` and `spelling_forms`.

    Repeated rows count again; extra columns are not looked at; an empty table gives no row.
    """
    return spelling_forms(written(word_counts(docs), "words"))
