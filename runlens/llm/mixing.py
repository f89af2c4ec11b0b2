"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a shuffled order. They are served in packets of at most
`packet_words` words; a packet's virtual finish time is the number of words its source has then
served, over the source's target. Served in that order, every source nears its target at the same
pace. The packets are range-sorted by finish time over the whole table and cut off at the budget,
inside a packet where need be, so the words taken sum to the budget exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import (
    names_kept,
    KEY, SPACE, WORD, before_each, in_ranges, keyed, numbered, only, text_of, with_key, written,
)

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
PACKET_WORDS = 256
# Rows of one source that one task sorts; sources with more are cut by ranges of the shuffle key.
ROWS_PER_BUCKET = 4_000
SHUFFLE_BITS = 60


def word_count(text: Column) -> Column:
    """The number of runs of characters other than space, tab, newline and the like."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 pseudo-random bits per id: the order in which a source's documents queue."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, SHUFFLE_BITS // 4), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """source, source_size -> rank, weight and target of each source.

    Weights repeat over the sources in code-point order, null last. Targets share the whole size
    by weight; none is above `most_passes` times its source's size, and what is above goes to the
    others by weight until none is. An empty source has target 0.
    """
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "sources", "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_passes), "weighted")
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = total / all_weight if total else 0.0
    while total:
        # The level only rises, so sources once capped stay capped; it settles after as many
        # rounds as there are distinct (cap, weight) classes at most, in practice a few.
        free = F.col("weight") * F.lit(level) <= F.col("cap")
        free_weight, held = ranked.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, F.col("cap")))).first()
        if not free_weight:
            break
        settled, level = level, (total - (held or 0)) / free_weight
        if level <= settled:
            break
    target = F.least(F.col("weight") * F.lit(float(level)), F.col("cap").cast("double"))
    return ranked.withColumn("target", target).drop("cap")


def queued(docs: DataFrame, seed: int, weights: tuple[int, ...], most_passes: int) -> DataFrame:
    """One row per document: KEY, doc_id, size, source_size, target, place in the queue (turn), words ahead of it."""
    rows = keyed(docs, "text", "source")
    sized = written(rows.select(KEY, "doc_id", "source", word_count(text_of()).alias("size"),
                                shuffle_key(F.col("doc_id"), seed).alias("turn")), "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    aims = written(targets(per_source, weights, most_passes), "targets")
    largest = aims.agg(F.max("rows")).first()[0] or 0
    bits = max(0, (largest // ROWS_PER_BUCKET).bit_length())
    aimed = sized.join(aims.select(F.col("source").alias("__source"), "rank", "source_size", "target"),
                       F.col("source").eqNullSafe(F.col("__source")))
    aimed = written(aimed.withColumn("bucket", F.shiftright("turn", SHUFFLE_BITS - bits))
                    .select(KEY, "doc_id", "size", "rank", "source_size", "target", "turn", "bucket"), "aimed")
    # A running sum per source in two steps: over buckets of the shuffle key, and inside a bucket.
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = aimed.groupBy("rank", "bucket").agg(F.sum("size").alias("__words"))
    buckets = buckets.select("rank", "bucket", F.coalesce(F.sum("__words").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("rank", "bucket").orderBy("turn", KEY).rowsBetween(Window.unboundedPreceding, -1)
    return written(
        aimed.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(buckets, ["rank", "bucket"])
        .withColumn("ahead", F.col("__ahead") + F.col("__inside")).drop("__ahead", "__inside", "bucket", "rank"), "queued")


def packets(packet_words: int, most_passes: int) -> Column:
    """The packets of a queued document, over all the passes its source may need, as structs."""
    passes = F.least(F.lit(most_passes), F.floor(F.col("target") / F.col("source_size")).cast("int") + 1)
    count = F.ceil(F.col("size") / packet_words).cast("int")

    def packet(round_: Column, k: Column) -> Column:
        end = F.least(F.col("size"), (k + 1) * packet_words)
        finish = (round_ * F.col("source_size") + F.col("ahead") + end).cast("double") / F.col("target")
        return F.struct(finish.alias("finish"), F.col("turn").alias("turn"), F.col(KEY).alias("key"),
                        round_.alias("round"), k.alias("k"), (end - k * packet_words).alias("words"))

    rounds = F.sequence(F.lit(0), passes - 1)
    made = F.flatten(F.transform(rounds, lambda r: F.transform(F.sequence(F.lit(0), count - 1), lambda k: packet(r, k))))
    return F.when((F.col("size") > 0) & (F.col("target") > 0), made)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES,
        packet_words: int = PACKET_WORDS, seed: int = 0) -> DataFrame:
    """How many words of each document a mix of its sources takes.

    One row per row of `docs`: KEY, doc_id, size, source_size, target, taken. A document may be
    taken up to `most_passes` times, whole but for the last time, when its first words are taken.
    Null texts and texts without a word have size 0 and give nothing; a null source is a source of
    its own, after the others; an empty table gives no row. Repeated rows are documents of their
    own. The order in a source comes from `seed` and doc_id alone, so that reruns agree.
    """
    queue = queued(docs, seed, weights, most_passes)
    budget = queue.agg(F.sum("size")).first()[0] or 0
    order = ["finish", "turn", "key", "round", "k"]
    served = in_ranges(queue.select(F.explode(packets(packet_words, most_passes)).alias("p")).select("p.*"), order, "packets")
    before, total = before_each(served, F.col("words"))
    columns = (KEY, "doc_id", "size", "source_size", "target")
    if not budget or total <= budget:
        every = F.expr("coalesce(aggregate(packets, 0L, (a, p) -> a + p.words), 0L)")
        return queue.withColumn("packets", packets(packet_words, most_passes)).select(*columns, every.alias("taken"))
    crossing = max(part for part, amount in before.items() if amount < budget)
    running = F.sum("words").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = (
        served.where(F.col("__part") == crossing).withColumn("upto", running + before[crossing])
        .where(F.col("upto") >= budget).orderBy(*order).first()
    )
    cut = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in
                     zip(order, ("double", "bigint", "bigint", "int", "int"))])
    rest = budget - (last["upto"] - last["words"])

    def taken(p: Column) -> Column:
        place = F.struct(*[p[c].alias(c) for c in order])
        return F.when(place < cut, p["words"]).when(place == cut, F.lit(rest)).otherwise(F.lit(0))

    words = F.aggregate(packets(packet_words, most_passes), F.lit(0).cast("bigint"),
                        lambda sum_, p: sum_ + taken(p).cast("bigint"))
    return queue.select(*columns, F.coalesce(words, F.lit(0)).alias("taken"))


@names_kept
def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of the mix: a document as often as it is taken, all columns as they were.

    Where only the first words of a text are taken, its text ends after them, with one blank
    between words, and n_chars, if there is such a column, is its length.
    """
    rows = with_key(docs)
    shares = mix(rows, **parameters).where("taken > 0").select(KEY, F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    whole = F.floor(F.col("__taken") / F.col("__size")).cast("int")
    rest = (F.col("__taken") % F.col("__size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    first = F.array_join(F.slice(F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE), 1, F.greatest(F.col("__cut"), F.lit(1))), " ")
    out = rows.join(shares, KEY).withColumn("__cut", F.explode(copies))
    out = out.withColumn("text", F.when(F.col("__cut") > 0, first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
