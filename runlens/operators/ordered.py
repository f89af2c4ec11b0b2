"""Ordered analysis of groups of any size.

A window over one key puts all rows of that key in one task. These helpers give
the same answers when one key holds a large share of the table: a key with more
rows than `runlens.hotRows` is cut into ordered slices at sampled split points,
every slice is a window of its own, and what a slice needs to know about the
slices before or after it is one small summary row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import checkpointed, hot_rows

MAX_SLICES = 1 << 16  # a power of two; beyond 65 billion rows of one key, or 16 billion of a whole table, slices grow
SAMPLES_PER_SLICE = 16
# Slices of a whole table, in what one task may be given.
WHOLE_PARTS = 8
# Points at which the sketch of a hot group is asked.
LEAST_CELLS, MOST_CELLS = 64, 4096


@dataclass(frozen=True)
class Step:
    """One column computed along the order of a group."""

    kind: str
    value: Column | None = None
    inclusive: bool = True
    sql: str | None = None


def rank() -> Step:
    """1-based position in the group."""
    return Step("rank")


def prev(value: Column) -> Step:
    """The value one row earlier, null on the first row."""
    return Step("prev", value, False)


def following(value: Column) -> Step:
    """The value one row later, null on the last row."""
    return Step("following", value, False)


def running_sum(value: Column, inclusive: bool = True) -> Step:
    return Step("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Step:
    return Step("max", value, inclusive)


def running_last(value: Column, inclusive: bool = True) -> Step:
    """The latest non-null value so far."""
    return Step("last", value, inclusive)


def upcoming_first(value: Column, inclusive: bool = True) -> Step:
    """The earliest non-null value from here on."""
    return Step("first_ahead", value, inclusive)


def upcoming_min(value: Column, inclusive: bool = True) -> Step:
    """The smallest value from here on."""
    return Step("min_ahead", value, inclusive)


def upcoming_rising(sql: str) -> Step:
    """The earliest non-null value after this row, of values (an SQL expression) that never fall along the order.

    It is the smallest of them as well, so a slice's summary needs no position and its window no second sort.
    """
    return Step("rising_ahead", F.expr(sql), False, sql)


def peers(after: bool = False) -> Step:
    """How many rows of the very same position come before this one, or after it."""
    return Step("peers_after" if after else "peers_before")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on `keys` that lets null match null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match and the left side's keys are kept."""
    marked = right.select(*[F.col(k).alias(f"__{k}") for k in keys],
                          *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(marked[f"__{k}"]) for k in keys])
    return left.join(marked, on, how).drop(*[f"__{k}" for k in keys])


def _reversed(partition: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*partition).orderBy(*[F.col(c).desc() for c in order])


def _local(step: Step, partition: Sequence[str], order: Sequence[str]) -> Column:
    window = Window.partitionBy(*partition).orderBy(*order)
    end = Window.currentRow if step.inclusive else -1
    frame = window.rowsBetween(Window.unboundedPreceding, end)
    if step.kind == "rank":
        return F.row_number().over(window).cast("long")
    if step.kind == "peers_before":
        return F.row_number().over(window) - F.rank().over(window)
    if step.kind == "peers_after":
        return F.count(F.lit(1)).over(window.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.row_number().over(window)
    if step.kind == "prev":
        return F.lag(F.struct(step.value.alias("v"))).over(window)
    if step.kind == "following":
        return F.lead(F.struct(step.value.alias("v"))).over(window)
    if step.kind == "sum":
        return F.sum(step.value).over(frame)
    if step.kind == "max":
        return F.max(step.value).over(frame)
    if step.kind == "last":
        return F.last(step.value, ignorenulls=True).over(frame)
    if step.kind == "rising_ahead":
        return F.expr(f"lead({step.sql}) IGNORE NULLS").over(window)
    # Backwards, since a frame that shrinks from the front is computed anew for every row.
    backwards = _reversed(partition, order).rowsBetween(Window.unboundedPreceding, end)
    return F.min(step.value).over(backwards) if step.kind == "min_ahead" else F.last(step.value, ignorenulls=True).over(backwards)


def _summary(step: Step, position: Column) -> Column:
    if step.kind in ("rank", "peers_before", "peers_after"):
        return F.count(F.lit(1))
    if step.kind == "sum":
        return F.sum(step.value)
    if step.kind == "max":
        return F.max(step.value)
    if step.kind in ("min_ahead", "rising_ahead"):
        return F.min(step.value)
    boxed = F.struct(step.value.alias("v"))
    if step.kind == "prev":
        return F.max_by(boxed, position)
    if step.kind == "following":
        return F.min_by(boxed, position)
    present = F.when(step.value.isNotNull(), position)
    if step.kind == "last":
        return F.max_by(step.value, present)
    return F.min_by(step.value, present)


def _carry(step: Step, summary: Column, keys: Sequence[str]) -> Column:
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    after = _reversed(keys, ["_slice"]).rowsBetween(Window.unboundedPreceding, -1)
    if step.kind in ("rank", "sum"):
        return F.sum(summary).over(before)
    if step.kind == "max":
        return F.max(summary).over(before)
    if step.kind in ("prev", "last"):
        return F.last(summary, ignorenulls=True).over(before)
    if step.kind in ("min_ahead", "rising_ahead"):
        return F.min(summary).over(after)
    return F.last(summary, ignorenulls=True).over(after)


def _combine(step: Step, local: Column, carry: Column) -> Column:
    if step.kind in ("rank", "sum"):
        return F.when(carry.isNull(), local).otherwise(F.coalesce(local, F.lit(0)) + carry)
    if step.kind == "max":
        return F.greatest(local, carry)
    if step.kind in ("peers_before", "peers_after"):
        return local  # one position is in one slice
    if step.kind == "min_ahead":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def _unbox(step: Step, column: Column) -> Column:
    return column["v"] if step.kind in ("prev", "following") else column


def _hot(df: DataFrame, keys: Sequence[str], share: int = 1) -> bool:
    """Whether any group has more rows than a `share` of what one task may be given."""
    limit = hot_rows(df.sparkSession) // share
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).isEmpty()


def split_points(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """Per oversized key, the sorted positions at which to cut it; None if there is none.

    The group sizes are one aggregate over the key columns. The split points
    come from a sample chosen by hash, so a recomputed task picks the same.
    """
    limit = hot_rows(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    if sizes.isEmpty():
        return None
    sizes = sizes.withColumn(
        "_slices", F.least(F.lit(MAX_SLICES), F.ceil(F.col("_n") * 2 / F.lit(limit))).cast("int"))
    sample = join_on(df.select(*keys, *[c for c in order if c not in keys]), sizes, keys).filter(
        F.pmod(F.xxhash64(*order), F.greatest(
            F.lit(1).cast("long"),
            (F.col("_n") / (F.col("_slices") * SAMPLES_PER_SLICE)).cast("long"))) == 0)
    points = sample.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct(*order))).alias("_seen"),
        F.max("_slices").alias("_slices"))
    chosen = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.col("_slices") - 1),
        lambda i: F.get(F.col("_seen"), (i * F.size("_seen") / F.col("_slices")).cast("int"))))
    return checkpointed(points.select(*keys, chosen.alias("_points")))


def slice_groups(df: DataFrame, points: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Tag every row of an oversized key with its slice; other rows get -1."""
    here, points_col = F.struct(*order), F.col("_points")
    # Binary search: the largest count of points not after this row, one bit at a time.
    bits = F.array(*[F.lit(MAX_SLICES >> (k + 1)) for k in range(MAX_SLICES.bit_length() - 1)])
    found = F.aggregate(bits, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(points_col)) & (F.get(points_col, at + step - 1) <= here), at + step).otherwise(at))
    number = F.when(points_col.isNull(), F.lit(-1)).otherwise(found)
    return join_on(df, points, keys, "left").withColumn("_slice", number.cast("int")).drop("_points")


def whole_points(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int] | None:
    """One row with the sorted positions at which to cut a whole table, and how many; None if one task can take it.

    One pass counts the rows and takes the sample, again by hash. Slices are a part of what one task may be given:
    the smaller they are, the less is compared row by row when they are sorted.
    """
    limit = hot_rows(df.sparkSession)
    size = max(1, limit // WHOLE_PARTS)
    sampled = F.pmod(F.xxhash64(*order), F.lit(max(1, size // SAMPLES_PER_SLICE))) == 0
    # Grouped by position, all rows outside the sample being one group.
    counted = df.groupBy(F.when(sampled, F.struct(*order)).alias("_at")).agg(F.count(F.lit(1)).alias("_k"))
    seen = checkpointed(counted.agg(F.sum("_k").alias("_n"), F.array_sort(F.collect_list("_at")).alias("_seen")))
    n, found = seen.select(F.coalesce("_n", F.lit(0)), F.size("_seen")).first()
    if n <= limit:
        return None
    slices = min(MAX_SLICES, -(-n // size))
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: F.get(
        F.col("_seen"), F.floor(i * F.lit(found).cast("long") / slices).cast("int")))) if found else F.slice("_seen", 1, 0)
    points = checkpointed(seen.select(chosen.alias("_points")))
    return points, points.select(F.size("_points")).first()[0]


def slice_whole(df: DataFrame, points: DataFrame, count: int, order: Sequence[str]) -> DataFrame:
    """Tag every row of a table with its slice.

    A binary search as one column per bit, which is compiled; of a lambda every step is interpreted. The cuts are scalars,
    since a join would copy them beside every row. Whole positions are compared only where a cut has the row's first value.
    """
    cuts = points.select("_points").scalar()
    firsts = points.select(F.transform("_points", lambda p: p[order[0]])).scalar()
    first = F.col(order[0])

    def reached(at: Column) -> Column:
        cut = F.get(firsts, at - 1)
        below = F.coalesce(cut < first, cut.isNull() & first.isNotNull())
        return (at <= count) & (below | (cut.eqNullSafe(first) & (F.get(cuts, at - 1) <= F.struct(*order))))

    found = df.withColumn("_slice", F.lit(0))
    for bit in reversed(range(count.bit_length())):
        found = found.withColumn("_slice", F.col("_slice") + F.when(reached(F.col("_slice") + (1 << bit)), 1 << bit).otherwise(0))
    return found


def fits(df: DataFrame, keys: Sequence[str], share: int = 1) -> bool:
    """Whether every group is small enough, or a `share` of it, for one task: worth asking once before several passes."""
    return not _hot(df, keys, share)


def along(df: DataFrame, keys: Sequence[str], order: Sequence[str], fitting: bool = False, **steps: Step) -> DataFrame:
    """Add one column per step, computed in `order` (ascending, unique) within `keys`.

    The size of the groups is looked at first, unless the caller knows them to be `fitting`.
    """
    keys, order = list(keys), list(order)
    whole = not keys
    if whole:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    points = None if fitting else whole_points(df, order) if whole else split_points(df, keys, order)
    if points is None:
        out = df.select("*", *[_unbox(s, _local(s, keys, order)).alias(n) for n, s in steps.items()])
        return out.drop("_all") if whole else out
    sliced = slice_whole(df, *points, order) if whole else slice_groups(df, points, keys, order)
    position = F.struct(*order)
    # A condition on the slice of a whole table would be pushed into the search, where each bit repeats the ones before.
    summaries = (sliced if whole else sliced.filter(F.col("_slice") >= 0)).groupBy(*keys, "_slice").agg(
        *[_summary(s, position).alias(f"_s_{n}") for n, s in steps.items()])
    if whole:
        summaries = checkpointed(summaries)
    carries = summaries.select(
        *keys, "_slice",
        *[_carry(s, F.col(f"_s_{n}"), keys).alias(f"_c_{n}") for n, s in steps.items()])
    local = sliced.select("*", *[_local(s, [*keys, "_slice"], order).alias(f"_l_{n}") for n, s in steps.items()])
    # Of a whole table there is a row per slice, MAX_SLICES at most: the rows themselves are not shuffled again to meet them.
    joined = join_on(local, F.broadcast(carries.drop(*keys)) if whole else carries, [*([] if whole else keys), "_slice"], "left")
    out = joined.select(
        *[c for c in df.columns],
        *[_unbox(s, _combine(s, F.col(f"_l_{n}"), F.col(f"_c_{n}"))).alias(n)
          for n, s in steps.items()])
    return out.drop("_all") if whole else out


def with_totals(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add group aggregates to every row without gathering a group in one task."""
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    if not keys:
        return df.join(F.broadcast(totals))
    return join_on(df, totals, keys)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  position: str = "_position") -> DataFrame:
    """The first `k` rows of each group; every map task keeps only its own first `k`.

    Spark drops rows past `k` before the shuffle only up to
    spark.sql.optimizer.windowGroupLimitThreshold; that threshold is raised to `k` where it is lower.
    """
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(df.sparkSession.conf.get(name, "1000")) < k:
        df.sparkSession.conf.set(name, str(k))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= k)


def _sorted_stats(df: DataFrame, keys: list[str], names: list[str], ranks: dict) -> DataFrame:
    """One struct per value: n, min, max and its ranks, from groups that fit one task."""
    lists = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in names])

    def stats(values: Column) -> Column:
        n = F.size(values).cast("long")
        return F.struct(n.alias("n"), F.get(values, 0).alias("min"), F.get(values, (n - 1).cast("int")).alias("max"),
                        *[F.get(values, rank_of(n).cast("int") - 1).alias(name) for name, rank_of in ranks.items()])

    return lists.select(*keys, *[stats(F.col(name)).alias(name) for name in names])


def _sketched_stats(df: DataFrame, keys: list[str], names: list[str], ranks: dict, largest: int, limit: int) -> DataFrame:
    """The same of groups of any size up to `largest`, in two passes over the rows as they are.

    The first keeps a sketch per value, whose error is a twentieth of a cell of its grid. So each rank lies
    between two points of the grid a few cells apart. The second pass counts what is below them and
    keeps what is between them, a small part of the group; values at the points themselves, of which there
    may be many, are only counted.
    """
    cells = min(MOST_CELLS, max(LEAST_CELLS, 8 * largest // limit))
    points = F.array(*[F.lit(i / cells) for i in range(cells + 1)])
    first = checkpointed(df.groupBy(*keys).agg(*[F.struct(
        F.count(name).alias("n"), F.min(name).alias("min"), F.max(name).alias("max"),
        F.percentile_approx(name, points, F.lit(20 * cells)).alias("grid")).alias(f"_{name}") for name in names]))

    def bracket(name: str, rank_of) -> Column:
        sketch = F.col(f"_{name}")
        place = rank_of(sketch["n"]) / F.nullif(sketch["n"], F.lit(0)) * cells
        low, high = F.floor(place).cast("int") - 1, F.ceil(place).cast("int") + 1
        return F.struct(F.when(low <= 0, sketch["min"]).otherwise(F.get(sketch["grid"], low)).alias("low"),
                        F.when(high >= cells, sketch["max"]).otherwise(F.get(sketch["grid"], high)).alias("high"))

    wanted = first.select(*keys, *[F.struct(*[bracket(name, r).alias(k) for k, r in ranks.items()]).alias(f"_b_{name}") for name in names])

    def part(name: str, rank: str) -> Column:
        value, low, high = F.col(name), F.col(f"_b_{name}")[rank]["low"], F.col(f"_b_{name}")[rank]["high"]
        return F.struct(F.count(F.when(value < low, 1)).alias("below"), F.count(F.when(value == low, 1)).alias("at_low"),
                        F.sort_array(F.collect_list(F.when((value > low) & (value < high), value))).alias("between"),
                        F.count(F.when((value == high) & (high > low), 1)).alias("at_high"),
                        F.first(low).alias("low"), F.first(high).alias("high"))

    second = join_on(df, wanted, keys).groupBy(*keys).agg(*[F.struct(*[part(name, rank).alias(rank) for rank in ranks]).alias(f"_p_{name}") for name in names])

    def answer(name: str, rank: str, rank_of) -> Column:
        found = F.col(f"_p_{name}")[rank]
        after = rank_of(F.col(f"_{name}")["n"]).cast("long") - found["below"]
        inside = after - found["at_low"]
        last = inside - F.size(found["between"])
        return (F.when(F.col(f"_{name}")["n"] == 0, F.lit(None)).when((after < 1) | (last > found["at_high"]), F.raise_error(F.lit("a rank lies outside its bracket")))
                .when(inside < 1, found["low"]).when(last < 1, F.get(found["between"], inside.cast("int") - 1)).otherwise(found["high"]))

    both = join_on(first, second, keys)
    return both.select(*keys, *[F.struct(*[F.col(f"_{name}")[c].alias(c) for c in ("n", "min", "max")],
                                         *[answer(name, k, r).alias(k) for k, r in ranks.items()]).alias(name) for name in names])


def _stats(df: DataFrame, keys: list[str], names: list[str], ranks: dict) -> DataFrame:
    """Exact order statistics of several values per group, one struct each.

    Groups whose size was checked are sorted in place; hot ones are answered by sketches and brackets.
    """
    limit = max(1, hot_rows(df.sparkSession) // (4 * len(names)))
    hot = checkpointed(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit))
    largest = hot.agg(F.max("_n")).first()[0]
    if largest is None:
        return _sorted_stats(df, keys, names, ranks)
    marked = join_on(df, hot, keys, "left")
    cold = marked.filter(F.col("_n").isNull()).drop("_n")
    return _sorted_stats(cold, keys, names, ranks).unionByName(
        _sketched_stats(marked.filter(F.col("_n").isNotNull()).drop("_n"), keys, names, ranks, largest, limit))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, **ranks) -> DataFrame:
    """Exact order statistics of `value` per group: n, min, max and one column per rank.

    Each rank maps the group's size column to the 1-based rank wanted. See `_stats` for hot groups. One too large for
    the finest sketch is counted per distinct value before its shuffle, and its values are ranked slice by slice.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    if not _beyond_sketches(present, keys, 1):
        return _stats(present, keys, ["_v"], ranks).select(*keys, *[F.col("_v")[c].alias(c) for c in ("n", "min", "max", *ranks)])
    counted = present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k"))
    upto = along(counted, keys, ["_v"], _upto=running_sum(F.col("_k")))
    sized = with_totals(upto, keys, n=F.sum("_k"))
    return sized.groupBy(*keys).agg(
        F.max("n").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        *[F.min(F.when(F.col("_upto") >= rank_of(F.col("n")), F.col("_v"))).alias(name)
          for name, rank_of in ranks.items()])


def _beyond_sketches(df: DataFrame, keys: Sequence[str], names: int) -> bool:
    """Whether a group has more rows than the finest grid brings down to what one task may sort."""
    limit = max(1, hot_rows(df.sparkSession) // (4 * names))
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return largest > limit * MOST_CELLS // 8


def wide_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """The median of several values per group, one column each, nulls left out.

    All values of a row are looked at together, in hot groups too; only a group too large for
    the finest sketch has its values turned into rows.
    """
    keys, names = list(keys), list(values)
    narrow = df.select(*keys, *[c.cast("double").alias(n) for n, c in values.items()])
    if not _beyond_sketches(narrow, keys, len(names)):
        stats = _stats(narrow, keys, names, {"lo": lower_middle, "hi": upper_middle})
        return stats.select(*keys, *[((F.col(n)["lo"] + F.col(n)["hi"]) / 2).alias(n) for n in names])
    rows = narrow.unpivot(keys, names, "_name", "_value")
    return medians_of(rows, [*keys, "_name"], "_value").groupBy(*keys).pivot("_name", names).agg(F.first("median"))


def lower_middle(n: Column) -> Column:
    return F.floor((n + 1) / 2)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2) + 1


def nearest_rank_95(n: Column) -> Column:
    """Rank of the nearest-rank 95th percentile, rounding halves to even."""
    return F.greatest(F.lit(1.0), F.least(n.cast("double"), F.rint(F.lit(0.95) * n + F.lit(0.5))))


def summary_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, median, min, max and nearest-rank p95 of `value` per group."""
    stats = order_statistics(df, keys, value, _lo=lower_middle, _hi=upper_middle, p95=nearest_rank_95)
    return stats.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"),
                        "min", "max", "p95")


def medians_of(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """The median of `value` per group, null where the group has no value."""
    stats = order_statistics(df, keys, value, _lo=lower_middle, _hi=upper_middle)
    return stats.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name))
