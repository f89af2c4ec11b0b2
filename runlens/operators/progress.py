"""The bar of a run made of nested calls, from columns that run along its events.

A call may be given a span of its caller's bar. The caller is then at least where the call has got
to inside that span, all the way up, so that one bar moves for the whole chain. A line that names
no call is of the one call that can have written it, if there is only one.

Nothing here follows a run event by event. Which calls run, at what depth, and what each last said are
running values; positions are found from the deepest calls upwards, one level of the call path at a time;
and the farthest of several calls, each of which may also go back, is looked up in blocks of
the caller's events whose length is a power of two.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numbers import rounded_exactly
from runlens.operators.ordered import (
    along, fits, following, join_on, rank, running_last, running_max, running_sum, upcoming_min, with_totals)
from runlens.session import checkpointed

MAX_DEPTH = 10
ROOT = ""
FIELDS = ["server", "tool", "edge", "span_start", "span_end", "call", "depth", "fraction"]
N = ["_n"]
NO_SPAN = "struct(double(null) as low, double(null) as high)"


def _path_length(call: Column) -> Column:
    return F.when(call == ROOT, 0).otherwise(F.size(F.split(call, r"\.")))


def call_states(marks: DataFrame, fitting: bool) -> DataFrame:
    """Each marker of a call with what the call was before it and is after it, and the number of its first marker.

    A marker opens its call unless it says otherwise, or says nothing and the call has been opened. An
    opened call takes the depth and the span of its marker; a call that has ended stays ended.
    """
    key = ["run_id", "call"]
    silent = F.col("edge").isNull()
    asked = F.col("edge").eqNullSafe("open")
    seen = along(marks, key, N, fitting, _known=running_max((silent | asked).cast("int"), False))
    opens = asked | (silent & F.coalesce("_known", F.lit(0)).eqNullSafe(0))
    ordered = F.col("span_start") <= F.col("span_end")
    none = F.expr(NO_SPAN)
    span = F.when(ordered, F.struct(F.col("span_start").cast("double").alias("low"), F.col("span_end").cast("double").alias("high"))).otherwise(none)
    rows = seen.withColumns({
        "_opens": opens, "_span": F.when(opens, span),
        "_level": F.when(opens & F.col("depth").isNotNull(), F.least(F.col("depth").cast("int"), F.lit(MAX_DEPTH)))})
    opened, ended = F.col("_opens").cast("int"), (~F.col("_opens")).cast("int")
    states = along(rows, key, N, fitting,
                   opened=running_max(opened), ended=running_max(ended), span=running_last(F.col("_span")), level=running_last(F.col("_level")),
                   was_opened=running_max(opened, False), had_ended=running_max(ended, False), had_span=running_last(F.col("_span"), False),
                   had_level=running_last(F.col("_level"), False))
    usual = F.least(_path_length(F.col("call")), F.lit(MAX_DEPTH))
    states = with_totals(states, key, id=F.min("_n"))

    def runs(is_open: str, is_over: str) -> Column:
        return (F.coalesce(is_open, F.lit(0)) == 1) & (F.coalesce(is_over, F.lit(0)) == 0)

    def spanned(name: str) -> Column:
        return F.col(name)["low"].isNotNull().cast("int")

    return states.select(
        "run_id", "_n", "call", "id", "opened", "ended", "span", F.coalesce("level", usual).alias("level"),
        F.coalesce("had_level", usual).alias("had_level"), runs("opened", "ended").alias("runs"),
        runs("was_opened", "had_ended").alias("ran"),
        (spanned("span") - F.coalesce(spanned("had_span"), F.lit(0))).alias("spans"))


def writers(states: DataFrame, unnamed: DataFrame, fitting: bool) -> DataFrame:
    """The unnamed lines that only one call can have written: run_id, _n, call and the depth found for it.

    With a depth that is the one call running there, at 0 the run itself. Without one it is the deepest
    running call if no depth has two, the run itself if none runs.
    """
    def change(level: str, sign: int, when: str) -> Column:
        return F.when(F.col(when), F.struct(F.col(level).alias("level"), F.lit(sign).alias("calls"), (F.col("id") * sign).alias("ids")))

    moves = states.select("run_id", "_n", F.explode(F.array_compact(F.array(change("had_level", -1, "ran"), change("level", 1, "runs")))).alias("m"))
    steps = moves.groupBy("run_id", "m.level", "_n").agg(F.sum("m.calls").alias("calls"), F.sum("m.ids").alias("ids"))
    steps = along(steps, ["run_id", "level"], N, fitting, _calls=running_sum(F.col("calls")), _ids=running_sum(F.col("ids")))
    names = [f"_at{level}" for level in range(MAX_DEPTH + 1)]
    running = F.struct(F.col("_calls").alias("calls"), F.col("_ids").alias("ids"))
    table = steps.groupBy("run_id", "_n").agg(*[F.max(F.when(F.col("level") == level, running)).alias(name) for level, name in enumerate(names)])
    lines = unnamed.select("run_id", "_n", F.col("depth").cast("int").alias("depth"), F.lit(True).alias("_line"))
    merged = along(table.unionByName(lines, allowMissingColumns=True), ["run_id"], N, fitting,
                   **{f"_now{level}": running_last(F.col(name)) for level, name in enumerate(names)}).filter("_line")
    now = [F.col(f"_now{level}") for level in range(MAX_DEPTH + 1)]
    shared = reduce(lambda a, b: a | b, [F.coalesce(at["calls"] > 1, F.lit(False)) for at in now])
    alone = [F.when(at["calls"] == 1, F.struct(at["ids"].alias("id"), F.lit(level).alias("level"))) for level, at in enumerate(now)]
    run = F.struct(F.lit(0).cast("bigint").alias("id"), F.lit(None).cast("int").alias("level"))
    at_depth = F.get(F.array(*alone), F.col("depth"))
    told = F.when(F.col("depth") == 0, run).when(at_depth.isNotNull(), F.struct(at_depth["id"].alias("id"), F.lit(None).cast("int").alias("level")))
    guess = F.when(~shared, F.coalesce(*reversed(alone), run))
    found = merged.withColumn("_by", F.when(F.col("depth").isNotNull(), told).otherwise(guess)).filter("_by is not null")
    found = found.select("run_id", "_n", F.col("_by.id").alias("id"), F.col("_by.level").alias("found_depth"))
    calls = states.select("run_id", "id", "call").distinct()
    named = join_on(found, calls, ["run_id", "id"], "left")
    return named.select("run_id", "_n", F.when(F.col("id") == 0, ROOT).otherwise(F.col("call")).alias("call"), "found_depth")


def farthest(points: DataFrame, fitting: bool) -> DataFrame:
    """`points` (run_id, name, _n, q, below, value) with `most`: at each point the largest of what the calls below last came to.

    `q` numbers the points of a name. A value that no later one of its call falls short of can be kept for
    good, so the running maximum holds it. Any other is valid up to the next value of its call; the points
    between are covered by blocks of 2^h points, where each point looks for the largest value of its blocks.
    """
    key = ["run_id", "name"]
    moved = points.filter("below is not null").select("run_id", "name", "below", "_n", "q", "value")
    ahead = along(moved, [*key, "below"], N, fitting, _next=following(F.col("q")), _low=upcoming_min(
        F.coalesce("value", F.lit(float("-inf"))), False))
    lasting = F.col("_low").isNull() | (F.col("_low") >= F.col("value"))
    marked = join_on(points, ahead.select("run_id", "name", "_n", lasting.alias("_lasting")), [*key, "_n"], "left")
    base = along(marked, key, N, fitting, _most=running_max(F.when(F.col("_lasting"), F.col("value")), True))
    passing = ahead.filter(~lasting & F.col("value").isNotNull() & (F.col("_next") > F.col("q") + 1))
    passing = passing.select("run_id", "name", (F.col("q") + 1).alias("a"), F.col("_next").alias("b"), "value")
    # Blocks of the half-open range a to b: at each height the first one if its number is odd, and the last one.
    heights = F.sequence(F.lit(0), F.floor(F.log2((F.col("b") - F.col("a")).cast("double"))).cast("int") + 1)

    def pieces(h: Column) -> Column:
        size = F.pow(F.lit(2.0), h).cast("bigint")
        low, high = F.floor((F.col("a") + size - 1) / size), F.floor(F.col("b") / size)
        first = F.when((low < high) & (low % 2 == 1), F.struct(h.alias("h"), low.alias("block")))
        last = F.when((low < high) & (high % 2 == 1), F.struct(h.alias("h"), (high - 1).alias("block")))
        return F.array_compact(F.array(first, last))

    blocks = passing.select("run_id", "name", F.explode(F.flatten(F.transform(heights, pieces))).alias("p"), "value")
    blocks = checkpointed(blocks.groupBy("run_id", "name", "p.h", "p.block").agg(F.max("value").alias("value")))
    top = blocks.agg(F.max("h")).first()[0]
    if top is None:
        return base.withColumn("most", F.greatest("_most", "value")).drop("_most", "_lasting")
    concerned = blocks.groupBy(*key).agg(F.max("h").alias("_top"))
    asked = join_on(points.select("run_id", "name", "_n", "q"), concerned, key).select(
        "run_id", "name", "_n", F.explode(F.transform(F.sequence(F.lit(0), "_top"), lambda h: F.struct(
            h.alias("h"), F.floor(F.col("q") / F.pow(F.lit(2.0), h)).alias("block")))).alias("p")).select("run_id", "name", "_n", "p.*")
    seen = join_on(asked, blocks, [*key, "h", "block"]).groupBy(*key, "_n").agg(F.max("value").alias("_passing"))
    out = join_on(base, seen, [*key, "_n"], "left")
    return out.withColumn("most", F.greatest("_most", "_passing", "value")).drop("_most", "_lasting", "_passing")


def positions(touches: DataFrame, fitting: bool) -> DataFrame:
    """Where each call stands after each event that can move it: run_id, _n, name, length, own, at, spanned, spans_below.

    `touches` has the events that concern a call. An event can move its call and the callers above it.
    """
    parts = F.split(F.col("call"), r"\.")
    length = _path_length(F.col("call"))
    line = F.explode(F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        i.alias("length"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("name"),
        F.when(i < length, F.array_join(F.slice(parts, F.lit(1), i + 1), ".")).alias("below"))))
    points = touches.withColumn("p", line).select("*", "p.*").drop("p")
    own, just_above = F.col("below").isNull(), F.col("below") == F.col("call")
    points = points.select(
        "run_id", "_n", "length", "name", "below", own.alias("own"), F.when(own, F.col("mark")).alias("mark"),
        F.when(own, F.col("opened")).alias("opened"), F.when(own, F.col("ended")).alias("ended"), F.when(own, F.col("span")).alias("span"),
        F.when(just_above, F.col("spans")).otherwise(0).alias("spans"))
    points = checkpointed(points)
    deepest = points.agg(F.max("length")).first()[0]
    key, done, above = ["run_id", "name"], None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = points.filter(F.col("length") == level)
        here = along(here, key, N, fitting, q=rank(), _mark=running_last(F.col("mark")), _opened=running_max(F.col("opened")),
                     _ended=running_max(F.col("ended")), _span=running_last(F.col("span")), spans_below=running_sum(F.col("spans")))
        if above is None:
            here = here.withColumn("value", F.lit(None).cast("double"))
        else:
            came = above.select("run_id", F.col("name").alias("below"), "_n", "value")
            here = join_on(here, came, ["run_id", "below", "_n"], "left")
        here = farthest(here, fitting) if above is not None else here.withColumn("most", F.lit(None).cast("double"))
        at = F.when(F.col("_ended") == 1, 1.0).otherwise(F.greatest("_mark", "most"))
        low, high = F.col("_span.low"), F.col("_span.high")
        here = here.withColumn("at", at).select(
            "run_id", "_n", "name", "length", "own", "at", low.isNotNull().alias("spanned"), F.coalesce("spans_below", F.lit(0)).alias("spans_below"),
            F.when((F.col("_opened") == 1) & low.isNotNull(), low + (high - low) * F.coalesce("at", F.lit(0.0))).alias("value"))
        above = checkpointed(here)
        done = above if done is None else done.union(above)
    return points.limit(0).select("run_id", "_n", "name", "length", "own", F.col("mark").alias("at"), F.lit(False).alias("spanned"),
                                  F.lit(0).alias("spans_below")) if done is None else done.drop("value")


def progress_tree(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each event with the fraction its run's reader sees; the writer's own one beside it where it differs.

    An event of the server, or a marker without a call, is shown as it is. `order` tells the events of a run apart.
    """
    order, said = list(order), F.col("fraction").cast("double")
    rows = events.select("run_id", *order, *FIELDS).withColumns({
        "server": F.coalesce("server", F.lit(False)), "tool": F.nullif(F.col("tool"), F.lit("")),
        "fraction": F.when(~F.isnan(said), said)})
    # A run that fits one task does so in each part of it below, none of which has more than two rows an event.
    fitting = fits(rows, ["run_id"], 2)
    numbered = checkpointed(along(rows, ["run_id"], order, fitting, _n=rank()))
    of_tool = numbered.filter(~F.col("server"))
    marks = of_tool.filter(F.col("tool").isNotNull() & F.col("call").isNotNull())
    lines = of_tool.filter(F.col("tool").isNull())
    states = checkpointed(call_states(marks, fitting))
    attributed = writers(states, lines.filter("call is null"), fitting)
    by = join_on(lines.filter("call is null").select("run_id", "_n", "fraction"), attributed, ["run_id", "_n"])
    named = lines.filter("call is not null").select("run_id", "_n", "call", "fraction", F.lit(None).cast("int").alias("found_depth"))
    said_by = by.select("run_id", "_n", "call", "fraction", "found_depth").union(named).withColumnRenamed("fraction", "mark")
    touches = checkpointed(said_by.unionByName(states.select("run_id", "_n", "call", "opened", "ended", "span", "spans"), allowMissingColumns=True))
    where = positions(touches, fitting)
    # The topmost caller that spans lead to is the deepest one of the line without a span.
    shown = where.groupBy("run_id", "_n").agg(
        F.max(F.when(~F.col("spanned") | (F.col("length") == 0), F.struct("length", "at"))).alias("top"),
        F.max("length").alias("_length"), F.max(F.when(F.col("own"), F.col("spans_below"))).alias("_below"))
    joined = (F.col("top.length") != F.col("_length")) | (F.col("_below") > 0)
    shown = shown.select("run_id", "_n", F.when(joined, F.col("top.at")).alias("at"))
    found = touches.filter("found_depth is not null").select("run_id", "_n", "found_depth")
    out = join_on(join_on(numbered, shown, ["run_id", "_n"], "left"), found, ["run_id", "_n"], "left")
    at = F.col("at")
    return out.select(
        "run_id", *order, F.when(at.isNull(), F.col("fraction")).otherwise(rounded_exactly(at)).alias("fraction"),
        F.when(at.isNotNull() & (F.col("fraction") != at), F.col("fraction")).alias("own_fraction"),
        F.coalesce("found_depth", "depth", F.lit(0)).cast("bigint").alias("depth"))
