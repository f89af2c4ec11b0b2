"""Time series: step curves, counters, thinning and as-of look-ups.

Every instant is a `long` of microseconds; nothing here joins on a range. What
would be a range or as-of join is a merge of both sides in time order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.numbers import rounded
from runlens.operators.ordered import (along, fits, join_on, prev, rank, running_last, running_max, running_sum,
                                       upcoming_first, with_totals)
from runlens.session import checkpointed


def _steps(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """How many intervals start and end at each instant, ends first."""
    deltas = intervals.select(F.explode(F.array(
        F.struct(F.col(start).alias("at_us"), F.lit(1).alias("kind")),
        F.struct(F.col(end).alias("at_us"), F.lit(-1).alias("kind")))).alias("d")).select("d.*")
    return deltas.filter(F.col("at_us").isNotNull()).groupBy("at_us", "kind").agg(
        F.sum("kind").alias("_delta"))


def concurrency_curve(spans: DataFrame) -> DataFrame:
    """How many `running` spans are open after each instant, and the most at once.

    Spans ending at an instant are counted out before those starting then.
    """
    closed = spans.filter((F.col("phase") == "running") & F.col("end_us").isNotNull())
    # Read twice, for the curve and for its peak.
    curve = checkpointed(along(_steps(closed, "start_us", "end_us"), [], ["at_us", "kind"], open=running_sum(F.col("_delta"))))
    peak = curve.agg(F.max("open").alias("peak"))
    return curve.drop("_delta").join(F.broadcast(peak))


def inflight_peak(requests: DataFrame) -> DataFrame:
    """How many requests are open at the end and the most there ever were; a finish never goes below 0."""
    steps = _steps(requests, "start_us", "end_us")
    fitting = fits(steps, [])
    summed = along(steps, [], ["at_us", "kind"], fitting, _sum=running_sum(F.col("_delta")))
    floored = along(summed, [], ["at_us", "kind"], fitting, _low=running_max(-F.col("_sum")))
    now = F.col("_sum") + F.greatest(F.col("_low"), F.lit(0))
    return floored.agg(F.max_by(now, F.struct("at_us", "kind")).alias("now"), F.max(now).alias("peak"))


def queue_peaks(samples: DataFrame) -> DataFrame:
    """Per arm with at least two samples: most running, most waiting, most in all."""
    running, waiting = (F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("running", "waiting"))
    return samples.groupBy("arm").agg(
        F.count(F.lit(1)).alias("points"), F.max(running).alias("run_peak"), F.max(waiting).alias("held_peak"),
        F.greatest(F.max(running + waiting), F.lit(1)).alias("top")).filter(F.col("points") >= 2)


def thin_series(points: DataFrame, keys: Sequence[str], order: Sequence[str], max_points: int,
                since_us: int | None = None) -> DataFrame:
    """Every n-th point of each series, n being what keeps it within `max_points`; nothing is averaged."""
    kept = points if since_us is None else points.filter(F.col("at_us") >= since_us)
    placed = along(kept, keys, order, _number=rank())
    sized = with_totals(placed, keys, _n=F.count(F.lit(1)))
    step = F.greatest(F.ceil(F.col("_n") / max_points), F.lit(1))
    return sized.filter((F.col("_number") - 1) % step == 0).drop("_number", "_n")


def counter_rate(samples: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Busy share between neighbouring readings of two counters; null on the first and without progress."""
    marked = along(samples, keys, order, _busy=prev(F.col("busy")), _total=prev(F.col("total")))
    total = F.col("total") - F.col("_total")
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("busy") - F.col("_busy")) * 100.0 / total))
    return marked.withColumn("percent", rounded(F.when(total > 0, share), 1)).drop("_busy", "_total")


def _next_marks(times: DataFrame, keys: list[str], least_us: int) -> DataFrame:
    """Each instant with the first one of its key at least `least_us` later, null if there is none."""
    asked = times.select(*keys, (F.col("at_us") + least_us).alias("x"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("t"))
    merged = asked.union(times.select(*keys, F.col("at_us").alias("x"), F.lit(1).alias("_side"), F.col("at_us").alias("t")))
    found = along(merged, keys, ["x", "_side"], next=upcoming_first(F.col("t")))
    return found.filter("_side = 0").select(*keys, (F.col("x") - least_us).alias("at_us"), "next")


def _reached(roots: DataFrame, jumps: DataFrame, keys: list[str]) -> DataFrame:
    """What pointers lead to from `roots`, the roots included: the jumps are doubled until none is left."""
    at = [*keys, "at_us"]
    reached, jumps = checkpointed(roots), checkpointed(jumps)
    while not jumps.isEmpty():
        new = join_on(reached, jumps, at).select(*keys, F.col("next").alias("at_us"))
        reached = checkpointed(reached.union(new).distinct())
        further = jumps.select(*keys, F.col("at_us").alias("next"), F.col("next").alias("_further"))
        jumps = checkpointed(join_on(jumps, further, [*keys, "next"]).select(*at, F.col("_further").alias("next")))
    return reached


def peak_rate(samples: DataFrame, keys: Sequence[str], order: Sequence[str], least_us: int = 500_000) -> DataFrame:
    """The highest rate of a counter per key, between marks at least `least_us` apart.

    A reading too close to the mark is passed over and the mark kept; one at the very instant of the mark replaces
    it. The mark after an instant is the first one far enough from it, wherever marks are; the marks are the
    instants that those pointers lead to from the first one. An instant after a pause of `least_us` is a mark
    whatever was before, so the doubling starts from all of them and ends with the longest chain between pauses.
    """
    keys, place = list(keys), F.struct(*order)
    ticks = F.col("ticks").cast("long")
    times = checkpointed(samples.groupBy(*keys, "at_us").agg(
        F.min_by(ticks, place).alias("_first"), F.max_by(ticks, place).alias("_last")))
    before = along(times.select(*keys, "at_us"), keys, ["at_us"], _before=prev(F.col("at_us")))
    pause = F.col("_before").isNull() | (F.col("at_us") - F.col("_before") >= least_us)
    roots = checkpointed(before.filter(pause).select(*keys, "at_us"))
    pointers = checkpointed(_next_marks(times, keys, least_us).filter("next is not null"))
    inner = join_on(pointers, roots.select(*keys, F.col("at_us").alias("next"), F.lit(True).alias("_root")), [*keys, "next"], "left")
    marks = _reached(roots, inner.filter("_root is null").drop("_root"), keys)
    moves = join_on(join_on(marks, pointers, [*keys, "at_us"]), times.select(*keys, "at_us", "_last"), [*keys, "at_us"])
    moves = join_on(moves, times.select(*keys, F.col("at_us").alias("next"), "_first"), [*keys, "next"])
    rate = (F.col("_first") - F.col("_last")) * 1e6 / (F.col("next") - F.col("at_us"))
    peaks = moves.groupBy(*keys).agg(F.greatest(F.max(rate), F.lit(0.0)).alias("peak_rate"))
    named = roots.select(*keys).distinct()
    return join_on(named, peaks, keys, "left").select(*keys, F.coalesce("peak_rate", F.lit(0.0)).alias("peak_rate"))


def _merged(instants: DataFrame, samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both sides in one table, a sample (0) before the instant (1) it ties with."""
    return instants.select(*keys, "at_us", "id", F.lit(1).alias("_side"),
                           F.lit(None).cast("struct<t:bigint,v:double>").alias("_s")).unionByName(
        samples.filter(F.col(value).isNotNull()).select(
            *keys, "at_us", F.col("id"), F.lit(0).alias("_side"),
            F.struct(F.col("at_us").alias("t"), F.col(value).cast("double").alias("v")).alias("_s")))


def asof_last(instants: DataFrame, samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """For each instant the last sample at or before it."""
    keys = list(keys)
    merged = along(_merged(instants, samples, keys, value), keys, ["at_us", "_side", "id"],
                   _found=running_last(F.col("_s")))
    return merged.filter(F.col("_side") == 1).select(
        *keys, "id", "at_us", F.col("_found.t").alias("sample_us"), F.col("_found.v").alias("value"))


def asof_nearest(instants: DataFrame, samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """For each instant the nearest sample, the earlier on a tie; null farther away than
    the larger of a second and two and a half times the series' mean spacing."""
    keys = list(keys)
    present = samples.filter(F.col(value).isNotNull())
    spacing = present.groupBy(*keys).agg(
        F.try_divide(F.max("at_us") - F.min("at_us"), F.count(F.lit(1)) - 1).alias("_gap"))
    merged = along(_merged(instants, samples, keys, value), keys, ["at_us", "_side", "id"],
                   _back=running_last(F.col("_s")), _fore=upcoming_first(F.col("_s")))
    sided = join_on(merged.filter(F.col("_side") == 1), spacing, keys, "left")
    back = F.abs(F.col("at_us") - F.col("_back.t"))
    fore = F.abs(F.col("_fore.t") - F.col("at_us"))
    best = F.when(F.col("_fore").isNull() | (back <= fore), F.col("_back")).otherwise(F.col("_fore"))
    reach = F.greatest(F.lit(1_000_000.0), F.coalesce(F.col("_gap") * 2.5, F.lit(float("inf"))))
    near = F.abs(best["t"] - F.col("at_us")) <= reach
    return sided.select(*keys, "id", "at_us", F.when(near, best["t"]).alias("sample_us"),
                        F.when(near, best["v"]).alias("value"))


def interval_contains(instants: DataFrame, marks: DataFrame, now_us: int, keys: Sequence[str] = ()) -> DataFrame:
    """Whether each instant lies inside any marked interval; an open one ends now.

    Of the intervals begun by then only the latest end matters, so one pass in time order answers it.
    """
    keys = list(keys)
    ends = marks.select(*keys, F.col("start_us").alias("at_us"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("_side"),
                        F.coalesce("end_us", F.lit(now_us)).alias("_end")).groupBy(*keys, "at_us", "id", "_side").agg(
        F.max("_end").alias("_end"))
    both = instants.select(*keys, "at_us", "id", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_end")).unionByName(ends)
    swept = along(both, keys, ["at_us", "_side", "id"], _until=running_max(F.col("_end")))
    return swept.filter(F.col("_side") == 1).select(
        *keys, "id", "at_us", F.coalesce(F.col("_until") >= F.col("at_us"), F.lit(False)).alias("inside"))
