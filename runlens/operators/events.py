"""The event log of runs: numbering, phases, nested calls, caps and snapshots.

Events have `run_id`, `at_us`, `phase`, `fraction`, `message`, `depth`, `tool`
(a nested-call marker when set), `is_log`, `level`, `audience`, `server` and the
columns of `order`, which place an event in its run's file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import events as fx
from runlens.functions.text import scrub_text
from runlens.operators.ordered import along, fits, following, join_on, prev, rank, running_last, top_per_group

MAX_SPANS = 60
MAX_NESTED = 200
MAX_EVENTS = 2000
MAX_LOGS = 500
KEPT_LOGS = 20
SERIOUS = ["warning", "error"]
# Fixed value: what a run ended by a restart is told.
ORPHAN_MESSAGE = "The server restarted during this run."


def assign_seq(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the lines of each run from 0, blank and malformed ones included."""
    return along(lines, ["run_id"], order, seq=rank()).withColumn("seq", F.col("seq") - 1)


def normalise_events(raw: DataFrame) -> DataFrame:
    """Untrusted lines as wire events; works on a batch and on a stream.

    Only a server line may name a phase or carry a measurement; a tool's line is a
    running tool's. A missing time falls back to `seen_us`.
    """
    known = F.col("server") & fx.phase_state(F.col("phase")).isNotNull()
    phase = F.when(known, F.col("phase")).otherwise("running")
    log = F.coalesce(F.col("kind") == "log", F.lit(False)) & ~F.col("server")
    depth = F.col("depth").try_cast("int")
    level = F.lower(F.coalesce("level", F.lit("")))
    tool = F.when(~log & (fx.identifier(F.col("tool")) != ""), F.col("tool"))
    return raw.select(
        "run_id", *[c for c in ("event_id", "seq") if c in raw.columns],
        F.when(F.col("at_us") > 0, F.col("at_us")).otherwise(F.col("seen_us")).alias("at_us"),
        F.when(log, "log").alias("kind"),
        F.when(log, "running").otherwise(fx.phase_state(phase)).alias("state"),
        F.when(log, "running").otherwise(phase).alias("phase"),
        F.when(log, F.when(level.isin(fx.LOG_LEVELS), level).otherwise("info")).alias("level"),
        F.when(log, F.when(F.col("audience").isin(fx.LOG_AUDIENCES), F.col("audience"))
               .otherwise("admin")).alias("audience"),
        F.when(~log, fx.clean_fraction(F.col("fraction"))).alias("fraction"),
        fx.clean_message(F.col("message")).alias("message"),
        F.when(depth.between(0, fx.MAX_DEPTH), depth).otherwise(0).alias("depth"),
        F.when(F.col("call").rlike(fx.CALL_ID), F.col("call")).alias("call"), tool.alias("tool"),
        F.when(tool.isNotNull() & F.col("edge").isin("open", "close"), F.col("edge")).alias("edge"),
        F.when(F.col("server") & ~log, fx.clean_amount(F.col("vram_bytes"))).alias("vram_bytes"))


def _progress(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("is_log"))


def phase_spans(events: DataFrame, order: Sequence[str], max_spans: int = MAX_SPANS) -> DataFrame:
    """The root's phases as spans: equal neighbours collapse, a terminal phase only closes."""
    root = _progress(events).filter((F.col("depth") == 0) & F.col("tool").isNull())
    fitting = fits(root, ["run_id"])
    changes = along(root, ["run_id"], order, fitting, _before=prev(F.col("phase"))).filter(
        F.col("_before").isNull() | (F.col("_before") != F.col("phase")))
    closed = along(changes, ["run_id"], order, fitting, end_us=following(F.col("at_us")))
    spans = closed.filter(~fx.is_terminal(F.col("phase")))
    return top_per_group(spans, ["run_id"], [F.col(c) for c in order], max_spans, "number").select(
        "run_id", "number", "phase", F.col("at_us").alias("start_us"), "end_us")


def paired_markers(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Markers paired in order by (run, tool, depth): odd ones open, even ones close."""
    markers = _progress(events).filter(F.col("tool").isNotNull())
    paired = along(markers, ["run_id", "tool", "depth"], order, _number=rank(),
                   end_us=following(F.col("at_us")), _closed=following(F.struct(*order)))
    return paired.filter(F.col("_number") % 2 == 1).select(
        "run_id", "tool", "depth", F.col("at_us").alias("start_us"), "end_us", "_closed")


def nested_calls(events: DataFrame, order: Sequence[str], max_nested: int = MAX_NESTED) -> DataFrame:
    """Nested calls of each run: closed ones by when they closed, then those still open."""
    calls = paired_markers(events, order)
    placed = top_per_group(calls, ["run_id"], [F.col("end_us").isNull(), F.col("_closed"), F.col("depth"),
                                               F.col("start_us"), F.col("tool")], max_nested, "_kept")
    window = Window.partitionBy("run_id").orderBy("start_us", "depth", "tool")
    return placed.select("run_id", F.row_number().over(window).alias("number"), "tool", "depth",
                         "start_us", "end_us")


def open_chain(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Tools called and not yet returned, outermost first: those with an odd number of markers."""
    last = F.max_by("at_us", F.struct(*order))
    held = _progress(events).filter(F.col("tool").isNotNull()).groupBy("run_id", "depth", "tool").agg(
        F.count(F.lit(1)).alias("_n"), last.alias("_at")).filter(F.col("_n") % 2 == 1)
    return held.groupBy("run_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("depth", "_at", "tool"))), lambda c: c["tool"]), ">").alias("chain"))


def timeline(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per run: its spans, nested calls, open chain and last measurement, each as one text."""

    def listed(rows: DataFrame, label: str, name: str) -> DataFrame:
        text = F.concat_ws(":", label, "start_us", F.coalesce(F.col("end_us").cast("string"), F.lit("")))
        return rows.groupBy("run_id").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("number", text.alias("t")))), lambda r: r["t"]), " ").alias(name))

    last = _progress(events).groupBy("run_id").agg(
        F.max_by("measured", F.when(F.col("measured").isNotNull(), F.struct(*order))).alias("measured"))
    out = last
    for part in (listed(phase_spans(events, order), "phase", "spans"),
                 listed(nested_calls(events, order), "tool", "nested"), open_chain(events, order)):
        out = join_on(out, part, ["run_id"], "left")
    return out


def run_snapshot(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Where each run stands: its latest progress, and when it started; defaults for a silent run."""
    place = F.when(~F.col("is_log"), F.struct(*order))
    latest = F.max_by(F.struct("phase", "fraction", "message", "depth", "at_us"), place)
    runs = events.groupBy("run_id").agg(
        latest.alias("_last"), F.min_by("at_us", place).alias("started_us"))
    return runs.select(
        "run_id", F.coalesce(fx.phase_state(F.col("_last.phase")), F.lit("pending")).alias("state"),
        F.coalesce("_last.phase", F.lit("received")).alias("phase"), F.col("_last.fraction").alias("fraction"),
        F.coalesce("_last.message", F.lit("")).alias("message"),
        F.coalesce("_last.depth", F.lit(0)).alias("depth"), "started_us", F.col("_last.at_us").alias("updated_us"))


def until_terminal(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """The events of each run up to and including its first terminal one."""
    first = F.min(F.when(fx.is_terminal(F.col("phase")) & ~F.col("is_log"), F.struct(*order)))
    ends = events.groupBy("run_id").agg(first.alias("_end"))
    return join_on(events, ends, ["run_id"], "left").filter(
        F.col("_end").isNull() | (F.struct(*order) <= F.col("_end"))).drop("_end")


def cap_events(events: DataFrame, order: Sequence[str], limit: int = MAX_EVENTS) -> DataFrame:
    """The first `limit` progress events, one marker for what is not reported, every terminal event.

    The marker replaces the first non-terminal event past the limit.
    """
    numbered = along(_progress(events), ["run_id"], order, _number=rank())
    past = F.col("_number") > limit
    terminal = fx.is_terminal(F.col("phase"))
    first_cut = F.min(F.when(past & ~terminal, F.col("_number")))
    cuts = numbered.groupBy("run_id").agg(first_cut.alias("_cut"))
    marker = F.coalesce(F.col("_number") == F.col("_cut"), F.lit(False))
    note = F.lit(f"Progress messages past {limit} are not reported; the run continues.")
    kept = join_on(numbered, cuts, ["run_id"], "left").filter(~past | terminal | marker)
    return kept.select(
        *[c for c in events.columns if c not in ("fraction", "message")],
        F.when(~marker, F.col("fraction")).alias("fraction"),
        F.when(marker, note).otherwise(F.col("message")).alias("message"), marker.alias("truncated"))


def filter_logs(events: DataFrame, order: Sequence[str], audiences: Sequence[str],
                limit: int = MAX_LOGS) -> DataFrame:
    """Log lines for the audiences asked for, at most `limit` per run."""
    audience = F.when(F.col("audience").isin(fx.LOG_AUDIENCES), F.col("audience")).otherwise("admin")
    level = F.when(F.col("level").isin(fx.LOG_LEVELS), F.col("level")).otherwise("info")
    logs = events.filter(F.col("is_log")).withColumn("audience", audience).withColumn("level", level)
    return top_per_group(logs.filter(F.col("audience").isin(list(audiences))), ["run_id"],
                         [F.col(c) for c in order], limit, "number")


def notable_logs(events: DataFrame, order: Sequence[str], keep: int = KEPT_LOGS) -> DataFrame:
    """The newest warnings and errors and, apart, the newest other lines, redacted; debug is dropped."""
    logs = events.filter(F.col("is_log") & (F.coalesce("level", F.lit("")) != "debug")).withColumn(
        "serious", F.coalesce(F.col("level").isin(SERIOUS), F.lit(False)))
    kept = top_per_group(logs, ["run_id", "serious"], [F.col(c).desc() for c in order], keep)
    return kept.withColumn("message", scrub_text(F.col("message"))).drop("_position")


def last_stage(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """The latest thing a run said it was doing at its own level: no logs, markers or server lines."""
    own = events.filter(~F.col("is_log") & F.col("tool").isNull() & ~F.col("server")
                        & ((F.coalesce("message", F.lit("")) != "") | F.col("fraction").isNotNull()))
    return own.groupBy("run_id").agg(
        F.max_by(F.struct("message", "fraction"), F.struct(*order)).alias("_last")).select(
        "run_id", F.when(F.col("_last.message") != "", F.col("_last.message")).alias("stage"),
        F.col("_last.fraction").alias("fraction"))


def close_orphans(events: DataFrame, order: Sequence[str], restart_us: int) -> DataFrame:
    """A failed event, at the restart, for every run that was pending or running then; paused ones wait."""
    before = _progress(events).filter(F.col("at_us") < restart_us)
    last = before.groupBy("run_id").agg(F.max_by("phase", F.struct(*order)).alias("_phase"))
    return last.filter(fx.phase_state(F.col("_phase")).isin("pending", "running")).select(
        "run_id", F.lit(restart_us).cast("long").alias("at_us"), F.lit("failed").alias("phase"),
        F.lit("failed").alias("state"), F.lit(ORPHAN_MESSAGE).alias("message"))


def live_listing(events: DataFrame, order: Sequence[str], pauses: DataFrame | None = None,
                 limit: int | None = None, records: DataFrame | None = None) -> DataFrame:
    """The latest state per run, newest started first; a pause record overrides unless the run ended.

    With `records` (run_id, tool, client, batch_id, start_us; one row a run) each run has what it was registered with
    and the chain of calls it is in, and counts as started when it was registered.
    """
    place = F.struct(*order)
    rows = _progress(events).groupBy("run_id").agg(
        F.max_by(F.struct("phase", "fraction", "depth", "at_us"), place).alias("_last"),
        F.min_by("at_us", place).alias("started_us"))
    if pauses is not None:
        rows = join_on(rows, pauses.select("run_id").distinct().withColumn("_paused", F.lit(True)),
                       ["run_id"], "left")
        held = F.coalesce("_paused", F.lit(False)) & ~fx.is_terminal(F.col("_last.phase"))
    else:
        held = F.lit(False)
    phase = F.when(held, "paused").otherwise(F.col("_last.phase"))
    listed = rows.select("run_id", phase.alias("phase"), fx.phase_state(phase).alias("state"),
                         F.col("_last.fraction").alias("fraction"), F.col("_last.depth").alias("depth"),
                         "started_us", F.col("_last.at_us").alias("updated_us"))
    if records is not None:
        known = records.select("run_id", "tool", "client", "batch_id", F.when(F.col("start_us") > 0, F.col("start_us")).alias("_registered"))
        listed = join_on(join_on(listed, known, ["run_id"], "left"), open_chain(events, order), ["run_id"], "left")
        listed = listed.withColumns({"started_us": F.coalesce("_registered", "started_us"), "chain": F.coalesce("chain", F.lit(""))}).drop("_registered")
    newest = listed.orderBy(F.desc("started_us"), "run_id")
    return newest if limit is None else newest.limit(limit)


def idle_expiry(events: DataFrame, order: Sequence[str], now_us: int, ttl_s: int = 900,
                paused_ttl_s: int = 14400) -> DataFrame:
    """Periods of activity of each run, ended by silence: 900 s, or 14 400 s while paused."""
    allowed = F.when(F.col("phase") == "paused", paused_ttl_s).otherwise(ttl_s).cast("long") * 1_000_000
    deadline = F.col("at_us") + allowed
    fitting = fits(events, ["run_id"])
    marked = along(events, ["run_id"], order, fitting, _due=prev(deadline))
    # A period is named by its first event, the latest start so far.
    fresh = F.col("_due").isNull() | (F.col("at_us") >= F.col("_due"))
    periods = along(marked.withColumn("_start", F.when(fresh, F.struct(*order))), ["run_id"], order, fitting,
                    _number=running_last(F.col("_start")))
    return periods.groupBy("run_id", "_number").agg(
        F.min("at_us").alias("start_us"), F.max_by(deadline, F.struct(*order)).alias("expires_us"),
        F.count(F.lit(1)).alias("events")).select(
        "run_id", "start_us", "expires_us", "events", (F.col("expires_us") <= now_us).alias("expired"))
