"""Cleaning of untrusted event fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phase to state, and which states end a run.
STATE_OF_PHASE = {
    "received": "pending", "staging": "pending", "queued_gpu": "pending", "running": "running",
    "packaging": "running", "done": "done", "failed": "failed", "cancelled": "cancelled", "paused": "paused"}
TERMINAL_PHASES = ["done", "failed", "cancelled"]
LOG_LEVELS = ["debug", "info", "warning", "error", "metric"]
LOG_AUDIENCES = ["user", "admin"]
MAX_DEPTH = 10
MAX_MESSAGE_CHARS = 200
TOOL_NAME = r"^[A-Za-z0-9_-]{1,64}\z"
CALL_ID = r"^[0-9]{1,4}(\.[0-9]{1,4}){0,9}\z"
BATCH_ID = r"^[A-Za-z0-9_-]{8,64}\z"
MAX_BATCHES = 10000


def phase_state(phase: Column) -> Column:
    """The state a phase stands for, null for an unknown phase."""
    pairs = [F.lit(x) for pair in STATE_OF_PHASE.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), phase)


def is_terminal(phase: Column) -> Column:
    return F.coalesce(phase.isin(TERMINAL_PHASES), F.lit(False))


def clean_message(text: Column) -> Column:
    """One line, at most 200 characters, never null."""
    return F.substring(F.translate(F.coalesce(text, F.lit("")), "\r\n", "  "), 1, MAX_MESSAGE_CHARS)


def clean_fraction(value: Column) -> Column:
    """A number in 0..1, or null when there is no usable one."""
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def clean_span(span: Column) -> Column:
    """[start, end] within 0..1 with start <= end, or null."""
    start, end = clean_fraction(F.get(span, 0)), clean_fraction(F.get(span, 1))
    return F.when((F.size(span) == 2) & (start <= end), F.array(start, end))


def clean_amount(value: Column) -> Column:
    """A finite number not below zero, else null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (number >= 0) & (number != float("inf")), number)


def clean_measured(vram: Column, ram: Column, cores: Column, channels: Column) -> Column:
    """The four figures a run may report about itself; null when none is usable."""
    fields = {"vram_bytes": vram, "ram_bytes": ram, "cpu_cores": cores, "channels": channels}
    kept = [clean_amount(c).alias(n) for n, c in fields.items()]
    return F.when(F.coalesce(*[clean_amount(c) for c in fields.values()]).isNotNull(), F.struct(*kept))


def identifier(name: Column) -> Column:
    """The value if it is a plain identifier, else the empty string."""
    return F.when(F.coalesce(name.rlike(TOOL_NAME), F.lit(False)), name).otherwise("")


def call_parent(call: Column) -> Column:
    """The call one level up: `1.2.3` gives `1.2`, `1` gives the empty string."""
    return F.regexp_extract(call, r"^(.*)\.[^.]*$", 1)


def call_depth(call: Column) -> Column:
    return F.size(F.split(call, r"\."))


def parse_batch(batch_id: Column, index: Column, total: Column) -> Column:
    """struct(id, index, total), or null when any part is absent or implausible."""
    at, of = index.try_cast("long"), total.try_cast("long")
    good = batch_id.rlike(BATCH_ID) & (at >= 1) & (at <= of) & (of <= MAX_BATCHES)
    return F.when(good, F.struct(batch_id.alias("id"), at.alias("index"), of.alias("total")))
