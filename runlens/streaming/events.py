"""The event log as a stream: reading, de-duplication, listings, expiry and ledger rows.

A stream cannot number rows with a window; what has to be known of earlier events is
kept as state per run, and per-run time-outs are event-time timers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import zip_longest

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructField, StructType

from runlens.functions.events import TERMINAL_PHASES, phase_state
from runlens.functions.text import scrub_text
from runlens.operators.events import KEPT_LOGS, MAX_NESTED, MAX_SPANS, SERIOUS
from runlens.operators.ledger import ledger_upsert
from runlens.operators.progress import FIELDS, progress_tree

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TTL_US, PAUSED_TTL_US = 900 * 1_000_000, 14_400 * 1_000_000


def stream_events(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Event files as they arrive, one JSON object a line; malformed lines are dropped."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path)
    return lines.filter(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")).select(
        F.from_json("value", schema).alias("r")).select("r.*")


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what the source holds now into Parquet under `path`, and read it back."""
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint")
             .outputMode(mode).trigger(availableNow=True).start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def dedup_replay(stream: DataFrame, keys: list[str], time_column: str = "at", ttl: str = "900 seconds") -> DataFrame:
    """Replayed events dropped on their keys for as long as the watermark remembers them."""
    return stream.withWatermark(time_column, ttl).dropDuplicatesWithinWatermark(keys)


def stream_listing(stream: DataFrame, order: list[str]) -> DataFrame:
    """The latest state of every run, for `update` or `complete` output."""
    place = F.struct(*order)
    return stream.filter(~F.col("is_log")).groupBy("run_id").agg(
        F.max_by(F.struct("phase", "fraction", "depth", "at_us"), place).alias("_l"), F.min("at_us").alias("started_us")).select(
        "run_id", F.col("_l.phase").alias("phase"), phase_state(F.col("_l.phase")).alias("state"),
        F.col("_l.fraction").alias("fraction"), F.col("_l.depth").alias("depth"), "started_us", F.col("_l.at_us").alias("updated_us"))


class _JsonState(StatefulProcessor):
    """A processor whose state per key is one small JSON document."""

    def init(self, handle) -> None:
        self.handle = handle
        self.blob = handle.getValueState("state", "blob string")

    def load(self) -> dict | None:
        return json.loads(self.blob.get()[0]) if self.blob.exists() else None

    def save(self, state: dict) -> None:
        self.blob.update((json.dumps(state),))

    def handleInputRows(self, key, rows, timerValues):
        return iter(())

    def close(self) -> None:
        pass


def _in_order(rows, order: list[str]) -> list:
    return sorted(rows, key=lambda r: tuple(r[c] for c in order))


LEDGER_ROW = ("run_id long, outcome string, started_us long, ended_us long, seconds double, paused_seconds double, "
              "measured long, spans string, nested string, logs long, notable string")
EXPIRED_ROW = "run_id long, start_us long, expires_us long, events long"
GAP_ROW = "client long, batch_id string, run_id long, index long, missing long"


def _maker(schema: str) -> Row:
    """A function making rows with the names of a schema."""
    return Row(*[column.split()[0] for column in schema.split(", ")])


def _spans(changes: list) -> list[tuple]:
    """(phase, start, end) from the changes of phase [at, phase] of a run."""
    until = [at for at, _ in changes[1:]] + [None]
    spans = [(phase, at, end) for (at, phase), end in zip(changes, until) if phase not in TERMINAL_PHASES]
    return spans[:MAX_SPANS]


def _calls(marks: dict[str, list[int]]) -> list[tuple]:
    """(tool, start, end) of nested calls, by start: the marks of a name are its starts and ends in turn."""
    pairs = [(name.split("/", 1), start, end) for name, times in marks.items()
             for start, end in zip_longest(times[::2], times[1::2])]
    closed = sorted((p for p in pairs if p[2] is not None), key=lambda p: p[2])[:MAX_NESTED]
    running = sorted((p for p in pairs if p[2] is None), key=lambda p: (int(p[0][0]), p[1]))
    kept = closed + running[: MAX_NESTED - len(closed)]
    return [(tool, start, end) for (depth, tool), start, end in sorted(kept, key=lambda p: (p[1], int(p[0][0]), p[0][1]))]


def _listed(rows: list[tuple]) -> str:
    return " ".join(f"{name}:{start}:{'' if end is None else end}" for name, start, end in rows)


class _LedgerRows(_JsonState):
    """Gathers what a run's ledger row is made of, and gives the row at its first terminal event.

    Kept are the changes of phase, the marks of nested calls by name, and the last notable log lines;
    the row is computed from them once, at the end.
    """

    def __init__(self, order: list[str]):
        self.order = order

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.load() or {"phases": [], "marks": {}, "logs": {"serious": [], "other": []}}
        if "ended" in state:
            return
        ordered = _in_order(rows, self.order)
        last = next((i for i, r in enumerate(ordered) if not r["is_log"] and r["phase"] in TERMINAL_PHASES), None)
        taken = ordered if last is None else ordered[: last + 1]
        for row in taken:
            if not row["is_log"]:
                self._event(state, row)
            elif row["level"] != "debug":
                lines = state["logs"]["serious" if row["level"] in SERIOUS else "other"]
                lines.append([row["at_us"], row["event_id"], row["level"], row["message"]])
                del lines[:-KEPT_LOGS]
        if last is None:
            self.save(state)
            return
        yield self._row(key[0], ordered[last], state)
        # What stays behind keeps the run from being reported twice.
        self.save({"ended": True})

    @staticmethod
    def _event(state: dict, row) -> None:
        state.setdefault("start", row["at_us"])
        if row["measured"] is not None:
            state["measured"] = row["measured"]
        if row["tool"] is not None:
            state["marks"].setdefault(f"{row['depth']}/{row['tool']}", []).append(row["at_us"])
        elif row["depth"] == 0 and [row["phase"]] != [p for _, p in state["phases"][-1:]] and len(state["phases"]) <= MAX_SPANS:
            state["phases"].append([row["at_us"], row["phase"]])

    @staticmethod
    def _row(run_id, final, state: dict) -> Row:
        start, end = state["start"], final["at_us"]
        spans, logs = _spans(state["phases"]), sorted(state["logs"]["serious"] + state["logs"]["other"])
        paused = sum(b - a for phase, a, b in spans if phase == "paused" and b is not None)
        return _maker(LEDGER_ROW)(
            run_id, final["phase"], start, end, max(0, end - start - paused) / 1e6, paused / 1e6, state.get("measured"),
            _listed(spans), _listed(_calls(state["marks"])), len(logs), "\n".join(f"{level}: {message}" for _, _, level, message in logs))


def emit_on_terminal(stream: DataFrame, order: list[str]) -> DataFrame:
    """One ledger row per run, at its first terminal event, in append mode."""
    slim = stream.withColumn("message", F.when(F.col("is_log"), scrub_text(F.col("message")))).select(
        "run_id", *order, "phase", "is_log", "level", "message", "depth", "tool", "measured")
    return slim.groupBy("run_id").transformWithState(_LedgerRows(order), LEDGER_ROW, "append", "none")


class _Expiry(_JsonState):
    """Ends a run that has been silent for its time-out; any activity puts the end off."""

    def handleInputRows(self, key, rows, timerValues):
        state = self.load() or {"start": None, "at": None, "due": None, "n": 0}
        for row in _in_order(rows, ["at_us"]):
            state["start"] = row["at_us"] if state["start"] is None else state["start"]
            state["at"], state["n"] = row["at_us"], state["n"] + 1
            due = row["at_us"] + (PAUSED_TTL_US if row["phase"] == "paused" else TTL_US)
            if state["due"] is not None:
                self.handle.deleteTimer(state["due"] // 1000)
            state["due"] = due
        self.handle.registerTimer(state["due"] // 1000)
        self.save(state)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.load()
        if state is not None and state["due"] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.blob.clear()
            yield _maker(EXPIRED_ROW)(key[0], state["start"], state["due"], state["n"])


def stream_expiry(stream: DataFrame, time_column: str = "at") -> DataFrame:
    """Runs that expired, each when its own time-out passed; `at` carries the watermark."""
    return stream.withWatermark(time_column, "0 seconds").groupBy("run_id").transformWithState(
        _Expiry(), EXPIRED_ROW, "append", "eventTime")


class _CohortGaps(_JsonState):
    """Flags a cohort member still waiting, after the grace, for a lower index that never came."""

    def __init__(self, grace_us: int, forget_us: int):
        self.grace_us, self.forget_us = grace_us, forget_us

    def handleInputRows(self, key, rows, timerValues):
        state = self.load() or {"seen": [], "waiting": {}, "last": 0}
        for row in _in_order(rows, ["at_us"]):
            state["seen"] = sorted({*state["seen"], row["index"]})
            state["waiting"][str(row["run_id"])] = [row["index"], row["at_us"]]
            state["last"] = max(state["last"], row["at_us"])
            self.handle.registerTimer((row["at_us"] + self.grace_us) // 1000 + 1)
            self.handle.registerTimer((row["at_us"] + self.forget_us) // 1000 + 1)
        self.save(state)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, now = self.load(), expiredTimerInfo.getExpiryTimeInMs() * 1000
        if state is None:
            return
        if now - state["last"] > self.forget_us:
            self.blob.clear()
            return
        for run, (index, at) in list(state["waiting"].items()):
            if now - at > self.grace_us:
                del state["waiting"][run]
                below = sum(1 for seen in state["seen"] if seen < index)
                if below < index - 1:
                    yield _maker(GAP_ROW)(key[0], key[1], int(run), index, index - 1 - below)
        self.save(state)


def stream_cohort_gaps(stream: DataFrame, time_column: str = "at", grace_us: int = 10_000_000,
                       forget_us: int = 6 * 3600 * 1_000_000) -> DataFrame:
    """Cohort members flagged when their grace ran out with a lower index missing."""
    return stream.withWatermark(time_column, "0 seconds").groupBy("client", "batch_id").transformWithState(
        _CohortGaps(grace_us, forget_us), GAP_ROW, "append", "eventTime")


def progress_sink(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the bars of runs under `path`; a batch run twice writes the same place.

    Events are kept as they come. The runs that a batch concerns are read again from their first event, by the
    partitions their ids fall in, and what the batch's own events show is added to the bars. Events of
    a run come in order, as a log does.
    """
    buckets = 64

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slot = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("slot")
        fresh = batch.select("run_id", *order, *FIELDS, slot, F.lit(number).alias("seen"))
        fresh.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/events/batch={number}")
        kept = spark.read.schema(StructType([*fresh.schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{path}/events").parquet(f"{path}/events")
        kept = kept.filter(F.col("batch") <= number)
        runs = kept.filter(F.col("batch") == number).select("run_id", "slot").distinct()
        slots = [r["slot"] for r in runs.select("slot").distinct().collect()]
        told = kept.filter(F.col("slot").isin(slots)).join(runs, ["run_id", "slot"], "left_semi")
        shown = progress_tree(told, order)
        own = kept.filter(F.col("batch") == number).select("run_id", *order)
        shown.join(own, ["run_id", *order], "left_semi").write.mode("overwrite").parquet(f"{path}/bars/batch={number}")

    return write


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The bars as kept by `progress_sink`."""
    return spark.read.parquet(f"{path}/bars").drop("batch")


def ledger_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps ledger records; a batch run twice writes the same place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_ledger(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """The ledger as kept by `ledger_sink`: its records folded to one row per run."""
    return ledger_upsert(spark.read.parquet(path), order)
