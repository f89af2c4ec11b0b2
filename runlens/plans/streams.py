"""Queries that run the event log as a stream, and the transform registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import ledger
from runlens.plans.bindings import EVENT_ORDER, RUNS_NOW_US, SQL, define, events, runs
from runlens.plans import events as _event_bindings  # noqa: F401 - defines the SQL of spans and calls
from runlens.plans.ledger import r
from runlens.plans.registry import query
from runlens.registry import Argument, Transforms
from runlens.session import scratch
from runlens.streaming import events as stream
from runlens.operators.progress import progress_tree as batch_progress

LOG_LINE = ("run_id long, at_us long, event_id long, phase string, fraction double, is_log boolean, level string, "
            "server boolean, depth long, tool string, message string, k long")


def logged(spark, sf):
    """The path of the events written as log files, a torn line after every twentieth."""
    path = scratch(spark, "log")
    n = F.col("event_id")
    line = F.to_json(F.struct(*[c.split()[0] for c in LOG_LINE.split(", ")]))
    torn = F.when(n % 20 == 0, F.array(line, F.substring(line, 1, 30))).otherwise(F.array(line))
    events(spark, sf).select(F.explode(torn).alias("value")).write.text(path)
    return path


def opened(spark, sf):
    """The log read as a stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    return stream.stream_events(spark, logged(spark, sf), LOG_LINE)


@query("stream_events", "SELECT run_id, event_id, at_us, phase, is_log, depth, tool, k FROM @evt")
def stream_events(spark, sf):
    tail = opened(spark, sf).select("run_id", "event_id", "at_us", "phase", "is_log", "depth", "tool", "k")
    return stream.run_to_end(tail, scratch(spark, "tail"))


@query("dedup_replay", "SELECT run_id, event_id FROM @evt")
def dedup_replay(spark, sf):
    path = scratch(spark, "log")
    line = F.to_json(F.struct("run_id", "event_id", "at_us"))
    twice = F.when(F.col("event_id") % 3 == 0, F.array(line, line, line)).otherwise(F.array(line))
    events(spark, sf).select(F.explode(twice).alias("value")).write.text(path)
    tail = stream.stream_events(spark, path, "run_id long, event_id long, at_us long").withColumn("at", F.timestamp_micros("at_us"))
    return stream.run_to_end(stream.dedup_replay(tail, ["run_id", "event_id"]), scratch(spark, "unique")).select("run_id", "event_id")


define("evtend", """(SELECT * EXCLUDE (fin) FROM (SELECT *, min(CASE WHEN phase IN ('done', 'failed', 'cancelled') AND NOT is_log THEN pos END) OVER (PARTITION BY run_id) AS fin FROM @evt)
  WHERE fin IS NOT NULL AND pos <= fin)""")


def _until(name: str) -> str:
    """A binding's SQL over the events up to each run's end."""
    sql = SQL[name].replace("@evt", "@evtend")
    return sql.replace("@pairs", SQL["pairs"].replace("@evt", "@evtend"))


@query("emit_on_terminal", f"""WITH s AS {_until('phasespans')}, n AS {_until('nested')},
e AS (SELECT run_id, arg_max(phase, pos) AS outcome, min(at_us) FILTER (NOT is_log) AS started_us, max(at_us) FILTER (NOT is_log) AS ended_us, arg_max(k, pos) FILTER (NOT is_log AND server AND k IS NOT NULL) AS measured,
  least(20, count(*) FILTER (is_log AND level IN ('warning', 'error'))) + least(20, count(*) FILTER (is_log AND level = 'info')) AS logs FROM @evtend GROUP BY run_id),
p AS (SELECT run_id, sum(end_us - start_us) FILTER (phase = 'paused' AND end_us IS NOT NULL) AS paused, string_agg(concat(phase, ':', start_us, ':', coalesce(CAST(end_us AS VARCHAR), '')), ' ' ORDER BY number) AS spans FROM s GROUP BY run_id),
c AS (SELECT run_id, string_agg(concat(tool, ':', start_us, ':', coalesce(CAST(end_us AS VARCHAR), '')), ' ' ORDER BY number) AS nested FROM n GROUP BY run_id)
SELECT run_id, outcome, started_us, ended_us, greatest(0, ended_us - started_us - coalesce(paused, 0)) / 1e6 AS seconds, coalesce(paused, 0) / 1e6 AS paused_seconds, measured,
  coalesce(spans, '') AS spans, coalesce(nested, '') AS nested, logs FROM e LEFT JOIN p USING (run_id) LEFT JOIN c USING (run_id)""")
def emit_on_terminal(spark, sf):
    log = opened(spark, sf).withColumn("measured", F.when(F.col("server"), F.col("k")))
    return stream.run_to_end(stream.emit_on_terminal(log, EVENT_ORDER), scratch(spark, "ledger")).drop("notable")


def weighted(rows):
    """Events as nested calls with spans report them."""
    n, k = F.col("event_id"), F.col("k")
    marker = n % 7 == 0
    call = F.when(n % 3 == 0, "1").when(n % 3 == 1, "1.1").otherwise("2")
    return rows.filter(~F.col("is_log")).select(
        "run_id", *EVENT_ORDER, (n % 11 == 0).alias("server"), F.when(marker, F.concat(F.lit("T"), n % 3)).alias("tool"),
        F.when(marker & (n % 2 == 0), F.when(n % 4 == 0, "open").otherwise("close")).alias("edge"),
        F.when(marker & (n % 5 > 0), k / 200).alias("span_start"), F.when(marker & (n % 5 > 0), 0.5 + k / 200).alias("span_end"),
        F.when(marker | (n % 5 == 0), call).alias("call"),
        F.when(marker, F.size(F.split(call, r"\."))).when(n % 4 == 0, n % 3).cast("long").alias("depth"),
        F.when(~marker, F.col("fraction")).alias("fraction"))


# The bound calls are 1, 1.1 and 2: each has its columns, running along the events of a run.
CALLS = {"a": "1", "b": "1.1", "c": "2"}


def _calls(text: str) -> str:
    return ", ".join(text.format(c=c, call=call) for c, call in CALLS.items())


def _nearest(value: str) -> str:
    """Four decimals of the binary value itself."""
    lost = f"(({value} * 134217729 - ({value} * 134217729 - {value})) * 1e4 - {value} * 1e4) + ({value} - ({value} * 134217729 - ({value} * 134217729 - {value}))) * 1e4"
    return f"""CASE WHEN {value} * 1e4 - floor({value} * 1e4) <> 0.5 OR {lost} = 0 THEN round_even({value} * 1e4, 0) WHEN {lost} > 0 THEN floor({value} * 1e4) + 1 ELSE floor({value} * 1e4) END / 1e4"""


PROGRESS_SQL = f"""WITH e AS (SELECT run_id, at_us, event_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n, event_id % 11 = 0 AS server, event_id % 7 = 0 AS marker,
  CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'open' ELSE 'close' END END AS edge,
  CASE WHEN event_id % 7 = 0 AND event_id % 5 > 0 THEN k / 200 END AS low, CASE WHEN event_id % 7 = 0 AND event_id % 5 > 0 THEN 0.5 + k / 200 END AS high,
  CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN (['1', '1.1', '2'])[1 + event_id % 3] END AS call,
  CASE WHEN event_id % 7 = 0 THEN ([1, 2, 1])[1 + event_id % 3] WHEN event_id % 4 = 0 THEN event_id % 3 END AS depth,
  CASE WHEN event_id % 7 <> 0 THEN fraction END AS fraction FROM @evt WHERE NOT is_log),
o AS (SELECT *, marker AND NOT server AS m, count(*) FILTER (marker AND NOT server AND (edge IS NULL OR edge = 'open')) OVER (PARTITION BY run_id, call ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS known FROM e),
t AS (SELECT *, m AND (edge IS NOT DISTINCT FROM 'open' OR (edge IS NULL AND NOT known)) AS opens FROM o),
s AS (SELECT *, {_calls("bool_or(opens AND call = '{call}') OVER w AS open_{c}, bool_or(m AND NOT opens AND call = '{call}') OVER w AS over_{c}, "
                        "last_value(CASE WHEN opens AND call = '{call}' THEN struct_pack(low := CASE WHEN low <= high THEN low END, high := high) END IGNORE NULLS) OVER w AS span_{c}")}
  FROM t WINDOW w AS (PARTITION BY run_id ORDER BY n)),
r AS (SELECT *, {_calls("coalesce(open_{c}, false) AND NOT coalesce(over_{c}, false) AS runs_{c}, span_{c}.low IS NOT NULL AS has_{c}")} FROM s),
u AS (SELECT *, CASE WHEN server THEN NULL WHEN call IS NOT NULL THEN call WHEN depth = 0 THEN '' WHEN depth = 2 THEN CASE WHEN runs_b THEN '1.1' END
  WHEN runs_a AND runs_c THEN NULL WHEN depth IS NULL AND runs_b THEN '1.1' WHEN runs_a THEN '1' WHEN runs_c THEN '2' WHEN depth IS NULL THEN '' END AS who FROM r),
k AS (SELECT *, last_value(CASE WHEN NOT marker AND who = '' THEN fraction END IGNORE NULLS) OVER w AS mark,
  {_calls("last_value(CASE WHEN NOT marker AND who = '{call}' THEN fraction END IGNORE NULLS) OVER w AS mark_{c}")} FROM u WINDOW w AS (PARTITION BY run_id ORDER BY n)),
b AS (SELECT *, CASE WHEN over_b THEN 1.0 ELSE mark_b END AS at_b, CASE WHEN over_c THEN 1.0 ELSE mark_c END AS at_c FROM k),
a AS (SELECT *, CASE WHEN over_a THEN 1.0 ELSE greatest(mark_a, CASE WHEN open_b THEN span_b.low + (span_b.high - span_b.low) * coalesce(at_b, 0) END) END AS at_a FROM b),
g AS (SELECT *, greatest(mark, CASE WHEN open_a THEN span_a.low + (span_a.high - span_a.low) * coalesce(at_a, 0) END,
  CASE WHEN open_c THEN span_c.low + (span_c.high - span_c.low) * coalesce(at_c, 0) END) AS at_run FROM a),
h AS (SELECT *, CASE WHEN who = '' THEN CASE WHEN has_a OR has_c THEN at_run END WHEN who = '2' THEN CASE WHEN has_c THEN at_run END
  WHEN who = '1' THEN CASE WHEN has_a THEN at_run WHEN has_b THEN at_a END WHEN who = '1.1' THEN CASE WHEN has_b AND has_a THEN at_run WHEN has_b THEN at_a END END AS bar FROM g)
SELECT run_id, at_us, event_id, CASE WHEN bar IS NULL THEN fraction ELSE {_nearest('bar')} END AS fraction, CASE WHEN bar IS NOT NULL AND fraction <> bar THEN fraction END AS own_fraction,
  CAST(CASE WHEN call IS NULL AND depth IS NULL AND who <> '' THEN len(string_split(who, '.')) ELSE coalesce(depth, 0) END AS BIGINT) AS depth FROM h"""


@query("progress_tree", PROGRESS_SQL)
def progress_tree(spark, sf):
    return batch_progress(weighted(events(spark, sf)), EVENT_ORDER)


TRANSFORMS = Transforms()


@TRANSFORMS.register("Tool_Uptime", now_us=Argument(int))
def _uptime(df, now_us):
    return ledger.tool_uptime(df, now_us)


@TRANSFORMS.register("Newest_Runs", limit=Argument(int), tool=Argument(str, required=False))
def _newest(df, limit, tool=None):
    return ledger.newest_runs(df, limit, tool)


@TRANSFORMS.register("Search_Runs", text=Argument(str, required=False), outcome=Argument(str, required=False, choices=("done", "failed")))
def _search(df, text=None, outcome=None):
    return ledger.history_search(df, text=text, outcome=outcome)


TRANSFORMS.dispatch("History", {"newest": "Newest_Runs", "search": "Search_Runs"})


@query("register_transform", f"""SELECT tool, count(*) AS runs, count(*) FILTER (end_us IS NULL) AS running,
  {r(f'sum(CASE WHEN end_us IS NULL THEN greatest({RUNS_NOW_US} - start_us, 0) ELSE end_us - start_us END) / 1e6', 1)} AS seconds FROM @runs GROUP BY tool""")
def register_transform(spark, sf):
    return TRANSFORMS.run("tool-uptime", runs(spark, sf), now_us=str(RUNS_NOW_US)).select("tool", "runs", "running", "seconds")


@query("dispatch_by_mode", """SELECT run_id, outcome FROM @runs WHERE outcome = 'failed' AND contains(lower(concat_ws(' ', run_id, tool, client, batch_id)), '77')""")
def dispatch_by_mode(spark, sf):
    return TRANSFORMS.run("history", runs(spark, sf), mode="search", text="77", outcome="failed").select("run_id", "outcome")
