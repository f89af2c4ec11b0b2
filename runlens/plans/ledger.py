"""Queries over the run ledger, spans and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import ledger as ops
from runlens.operators import series
from runlens.plans.bindings import EVENT_ORDER, EVENTS_NOW_US, RUNS_NOW_US, define, events, runs, spans, table
from runlens.plans.registry import query

# Noon of the last day that has runs, so that some of them are recent.
NOON_US = RUNS_NOW_US - 43200 * 1_000_000
STATE = ("CASE WHEN {p} IN ('received', 'staging', 'queued_gpu') THEN 'pending' "
         "WHEN {p} IN ('running', 'packaging') THEN 'running' ELSE {p} END")


def r(expression: str, digits: int) -> str:
    """The oracle's rounding."""
    return f"round_even(({expression}) * 1e{digits}, 0) / 1e{digits}"


define("live", """(SELECT run_id, client, tool, start_us, CASE WHEN run_id % 3 = 0 THEN 'queued_gpu' WHEN run_id % 7 = 0
  THEN 'paused' ELSE 'running' END AS phase, batch_id, batch_total FROM @runs WHERE outcome IS NULL)""")


def live(spark, sf):
    """Runs in flight: those without an outcome."""
    phase = F.when(F.col("run_id") % 3 == 0, "queued_gpu").when(F.col("run_id") % 7 == 0, "paused").otherwise("running")
    rows = runs(spark, sf).filter(F.col("outcome").isNull()).withColumn("phase", phase)
    state = F.when(F.col("phase") == "queued_gpu", "pending").otherwise(F.col("phase"))
    return rows.withColumn("state", state).withColumn("updated_us", F.col("start_us"))


@query("history_search", """SELECT run_id, client, tool, outcome FROM @runs WHERE outcome = 'done'
AND contains(lower(concat_ws(' ', run_id, tool, client, batch_id)), '12')""")
def history_search(spark, sf):
    return ops.history_search(runs(spark, sf), outcome="done", text="12").select("run_id", "client", "tool", "outcome")


@query("mask_ids", """SELECT concat('~', substr(sha256(concat('k1', o_orderkey)), 1, 20)) AS run_id,
  concat('~', substr(sha256(concat('k1', o_custkey)), 1, 20)) AS parent, o_orderpriority AS tool FROM orders""")
def mask_ids(spark, sf):
    rows = runs(spark, sf).select("run_id", F.array("client").alias("parents"), "tool")
    return ops.mask_ids(rows, ["run_id"], "k1", nested=["parents"]).select(
        "run_id", F.get("parents", 0).alias("parent"), "tool")


@query("paused_split", f"""WITH p AS (SELECT run_id, sum(greatest(end_us - start_us, 0)) AS p FROM @spans
  WHERE phase = 'paused' AND end_us IS NOT NULL GROUP BY run_id)
SELECT run_id, {r('greatest(greatest(end_us - start_us, 0) - coalesce(p, 0), 0) / 1e6', 2)} AS seconds,
  {r('coalesce(p, 0) / 1e6', 2)} AS paused_seconds FROM @runs LEFT JOIN p USING (run_id) WHERE end_us IS NOT NULL""")
def paused_split(spark, sf):
    return ops.paused_split(runs(spark, sf), spans(spark, sf))


@query("tool_uptime", f"""WITH e AS (SELECT *, CASE WHEN end_us IS NULL THEN greatest({RUNS_NOW_US} - start_us, 0)
  ELSE end_us - start_us END AS e FROM @runs)
SELECT tool, count(*) AS runs, count(*) FILTER (end_us IS NULL) AS running, count(*) FILTER (outcome = 'done') AS ok,
  count(*) FILTER (outcome = 'failed') AS failed, {r('sum(e) / 1e6', 1)} AS seconds, {r('max(e) / 1e6', 1)} AS longest,
  max(coalesce(end_us, start_us)) AS last_seen_us, {r(r('sum(e) / 1e6', 1) + ' / count(*)', 1)} AS mean FROM e GROUP BY tool""")
def tool_uptime(spark, sf):
    return ops.tool_uptime(runs(spark, sf), RUNS_NOW_US)


@query("tool_summary", f"""SELECT tool, count(*) AS runs, count(*) FILTER (outcome = 'done') AS ok,
  count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (end_us IS NULL) AS running,
  {r('sum(end_us - start_us) / 1e6 / count(end_us)', 1)} AS mean_seconds,
  {r('sum(waited_us) FILTER (end_us IS NOT NULL) / 1e6 / count(end_us)', 2)} AS mean_wait FROM @runs GROUP BY tool""")
def tool_summary(spark, sf):
    return ops.tool_summary(runs(spark, sf))


@query("queue_ranking", f"""WITH w AS (SELECT concat('T', event_id % 4) AS tool,
  CAST(greatest(round_even(CAST(round_even(value * 1e5, 0) AS BIGINT) / 10000, 0), 0) AS BIGINT) AS w FROM @evt)
SELECT tool, count(*) AS runs, count(*) FILTER (w >= 5) AS queued, sum(w) / 100 AS total_wait, max(w) / 100 AS worst_wait,
  {r('sum(w) / 100 / count(*)', 2)} AS mean_wait FROM w GROUP BY tool""")
def queue_ranking(spark, sf):
    return ops.queue_ranking(events(spark, sf).select(
        F.concat(F.lit("T"), F.col("event_id") % 4).alias("tool"),
        F.rint(F.col("value") * 100_000).cast("long").alias("waited_us")))


@query("phase_means", f"""SELECT tool, phase, {r('sum(end_us - start_us) / 1e6', 1)} AS seconds, count(*) AS runs,
  {r('sum(end_us - start_us) / 1e6 / count(*)', 2)} AS mean FROM @spans WHERE end_us IS NOT NULL GROUP BY tool, phase""")
def phase_means(spark, sf):
    return ops.phase_means(spans(spark, sf))


@query("phase_share", f"""SELECT run_id, phase, {r('greatest(0, least(100, any_value(s) / any_value(w) * 100))', 1)} AS percent
FROM (SELECT run_id, phase, sum(end_us - start_us) AS s FROM @spans WHERE end_us IS NOT NULL
  AND phase IN ('received', 'staging', 'queued_gpu', 'running', 'packaging') GROUP BY run_id, phase)
JOIN (SELECT run_id, end_us - start_us AS w FROM @runs WHERE end_us > start_us) USING (run_id) WHERE s <> 0 GROUP BY run_id, phase""")
def phase_share(spark, sf):
    return ops.phase_share(spans(spark, sf), runs(spark, sf))


@query("run_compute", """SELECT run_id, NULL AS callee, coalesce(sum(CASE WHEN phase = 'running' THEN end_us - start_us END), 0) / 1e6 AS seconds
FROM @spans GROUP BY run_id UNION ALL SELECT run_id, tool, sum(end_us - start_us) / 1e6 FROM @spans
WHERE end_us IS NOT NULL AND depth > 0 GROUP BY run_id, tool""")
def run_compute(spark, sf):
    return ops.run_compute(spans(spark, sf))


@query("history_kpis", """WITH c AS (SELECT run_id, sum(end_us - start_us) AS ran FROM @spans WHERE phase = 'running' AND end_us IS NOT NULL
  GROUP BY run_id), f AS (SELECT r.*, coalesce(ran, 0) AS ran, coalesce(end_us - start_us, 0) AS took FROM @runs r LEFT JOIN c USING (run_id))
SELECT tool, count(*) AS runs, count(*) - count(*) FILTER (outcome = 'done') AS failed,
  CAST(floor(count(*) FILTER (outcome = 'done') * 100 / count(*) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS succeeded_percent,
  sum(ran) / 1e6 AS ran, sum(waited_us) / 1e6 AS waited, sum(took) / 1e6 AS took, max(took) / 1e6 AS longest
FROM f GROUP BY GROUPING SETS ((tool), ())""")
def history_kpis(spark, sf):
    return ops.history_kpis(runs(spark, sf), spans(spark, sf))


@query("client_activity", f"""WITH p AS (SELECT client, CASE WHEN end_us IS NOT NULL THEN batch_id END AS batch_id, batch_total, tool,
  row(1, start_us, run_id) AS place, coalesce(end_us, start_us) AS seen,
  CASE WHEN {NOON_US} - start_us < 86400000000 THEN 1 ELSE 0 END AS today, CASE WHEN outcome = 'done' THEN 1 ELSE 0 END AS done,
  CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END AS failed, 0 AS running, 0 AS waiting, coalesce(end_us, start_us) AS last, start_us
  FROM @runs WHERE {NOON_US} - coalesce(end_us, start_us) <= 86400000000
  UNION ALL SELECT client, batch_id, batch_total, tool, row(0, start_us, run_id), start_us, 0, 0, 0,
  CASE WHEN phase = 'running' THEN 1 ELSE 0 END, CASE WHEN phase <> 'running' THEN 1 ELSE 0 END, {NOON_US}, start_us
  FROM @live WHERE phase <> 'paused'),
c AS (SELECT client, batch_id, arg_max(tool, place) AS tool, arg_max(batch_total, place) AS total, sum(done) AS done,
  sum(failed) AS failed, sum(running) AS running, sum(waiting) AS waiting, sum(today) AS today, max(seen) AS seen,
  max(last) AS last, min(start_us) AS started_us FROM p GROUP BY client, batch_id),
k AS (SELECT client, max(seen) AS last_seen_us, sum(running) AS client_running, sum(waiting) AS client_waiting,
  sum(today) AS runs_today FROM c GROUP BY client),
u AS (SELECT DISTINCT c_custkey AS client FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT coalesce(k.client, u.client) AS client, u.client IS NOT NULL AS custom, coalesce(last_seen_us, 0) AS last_seen_us,
  coalesce(client_running, 0) AS client_running, coalesce(client_waiting, 0) AS client_waiting, coalesce(runs_today, 0) AS runs_today,
  batch_id, tool, total, done, failed, running, waiting, started_us FROM k FULL JOIN u ON k.client = u.client
LEFT JOIN (SELECT * FROM c WHERE batch_id IS NOT NULL AND (running + waiting > 0 OR {NOON_US} - last < 900000000)) s
  ON s.client = coalesce(k.client, u.client)""")
def client_activity(spark, sf):
    rules = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("client"))
    return ops.client_activity(live(spark, sf), runs(spark, sf), rules, NOON_US)


@query("runs_in_flight", """SELECT client, count(*) AS in_flight, count(*) >= 4 AS refused FROM @live WHERE phase <> 'paused' GROUP BY client""")
def runs_in_flight(spark, sf):
    return ops.runs_in_flight(live(spark, sf), 4)


@query("nested_share", """WITH t AS (SELECT tool, sum(end_us - start_us) AS total FROM @runs WHERE end_us IS NOT NULL GROUP BY tool),
i AS (SELECT r.tool, s.tool AS callee, sum(s.end_us - s.start_us) AS inside FROM @spans s JOIN @runs r USING (run_id)
  WHERE s.depth = 1 AND s.end_us IS NOT NULL GROUP BY r.tool, s.tool)
SELECT tool, callee, CAST(floor(inside / total * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS percent FROM i JOIN t USING (tool)""")
def nested_share(spark, sf):
    return ops.nested_share(runs(spark, sf), spans(spark, sf))


# The listing is of other runs than the ledger, but for those that both have.
SHIFT = 1000


@query("live_ledger_join", f"""WITH l AS (SELECT run_id + {SHIFT} AS run_id, arg_max(phase, row(start_us, l_linenumber, l_partkey, l_suppkey)) AS phase FROM @spans
  GROUP BY run_id), g AS (SELECT * FROM @runs)
SELECT coalesce(l.run_id, g.run_id) AS run_id, phase, {STATE.format(p='phase')} AS state, tool, outcome, l.run_id IS NOT NULL AS in_live,
  g.run_id IS NOT NULL AS in_ledger, NOT coalesce({STATE.format(p='phase')} IN ('running', 'pending'), false) AND end_us IS NOT NULL AS in_history
FROM l FULL JOIN g ON l.run_id = g.run_id""")
def live_ledger_join(spark, sf):
    from runlens.functions.events import phase_state

    listing = spans(spark, sf).groupBy((F.col("run_id") + SHIFT).alias("run_id")).agg(F.max_by(
        "phase", F.struct("start_us", "l_linenumber", "l_partkey", "l_suppkey")).alias("phase")).withColumn(
        "state", phase_state(F.col("phase")))
    return ops.live_ledger_join(listing, runs(spark, sf))


SPAN_ORDER = ["run_id", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
define("held", """(SELECT *, coalesce(end_us, start_us + 30000000) AS fin FROM @spans)""")


@query("solo_runs", """WITH e AS (SELECT *, start_us AS t, 1 AS delta FROM @held UNION ALL SELECT *, fin, -1 FROM @held),
s AS (SELECT *, sum(delta) OVER (ORDER BY t, delta, run_id, l_linenumber, l_partkey, l_suppkey, l_quantity
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live FROM e),
n AS (SELECT *, lead(t) OVER (ORDER BY t, run_id, l_linenumber, l_partkey, l_suppkey, l_quantity) AS nxt FROM s WHERE delta = 1)
SELECT run_id, l_linenumber, l_partkey, l_suppkey, coalesce(live, 0) = depth AND (nxt IS NULL OR nxt >= fin) AS solo FROM n""")
def solo_runs(spark, sf):
    held = spans(spark, sf).select(*SPAN_ORDER, "start_us", "depth",
                                   F.coalesce("end_us", F.col("start_us") + 30_000_000).alias("end_us"))
    return ops.solo_runs(held, SPAN_ORDER).select("run_id", "l_linenumber", "l_partkey", "l_suppkey", "solo")


@query("queue_positions", """WITH b AS (SELECT run_id, start_us, CASE WHEN tool = '1-URGENT' AND run_id % 4 > 0 THEN -(run_id % 4)
  WHEN tool = '2-HIGH' THEN 1 ELSE 2 END AS band FROM @runs WHERE outcome IS NULL)
SELECT run_id, band, row_number() OVER (ORDER BY band, start_us, run_id) AS position FROM b""")
def queue_positions(spark, sf):
    waiting = runs(spark, sf).filter(F.col("outcome").isNull()).select(
        "run_id", "start_us", F.when(F.col("tool") == "1-URGENT", F.col("run_id") % 4).otherwise(0).alias("depth"),
        F.when(F.col("tool") == "2-HIGH", "high").otherwise("normal").alias("priority"))
    return ops.queue_positions(waiting, ["start_us", "run_id"]).select("run_id", "band", "position")


@query("newest_runs", "SELECT run_id, tool, start_us FROM @runs WHERE tool = '1-URGENT' ORDER BY start_us DESC, run_id DESC LIMIT 80")
def newest_runs(spark, sf):
    return ops.newest_runs(runs(spark, sf), 80, "1-URGENT").select("run_id", "tool", "start_us")


@query("history_compact", """SELECT run_id, end_us FROM @runs WHERE end_us IS NOT NULL ORDER BY end_us DESC, run_id DESC
LIMIT (SELECT CASE WHEN count(end_us) > 3000 THEN 1000 ELSE count(end_us) END FROM @runs)""")
def history_compact(spark, sf):
    return ops.history_compact(runs(spark, sf)).select("run_id", "end_us")


@query("sequence_gaps", """SELECT o_orderkey AS run_id, missing FROM (SELECT o_orderkey, unnest(range(greatest(o_custkey % 9, 1))) AS missing
  FROM orders) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber - 1 = missing)""")
def sequence_gaps(spark, sf):
    received = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") - 1).alias("part"))
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 9).alias("parts"))
    return ops.sequence_gaps(received, expected, ["run_id"])


@query("cohort_gap_monitor", f"""WITH a AS (SELECT client, batch_id, run_id, batch_index AS index, start_us AS at_us FROM @runs),
k AS (SELECT client, batch_id FROM a GROUP BY client, batch_id HAVING {NOON_US + 60 * 1_000_000} - max(at_us) <= 21600000000 * 4)
SELECT client, batch_id, run_id, index, index - (SELECT count(DISTINCT b.index) FROM a b WHERE b.batch_id = a.batch_id AND b.index <= a.index) AS missing
FROM a JOIN k USING (client, batch_id) WHERE {NOON_US + 60 * 1_000_000} - at_us > 10000000
  AND index > (SELECT count(DISTINCT b.index) FROM a b WHERE b.batch_id = a.batch_id AND b.index <= a.index)""")
def cohort_gap_monitor(spark, sf):
    arrivals = runs(spark, sf).select("client", "batch_id", "run_id", F.col("batch_index").alias("index"), F.col("start_us").alias("at_us"))
    return ops.cohort_gaps(arrivals, NOON_US + 60 * 1_000_000, forgotten_us=86400 * 1_000_000)


define("ledgered", """(SELECT run_id, pos, at_us, (['start', 'resume', 'grant', 'inputs', 'end'])[event_id % 5 + 1] AS kind,
  CASE WHEN k % 3 > 0 THEN concat('T', event_id % 4) END AS tool, CASE WHEN k % 4 > 0 THEN concat('c', k % 7) END AS client,
  CASE WHEN k % 2 = 0 THEN at_us - 1000000 * k END AS started_us, CAST(round_even(value * 1e6, 0) AS BIGINT) AS waited_us,
  CASE WHEN k > 10 THEN k END AS channels, k AS files, CASE WHEN k > 50 THEN 'done' ELSE 'failed' END AS outcome FROM @evt)""")


def ledger_records(spark, sf):
    """What reaches the ledger of a run: start, resume, grant, inputs and end records, from events."""
    n, k = F.col("event_id"), F.col("k")
    return events(spark, sf).select(
        "run_id", *EVENT_ORDER,
        F.get(F.array(*[F.lit(v) for v in ("start", "resume", "grant", "inputs", "end")]), (n % 5).cast("int")).alias("kind"),
        F.when(k % 3 > 0, F.concat(F.lit("T"), n % 4)).alias("tool"), F.when(k % 4 > 0, F.concat(F.lit("c"), k % 7)).alias("client"),
        F.when(k % 2 == 0, F.col("at_us") - 1_000_000 * k).alias("started_us"),
        F.rint(F.col("value") * 1e6).cast("long").alias("waited_us"), F.when(k > 10, k).alias("channels"), k.alias("files"),
        F.when(k > 50, "done").otherwise("failed").alias("outcome"))


@query("ledger_upsert", """WITH m AS (SELECT *, min(CASE WHEN kind <> 'end' THEN pos END) OVER (PARTITION BY run_id) AS made FROM @ledgered),
k AS (SELECT *, min(CASE WHEN kind = 'end' THEN pos END) OVER (PARTITION BY run_id) AS ended FROM m WHERE pos >= made)
SELECT run_id, coalesce(arg_max(tool, pos) FILTER (kind = 'start' AND tool IS NOT NULL), arg_min(tool, pos) FILTER (kind = 'resume' AND tool IS NOT NULL)) AS tool,
  coalesce(arg_max(client, pos) FILTER (kind = 'start' AND client IS NOT NULL), arg_min(client, pos) FILTER (kind = 'resume' AND client IS NOT NULL)) AS client,
  least(min(at_us), min(started_us) FILTER (kind = 'resume' AND (ended IS NULL OR pos < ended))) AS started_us,
  arg_max(waited_us, pos) FILTER (kind = 'grant') AS waited_us, arg_max(channels, pos) FILTER (kind = 'grant' AND channels IS NOT NULL) AS channels,
  arg_max(files, pos) FILTER (kind = 'inputs') AS files, arg_max(outcome, pos) FILTER (kind = 'end') AS outcome,
  max(at_us) FILTER (kind = 'end') AS ended_us FROM k GROUP BY run_id""")
def ledger_upsert(spark, sf):
    return ops.ledger_upsert(ledger_records(spark, sf), EVENT_ORDER)


@query("width_reached", """SELECT run_id, CASE WHEN bool_or(run_id % 5 > 0) THEN coalesce(min(CASE WHEN depth = 0 AND k >= 95 AND k - 95 >= 1 THEN k - 95 END), 1)
  WHEN max(run_id % 2 + 1) <= 1 THEN 1 END AS width FROM @evt GROUP BY run_id""")
def width_reached(spark, sf):
    records = events(spark, sf).select(
        "run_id", (F.col("depth") == 0).alias("own"), F.when(F.col("k") >= 95, F.col("k") - 95).alias("width"),
        (F.col("run_id") % 2 + 1).alias("possible"), (F.col("run_id") % 5 > 0).alias("has_log"))
    return ops.width_reached(records)


CALLS = {1: "", 2: "1", 3: "2", 4: "1.1", 5: "1.2", 6: "2.1", 7: "1.1.1"}
define("tree", "(SELECT l_orderkey AS run_id, (['', '1', '2', '1.1', '1.2', '2.1', '1.1.1'])[l_linenumber] AS call, "
       "max(CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) * 1000 ELSE 0 END) AS own, "
       "CASE WHEN min(l_partkey) % 3 = 0 THEN 'card' ELSE 'torch' END AS source, "
       "max(CASE WHEN l_tax > 0.045 THEN l_partkey ELSE 0 END) AS fallback FROM lineitem GROUP BY 1, 2)")


def _children(call):
    return [c for c in CALLS.values() if c and (c.rsplit(".", 1)[0] if "." in c else "") == call]


def _fold_sql():
    """Bottom-up, one call after the other, deepest first."""
    parts = []
    for call in sorted(CALLS.values(), key=lambda c: -(c.count(".") + bool(c))):
        name = "n" + call.replace(".", "_")
        kids = _children(call)
        below = " UNION ALL ".join(f"SELECT * FROM n{k.replace('.', '_')}" for k in kids) or "SELECT * FROM none"
        parts.append(f"""{name} AS (SELECT t.run_id, t.call, own + coalesce(c, 0) + CASE WHEN own + coalesce(c, 0) = 0 THEN fallback ELSE 0 END AS v,
          CASE WHEN own + coalesce(c, 0) = 0 THEN CASE WHEN fallback > 0 THEN 'card' ELSE 'none' END
            WHEN (own > 0 AND source = 'card') OR (c > 0 AND s = 'card') THEN 'card' ELSE 'torch' END AS src
          FROM @tree t LEFT JOIN (SELECT run_id, max(v) AS c, arg_min(src, row(-v, src)) AS s FROM ({below}) GROUP BY run_id) USING (run_id)
          WHERE t.call = '{call}')""")
    return ("WITH none AS (SELECT NULL::BIGINT AS run_id, '' AS call, 0::BIGINT AS v, '' AS src WHERE false), " + ", ".join(parts)
            + " SELECT run_id, call, v AS chain_vram, src AS source FROM ("
            + " UNION ALL ".join(f"SELECT * FROM n{c.replace('.', '_')}" for c in CALLS.values()) + ")")


@query("chain_fold", _fold_sql())
def chain_fold(spark, sf):
    call = F.get(F.array(*[F.lit(c) for c in CALLS.values()]), F.col("l_linenumber") - 1)
    calls = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), call.alias("call")).agg(
        F.max(F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long") * 1000).otherwise(0)).alias("own"),
        F.when(F.min("l_partkey") % 3 == 0, "card").otherwise("torch").alias("source"),
        F.max(F.when(F.col("l_tax") > 0.045, F.col("l_partkey")).otherwise(0)).alias("fallback"))
    return ops.chain_fold(calls)


define("steps", """(SELECT at_us, kind, sum(kind) AS d FROM (SELECT start_us AS at_us, 1 AS kind FROM @spans WHERE phase = 'running' AND end_us IS NOT NULL
  UNION ALL SELECT end_us, -1 FROM @spans WHERE phase = 'running' AND end_us IS NOT NULL) GROUP BY at_us, kind)""")


@query("concurrency_curve", """SELECT *, max(open) OVER () AS peak FROM (SELECT at_us, kind, sum(d) OVER (ORDER BY at_us, kind) AS open FROM @steps)""")
def concurrency_curve(spark, sf):
    return series.concurrency_curve(spans(spark, sf))


@query("inflight_peak", """WITH e AS (SELECT start_us AS t, 1 AS d FROM @runs WHERE tool <> '1-URGENT' UNION ALL SELECT end_us, -1 FROM @runs WHERE end_us IS NOT NULL),
g AS (SELECT t, d, sum(d) AS s FROM e GROUP BY t, d), c AS (SELECT *, sum(s) OVER (ORDER BY t, d) AS c FROM g),
f AS (SELECT *, c - least(0, min(c) OVER (ORDER BY t, d)) AS v FROM c) SELECT arg_max(v, row(t, d)) AS now, max(v) AS peak FROM f""")
def inflight_peak(spark, sf):
    requests = runs(spark, sf).select(F.when(F.col("tool") != "1-URGENT", F.col("start_us")).alias("start_us"), "end_us")
    return series.inflight_peak(requests)


@query("queue_peaks", """SELECT run_id AS arm, count(*) AS points, max(k) AS run_peak, max(depth) AS held_peak, greatest(max(k + depth), 1) AS top
FROM @evt GROUP BY run_id HAVING count(*) >= 2""")
def queue_peaks(spark, sf):
    return series.queue_peaks(events(spark, sf).select(
        F.col("run_id").alias("arm"), F.col("k").alias("running"), F.col("depth").alias("waiting")))


SINCE_US = EVENTS_NOW_US - 25 * 86400 * 1_000_000


@query("thin_series", f"""SELECT run_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY run_id) AS c
  FROM @evt WHERE at_us >= {SINCE_US}) WHERE (n - 1) % greatest(CAST(ceil(c / 20) AS BIGINT), 1) = 0""")
def thin_series(spark, sf):
    points = events(spark, sf).select("run_id", *EVENT_ORDER)
    return series.thin_series(points, ["run_id"], EVENT_ORDER, 20, SINCE_US).select("run_id", "event_id")


@query("counter_rate", f"""WITH s AS (SELECT *, CAST(round_even(value * 10, 0) AS BIGINT) AS busy, k * 10 AS total FROM @evt),
d AS (SELECT *, busy - lag(busy) OVER w AS b, total - lag(total) OVER w AS t FROM s WINDOW w AS (PARTITION BY run_id ORDER BY pos))
SELECT run_id, event_id, CASE WHEN t > 0 THEN {r('greatest(0, least(100, b * CAST(100 AS DOUBLE) / t))', 1)} END AS percent FROM d""")
def counter_rate(spark, sf):
    samples = events(spark, sf).select("run_id", *EVENT_ORDER, F.rint(F.col("value") * 10).cast("long").alias("busy"),
                                       (F.col("k") * 10).alias("total"))
    return series.counter_rate(samples, ["run_id"], EVENT_ORDER).select("run_id", "event_id", "percent")


# One reading in six hours instead of two a second: the events of a run are hours apart.
RATE_US = 6 * 3600 * 1_000_000


@query("peak_rate", f"""WITH RECURSIVE s AS (SELECT run_id, at_us, k, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n FROM @evt),
f AS (SELECT run_id, n, at_us AS t, k, CAST(0 AS DOUBLE) AS peak FROM s WHERE n = 1 UNION ALL
SELECT s.run_id, s.n, CASE WHEN s.at_us - f.t >= {RATE_US} OR s.at_us = f.t THEN s.at_us ELSE f.t END,
  CASE WHEN s.at_us - f.t >= {RATE_US} OR s.at_us = f.t THEN s.k ELSE f.k END,
  CASE WHEN s.at_us - f.t >= {RATE_US} THEN greatest(f.peak, (s.k - f.k) * 1e6 / (s.at_us - f.t)) ELSE f.peak END
FROM f JOIN s ON s.run_id = f.run_id AND s.n = f.n + 1)
SELECT run_id, {r('max(peak)', 9)} AS peak_rate FROM f GROUP BY run_id""")
def peak_rate(spark, sf):
    samples = events(spark, sf).select("run_id", *EVENT_ORDER, F.col("k").alias("ticks"))
    out = series.peak_rate(samples, ["run_id"], EVENT_ORDER, RATE_US)
    return out.select("run_id", (F.rint(F.col("peak_rate") * 1e9) / 1e9).alias("peak_rate"))


# The first order of a customer stands for an instant in the month the events cover.
define("instants", f"""(SELECT o_orderkey AS id, o_custkey % 200 AS run_id,
  {EVENTS_NOW_US} - 31 * 86400000000 + o_orderkey * 7919 % 2764800 * 1000000 AS at_us FROM orders)""")


def instants(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("id"), (F.col("o_custkey") % 200).alias("run_id"),
        (F.lit(EVENTS_NOW_US - 31 * 86400 * 1_000_000) + key * 7919 % 2764800 * 1_000_000).alias("at_us"))


def samples(spark, sf):
    return events(spark, sf).select("run_id", "at_us", F.col("event_id").alias("id"),
                                    F.when(F.col("k") > 20, F.col("value")).alias("value"))


@query("asof_last", """SELECT i.id, i.run_id, i.at_us, e.at_us AS sample_us, e.value FROM @instants i ASOF LEFT JOIN
  (SELECT run_id, at_us, value FROM @evt WHERE k > 20) e ON i.run_id = e.run_id AND i.at_us >= e.at_us""")
def asof_last(spark, sf):
    return series.asof_last(instants(spark, sf), samples(spark, sf), ["run_id"], "value")


@query("asof_nearest", """WITH e AS (SELECT run_id, at_us, value FROM @evt WHERE k > 20),
g AS (SELECT run_id, (max(at_us) - min(at_us)) / nullif(count(*) - 1, 0) AS gap FROM e GROUP BY run_id),
b AS (SELECT i.*, e.at_us AS bt, e.value AS bv FROM @instants i ASOF LEFT JOIN e ON i.run_id = e.run_id AND i.at_us >= e.at_us),
f AS (SELECT b.*, e.at_us AS ft, e.value AS fv FROM b ASOF LEFT JOIN e ON b.run_id = e.run_id AND b.at_us <= e.at_us),
c AS (SELECT f.*, gap, CASE WHEN ft IS NULL OR at_us - bt <= ft - at_us THEN bt ELSE ft END AS t,
  CASE WHEN ft IS NULL OR at_us - bt <= ft - at_us THEN bv ELSE fv END AS v FROM f LEFT JOIN g USING (run_id))
SELECT id, run_id, at_us, CASE WHEN gap IS NULL OR abs(t - at_us) <= greatest(1e6, gap * CAST(2.5 AS DOUBLE)) THEN t END AS sample_us,
  CASE WHEN gap IS NULL OR abs(t - at_us) <= greatest(1e6, gap * CAST(2.5 AS DOUBLE)) THEN v END AS value FROM c""")
def asof_nearest(spark, sf):
    return series.asof_nearest(instants(spark, sf), samples(spark, sf), ["run_id"], "value")


@query("interval_contains", f"""WITH m AS (SELECT start_us, coalesce(end_us, {RUNS_NOW_US}) AS e FROM @spans
  WHERE phase = 'paused'),
s AS (SELECT start_us, max(e) OVER (ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS e FROM m)
SELECT i.run_id AS id, i.start_us AS at_us, coalesce(max(s.e) >= i.start_us, false) AS inside
FROM (SELECT run_id, start_us + waited_us * 1000 AS start_us FROM @runs) i ASOF LEFT JOIN (SELECT start_us, max(e) AS e FROM s GROUP BY start_us) s
  ON i.start_us >= s.start_us GROUP BY i.run_id, i.start_us""")
def interval_contains(spark, sf):
    moments = runs(spark, sf).select(F.col("run_id").alias("id"), (F.col("start_us") + F.col("waited_us") * 1000).alias("at_us"))
    marks = spans(spark, sf).filter(F.col("phase") == "paused")
    return series.interval_contains(moments, marks, RUNS_NOW_US)
