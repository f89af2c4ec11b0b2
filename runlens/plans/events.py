"""Queries over the event log of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import events as fx
from runlens.functions import text as tx
from runlens.operators import events as ops
from runlens.plans.bindings import EVENT_ORDER, EVENTS_NOW_US, define, events, runs, table
from runlens.plans.registry import query

STATE = ("CASE WHEN {p} IN ('received', 'staging', 'queued_gpu') THEN 'pending' "
         "WHEN {p} IN ('running', 'packaging') THEN 'running' ELSE {p} END")
TERMINAL = "phase IN ('done', 'failed', 'cancelled')"

define("raw", f"""(SELECT user_id AS run_id, event_id, CASE WHEN event_id % 10 = 0 THEN 'log' END AS kind,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -1 ELSE epoch_us(ts) END AS at_us,
  {EVENTS_NOW_US} AS seen_us, CASE WHEN event_id % 19 = 0 THEN 'bogus' ELSE phase END AS phase,
  CASE WHEN event_id % 40 = 0 THEN 'trace' ELSE upper(level) END AS level,
  CASE WHEN event_id % 60 = 0 THEN 'all' ELSE audience END AS audience,
  CASE WHEN event_id % 11 = 0 THEN 'abc' WHEN event_id % 23 = 0 THEN '1.7' WHEN event_id % 29 = 0 THEN 'NaN'
    ELSE CAST(fraction AS VARCHAR) END AS fraction, message,
  CASE WHEN event_id % 31 = 0 THEN '99' WHEN event_id % 37 = 0 THEN 'x' ELSE CAST(depth AS VARCHAR) END AS depth,
  CASE event_id % 5 WHEN 0 THEN concat('1.', event_id % 4) WHEN 1 THEN 'x' END AS call,
  CASE WHEN event_id % 41 = 0 THEN 'bad name' ELSE tool END AS tool,
  CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'close' ELSE 'other' END AS edge, server,
  CASE WHEN event_id % 43 = 0 THEN '-1' WHEN event_id % 47 = 0 THEN 'Infinity' WHEN event_id % 2 = 0 THEN
    CAST(event_id * 10 AS VARCHAR) END AS vram_bytes FROM (SELECT *, run_id AS user_id, to_timestamp(at_us / 1e6) AT TIME ZONE 'UTC' AS ts FROM @evt))""")


def raw_events(spark, sf):
    """Event lines as a tool or a server may have written them, damage included."""
    n = F.col("event_id")
    return events(spark, sf).select(
        "run_id", n, F.when(n % 10 == 0, "log").alias("kind"),
        F.when(n % 13 == 0, F.lit(None)).when(n % 17 == 0, -1).otherwise(F.col("at_us")).alias("at_us"),
        F.lit(EVENTS_NOW_US).alias("seen_us"), F.when(n % 19 == 0, "bogus").otherwise(F.col("phase")).alias("phase"),
        F.when(n % 40 == 0, "trace").otherwise(F.upper("level")).alias("level"),
        F.when(n % 60 == 0, "all").otherwise(F.col("audience")).alias("audience"),
        F.when(n % 11 == 0, "abc").when(n % 23 == 0, "1.7").when(n % 29 == 0, "NaN")
        .otherwise(F.col("fraction").cast("string")).alias("fraction"), "message",
        F.when(n % 31 == 0, "99").when(n % 37 == 0, "x").otherwise(F.col("depth").cast("string")).alias("depth"),
        F.when(n % 5 == 0, F.concat(F.lit("1."), n % 4)).when(n % 5 == 1, "x").alias("call"),
        F.when(n % 41 == 0, "bad name").otherwise(F.col("tool")).alias("tool"),
        F.when(n % 3 == 0, "open").when(n % 3 == 1, "close").otherwise("other").alias("edge"), "server",
        F.when(n % 43 == 0, "-1").when(n % 47 == 0, "Infinity")
        .when(n % 2 == 0, (n * 10).cast("string")).alias("vram_bytes"))


@query("normalise_events", f"""WITH c AS (SELECT *, kind = 'log' IS TRUE AND NOT server AS log,
  server AND phase <> 'bogus' AS known, try_cast(fraction AS DOUBLE) AS f, try_cast(depth AS INTEGER) AS d,
  try_cast(vram_bytes AS DOUBLE) AS v FROM (SELECT * REPLACE (coalesce(kind, '') AS kind) FROM @raw)),
p AS (SELECT *, CASE WHEN known THEN phase ELSE 'running' END AS ph,
  CASE WHEN NOT log AND tool <> 'bad name' THEN tool END AS t FROM c)
SELECT run_id, event_id, CASE WHEN at_us > 0 THEN at_us ELSE seen_us END AS at_us,
  CASE WHEN log THEN 'log' END AS kind, CASE WHEN log THEN 'running' ELSE {STATE.format(p='ph')} END AS state,
  CASE WHEN log THEN 'running' ELSE ph END AS phase,
  CASE WHEN log THEN CASE WHEN lower(level) IN ('debug', 'info', 'warning', 'error', 'metric') THEN lower(level)
    ELSE 'info' END END AS level,
  CASE WHEN log THEN CASE WHEN audience IN ('user', 'admin') THEN audience ELSE 'admin' END END AS audience,
  CASE WHEN NOT log AND NOT isnan(f) AND NOT isinf(f) THEN greatest(0, least(1, f)) END AS fraction,
  substr(message, 1, 200) AS message, CASE WHEN d BETWEEN 0 AND 10 THEN d ELSE 0 END AS depth,
  CASE WHEN regexp_full_match(call, '[0-9]{{1,4}}(\\.[0-9]{{1,4}}){{0,9}}') THEN call END AS call, t AS tool,
  CASE WHEN t IS NOT NULL AND edge IN ('open', 'close') THEN edge END AS edge,
  CASE WHEN server AND NOT log AND v >= 0 AND NOT isnan(v) AND NOT isinf(v) THEN v END AS vram_bytes FROM p""")
def normalise_events(spark, sf):
    return ops.normalise_events(raw_events(spark, sf))


@query("assign_seq", """SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY at_us, event_id) - 1
  AS seq FROM @evt""")
def assign_seq(spark, sf):
    return ops.assign_seq(events(spark, sf).select("run_id", *EVENT_ORDER), EVENT_ORDER).select(
        "run_id", "event_id", "seq")


define("phasespans", f"""(SELECT run_id, number, phase, start_us, end_us FROM (
  SELECT run_id, phase, start_us, end_us, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS number FROM (
    SELECT *, at_us AS start_us, lead(at_us) OVER (PARTITION BY run_id ORDER BY pos) AS end_us FROM (
      SELECT *, lag(phase) OVER (PARTITION BY run_id ORDER BY pos) AS before FROM @evt
      WHERE NOT is_log AND depth = 0 AND tool IS NULL)
    WHERE before IS NULL OR before <> phase) WHERE NOT ({TERMINAL})) WHERE number <= 60)""")
define("pairs", """(SELECT run_id, tool, depth, at_us AS start_us, end_us, closed FROM (
  SELECT *, row_number() OVER w AS n, lead(at_us) OVER w AS end_us, lead(pos) OVER w AS closed FROM @evt
  WHERE NOT is_log AND tool IS NOT NULL WINDOW w AS (PARTITION BY run_id, tool, depth ORDER BY pos)) WHERE n % 2 = 1)""")
define("nested", """(SELECT run_id, tool, depth, start_us, end_us,
  row_number() OVER (PARTITION BY run_id ORDER BY start_us, depth, tool) AS number FROM (SELECT *,
  row_number() OVER (PARTITION BY run_id ORDER BY end_us IS NULL, closed, depth, start_us, tool) AS kept FROM @pairs)
  WHERE kept <= 200)""")
define("chain", """(SELECT run_id, string_agg(tool, '>' ORDER BY depth, start_us, tool) AS chain FROM @pairs
  WHERE end_us IS NULL GROUP BY run_id)""")


@query("phase_spans", "SELECT run_id, number, phase, start_us, end_us FROM @phasespans")
def phase_spans(spark, sf):
    return ops.phase_spans(events(spark, sf), EVENT_ORDER)


@query("nested_calls", "SELECT run_id, number, tool, depth, start_us, end_us FROM @nested")
def nested_calls(spark, sf):
    return ops.nested_calls(events(spark, sf), EVENT_ORDER)


@query("open_chain", "SELECT run_id, chain FROM @chain")
def open_chain(spark, sf):
    return ops.open_chain(events(spark, sf), EVENT_ORDER)


def _listed(label):
    return f"string_agg(concat({label}, ':', start_us, ':', coalesce(CAST(end_us AS VARCHAR), '')), ' ' ORDER BY number)"


@query("timeline", f"""SELECT run_id, measured, spans, nested, chain FROM
  (SELECT run_id, arg_max(k, pos) FILTER (server AND k IS NOT NULL) AS measured FROM @evt WHERE NOT is_log GROUP BY run_id)
  LEFT JOIN (SELECT run_id, {_listed('phase')} AS spans FROM @phasespans GROUP BY run_id) USING (run_id)
  LEFT JOIN (SELECT run_id, {_listed('tool')} AS nested FROM @nested GROUP BY run_id) USING (run_id)
  LEFT JOIN @chain USING (run_id)""")
def timeline(spark, sf):
    measured = events(spark, sf).withColumn("measured", F.when(F.col("server"), F.col("k")))
    return ops.timeline(measured, EVENT_ORDER)


@query("run_snapshot", f"""WITH s AS (SELECT run_id, arg_max(phase, pos) FILTER (NOT is_log) AS phase,
  arg_max(fraction, pos) FILTER (NOT is_log) AS fraction, arg_max(message, pos) FILTER (NOT is_log) AS message,
  arg_max(depth, pos) FILTER (NOT is_log) AS depth, min(at_us) FILTER (NOT is_log) AS started_us,
  max(at_us) FILTER (NOT is_log) AS updated_us FROM @evt GROUP BY run_id)
SELECT run_id, coalesce({STATE.format(p='phase')}, 'pending') AS state, coalesce(phase, 'received') AS phase, fraction,
  coalesce(message, '') AS message, coalesce(depth, 0) AS depth, started_us, updated_us FROM s""")
def run_snapshot(spark, sf):
    return ops.run_snapshot(events(spark, sf), EVENT_ORDER)


@query("until_terminal", f"""SELECT run_id, event_id, phase FROM (SELECT *, min(CASE WHEN {TERMINAL} AND NOT is_log
  THEN pos END) OVER (PARTITION BY run_id) AS fin FROM @evt) WHERE fin IS NULL OR pos <= fin""")
def until_terminal(spark, sf):
    return ops.until_terminal(events(spark, sf), EVENT_ORDER).select("run_id", "event_id", "phase")


CAP = 40


@query("cap_events", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n FROM @evt
  WHERE NOT is_log), c AS (SELECT *, min(CASE WHEN n > {CAP} AND NOT ({TERMINAL}) THEN n END)
  OVER (PARTITION BY run_id) AS cut FROM n)
SELECT run_id, event_id, phase, CASE WHEN n = cut THEN NULL ELSE fraction END AS fraction,
  CASE WHEN n = cut THEN 'Progress messages past {CAP} are not reported; the run continues.' ELSE message END AS message,
  coalesce(n = cut, false) AS truncated FROM c WHERE n <= {CAP} OR {TERMINAL} OR n = cut""")
def cap_events(spark, sf):
    return ops.cap_events(events(spark, sf), EVENT_ORDER, CAP).select(
        "run_id", "event_id", "phase", "fraction", "message", "truncated")


@query("filter_logs", """SELECT run_id, event_id, level, audience, number FROM (SELECT *,
  row_number() OVER (PARTITION BY run_id ORDER BY pos) AS number FROM @evt WHERE is_log AND audience = 'user')
  WHERE number <= 500""")
def filter_logs(spark, sf):
    return ops.filter_logs(events(spark, sf), EVENT_ORDER, ["user"]).select(
        "run_id", "event_id", "level", "audience", "number")


@query("notable_logs", """SELECT run_id, event_id, level, audience, depth FROM (SELECT *,
  row_number() OVER (PARTITION BY run_id, level IN ('warning', 'error') ORDER BY pos DESC) AS n FROM @evt
  WHERE is_log AND level <> 'debug') WHERE n <= 3""")
def notable_logs(spark, sf):
    return ops.notable_logs(events(spark, sf), EVENT_ORDER, 3).select(
        "run_id", "event_id", "level", "audience", "depth")


@query("last_stage", """SELECT run_id, arg_max(message, pos) AS stage, arg_max(fraction, pos) AS fraction FROM @evt
  WHERE NOT is_log AND tool IS NULL AND NOT server GROUP BY run_id""")
def last_stage(spark, sf):
    return ops.last_stage(events(spark, sf), EVENT_ORDER)


RESTART_US = EVENTS_NOW_US - 15 * 86400 * 1_000_000


@query("close_orphans", f"""SELECT run_id, {RESTART_US} AS at_us, 'failed' AS phase, 'failed' AS state,
  'The server restarted during this run.' AS message FROM (SELECT run_id, arg_max(phase, pos) AS last
  FROM @evt WHERE NOT is_log AND at_us < {RESTART_US} GROUP BY run_id)
WHERE last IN ('received', 'staging', 'queued_gpu', 'running', 'packaging')""")
def close_orphans(spark, sf):
    return ops.close_orphans(events(spark, sf), EVENT_ORDER, RESTART_US)


@query("live_listing", f"""WITH s AS (SELECT run_id, arg_max(phase, pos) AS last, arg_max(fraction, pos) AS fraction,
  arg_max(depth, pos) AS depth, min(at_us) AS started_us, max(at_us) AS updated_us FROM @evt WHERE NOT is_log GROUP BY run_id),
h AS (SELECT s.*, CASE WHEN d.run_id IS NOT NULL AND last NOT IN ('done', 'failed', 'cancelled') THEN 'paused' ELSE last END AS phase
  FROM s LEFT JOIN (SELECT DISTINCT client % 50 AS run_id FROM @runs WHERE outcome IS NULL AND client % 50 < 20) d USING (run_id)),
c AS (SELECT run_id, depth, tool, max(at_us) AS last_us FROM @evt WHERE NOT is_log AND tool IS NOT NULL GROUP BY run_id, depth, tool HAVING count(*) % 2 = 1),
o AS (SELECT run_id, string_agg(tool, '>' ORDER BY depth, last_us, tool) AS chain FROM c GROUP BY run_id)
SELECT h.run_id, phase, {STATE.format(p='phase')} AS state, fraction, depth, CASE WHEN r.start_us > 0 THEN r.start_us ELSE started_us END AS started_us, updated_us,
  r.tool AS tool, r.client AS client, r.batch_id AS batch_id, coalesce(o.chain, '') AS chain FROM h LEFT JOIN @runs r USING (run_id) LEFT JOIN o USING (run_id)""")
def live_listing(spark, sf):
    pauses = runs(spark, sf).filter(F.col("outcome").isNull() & (F.col("client") % 50 < 20)).select(
        (F.col("client") % 50).alias("run_id"))
    return ops.live_listing(events(spark, sf), EVENT_ORDER, pauses, records=runs(spark, sf))


@query("idle_expiry", f"""WITH d AS (SELECT *, at_us + CASE WHEN phase = 'paused' THEN 43200000000 ELSE 21600000000 END AS due
  FROM @evt), s AS (SELECT *, CASE WHEN coalesce(at_us >= lag(due) OVER (PARTITION BY run_id ORDER BY pos), true) THEN 1 ELSE 0 END
  AS fresh FROM d), g AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY pos) AS g FROM s)
SELECT run_id, min(at_us) AS start_us, arg_max(due, pos) AS expires_us, count(*) AS events,
  arg_max(due, pos) <= {EVENTS_NOW_US} AS expired FROM g GROUP BY run_id, g""")
def idle_expiry(spark, sf):
    return ops.idle_expiry(events(spark, sf).select("run_id", "phase", *EVENT_ORDER), EVENT_ORDER,
                           EVENTS_NOW_US, 21600, 43200)


@query("clean_message", """SELECT conv_id, turn,
  substr(replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' '), 1, 200) AS message FROM conversations""")
def clean_message(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", fx.clean_message(F.col("text")).alias("message"))


@query("clean_fraction", """SELECT event_id, CASE WHEN NOT isnan(f) AND NOT isinf(f) THEN greatest(0, least(1, f)) END AS fraction
FROM (SELECT event_id, try_cast(fraction AS DOUBLE) AS f FROM @raw)""")
def clean_fraction(spark, sf):
    return raw_events(spark, sf).select("event_id", fx.clean_fraction(F.col("fraction")).alias("fraction"))


@query("clean_span", """WITH s AS (SELECT event_id, greatest(0, least(1, fraction)) AS a,
  CASE WHEN event_id % 9 <> 0 THEN greatest(0, least(1, k / 50)) END AS b FROM @evt)
SELECT event_id, CASE WHEN a <= b THEN a END AS start_fraction, CASE WHEN a <= b THEN b END AS end_fraction FROM s""")
def clean_span(spark, sf):
    span = F.when(F.col("event_id") % 9 != 0, F.array(F.col("fraction"), F.col("k") / 50)).otherwise(
        F.array(F.col("fraction")))
    cleaned = fx.clean_span(span)
    return events(spark, sf).select("event_id", F.get(cleaned, 0).alias("start_fraction"),
                                    F.get(cleaned, 1).alias("end_fraction"))


@query("clean_measured", """WITH m AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 AND k >= 50 THEN k * 1000 END AS v,
  CASE WHEN event_id % 6 <> 0 AND value - 60 >= 0 THEN value - 60 END AS c FROM @evt)
SELECT event_id, CAST(v AS DOUBLE) AS vram_bytes, c AS cpu_cores, v IS NOT NULL OR c IS NOT NULL AS known FROM m""")
def clean_measured(spark, sf):
    usable = F.col("event_id") % 6 != 0
    struct = fx.clean_measured(F.when(usable & (F.col("k") >= 50), F.col("k") * 1000), F.lit(None).cast("long"),
                               F.when(usable, F.col("value") - 60), F.lit(float("nan")))
    return events(spark, sf).select("event_id", struct.alias("m")).select(
        "event_id", F.col("m.vram_bytes").alias("vram_bytes"), F.col("m.cpu_cores").alias("cpu_cores"),
        F.col("m").isNotNull().alias("known"))


@query("identifier_gate", """SELECT p_partkey, CASE WHEN regexp_full_match(n, '[A-Za-z0-9_-]{1,64}') THEN n ELSE '' END AS name
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') WHEN p_partkey % 3 = 1 THEN p_name
  ELSE concat(p_type, chr(10)) END AS n FROM part)""")
def identifier_gate(spark, sf):
    key = F.col("p_partkey")
    name = (F.when(key % 3 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).when(key % 3 == 1, F.col("p_name"))
            .otherwise(F.concat("p_type", F.lit("\n"))))
    return table(spark, sf, "part").select("p_partkey", fx.identifier(name).alias("name"))


@query("phase_to_state", f"""SELECT event_id, phase, {STATE.format(p='phase')} AS state, {TERMINAL} AS terminal FROM @evt""")
def phase_to_state(spark, sf):
    phase = F.col("phase")
    return events(spark, sf).select("event_id", "phase", fx.phase_state(phase).alias("state"),
                                    fx.is_terminal(phase).alias("terminal"))


@query("call_parent", """SELECT DISTINCT call, CASE WHEN contains(call, '.') THEN regexp_replace(call, '\\.[^.]*$', '') ELSE '' END AS parent,
  len(string_split(call, '.')) AS depth FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN concat(l_linenumber)
  WHEN 1 THEN concat(l_linenumber, '.', l_suppkey) ELSE concat(l_linenumber, '.', l_suppkey, '.', l_quantity::BIGINT) END AS call FROM lineitem)""")
def call_parent(spark, sf):
    line = F.col("l_linenumber")
    call = F.when(line % 3 == 0, F.concat_ws(".", line)).when(line % 3 == 1, F.concat_ws(".", line, "l_suppkey")).otherwise(
        F.concat_ws(".", line, "l_suppkey", F.col("l_quantity").cast("long")))
    return table(spark, sf, "lineitem").select(call.alias("call")).distinct().select(
        "call", fx.call_parent(F.col("call")).alias("parent"), fx.call_depth(F.col("call")).alias("depth"))


@query("parse_batch", """SELECT run_id, CASE WHEN ok THEN batch_id END AS batch_id, CASE WHEN ok THEN batch_index END AS batch_index,
  CASE WHEN ok THEN batch_total END AS batch_total FROM (SELECT *, length(batch_id) >= 8 AND batch_index BETWEEN 1 AND batch_total AS ok FROM @runs)""")
def parse_batch(spark, sf):
    batch = fx.parse_batch(F.col("batch_id"), F.col("batch_index"), F.col("batch_total"))
    return runs(spark, sf).select("run_id", batch.alias("b")).select(
        "run_id", F.col("b.id").alias("batch_id"), F.col("b.index").alias("batch_index"),
        F.col("b.total").alias("batch_total"))


@query("scrub_text")
def scrub_text(spark, sf):
    documents = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return documents.union(pages).select("kind", "id", tx.scrub_text(F.col("text")).alias("scrubbed"))


@query("canonical_name", "SELECT p_partkey, regexp_replace(lower(p_name), '[^\\pL\\pN]', '', 'g') AS name FROM part")
def canonical_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.canonical_name(F.col("p_name")).alias("name"))


define("uploads", """(SELECT page_id, concat(regexp_extract(url, '([^/]*)$', 1), CASE page_id % 5 WHEN 0 THEN '.nii.gz'
  WHEN 1 THEN '.CSV' WHEN 2 THEN '' WHEN 3 THEN '..tar.gz' ELSE '.json' END) AS file, url,
  CASE page_id % 5 WHEN 0 THEN '.nii.gz' WHEN 1 THEN '.csv' WHEN 3 THEN '.gz' ELSE '' END AS ext FROM pages)""")


def uploads(spark, sf):
    """File names as clients send them, from pages."""
    kind = F.col("page_id") % 5
    suffix = (F.when(kind == 0, ".nii.gz").when(kind == 1, ".CSV").when(kind == 2, "").when(kind == 3, "..tar.gz")
              .otherwise(".json"))
    ext = F.when(kind == 0, ".nii.gz").when(kind == 1, ".csv").when(kind == 3, ".gz").otherwise("")
    return table(spark, sf, "pages").select(
        "page_id", F.concat(tx.base_name(F.col("url")), suffix).alias("file"), "url", ext.alias("ext"))


EXTENSION = ("CASE WHEN regexp_matches(lower({f}), '\\.(nii|nrrd|gipl|tar)\\.gz$') THEN "
             "regexp_extract(lower({f}), '\\.(nii|nrrd|gipl|tar)\\.gz$') ELSE regexp_extract(lower({f}), '^\\.*[^.].*(\\.[^.]*)$', 1) END")


@query("compound_extension", f"""SELECT page_id, {EXTENSION.format(f='file')} AS extension,
  left(file, length(file) - length({EXTENSION.format(f='file')})) AS stem FROM @uploads""")
def compound_extension(spark, sf):
    return uploads(spark, sf).select("page_id", tx.compound_extension(F.col("file")).alias("extension"),
                                     tx.stem(F.col("file")).alias("stem"))


@query("safe_stem", """SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(
  CASE WHEN ext <> '' AND ends_with(lower(file), ext) THEN left(file, length(file) - length(ext)) ELSE file END,
  '[^A-Za-z0-9_.-]+', '_', 'g'), '\\.{2,}', '.', 'g'), '^[._]+|[._]+$', '', 'g'), 64) AS stem FROM @uploads""")
def safe_stem(spark, sf):
    return uploads(spark, sf).select("page_id", tx.safe_stem(F.col("file"), F.col("ext")).alias("stem"))
