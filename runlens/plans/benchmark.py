"""Queries over benchmark records."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.numbers import rounded
from runlens.operators import benchmark as ops
from runlens.plans.bindings import BENCH_ORDER, bench, define, events, table
from runlens.plans.registry import query

P95 = "CAST(greatest(1, least(n, round_even(CAST(0.95 AS DOUBLE) * n + CAST(0.5 AS DOUBLE), 0))) AS BIGINT)"

@query("measured_only", """SELECT tool, path, repetition, total_seconds, l_orderkey, l_partkey, l_suppkey
FROM @bench WHERE status = 'ok' AND NOT warmup""")
def measured_only(spark, sf):
    return ops.measured_only(bench(spark, sf)).select(
        "tool", "path", "repetition", "total_seconds", "l_orderkey", "l_partkey", "l_suppkey")


@query("stats_summary", f"""WITH m AS (SELECT tool, path, total_seconds AS v,
  row_number() OVER (PARTITION BY tool, path ORDER BY total_seconds) AS r,
  count(*) OVER (PARTITION BY tool, path) AS n FROM @bench WHERE status = 'ok' AND NOT warmup)
SELECT tool, path, max(n) AS n, median(v) AS median, min(v) AS min, max(v) AS max,
  max(CASE WHEN r = {P95} THEN v END) AS p95 FROM m GROUP BY tool, path""")
def stats_summary(spark, sf):
    return ops.stats_summary(bench(spark, sf), ["tool", "path"])


@query("latency_table", """SELECT tool, path, count(*) AS runs, count(*) FILTER (warmup) AS warmup_discarded,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'ok' AND NOT warmup) AS n,
  round_even(median(total_seconds) FILTER (status = 'ok' AND NOT warmup) * 1e4, 0) / 1e4 AS median_s,
  round_even(min(total_seconds) FILTER (status = 'ok' AND NOT warmup) * 1e4, 0) / 1e4 AS min_s,
  round_even(max(total_seconds) FILTER (status = 'ok' AND NOT warmup) * 1e4, 0) / 1e4 AS max_s,
  coalesce(arg_min(error_message, pos) FILTER (status = 'failed'), '') AS first_error
FROM @bench GROUP BY tool, path""")
def latency_table(spark, sf):
    return ops.latency_table(bench(spark, sf), BENCH_ORDER)


def _phased(spark, sf):
    return bench(spark, sf).withColumn("phases", F.map_filter(F.create_map(
        F.lit("upload"), F.col("upload"), F.lit("server_exec"), F.col("server_exec"),
        F.lit("download"), F.col("download")), lambda k, v: v.isNotNull()))


def _median(column, digits=4):
    return (f"round_even(median({column}) FILTER (status = 'ok' AND NOT warmup) * 1e{digits}, 0) "
            f"/ 1e{digits}")


@query("network_table", "SELECT tool, payload, concurrency AS parallelism, count(*) AS runs, "
       "count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'ok' AND NOT warmup) AS n, "
       f"{_median('total_seconds')} AS total_s, {_median('bytes_uploaded / 1e6', 1)} AS uploaded_mb, "
       f"{_median('bytes_downloaded / 1e6', 1)} AS downloaded_mb, "
       + ", ".join(f"{_median(p)} AS {p}_s" if p in ("upload", "server_exec", "download")
                   else f"CAST(NULL AS DOUBLE) AS {p}_s" for p in ops.PHASES)
       + " FROM @bench GROUP BY tool, payload, concurrency")
def network_table(spark, sf):
    return ops.network_table(_phased(spark, sf).withColumnRenamed("concurrency", "parallelism"))


define("startups", """(SELECT *, CASE WHEN payload = 0 THEN 'startup' ELSE 'chain' END AS measurement,
  concat('m', concurrency) AS mode, path AS local_mode, upload / 100 AS interpreter_start_seconds,
  server_exec / 100 AS import_stack_seconds, concat('p', l_partkey % 5) AS package FROM @bench)""")


@query("startup_chain_table", """SELECT measurement, tool, '' AS mode, local_mode, 1 AS runs,
  CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS failed, CASE WHEN status = 'ok' THEN 1 ELSE 0 END AS n,
  CAST(NULL AS DOUBLE) AS median_s,
  round_even(interpreter_start_seconds * 1e4, 0) / 1e4 AS interpreter_start_s,
  round_even(import_stack_seconds * 1e4, 0) / 1e4 AS import_stack_s, package, error_message AS error
FROM @startups WHERE measurement = 'startup'
UNION ALL SELECT 'chain', tool, mode,
  coalesce(arg_min(local_mode, pos) FILTER (status = 'ok' AND NOT warmup), ''), count(*),
  count(*) FILTER (status = 'failed'), count(*) FILTER (status = 'ok' AND NOT warmup),
  round_even(median(total_seconds) FILTER (status = 'ok' AND NOT warmup) * 1e4, 0) / 1e4, NULL, NULL, '',
  coalesce(arg_min(error_message, pos) FILTER (status = 'failed'), '')
FROM @startups WHERE measurement <> 'startup' GROUP BY tool, mode""")
def startup_chain_table(spark, sf):
    records = bench(spark, sf).withColumns({
        "measurement": F.when(F.col("payload") == 0, "startup").otherwise("chain"),
        "mode": F.concat(F.lit("m"), F.col("concurrency")), "local_mode": F.col("path"),
        "interpreter_start_seconds": F.col("upload") / 100,
        "import_stack_seconds": F.col("server_exec") / 100,
        "package": F.concat(F.lit("p"), F.col("l_partkey") % 5)})
    return ops.startup_chain_table(records, BENCH_ORDER)


@query("concurrency_table", f"""WITH m AS (SELECT tool, concurrency, total_seconds AS v,
  row_number() OVER (PARTITION BY tool, concurrency ORDER BY total_seconds) AS r,
  count(*) OVER (PARTITION BY tool, concurrency) AS n FROM @bench WHERE status = 'ok' AND NOT warmup),
s AS (SELECT tool, concurrency, max(n) AS n, median(v) AS median, max(v) AS max,
  max(CASE WHEN r = {P95} THEN v END) AS p95 FROM m GROUP BY tool, concurrency),
c AS (SELECT tool, concurrency, count(*) AS jobs, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'ok') AS ok,
  arg_min(server_exec * 100, pos) AS w, arg_min(greatest(l_suppkey * 100, l_partkey), pos) AS peak,
  arg_min(greatest(l_suppkey * 10, l_partkey - 1), pos) AS base FROM @bench GROUP BY tool, concurrency)
SELECT tool, concurrency, jobs, failed, n, round_even(w * 1e4, 0) / 1e4 AS window_s,
  round_even(ok / w * 60 * 1e2, 0) / 1e2 AS throughput_jobs_per_min,
  round_even(median * 1e4, 0) / 1e4 AS p50_s, round_even(p95 * 1e4, 0) / 1e4 AS p95_s,
  round_even(max * 1e4, 0) / 1e4 AS max_s, peak AS peak_vram_mib, base AS baseline_vram_mib
FROM c LEFT JOIN s USING (tool, concurrency)""")
def concurrency_table(spark, sf):
    records = bench(spark, sf).withColumns({
        "window_seconds": F.col("server_exec") * 100,
        "peak_mib": F.create_map(F.lit("0"), F.col("l_suppkey") * 100, F.lit("1"), F.col("l_partkey")),
        "baseline_mib": F.create_map(F.lit("0"), F.col("l_suppkey") * 10, F.lit("1"), F.col("l_partkey") - 1)})
    return ops.concurrency_table(records, BENCH_ORDER)


define("compared", """(SELECT concat(source, '/', lang) AS record_id, concat('d', doc_id) AS name,
  CASE WHEN doc_id % 5 = 0 THEN 'differing' WHEN doc_id % 7 = 0 THEN 'only_left'
    WHEN doc_id % 11 = 0 THEN 'only_right' ELSE 'identical' END AS result,
  CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN doc_id % 2 = 0 END AS renamed FROM documents)""")


@query("parity_table", """WITH r AS (SELECT source AS tool, lang AS pair, concat(source, '/', lang) AS record_id,
  CASE WHEN lang = 'de' THEN 'local_control' ELSE 'comparison' END AS side,
  CASE WHEN max(n_chars) > 20000 THEN 'failed' ELSE 'ok' END AS status,
  bool_and(doc_id % 5 <> 0) AS parity_ok, bool_and(doc_id % 7 <> 0) AS content_parity_ok,
  concat('E', max(doc_id)) AS error_message FROM documents GROUP BY source, lang),
c AS (SELECT record_id, count(*) FILTER (result = 'identical') AS identical,
  count(*) FILTER (result = 'differing') AS differing, count(*) FILTER (result = 'only_left') AS only_local,
  count(*) FILTER (result = 'only_right') AS only_remote, count(renamed) AS renamed_pairs,
  count(*) FILTER (renamed) AS renamed_identical,
  coalesce(string_agg(name, '; ' ORDER BY name) FILTER (result = 'differing'), '') AS list
  FROM @compared GROUP BY record_id)
SELECT tool, pair, status, parity_ok,
  CASE WHEN side = 'local_control' THEN parity_ok ELSE content_parity_ok END AS content_parity_ok,
  identical, differing, only_local, only_remote,
  CASE WHEN side = 'local_control' THEN 0 ELSE renamed_pairs END AS renamed_pairs,
  CASE WHEN side = 'local_control' THEN 0 ELSE renamed_identical END AS renamed_identical,
  CASE WHEN side = 'local_control' THEN concat('LOCAL-VS-LOCAL CONTROL: ', substr(list, 1, 380))
    ELSE substr(list, 1, 400) END AS differing_files, error_message AS error FROM r JOIN c USING (record_id)""")
def parity_table(spark, sf):
    documents = table(spark, sf, "documents")
    record = F.concat_ws("/", "source", "lang")
    number = F.col("doc_id")
    records = documents.groupBy("source", "lang").agg(
        F.max("n_chars").alias("_chars"), F.bool_and(number % 5 != 0).alias("parity_ok"),
        F.bool_and(number % 7 != 0).alias("content_parity_ok"), F.max("doc_id").alias("_last")).select(
        record.alias("record_id"), F.col("source").alias("tool"), F.col("lang").alias("pair"),
        F.when(F.col("lang") == "de", "local_control").otherwise("comparison").alias("side"),
        F.when(F.col("_chars") > 20000, "failed").otherwise("ok").alias("status"), "parity_ok",
        "content_parity_ok", F.concat(F.lit("E"), F.col("_last")).alias("error_message"))
    names = documents.select(
        record.alias("record_id"), F.concat(F.lit("d"), number).alias("name"),
        F.when(number % 5 == 0, "differing").when(number % 7 == 0, "only_left")
        .when(number % 11 == 0, "only_right").otherwise("identical").alias("result"),
        F.when((number % 5 != 0) & (number % 7 == 0), number % 2 == 0).alias("renamed"))
    return ops.parity_table(records, names)


@query("failure_rows", """SELECT tool, path, repetition, source_file, error_message FROM @bench
WHERE status = 'failed'""")
def failure_rows(spark, sf):
    return ops.failure_rows(bench(spark, sf), ["tool", "path", "repetition", "source_file"])


@query("campaign_header", """SELECT count(*) AS records, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (warmup) AS warmups, count(DISTINCT source_file) AS source_files FROM @bench""")
def campaign_header(spark, sf):
    return ops.campaign_header(bench(spark, sf))


@query("hardware_fingerprint", """WITH l AS (SELECT concat_ws(' - ', n_name, concat('cpu', s_suppkey % 3),
  concat('gpu', s_suppkey % 2)) AS line, min(s_suppkey) AS at0, count(*) AS records
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT row_number() OVER (ORDER BY at0) AS position, line, records, count(*) OVER () > 1 AS several_machines
FROM l""")
def hardware_fingerprint(spark, sf):
    records = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("hostname"), F.concat(F.lit("cpu"), F.col("s_suppkey") % 3).alias("cpu"),
        F.concat(F.lit("gpu"), F.col("s_suppkey") % 2).alias("gpu"), "s_suppkey")
    return ops.hardware_fingerprint(records, ["s_suppkey"])


@query("throughput_probe", """WITH m AS (SELECT tool, concurrency AS parallelism, count(*) AS n,
  median(total_seconds) AS med, min(total_seconds) AS lo, max(total_seconds) AS hi,
  max(bytes_uploaded) AS b FROM @bench WHERE status = 'ok' GROUP BY 1, 2)
SELECT tool, parallelism, n, round_even(med * 1e4, 0) / 1e4 AS median_s, round_even(lo * 1e4, 0) / 1e4 AS min_s,
  round_even(hi * 1e4, 0) / 1e4 AS max_s, round_even(b / 1e6 / med * 1e2, 0) / 1e2 AS mb_per_s FROM m""")
def throughput_probe(spark, sf):
    return ops.throughput_probe(bench(spark, sf).withColumnRenamed("concurrency", "parallelism"))


@query("config_compare", """WITH b AS (SELECT *, tool AS config,
  CASE WHEN payload <> 0 THEN upload END AS running FROM @bench),
g AS (SELECT config, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, min(pos) AS at0 FROM b GROUP BY config),
s AS (SELECT config, count(*) AS n, round_even(sum(CAST(round_even(total_seconds * 1e6, 0) AS BIGINT)) / 1e6
    / count(*) * 1e2, 0) / 1e2 AS mean,
  round_even(stddev_samp(total_seconds) * 1e2, 0) / 1e2 AS sd,
  round_even(median(total_seconds) * 1e2, 0) / 1e2 AS med, round_even(min(total_seconds) * 1e2, 0) / 1e2 AS lo,
  round_even(max(total_seconds) * 1e2, 0) / 1e2 AS hi FROM b WHERE status = 'ok' GROUP BY config),
r AS (SELECT config, count(*) AS n, round_even(sum(CAST(round_even(running * 1e6, 0) AS BIGINT)) / 1e6
    / count(*) * 1e2, 0) / 1e2 AS mean,
  round_even(stddev_samp(running) * 1e2, 0) / 1e2 AS sd, round_even(median(running) * 1e2, 0) / 1e2 AS med,
  round_even(min(running) * 1e2, 0) / 1e2 AS lo, round_even(max(running) * 1e2, 0) / 1e2 AS hi
  FROM b WHERE status = 'ok' AND running <> 0 GROUP BY config)
SELECT config, row_number() OVER w AS position, runs, ok, s.n AS seconds_n, s.mean AS seconds_mean,
  s.sd AS seconds_sd, s.med AS seconds_median, s.lo AS seconds_min, s.hi AS seconds_max, r.n AS running_n,
  r.mean AS running_mean, r.sd AS running_sd, r.med AS running_median, r.lo AS running_min, r.hi AS running_max,
  CASE WHEN row_number() OVER w > 1 THEN round_even((r.mean - first_value(r.mean) OVER w)
    / first_value(r.mean) OVER w * 100 * 1e1, 0) / 1e1 END AS delta_percent
FROM g LEFT JOIN s USING (config) LEFT JOIN r USING (config) WINDOW w AS (ORDER BY at0)""")
def config_compare(spark, sf):
    records = bench(spark, sf).withColumns({
        "config": F.col("tool"), "running": F.when(F.col("payload") != 0, F.col("upload"))})
    return ops.config_compare(records, BENCH_ORDER)


define("params", """(SELECT tool AS config, concat('p', l_partkey % 200) AS param,
  CAST(CAST(max(upload) AS BIGINT) AS VARCHAR) AS value FROM @bench GROUP BY 1, 2)""")


@query("config_diff", """WITH c AS (SELECT DISTINCT config FROM @params), k AS (SELECT DISTINCT param FROM @params),
g AS (SELECT param, config, coalesce(value, 'default') AS value FROM k CROSS JOIN c
  LEFT JOIN @params p USING (param, config))
SELECT param, string_agg(concat(config, '=', value), ';' ORDER BY config) AS values FROM g
GROUP BY param HAVING count(DISTINCT value) > 1""")
def config_diff(spark, sf):
    params = bench(spark, sf).groupBy(
        F.col("tool").alias("config"), F.concat(F.lit("p"), F.col("l_partkey") % 200).alias("param")).agg(
        F.max("upload").cast("long").cast("string").alias("value"))
    return ops.config_diff(params)


@query("arm_summary", """WITH b AS (SELECT tool AS arm, status, total_seconds, upload, server_exec, download FROM @bench),
p AS (UNPIVOT b ON upload, server_exec, download INTO NAME phase VALUE seconds),
d AS (SELECT arm, phase, count(*) AS phase_runs, round_even(max(seconds) * 1e2, 0) / 1e2 AS phase_max,
  round_even(sum(CAST(round_even(seconds * 1e6, 0) AS BIGINT)) / 1e6 / count(*) * 1e2, 0) / 1e2 AS phase_mean
  FROM p GROUP BY arm, phase),
a AS (SELECT arm, count(*) FILTER (status = 'ok') AS ok, count(*) AS total,
  round_even(min(total_seconds) FILTER (status = 'ok') * 1e2, 0) / 1e2 AS fastest_seconds,
  round_even(max(total_seconds) FILTER (status = 'ok') * 1e2, 0) / 1e2 AS slowest_seconds,
  round_even(median(total_seconds) FILTER (status = 'ok') * 1e2, 0) / 1e2 AS median_seconds FROM b GROUP BY arm)
SELECT arm, ok, total, fastest_seconds, slowest_seconds, median_seconds, phase, phase_mean, phase_max, phase_runs
FROM a LEFT JOIN d USING (arm)""")
def arm_summary(spark, sf):
    records = bench(spark, sf).withColumnRenamed("tool", "arm")
    phases = records.unpivot(["arm"], ["upload", "server_exec", "download"], "phase", "seconds").filter(
        F.col("seconds").isNotNull())
    return ops.arm_summary(records, phases)


define("arms", """(SELECT concat(chr(CAST(65 + l_suppkey % 5 AS INTEGER)), l_suppkey) AS arm, l_suppkey AS pos,
  concat('T', l_suppkey % 7) AS tool, count(*) AS total,
  count(*) FILTER (NOT (l_discount >= 0.095 AND l_quantity = 50 AND l_linenumber = 1)) AS ok,
  count(*) FILTER (l_discount >= 0.095 AND l_quantity = 50 AND l_linenumber = 1) AS failed,
  count(*) FILTER (l_discount < 0.005 AND l_quantity = 1 AND l_linenumber = 2) AS oom,
  CAST(NULL AS BIGINT) AS health_failures, max(l_extendedprice) / 1000 AS wall_seconds,
  CAST(max(l_quantity) FILTER (l_linenumber = 3 AND l_tax = 0) AS BIGINT) AS peak_running,
  CASE WHEN l_suppkey % 9 <> 0 THEN CAST(round_even(max(l_extendedprice) * 1000, 0) AS BIGINT) ELSE 0 END AS peak_vram,
  CASE WHEN l_suppkey % 10 <> 0 THEN 104000000 + l_suppkey % 4 * 15000000 END AS budget_vram,
  1 + l_suppkey % 4 AS clients FROM lineitem GROUP BY l_suppkey)""")


def arms(spark, sf):
    """Arms of a campaign, one per supplier."""
    key = F.col("l_suppkey")
    lost = (F.col("l_discount") >= 0.095) & (F.col("l_quantity") == 50) & (F.col("l_linenumber") == 1)
    oom = (F.col("l_discount") < 0.005) & (F.col("l_quantity") == 1) & (F.col("l_linenumber") == 2)
    grouped = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~lost).alias("ok"), F.count_if(lost).alias("failed"),
        F.count_if(oom).alias("oom"), (F.max("l_extendedprice") / 1000).alias("wall_seconds"),
        F.max(F.when((F.col("l_linenumber") == 3) & (F.col("l_tax") == 0), F.col("l_quantity")))
        .cast("long").alias("peak_running"),
        F.rint(F.max("l_extendedprice") * 1000).cast("long").alias("_peak"))
    return grouped.select(
        F.concat(F.char(65 + key % 5), key).alias("arm"), key.alias("pos"),
        F.concat(F.lit("T"), key % 7).alias("tool"), "total", "ok", "failed", "oom",
        F.lit(None).cast("long").alias("health_failures"), "wall_seconds", "peak_running",
        F.when(key % 9 != 0, F.col("_peak")).otherwise(0).alias("peak_vram"),
        F.when(key % 10 != 0, 104000000 + key % 4 * 15000000).alias("budget_vram"),
        (1 + key % 4).alias("clients"))


define("verdicts", """(SELECT *, CASE WHEN budget_vram > 0 AND peak_vram > 0
    THEN round_even(peak_vram / budget_vram * 1e4, 0) / 1e4 END AS reached,
  CASE WHEN failed > 0 OR oom > 0 OR coalesce(health_failures, 0) > 0 THEN 'broke'
    WHEN budget_vram > 0 AND peak_vram > 0 AND peak_vram / budget_vram < CAST(0.75 AS DOUBLE) THEN 'short'
    ELSE 'held' END AS verdict FROM @arms)""")


@query("limit_verdict", "SELECT arm, failed, oom, reached, verdict FROM @verdicts")
def limit_verdict(spark, sf):
    return ops.limit_verdict(arms(spark, sf)).select("arm", "failed", "oom", "reached", "verdict")


@query("campaign_tiles", """SELECT 'runs' AS tile, CAST(sum(total) AS DOUBLE) AS value,
  CAST(count(*) AS VARCHAR) AS note FROM @verdicts
UNION ALL SELECT 'failures', sum(total - ok), NULL FROM @verdicts
UNION ALL SELECT 'most at once', max(peak_running), arg_min(concat(arm, ' ', tool), row(-peak_running, pos))
  FROM @verdicts WHERE peak_running IS NOT NULL
UNION ALL SELECT 'peak vram', max(peak_vram), arg_min(arm, row(-peak_vram, pos)) FROM @verdicts
UNION ALL SELECT 'on the clock',
  round_even(sum(CAST(round_even(wall_seconds * 1e6, 0) AS BIGINT)) / 1e6 * 1e3, 0) / 1e3, NULL FROM @verdicts
UNION ALL SELECT 'failed arm', total - ok, arm FROM @verdicts WHERE total > ok
UNION ALL SELECT concat('limit ', verdict), reached, arm FROM @verdicts WHERE verdict <> 'held'""")
def campaign_tiles(spark, sf):
    return ops.campaign_tiles(arms(spark, sf))


@query("arm_families", """WITH a AS (SELECT *, regexp_extract(arm, '^[A-Za-z]+') AS family FROM @arms),
t AS (SELECT family, count(*) AS n, string_agg(tool, ', ' ORDER BY at0, tool) AS names FROM
  (SELECT family, tool, min(pos) AS at0 FROM a GROUP BY family, tool) GROUP BY family),
c AS (SELECT family, string_agg(DISTINCT CAST(clients AS VARCHAR), ', ' ORDER BY CAST(clients AS VARCHAR)) AS client_levels
  FROM a GROUP BY family)
SELECT family, count(*) AS arms, round_even(max(wall_seconds) * 1e3, 0) / 1e3 AS max_wall, any_value(client_levels)
  AS client_levels, CASE WHEN any_value(n) <= 3 THEN any_value(names) ELSE concat(any_value(n), ' tools') END AS tools
FROM a JOIN t USING (family) JOIN c USING (family) GROUP BY family""")
def arm_families(spark, sf):
    return ops.arm_families(arms(spark, sf))


@query("device_peaks", """SELECT run_id % 4 AS device, max(value) AS peak, arg_min(value, pos) AS baseline,
  count(*) AS samples, (SELECT max(value) FROM @evt) AS overall_peak FROM @evt GROUP BY run_id % 4""")
def device_peaks(spark, sf):
    samples = events(spark, sf).select((F.col("run_id") % 4).alias("device"), F.col("value").alias("used"),
                                       "at_us", "event_id")
    return ops.device_peaks(samples, ["at_us", "event_id"])


@query("phase_other", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round_even((total_seconds - (upload + server_exec + coalesce(download, 0))) * 1e6, 0) / 1e6 AS other FROM @bench""")
def phase_other(spark, sf):
    return ops.phase_other(_phased(spark, sf)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(F.col("other"), 6).alias("other"))
