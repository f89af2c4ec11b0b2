"""Queries that write the driver's tables in the formats of the sources and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators.benchmark import latency_table
from runlens.plans.bindings import BENCH_ORDER, bench, define, events, runs, table
from runlens.plans.registry import query
from runlens.session import scratch
from runlens.sources import files, records, tables

BENCH_FILE = "tool string, path string, repetition long, total_seconds double, status string, warmup boolean"


def _text(rows, path, value="value", by=()):
    rows.select(value, *by).write.partitionBy(*by).text(path)
    return path


@query("scan_jsonl_records", """SELECT CASE WHEN event_id % 20 > 0 THEN event_id END AS id, CASE WHEN event_id % 20 > 0 THEN k END AS k,
  CASE WHEN event_id % 20 = 0 THEN concat('{"id": ', event_id, ', "k') END AS raw FROM @evt""")
def scan_jsonl_records(spark, sf):
    n = F.col("event_id")
    line = F.when(n % 20 == 0, F.concat(F.lit('{"id": '), n, F.lit(', "k'))).otherwise(
        F.concat(F.lit('{"id": '), n, F.lit(', "k": '), "k", F.lit("}")))
    lines = events(spark, sf).select(F.explode(F.when(n % 3 == 0, F.array(line, F.lit("  "))).otherwise(F.array(line))).alias("value"))
    path = _text(lines, scratch(spark, "records"))
    return records.scan_jsonl_records(spark, path, "id long, k long").select("id", "k", F.col("_raw").alias("raw"))


@query("scan_campaign", """SELECT tool, path, repetition, total_seconds, status, warmup FROM @bench WHERE l_suppkey % 3 < 2""")
def scan_campaign(spark, sf):
    path = scratch(spark, "raw")
    rows = bench(spark, sf)
    kind = F.when(F.col("l_suppkey") % 3 < 2, "b1-run").otherwise("b2-run").alias("file")
    rows.select(F.to_json(F.struct("tool", "path", "repetition", "total_seconds", "status", "warmup")).alias("value"), kind).write.partitionBy("file").text(path)
    # A folder per file here: the campaign's name begins the folder's.
    return records.scan_campaign(spark, path, "file=b1", BENCH_FILE).drop("_source_file", "_unreadable_line", "_raw")


define("history", """(SELECT CAST(run_id AS VARCHAR) AS run_id, tool, start_us, end_us, (end_us - start_us) / 1e6 AS took, run_id % 4 AS kind, outcome FROM @runs WHERE end_us IS NOT NULL)""")


@query("scan_history", """SELECT run_id, tool, outcome, CASE WHEN kind = 0 THEN round_even(greatest(0, took - 30) * 1e2, 0) / 1e2 ELSE took END AS seconds,
  CASE WHEN kind = 0 THEN 30 ELSE 5 END AS paused_seconds FROM @history WHERE kind <> 3""")
def scan_history(spark, sf):
    finished = runs(spark, sf).filter(F.col("end_us").isNotNull())
    start, end = F.col("start_us") / 1e6, F.col("end_us") / 1e6
    kind = F.col("run_id") % 4
    paused = F.struct(F.lit("paused").alias("phase"), start.alias("start"), (start + 30).alias("end"))
    span = F.array(paused, F.struct(F.lit("running").alias("phase"), (start + 30).alias("start"), F.lit(None).cast("double").alias("end")))
    record = F.to_json(F.struct(
        F.when(kind != 3, F.col("run_id").cast("string")).alias("run_id"), "tool", "outcome", start.alias("started_at"), end.alias("ended_at"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("seconds"), F.when(kind != 0, 5.0).alias("paused_seconds"), span.alias("spans")))
    torn = F.when(kind == 3, F.array(record, F.substring(record, 1, 40))).otherwise(F.array(record))
    path = _text(finished.select(F.explode(torn).alias("value")), scratch(spark, "history"))
    return records.scan_history(spark, path).select("run_id", "tool", "outcome", "seconds", "paused_seconds")


@query("sink_append_only", "SELECT tool, path, repetition, total_seconds, status, warmup FROM @bench")
def sink_append_only(spark, sf):
    rows = bench(spark, sf).select("tool", "path", "repetition", "total_seconds", "status", "warmup")
    return spark.read.schema(BENCH_FILE).json(records.sink_append_only(rows, scratch(spark, "records")))


@query("scan_csv", "SELECT p_name, CAST(p_size AS VARCHAR) AS p_size, p_brand FROM part WHERE p_partkey % 5 > 0")
def scan_csv(spark, sf):
    n = F.col("p_partkey")
    blank = n % 5 == 0
    rows = table(spark, sf, "part").select(
        *[F.when(blank, "  ").otherwise(F.col(c).cast("string")).alias(c) for c in ("p_name", "p_size", "p_brand")])
    path = scratch(spark, "csv")
    rows.write.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path, header=True)
    return tables.scan_csv(spark, path)


@query("union_csv_dir", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type FROM part")
def union_csv_dir(spark, sf):
    path = scratch(spark, "csvs")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_type").repartition(4, "p_type").write.csv(path, header=True)
    return tables.union_csv_dir(spark, path).drop("_source_file")


@query("sink_summary_table", """SELECT concat('| ', tool, '\\|', ' | ', path, ' | ', count(*), ' | ', count(*) FILTER (status = 'failed'), ' |') AS value FROM @bench GROUP BY tool, path
UNION ALL SELECT '| tool | path | runs | failed |' UNION ALL SELECT '|---|---|---|---|'""")
def sink_summary_table(spark, sf):
    rows = latency_table(bench(spark, sf), BENCH_ORDER).select(
        F.concat("tool", F.lit("|")).alias("tool"), "path", "runs", "failed")
    return spark.read.text(f"{tables.sink_summary_table(rows, scratch(spark, 'summary'))}/markdown")


@query("export_preview", "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, p_brand FROM part ORDER BY p_name, p_partkey LIMIT 5")
def export_preview(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name",
                                           F.when(F.col("p_partkey") >= 0, F.col("p_brand")).alias("p_brand"), F.col("p_partkey").alias("_n"))
    path = tables.export_preview(rows, ["p_name", "_n"], scratch(spark, "preview"), 5, "json")
    return spark.read.schema("p_partkey double, p_name string, p_brand string").json(path)


@query("file_inventory", """SELECT concat('part=', source, '-', doc_id % 8) AS name, sha256(string_agg(concat(text, chr(10)), '' ORDER BY doc_id)) AS sha256,
  CAST(octet_length(encode(string_agg(concat(text, chr(10)), '' ORDER BY doc_id))) AS BIGINT) AS size FROM documents GROUP BY ALL
UNION ALL SELECT '_SUCCESS', sha256(''), 0""")
def file_inventory(spark, sf):
    path = scratch(spark, "tree")
    texts = table(spark, sf, "documents").select(F.concat("source", F.lit("-"), F.col("doc_id") % 8).alias("part"), "doc_id", "text")
    texts.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(path)
    # Checksums that a local file system keeps beside files are not of the table.
    found = files.file_inventory(spark, path).filter(~F.endswith("name", F.lit(".crc")))
    return found.select(F.element_at(F.split("name", "/"), 1).alias("name"), "sha256", "size")


@query("dataset_listing", """SELECT concat('tool=', source) AS tool, concat('kind=', lang) AS kind, 'file' AS type, sum(octet_length(encode(replace(text, chr(10), ' '))) + 1) AS bytes
FROM documents GROUP BY source, lang""")
def dataset_listing(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("value"), F.col("source").alias("tool"), F.col("lang").alias("kind"))
    path = scratch(spark, "DATA")
    rows.write.partitionBy("tool", "kind").text(path)
    listed = files.dataset_listing(spark, path)
    return listed.groupBy("tool", "kind", "type").agg(F.sum("bytes").alias("bytes"))


@query("campaign_index", """SELECT l_returnflag AS campaign, max(l_suppkey) AS generated_at, count(DISTINCT l_suppkey) AS arms,
  length(concat('{"generated_at":', max(l_suppkey), ',"arms":[', string_agg(DISTINCT concat('{"arm":"', l_suppkey, '"}'), ','), ']}')) + 1 AS bytes FROM lineitem GROUP BY l_returnflag""")
def campaign_index(spark, sf):
    campaigns = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("campaign")).agg(
        F.max("l_suppkey").alias("_at"), F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda s: F.concat(
            F.lit('{"arm":"'), s.cast("string"), F.lit('"}'))), ",").alias("_arms"))
    path = scratch(spark, "campaigns")
    text = F.concat(F.lit('{"generated_at":'), "_at", F.lit(',"arms":['), "_arms", F.lit("]}"))
    rows = campaigns.select(text.alias("value"), "campaign").union(spark.range(1).select(F.lit("{torn"), F.lit("torn")))
    rows.write.partitionBy("campaign").text(path)
    return files.campaign_index(spark, f"{path}/campaign=*").select(
        F.regexp_extract("path", "campaign=([^/]*)/", 1).alias("campaign"), F.col("generated_at").cast("long").alias("generated_at"), "arms", "bytes")


@query("count_above", """SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity > 25) AS above FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(*) FILTER (l_extendedprice > 25) FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax > 25) FROM lineitem""")
def count_above(spark, sf):
    rows = table(spark, sf, "lineitem").select(*[
        F.col(c).cast("string").alias(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "l_returnflag")])
    return tables.count_above(rows, 25)
