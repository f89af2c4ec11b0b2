"""How the driver's tables stand in for benchmark records, runs, events and costs.

Each binding exists twice: as a DataFrame and as the SQL text the oracle reads
(`@name` in an oracle stands for it). Instants are whole microseconds since the
epoch, so sums and differences are exact whatever the partitioning.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
# 2001-08-02 and 2024-02-01, both 00:00 UTC.
RUNS_NOW_US = 996_710_400 * SECOND
EVENTS_NOW_US = 1_706_745_600 * SECOND

BENCH_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship_us", "l_quantity"]
EVENT_ORDER = ["at_us", "event_id"]
PEAK_ORDER = ["ship_us", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "ram"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, in any session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                  f"CAST({column} AS TIMESTAMP_NTZ))")


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark records, from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("tool"), F.col("l_linestatus").alias("path"),
        F.col("l_linenumber").cast("long").alias("repetition"),
        (F.col("l_extendedprice") / 1000).alias("total_seconds"),
        (F.col("l_linenumber") == 1).alias("warmup"),
        F.when(F.col("l_discount") >= 0.095, "failed").otherwise("ok").alias("status"),
        F.concat(F.lit("E"), F.col("l_suppkey")).alias("error_message"),
        (1 + F.col("l_suppkey") % 4).alias("concurrency"),
        (F.col("l_suppkey") % 3).alias("payload"),
        F.col("l_quantity").alias("upload"),
        (F.col("l_extendedprice") / 1000).alias("server_exec"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("download"),
        (F.col("l_partkey") * 1000).alias("bytes_uploaded"),
        (F.col("l_suppkey") * 10000).alias("bytes_downloaded"),
        F.concat(F.lit("b1-"), F.year("l_shipdate")).alias("source_file"),
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey",
        micros("l_shipdate").alias("ship_us"), "l_quantity")


BENCH_SQL = """(SELECT l_returnflag AS tool, l_linestatus AS path,
  CAST(l_linenumber AS BIGINT) AS repetition, l_extendedprice / 1000 AS total_seconds,
  l_linenumber = 1 AS warmup, CASE WHEN l_discount >= 0.095 THEN 'failed' ELSE 'ok' END AS status,
  concat('E', l_suppkey) AS error_message, 1 + l_suppkey % 4 AS concurrency, l_suppkey % 3 AS payload,
  l_quantity AS upload, l_extendedprice / 1000 AS server_exec,
  CASE WHEN l_tax > 0 THEN l_tax * 100 END AS download,
  l_partkey * 1000 AS bytes_uploaded, l_suppkey * 10000 AS bytes_downloaded,
  concat('b1-', year(l_shipdate)) AS source_file,
  l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
  epoch_us(l_shipdate) AS ship_us, l_quantity,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate), l_quantity) AS pos
  FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run ledger, from orders."""
    cents = F.rint(F.col("o_totalprice") * 100).cast("long")
    start = micros("o_orderdate")
    outcome = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("client"),
        F.col("o_orderpriority").alias("tool"), start.alias("start_us"), outcome.alias("outcome"),
        F.when(outcome.isNotNull(), start + 60 * SECOND + (cents % 360000) * 10000).alias("end_us"),
        ((cents % 1000) * 10000).alias("waited_us"),
        F.concat(F.lit("batch-"), F.col("o_custkey")).alias("batch_id"),
        (1 + F.col("o_orderkey") % 12).alias("batch_index"),
        (8 + F.col("o_custkey") % 3).alias("batch_total"))


RUNS_SQL = """(SELECT o_orderkey AS run_id, o_custkey AS client, o_orderpriority AS tool,
  epoch_us(o_orderdate) AS start_us,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' END AS outcome,
  CASE WHEN o_orderstatus IN ('F', 'P') THEN epoch_us(o_orderdate) + 60000000
    + (CAST(round_even(o_totalprice * 100, 0) AS BIGINT) % 360000) * 10000 END AS end_us,
  (CAST(round_even(o_totalprice * 100, 0) AS BIGINT) % 1000) * 10000 AS waited_us,
  concat('batch-', o_custkey) AS batch_id, 1 + o_orderkey % 12 AS batch_index,
  8 + o_custkey % 3 AS batch_total FROM orders)"""

# The phase standing for each line number.
LINE_PHASES = ["received", "staging", "queued_gpu", "running", "paused", "packaging", "done"]


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase spans of runs, from lineitem."""
    start = micros("l_shipdate") + F.col("l_suppkey") * 60 * SECOND
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.get(F.array(*[F.lit(p) for p in LINE_PHASES]), F.col("l_linenumber") - 1).alias("phase"),
        start.alias("start_us"),
        F.when(F.col("l_tax") < 0.075, start + (F.col("l_quantity") * SECOND).cast("long")).alias("end_us"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("depth"),
        F.concat(F.lit("T"), F.col("l_partkey") % 8).alias("tool"),
        F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity")


SPANS_SQL = """(SELECT l_orderkey AS run_id,
  (['received', 'staging', 'queued_gpu', 'running', 'paused', 'packaging', 'done'])[l_linenumber] AS phase,
  epoch_us(l_shipdate) + l_suppkey * 60000000 AS start_us,
  CASE WHEN l_tax < 0.075 THEN epoch_us(l_shipdate) + l_suppkey * 60000000
    + CAST(l_quantity AS BIGINT) * 1000000 END AS end_us,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS depth, concat('T', l_partkey % 8) AS tool,
  CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log, from events. Only one purchase and one error in fifty end a run."""
    number, kind = F.col("event_id"), F.col("event_type")
    phase = (F.when(kind == "signup", "received").when(kind == "view", "staging")
             .when(kind == "click", "running")
             .when(kind == "purchase", F.when(number % 50 == 0, "done").otherwise("packaging"))
             .otherwise(F.when(number % 50 == 1, "failed").otherwise("paused")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), micros("ts").alias("at_us"), number, phase.alias("phase"),
        (F.col("value") / 100).alias("fraction"), (number % 10 == 0).alias("is_log"),
        F.get(F.array(*[F.lit(v) for v in ("debug", "info", "warning", "error")]),
              (number % 4).cast("int")).alias("level"),
        F.when(number % 20 == 0, "user").otherwise("admin").alias("audience"),
        (number % 3 != 0).alias("server"), (number % 3).alias("depth"),
        F.when(number % 7 == 0, F.concat(F.lit("T"), number % 4)).alias("tool"),
        F.concat_ws(" ", kind, F.col("value").cast("string"), F.col("props")).alias("message"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("value"), F.col("props"))


EVENTS_SQL = """(SELECT user_id AS run_id, epoch_us(ts) AS at_us, event_id,
  CASE event_type WHEN 'signup' THEN 'received' WHEN 'view' THEN 'staging' WHEN 'click' THEN 'running'
    WHEN 'purchase' THEN CASE WHEN event_id % 50 = 0 THEN 'done' ELSE 'packaging' END
    ELSE CASE WHEN event_id % 50 = 1 THEN 'failed' ELSE 'paused' END END AS phase,
  value / 100 AS fraction, event_id % 10 = 0 AS is_log,
  (['debug', 'info', 'warning', 'error'])[event_id % 4 + 1] AS level,
  CASE WHEN event_id % 20 = 0 THEN 'user' ELSE 'admin' END AS audience,
  event_id % 3 <> 0 AS server, event_id % 3 AS depth,
  CASE WHEN event_id % 7 = 0 THEN concat('T', event_id % 4) END AS tool,
  concat_ws(' ', event_type, CAST(value AS VARCHAR), props) AS message,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, props,
  row(epoch_us(ts), event_id) AS pos FROM events)"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak measurements, from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tool"), (1 + F.col("l_linenumber") % 4).cast("long").alias("width"),
        F.rint(F.col("l_extendedprice") * 1000).cast("long").alias("ram"),
        F.when(F.col("l_returnflag") == "R", F.lit(None)).when(F.col("l_tax") == 0, 0)
        .otherwise((F.col("l_quantity") * 1000000).cast("long")).alias("vram"),
        F.when(F.col("l_linestatus") == "F", "torch").otherwise("card").alias("source"),
        (F.col("l_discount") < 0.05).alias("solo"), (F.col("l_suppkey") % 3).alias("epoch"),
        (F.col("l_quantity") / 4).alias("cores"), (F.col("l_partkey") % 10 < 4).alias("own_only"),
        micros("l_shipdate").alias("ship_us"), "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity")


PEAKS_SQL = """(SELECT l_suppkey AS tool, CAST(1 + l_linenumber % 4 AS BIGINT) AS width,
  CAST(round_even(l_extendedprice * 1000, 0) AS BIGINT) AS ram,
  CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_tax = 0 THEN 0
    ELSE CAST(l_quantity AS BIGINT) * 1000000 END AS vram,
  CASE l_linestatus WHEN 'F' THEN 'torch' ELSE 'card' END AS source, l_discount < 0.05 AS solo,
  l_suppkey % 3 AS epoch, l_quantity / 4 AS cores, l_partkey % 10 < 4 AS own_only,
  epoch_us(l_shipdate) AS ship_us, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
  l_quantity, row(epoch_us(l_shipdate), l_orderkey, l_linenumber, l_partkey, l_quantity,
    CAST(round_even(l_extendedprice * 1000, 0) AS BIGINT)) AS pos FROM lineitem)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two artifact trees with their contents, from documents: one name in eleven
    renamed by the staging rule, one in seven moved away, one text in five changed."""
    documents = table(spark, sf_dir, "documents")
    number = F.col("doc_id")
    name = F.concat(F.lit("d"), number, F.lit(".txt"))
    changed = F.when(number % 5 == 0, F.concat(F.replace(F.col("text"), F.lit("en"), F.lit("EN")), F.lit("\nx"))).otherwise(
        F.col("text"))
    moved = (F.when(number % 7 == 0, F.concat(F.lit("moved/"), name))
             .when(number % 11 == 0, F.concat(F.lit("input_"), name)).otherwise(name))
    return (documents.select(name.alias("name"), F.col("text").alias("content")),
            documents.select(moved.alias("name"), changed.alias("content")))


LEFT_SQL = """(SELECT concat('d', doc_id, '.txt') AS name, text AS content, sha256(text) AS sha256,
  CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents)"""
RIGHT_SQL = """(SELECT name, content, sha256(content) AS sha256,
  CAST(octet_length(encode(content)) AS BIGINT) AS size FROM (SELECT
  CASE WHEN doc_id % 7 = 0 THEN concat('moved/d', doc_id, '.txt')
    WHEN doc_id % 11 = 0 THEN concat('input_d', doc_id, '.txt') ELSE concat('d', doc_id, '.txt') END AS name,
  CASE WHEN doc_id % 5 = 0 THEN concat(replace(text, 'en', 'EN'), chr(10), 'x') ELSE text END AS content FROM documents))"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data manifest entries, from part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("tool"),
        F.when(F.col("p_size") % 2 == 0, "models").otherwise("testfiles").alias("kind"), key.alias("pos"),
        F.when(key % 29 == 0, F.lit(None)).when(key % 31 == 0, F.concat(F.col("p_name"), F.lit("/"), key))
        .otherwise(F.concat(F.col("p_name"), key)).alias("name"),
        F.concat(F.when(key % 13 == 0, "http://x/").otherwise("https://x/"), key).alias("url"),
        F.when(key % 9 != 0, F.sha2(F.col("p_name"), 256)).alias("sha256"),
        (F.col("p_size") * 1000).cast("long").alias("size"),
        F.when(key % 17 == 0, "../e").when(key % 19 == 0, "/abs").when(key % 23 == 0, "sub/dir").alias("dest"),
        (key % 18 == 0).alias("unpinned"), F.when(key % 37 == 0, "view").alias("split"),
        (key % 74 == 0).alias("extract"))


MANIFEST_SQL = """(SELECT p_brand AS tool, CASE WHEN p_size % 2 = 0 THEN 'models' ELSE 'testfiles' END AS kind,
  p_partkey AS pos,
  CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN concat(p_name, '/', p_partkey)
    ELSE concat(p_name, p_partkey) END AS name,
  concat(CASE WHEN p_partkey % 13 = 0 THEN 'http://x/' ELSE 'https://x/' END, p_partkey) AS url,
  CASE WHEN p_partkey % 9 <> 0 THEN sha256(p_name) END AS sha256, CAST(p_size * 1000 AS BIGINT) AS size,
  CASE WHEN p_partkey % 17 = 0 THEN '../e' WHEN p_partkey % 19 = 0 THEN '/abs'
    WHEN p_partkey % 23 = 0 THEN 'sub/dir' END AS dest,
  p_partkey % 18 = 0 AS unpinned, CASE WHEN p_partkey % 37 = 0 THEN 'view' END AS split,
  p_partkey % 74 = 0 AS extract FROM part)"""


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is installed: presence, the stamped hash and whether the derived view exists, from part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("pos"), (key % 4 != 0).alias("present"),
        F.when(key % 10 != 3, F.when(key % 6 == 0, F.lit("stale")).otherwise(F.sha2("p_name", 256)))
        .alias("stamp"),
        (key % 111 != 0).alias("view_present"))


STAMPS_SQL = """(SELECT p_partkey AS pos, p_partkey % 4 <> 0 AS present,
  CASE WHEN p_partkey % 10 <> 3 THEN CASE WHEN p_partkey % 6 = 0 THEN 'stale' ELSE sha256(p_name) END END
    AS stamp, p_partkey % 111 <> 0 AS view_present FROM part)"""


def calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tool catalogue and its call edges, from nation."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    tools = nation.select(F.col("n_name").alias("tool"),
                          F.when(key % 4 == 0, "edit").when(key % 4 == 1, "approve").alias("review_kind"))
    edges = nation.select(F.col("n_name").alias("caller"), F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.concat(F.lit("NATION_"), (key * 2 + 1) % 25).alias("callee")),
        F.struct(F.lit(2).alias("pos"), F.concat(F.lit("NATION_"), (key + 5) % 27).alias("callee")),
    )).alias("edge")).select("caller", "edge.pos", "edge.callee")
    return tools, edges


TOOLS_SQL = """(SELECT n_name AS tool, CASE WHEN n_nationkey % 4 = 0 THEN 'edit'
  WHEN n_nationkey % 4 = 1 THEN 'approve' END AS review_kind FROM nation)"""
CALLS_SQL = """(SELECT n_name AS caller, 1 AS pos, concat('NATION_', (n_nationkey * 2 + 1) % 25) AS callee
  FROM nation UNION ALL
  SELECT n_name, 2, concat('NATION_', (n_nationkey + 5) % 27) FROM nation)"""

SQL = {"bench": BENCH_SQL, "runs": RUNS_SQL, "spans": SPANS_SQL, "evt": EVENTS_SQL, "peaks": PEAKS_SQL,
       "left": LEFT_SQL, "right": RIGHT_SQL, "manifest": MANIFEST_SQL, "stamps": STAMPS_SQL,
       "tools": TOOLS_SQL, "calls": CALLS_SQL}


def define(name: str, sql: str) -> None:
    """Make `@name` available to oracles."""
    SQL[name] = sql


def expand(sql: str) -> str:
    """Replace every `@name` by its SQL."""
    while re.search(r"@[a-z_0-9]+", sql):
        sql = re.sub(r"@([a-z_0-9]+)", lambda m: SQL[m.group(1)], sql)
    return sql
