"""Reading and writing of records kept as JSON lines, and of run histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions.numbers import rounded

RAW_CHARS = 200
SPAN = "array<struct<phase:string,start:double,end:double>>"
HISTORY = ("run_id string, tool string, client string, outcome string, started_at double, ended_at double, "
           f"seconds double, paused_seconds double, spans {SPAN}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of text files with its file and 1-based number.

    Files are read in blocks. A line is numbered inside its block, which is no larger than
    spark.sql.files.maxPartitionBytes, and moved up by the lines of the blocks before it.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"))
    within = Window.partitionBy("path", "block").orderBy("_id")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_n")).select(
        "path", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    return lines.withColumn("_at", F.row_number().over(within)).join(blocks, ["path", "block"]).select(
        F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "path", (F.col("_at") + F.col("_skip")).alias("line"), "value")


def scan_jsonl_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per non-blank line; a line that is not JSON becomes a marker row, never an error."""
    lines = read_lines(spark, path).withColumn("value", F.trim("value")).filter(F.col("value") != "")
    bad = F.try_parse_json("value").isNull()
    return lines.withColumn("_r", F.from_json("value", schema)).select(
        "_r.*", F.col("file").alias("_source_file"), F.when(bad, F.col("line")).alias("_unreadable_line"),
        F.when(bad, F.substring("value", 1, RAW_CHARS)).alias("_raw"))


def scan_campaign(spark: SparkSession, root: str, campaign: str, schema: str, only: Sequence[str] | None = None) -> DataFrame:
    """The records of every raw file of a campaign, the file's name beside each; `only` picks files."""
    records = scan_jsonl_records(spark, f"{root.rstrip('/')}/{campaign}-*", schema)
    return records if only is None else records.filter(F.col("_source_file").isin(list(only)))


def scan_history(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """Finished runs from a history file, torn lines and rows without an id left out.

    Rows written before pauses were taken out of `seconds` have it corrected from their spans.
    """
    lines = spark.read.text(path)
    rows = lines.select("value", F.from_json("value", schema).alias("r")).filter(
        F.coalesce("r.run_id", F.lit("")) != "").select("value", "r.*")
    old = ~F.coalesce(F.array_contains(F.json_object_keys("value"), "paused_seconds"), F.lit(False)) & (
        F.coalesce("ended_at", F.lit(0.0)) != 0)
    paused = F.aggregate(
        F.filter(F.coalesce("spans", F.array().cast(SPAN)), lambda s: (s["phase"] == "paused") & s["end"].isNotNull()),
        F.lit(0.0), lambda total, s: total + F.greatest(F.lit(0.0), s["end"] - s["start"]))
    whole = F.greatest(F.lit(0.0), F.col("ended_at") - F.coalesce("started_at", F.lit(0.0)))
    worked = rounded(F.greatest(F.lit(0.0), whole - paused), 2)
    return rows.withColumns({"seconds": F.when(old, worked).otherwise(F.col("seconds")),
                             "paused_seconds": F.when(old, rounded(paused, 2)).otherwise(F.col("paused_seconds"))}).drop("value")


def sink_append_only(records: DataFrame, path: str) -> str:
    """Write records as JSON lines to a new place; an existing one is an error, never overwritten."""
    records.write.mode("errorifexists").json(path)
    return path
