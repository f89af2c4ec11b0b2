"""Reading and writing of CSV tables and of tables meant to be read by people."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.args import stripped
from runlens.sources.files import Tree, list_files


def _blanks_dropped(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.filter(F.concat(*[F.coalesce(stripped(F.col(f"`{c}`")), F.lit("")) for c in columns]) != "")


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose first line names the columns, every value as text; blank rows are left out."""
    rows = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=False)
    if not rows.columns:
        raise ValueError(f"{path} is empty")
    return _blanks_dropped(rows, rows.columns)


def _heads(root: str) -> Callable[[Iterator[pyarrow.RecordBatch]], Iterator[pyarrow.RecordBatch]]:
    """A function that reads the first line of each named file below `root`, and no more of it than a block."""

    def work(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        tree = Tree(root)
        for batch in batches:
            heads = [tree.first_line(name) for name in batch.column("name").to_pylist()]
            yield pyarrow.record_batch([batch.column("name"), pyarrow.array(heads, pyarrow.binary())], names=["name", "head"])

    return work


def union_csv_dir(spark: SparkSession, folder: str) -> DataFrame:
    """Every CSV of a folder in one table, refused when their headers differ.

    For the check the first line of each file is read, whatever its length, and nothing after its block.
    """
    direct = ~F.col("name").contains("/") & F.col("name").rlike(r"(?i)^[^_.].*\.csv$")
    heads = list_files(spark, folder).filter(direct & (F.col("size") > 0)).select("name").mapInArrow(_heads(folder), "name string, head binary")
    found = heads.groupBy("head").agg(F.min("name").alias("name")).orderBy("name").limit(2).collect()
    if not found:
        raise ValueError(f"No .csv file found directly in {folder}")
    if len(found) > 1:
        raise ValueError(f"{found[1]['name']} has different columns from {found[0]['name']}")
    pattern = f"{folder.rstrip('/')}/*.[cC][sS][vV]"
    rows = spark.read.csv(pattern, header=True, inferSchema=False, quote='"', escape='"')
    return _blanks_dropped(rows.select("*", F.col("_metadata.file_name").alias("_source_file")), rows.columns)


def numeric_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether each column is numeric: every non-blank cell a number, and at least one."""
    cells = rows.select(*columns).unpivot([], list(columns), "column", "cell").withColumn("cell", stripped(F.col("cell")))
    filled = cells.filter(F.coalesce("cell", F.lit("")) != "")
    return filled.groupBy("column").agg(F.bool_and(F.col("cell").try_cast("double").isNotNull()).alias("numeric"))


def count_above(rows: DataFrame, threshold: float) -> DataFrame:
    """How many cells of the numeric columns of an all-text table exceed a threshold, per column."""
    cells = rows.unpivot([], rows.columns, "column", "cell").withColumn("cell", stripped(F.col("cell")))
    value = F.col("cell").try_cast("double")
    filled = cells.filter(F.coalesce("cell", F.lit("")) != "")
    # Blank cells were left out above, so a column without a value has no row at all.
    return filled.groupBy("column").agg(
        F.bool_and(value.isNotNull()).alias("_numeric"),
        F.count(F.when((value > threshold) & ~F.isnan(value), 1)).alias("above")).filter("_numeric").select("column", "above")


def _cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\n", " ")


def markdown_lines(rows: DataFrame) -> DataFrame:
    """The rows of a table as lines of a markdown table, header lines apart."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(F.col(f"`{c}`")) for c in rows.columns]), F.lit(" |")).alias("value"))


def sink_summary_table(rows: DataFrame, path: str) -> str:
    """A report's rows as CSV and as markdown, under `path`/csv and `path`/markdown."""
    rows.write.mode("errorifexists").csv(f"{path}/csv", header=True)
    head = rows.sparkSession.range(1).select(F.explode(F.array(
        F.lit("| " + " | ".join(rows.columns) + " |"), F.lit("|" + "|".join("---" for _ in rows.columns) + "|"))).alias("value"))
    head.coalesce(1).write.mode("errorifexists").text(f"{path}/markdown")
    markdown_lines(rows).write.mode("append").text(f"{path}/markdown")
    return path


def export_preview(rows: DataFrame, order: Sequence[str], path: str, count: int = 5, kind: str = "csv") -> str:
    """The first rows of a table as CSV or JSON; a numeric column's cells are numbers, blanks are null."""
    head = rows.orderBy(*order).limit(count)
    if kind == "csv":
        head.write.mode("errorifexists").csv(path, header=True)
        return path
    texts = [c for c, t in rows.dtypes if t == "string"]
    kinds = {r["column"]: r["numeric"] for r in numeric_columns(rows, texts).collect()} if texts else {}
    typed = head.select(*[
        F.nullif(stripped(F.col(c)), F.lit("")).cast("double").alias(c) if kinds.get(c) else
        (F.nullif(F.col(c), F.lit("")).alias(c) if c in texts else F.col(c)) for c in rows.columns])
    typed.write.mode("errorifexists").json(path)
    return path
