"""What several operators of this package share: words, row keys, written tables, global order."""

from __future__ import annotations

import contextlib
import functools
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import scratch

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = "__row_key"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case; every other letter stays."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, its lineage cut."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of few columns that one file of a small table may hold.
ROWS_PER_FILE = 100_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of `rows` rows at most, in no more partitions than they need, but one for each core.

    For small tables that are written again and again: each file costs a task, and on a local disk Hadoop also starts
    processes for its permissions. A table that needs all its partitions keeps them.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))


# Spark's own setting for what `shuffles_freed` does.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a write in the block shuffles leaves the disks when the write ends, not when the driver next collects garbage.

    Only for frames that are run once: another run of the same one shuffles anew.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


# Bytes of rows that Spark hands to Python at once; its default is 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs in the block hands rows to Python workers a few MB at a time.

    A batch is held several times over, in the executor and in each of its workers: as columns, as objects, and as what the
    worker makes of it.
    """
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


@contextlib.contextmanager
def in_buckets(df: DataFrame, name: str, key: str) -> Iterator[DataFrame]:
    """`df` written once to the shared folder, a bucket of `key` for each shuffle partition: a join by `key` moves only the other side.

    The files stay, as those of `written`; the name of the table is for the block only.
    """
    spark = df.sparkSession
    table = f"runlens_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.format("parquet").option("path", scratch(spark, name)).bucketBy(partitions(spark), key).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def with_key(docs: DataFrame) -> DataFrame:
    """`docs` with a bigint `KEY` that tells every row from every other.

    Where doc_id is there in every row and never twice, it is the key. Otherwise the rows are
    written to the shared folder with a number each, so that later passes see the same numbers.
    """
    if KEY in docs.columns:
        return docs
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs.withColumn(KEY, F.col("doc_id").cast("bigint"))
    return written(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, `columns` and `KEY` of `docs`; see `with_key`."""
    own = [KEY] if KEY in docs.columns else []
    return with_key(docs.select(*dict.fromkeys(("doc_id", *columns, *own))))


READ = ("doc_id", "text", "source", "n_chars")


def names_kept(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that gives back the columns of `docs`, whatever they are called.

    Inside it every column but `READ` has a name of no meaning, so that none is taken for one of the stage's own.
    """

    @functools.wraps(stage)
    def run(docs: DataFrame, *args: Any, **parameters: Any) -> DataFrame:
        inside = docs.toDF(*[name if name in READ else f"column_{i}" for i, name in enumerate(docs.columns)])
        return stage(inside, *args, **parameters).select(*inside.columns).toDF(*docs.columns)

    return run


def only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `docs`, which carries `KEY`, whose key is in `keys`; `KEY` is dropped."""
    return docs.join(keys.select(KEY), KEY, "left_semi").drop(KEY)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, order: list, name: str, part: str = "__part") -> DataFrame:
    """`df` dealt over ranges of `order` and written, each row with the number of its range.

    Ranges follow each other in the order; inside a range rows are not sorted yet. The rows are
    written because the bounds come from a sample that another run may draw differently.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order)
    return written(dealt.withColumn(part, F.spark_partition_id()), name)


def before_each(df: DataFrame, value: Column, part: str = "__part") -> tuple[dict[int, int], int]:
    """What the ranges before each range sum to, and the whole sum: one number per range."""
    sums = df.groupBy(part).agg(F.sum(value)).collect()
    before, total = {}, 0
    for number, amount in sorted((r[0], r[1] or 0) for r in sums):
        before[number] = total
        total += amount
    return before, total


def numbered(df: DataFrame, order: list, name: str, number: str) -> DataFrame:
    """`df` with the rank of each row, from 0, in an order over the whole table."""
    from pyspark.sql import Window

    ranged = in_ranges(df, order, name)
    before, _ = before_each(ranged, F.lit(1))
    spark = df.sparkSession
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "__part int, __start bigint")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(starts, "__part").withColumn(number, F.col("__start") + inside - 1).drop("__part", "__start")


def kept_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """What `make` returns, made once by a Python worker process and kept from task to task.

    Only for memories that save time: a worker that starts anew makes its own.
    """
    store = sys.modules.setdefault("_runlens_worker", types.ModuleType("_runlens_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)
