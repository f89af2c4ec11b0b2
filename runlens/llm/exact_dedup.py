"""Exact dedup: a stream with disk-backed keyed state that never expires.

Rows arrive as (digest, identifier, locator). The state holds one record per digest: how many rows
came, and the identifier and locator of the row that stays. It lives in RocksDB on the executors and
in the checkpoint on the shared folder, so that a further `ingest` goes on from it. A digest that
several rows share is a hit: their full texts, fetched by locator, are compared byte by byte, and
texts that only share the digest are told apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import KEY, ascii_lower, keyed, only, text_of, with_key, written, names_kept
from runlens.session import scratch

# The state in RocksDB, its files no larger than what they hold: many small stores share a disk.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class DedupIndex:
    """The digests seen so far, in `folder`; `ingest` adds rows, `records` reads the state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def ingest(self, arrivals: DataFrame) -> None:
        """Add rows (digest binary, doc_id bigint, locator bigint); a null doc_id sorts first."""
        spark, inbox = self.spark, f"{self.folder}/arrivals"
        arrivals.select("digest", "doc_id", "locator").write.mode("append").parquet(inbox)
        keeper = F.max(F.struct("doc_id", "locator"))
        records = (
            spark.readStream.schema("digest binary, doc_id bigint, locator bigint").parquet(inbox)
            .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), keeper.alias("keeper"))
        )
        before = {name: spark.conf.get(name, None) for name in STATE}
        for name, value in STATE.items():
            spark.conf.set(name, value)
        try:
            stream = (records.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                      .option("checkpointLocation", f"{self.folder}/state").start())
            stream.awaitTermination()
        finally:
            for name, value in before.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)

    def records(self) -> DataFrame:
        """One row per digest: digest, n, keeper (doc_id, locator)."""
        state = self.spark.read.format("statestore").load(f"{self.folder}/state")
        kinds = {f.name: f.dataType.simpleString() for f in state.schema["value"].dataType.fields}
        n = next(k for k, v in kinds.items() if v == "bigint")
        keeper = next(k for k, v in kinds.items() if v.startswith("struct"))
        return state.select(F.col("key.digest").alias("digest"), F.col("value")[n].alias("n"),
                            F.col("value")[keeper].alias("keeper"))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256,
                index: DedupIndex | None = None) -> DataFrame:
    """Groups of rows of `docs` whose texts are equal after lower-casing A-Z.

    One row per row of `docs`: KEY, doc_id, keep_id, group_size, kept, text_sha256. Of equal texts
    the row with the largest doc_id stays; among rows that repeat one doc_id, one of them. A null
    doc_id is smaller than any other; null texts count as empty, and empty texts are equal. An
    empty table gives no row. Texts of any length are compared whole. `digest` is a parameter so
    that digests that collide can be tried; results do not depend on it.
    """
    spark = docs.sparkSession
    rows = keyed(docs, "text").select(KEY, "doc_id", ascii_lower(text_of()).alias("text"))
    seen = written(rows.select(KEY, "doc_id", digest(F.col("text")).alias("digest"),
                               F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "digests")
    index = index or DedupIndex(spark, scratch(spark, "dedup-index"))
    index.ingest(seen.select("digest", "doc_id", F.col(KEY).alias("locator")))
    records = written(index.records(), "records")

    # Hits: rows whose digest another row has too. Their texts are fetched once and compared in
    # full, as the least and the greatest of a group: each task sends one pair per digest, so no
    # group is gathered. The fetch is a shuffle join at any size, for hits grow with the input.
    hits = seen.join(records.where("n > 1").select("digest"), "digest", "left_semi").select(KEY, "doc_id", "digest")
    contents = written(rows.select(KEY, "text").join(hits.hint("merge"), KEY), "hits")
    differing = written(
        contents.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
        .where("least != greatest").select("digest"), "collisions")
    split = (
        contents.join(differing, "digest", "left_semi").groupBy("digest", "text")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", F.col(KEY).alias("locator"))).alias("keeper"))
    )
    told_apart = (
        contents.join(differing, "digest", "left_semi").select(KEY, "digest", "text")
        .join(split, ["digest", "text"]).select(KEY, "n", "keeper")
    )
    equal = seen.join(differing, "digest", "left_anti").join(records, "digest")
    collided = seen.join(differing, "digest", "left_semi").join(told_apart, KEY)
    columns = (KEY, "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
               (F.col(KEY) == F.col("keeper.locator")).alias("kept"), "text_sha256")
    return equal.select(*columns).unionAll(collided.select(*columns))


@names_kept
def without_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were."""
    rows = with_key(docs)
    return only(rows, exact_dedup(rows).where("kept"))
