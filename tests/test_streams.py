"""Streams against their batch twins, the progress tree, sources and the transform registry."""

import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlens.operators import events as ops
from runlens.operators import ledger
from runlens.operators.progress import FIELDS, progress_tree
from runlens.plans.bindings import EVENT_ORDER, events
from runlens.plans.ledger import ledger_records
from runlens.plans.streams import TRANSFORMS, opened, weighted
from runlens.registry import Argument, ArgumentError, Transforms
from runlens.session import scratch
from runlens.sources import records, tables
from runlens.streaming import events as stream

FOLDER = "/root/testdata/sf0.001"


def as_set(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_listing_equals_batch(spark):
    path = scratch(spark, "listing")
    live = stream.stream_listing(opened(spark, FOLDER), EVENT_ORDER)
    query = (live.writeStream.format("memory").queryName("listing").outputMode("complete")
             .option("checkpointLocation", path).trigger(availableNow=True).start())
    query.awaitTermination()
    assert as_set(spark.table("listing")) == as_set(ops.live_listing(events(spark, FOLDER), EVENT_ORDER))


def test_progress_equals_batch(spark):
    path, kept = scratch(spark, "weighted"), scratch(spark, "bars")
    batch = weighted(events(spark, FOLDER)).filter("run_id % 10 = 1")
    middle = batch.agg(F.expr("cast(median(at_us) as long)")).first()[0]
    # A log comes in order: the earlier half is there before the later one.
    for part in (batch.filter(F.col("at_us") <= middle), batch.filter(F.col("at_us") > middle)):
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    tail = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = tail.writeStream.foreachBatch(stream.progress_sink(kept, EVENT_ORDER)).option("checkpointLocation", f"{kept}-c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert as_set(stream.read_progress(spark, kept)) == as_set(progress_tree(batch, EVENT_ORDER))


def test_expiry_by_timer(spark):
    path = scratch(spark, "expiry")
    minute = 60_000_000
    # Nothing at the epoch itself: a watermark starts there, and what it has reached is late.
    data = [(1, "running", minute), (1, "running", 11 * minute), (2, "paused", minute), (3, "running", 301 * minute)]
    df = spark.createDataFrame(data, "run_id long, phase string, at_us long").withColumn("at", F.timestamp_micros("at_us"))
    df.write.parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    got = stream.run_to_end(stream.stream_expiry(spark.readStream.schema(df.schema).parquet(path)), scratch(spark, "expired"))
    assert [(r["run_id"], r["expires_us"], r["events"]) for r in rows(got, "run_id")] == [(1, 26 * minute, 2), (2, 241 * minute, 1)]


def test_cohort_gaps_by_timer(spark):
    path = scratch(spark, "cohorts")
    second = 1_000_000
    data = [(1, "b", 10, 1, second), (1, "b", 13, 3, 2 * second), (2, "c", 20, 2, second), (2, "c", 21, 1, 6 * second), (9, "z", 90, 1, 60 * second)]
    df = spark.createDataFrame(data, "client long, batch_id string, run_id long, index long, at_us long").withColumn(
        "at", F.timestamp_micros("at_us"))
    df.write.parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    got = stream.run_to_end(stream.stream_cohort_gaps(spark.readStream.schema(df.schema).parquet(path)), scratch(spark, "gaps"))
    assert [(r["run_id"], r["index"], r["missing"]) for r in rows(got)] == [(13, 3, 1)]


def test_ledger_kept_by_batches(spark):
    path, log = scratch(spark, "ledger"), scratch(spark, "records")
    batch = ledger_records(spark, FOLDER)
    batch.repartition(3).write.parquet(log)
    tail = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(log)
    query = tail.writeStream.foreachBatch(stream.ledger_sink(path)).option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert as_set(stream.read_ledger(spark, path, EVENT_ORDER)) == as_set(ledger.ledger_upsert(batch, EVENT_ORDER))


def test_torn_lines_are_numbered(spark):
    path = scratch(spark, "torn")
    spark.createDataFrame([('{"a": 1}',), ("",), ('{"a": 2',), ('{"a": 3}',)], "value string").coalesce(1).write.text(path)
    got = rows(records.scan_jsonl_records(spark, path, "a long"), "_unreadable_line", "a")
    assert [(r["a"], r["_unreadable_line"], r["_raw"]) for r in got] == [(1, None, None), (3, None, None), (None, 3, '{"a": 2')]


def test_lines_are_numbered_over_blocks(spark):
    path = scratch(spark, "blocks")
    spark.range(5000).select(F.col("id").cast("string").alias("value")).coalesce(1).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = records.read_lines(spark, path)
        assert lines.filter(F.col("line") != F.col("value").cast("long") + 1).count() == 0
        assert lines.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_existing_records_are_never_overwritten(spark):
    path = scratch(spark, "once")
    df = spark.range(3)
    records.sink_append_only(df, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        records.sink_append_only(df, path)


def test_csvs_of_other_columns_are_refused(spark):
    path = scratch(spark, "mixed")
    spark.createDataFrame([(1, 2)], "a int, b int").coalesce(1).write.csv(path, header=True)
    spark.createDataFrame([(1, 2)], "a int, c int").coalesce(1).write.mode("append").csv(path, header=True)
    with pytest.raises(ValueError, match="different columns"):
        tables.union_csv_dir(spark, path)


def test_markdown_cells(spark):
    df = spark.createDataFrame([("a|b\nc", None)], "x string, y long")
    assert tables.markdown_lines(df).first().value == "| a\\|b c |  |"


def test_arguments_are_checked(spark):
    known = Transforms()

    @known.register("Take_Some", count=Argument(int), kind=Argument(str, False, ("a", "b"), "a"))
    def take(df, count, kind):
        return df.limit(count).withColumn("kind", F.lit(kind))

    assert [r["kind"] for r in rows(known.run("takesome", spark.range(9), count="2"))] == ["a", "a"]
    for given, message in (({}, "Missing"), ({"count": 1, "x": 2}, "Unexpected"), ({"count": "many"}, "must be"), ({"count": 1, "kind": "c"}, "not one of")):
        with pytest.raises(ArgumentError, match=message):
            known.run("Take_Some", spark.range(9), **given)
    with pytest.raises(ValueError, match="twice"):
        known.register("take some")(take)
    with pytest.raises(ArgumentError, match="not one of"):
        TRANSFORMS.run("History", spark.range(1), mode="other")


def test_a_transform_s_sum_may_exceed_a_long(spark):
    """Three open runs of 4e18 microseconds, and one that ended, under a name spelled otherwise."""
    runs = spark.createDataFrame([("t", -2 * 10 ** 18, None, None)] * 3 + [("u", 0, 5_000_000, "done")], "tool string, start_us long, end_us long, outcome string")
    got = rows(TRANSFORMS.run("tool-uptime", runs, now_us=str(2 * 10 ** 18)).select("tool", "runs", "running", "seconds"))
    assert [tuple(r.values()) for r in got] == [("t", 3, 3, 1.2e13), ("u", 1, 0, 5.0)]
