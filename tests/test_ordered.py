"""Sliced groups must give what a plain window gives, whatever the skew and the partitioning."""

import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.operators.ordered import (along, following, order_statistics, prev, rank, running_last, running_max,
                                       running_sum, summary_of, top_per_group, upcoming_first, upcoming_rising, wide_medians)


def skewed(n=300, seed=3):
    """A third of the rows and more under one key, with null and repeated values."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", i, rng.choice([None, *range(12)])) for i in range(n)]


def expected(data):
    out = {}
    for key in {d[0] for d in data}:
        group = sorted((i, v) for k, i, v in data if k == key)
        total, top, last = None, None, None
        for at, (i, v) in enumerate(group):
            before = group[at - 1][1] if at else None
            after = group[at + 1][1] if at + 1 < len(group) else None
            ahead = next((x for _, x in group[at:] if x is not None), None)
            if v is not None:
                total, top, last = (total or 0) + v, max(v, -1 if top is None else top), v
            out[(key, i)] = (at + 1, before, after, total, top, last, ahead)
    return out


def computed(spark, data, parts):
    df = spark.createDataFrame(data, "k string, i long, v long").repartition(parts)
    v = F.col("v")
    got = along(df, ["k"], ["i"], r=rank(), p=prev(v), f=following(v), s=running_sum(v), m=running_max(v),
                l=running_last(v), a=upcoming_first(v))
    return {(x.k, x.i): (x.r, x.p, x.f, x.s, x.m, x.l, x.a) for x in got.collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_plain_windows(spark, parts):
    data = skewed()
    assert computed(spark, data, parts) == expected(data)


@pytest.mark.parametrize("parts", [1, 7])
def test_sliced_windows(spark, hot, parts):
    data = skewed()
    assert computed(spark, data, parts) == expected(data)


def test_whole_table_order(spark, hot):
    df = spark.range(100).withColumn("v", F.lit(1))
    got = along(df, [], ["id"], n=rank(), s=running_sum(F.col("v"), inclusive=False))
    assert [(r.n, r.s) for r in got.orderBy("id").collect()] == [(i + 1, i or None) for i in range(100)]


@pytest.mark.parametrize("first", [lambda i: None, lambda i: i % 3 or None, lambda i: f"k{i % 7}", lambda i: float(i) if i % 9 else None])
def test_whole_table_order_of_any_first_value(spark, hot, first):
    """Cuts that share their first value, or have none, are told apart by the rest of the position."""
    kind = "string" if isinstance(first(1), str) else "double" if isinstance(first(1), float) else "long"
    data = [(first(i), i) for i in range(200)]
    got = along(spark.createDataFrame(data, f"a {kind}, i long").repartition(4), [], ["a", "i"], n=rank(), up=upcoming_rising("CASE WHEN i % 5 = 0 THEN a END"))
    ordered = sorted(data, key=lambda d: (d[0] is not None, d[0] if d[0] is not None else 0, d[1]))
    ahead = [next((a for a, i in ordered[at + 1:] if i % 5 == 0 and a is not None), None) for at in range(200)]
    assert {r.i: (r.n, r.up) for r in got.collect()} == {i: (at + 1, ahead[at]) for at, (a, i) in enumerate(ordered)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=120))
def test_summary_on_any_values(spark, hot, values):
    df = spark.createDataFrame([("g", float(v)) for v in values], "k string, v double")
    got = summary_of(df, ["k"], "v").collect()[0]
    n, ordered = len(values), sorted(values)
    place = max(0, min(n - 1, int(round(0.95 * n + 0.5)) - 1))
    assert (got.n, got.median, got.min, got.max, got.p95) == (
        n, statistics.median(values), ordered[0], ordered[-1], ordered[place])


def test_p95_is_an_observation(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double").withColumn("k", F.lit(1))
    got = summary_of(df, ["k"], "v").collect()[0]
    assert (got.median, got.p95) == (2.5, 10.0)


def test_ranks_agree_hot_and_cold(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    third = {"r": lambda n: F.floor(n / 3) + 1}
    cold = {r.k: r.r for r in order_statistics(df, ["k"], "v", **third).collect()}
    spark.conf.set("runlens.hotRows", "20")
    try:
        hot_ranks = {r.k: r.r for r in order_statistics(df, ["k"], "v", **third).collect()}
        wide = {r.k: (r.a, r.b) for r in wide_medians(df, ["k"], {"a": F.col("v"), "b": -F.col("v")}).collect()}
    finally:
        spark.conf.unset("runlens.hotRows")
    assert cold == hot_ranks
    assert wide == {r.k: (r.a, r.b) for r in wide_medians(df, ["k"], {"a": F.col("v"), "b": -F.col("v")}).collect()}


def test_null_keys_are_a_group(spark, hot):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(5)], "k string, i long")
    got = along(df, ["k"], ["i"], n=rank())
    assert sorted((r.k or "", r.n) for r in got.collect()) == sorted(
        [("", i + 1) for i in range(50)] + [("a", i + 1) for i in range(5)])


def test_top_keeps_only_the_first_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    top = top_per_group(df, ["k"], [F.col("id").desc()], 4)
    assert top.count() == 12
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
