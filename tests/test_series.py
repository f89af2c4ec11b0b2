"""Marks of a counter and progress bars against following their rules row by row."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlens.functions.numbers import rounded_exactly
from runlens.operators.ordered import along, upcoming_min
from runlens.operators.progress import progress_tree
from runlens.operators.series import peak_rate


def highest(samples, least):
    """The rule read aloud: keep a mark, pass over what is too near, take what is at the mark's own instant."""
    (t0, k0), best = samples[0], 0.0
    for t, k in samples[1:]:
        if t - t0 >= least:
            best, t0, k0 = max(best, (k - k0) * 1e6 / (t - t0)), t, k
        elif t == t0:
            k0 = k
    return best


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marks_of_a_counter(spark):
    rng = random.Random(2)
    data, expected = [], {}
    for key, gaps in (("burst", [1, 2, 3]), ("pauses", [1, 5, 50]), ("ties", [0, 0, 4]), ("one", None), ("still", [0])):
        t, k, samples = 100, 0, []
        for n in range(1 if gaps is None else 300):
            t, k = t + (rng.choice(gaps) if gaps else 0), k + rng.randrange(-1, 9)
            samples.append((t, k))
            data.append((key, n, t, k))
        expected[key] = highest(samples, 10)
    df = spark.createDataFrame(data, "key string, n int, at_us long, ticks long").repartition(4)
    found = peak_rate(df, ["key"], ["at_us", "n"], 10)
    assert {r["key"]: r["peak_rate"] for r in rows(found)} == expected
    assert "Python" not in plan_of(found) and "InPandas" not in plan_of(found)


def test_marks_of_one_long_burst(spark, hot):
    samples = [(3 * n, n * n % 17) for n in range(400)]
    df = spark.createDataFrame([("x", n, t, k) for n, (t, k) in enumerate(samples)], "key string, n int, at_us long, ticks long")
    assert rows(peak_rate(df, ["key"], ["at_us", "n"], 10)) == [{"key": "x", "peak_rate": highest(samples, 10)}]


def test_least_value_from_here_on(spark, hot):
    data = [(n, (n * 37) % 101) for n in range(90)]
    df = spark.createDataFrame(data, "n int, v int").withColumn("g", F.lit(1))
    got = rows(along(df, ["g"], ["n"], here=upcoming_min(F.col("v")), after=upcoming_min(F.col("v"), False)), "n")
    assert [r["here"] for r in got] == [min(v for _, v in data[n:]) for n in range(90)]
    assert [r["after"] for r in got] == [min((v for _, v in data[n + 1:]), default=None) for n in range(90)]


def test_rounding_as_python_does(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(300)] + [0.44545, 0.36245, 0.00005, 0.12345, 1.00005, 0.5, 0.0, *[n / 20000 for n in range(0, 20000, 37)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r["got"] == round(r["v"], 4) for r in rows(df.select("v", rounded_exactly(F.col("v")).alias("got"))))


BAR = "run_id long, n long, server boolean, tool string, edge string, span_start double, span_end double, call string, depth long, fraction double"


def bars(spark, *events):
    """What the events of one run show; each is (tool, edge, span, call, depth, fraction)."""
    data = [(1, n, False, tool, edge, *(span or (None, None)), call, depth, fraction) for n, (tool, edge, span, call, depth, fraction) in enumerate(events)]
    return [(r["fraction"], r["own_fraction"], r["depth"]) for r in rows(progress_tree(spark.createDataFrame(data, BAR), ["n"]), "n")]


def test_a_leaf_moves_the_run(spark):
    got = bars(spark, ("A", "open", (0.2, 0.6), "1", 1, None), ("B", "open", (0.5, 1.0), "1.1", 2, None), (None, None, None, None, None, 0.6),
               ("B", "close", None, "1.1", 2, None), ("A", "close", None, "1", 1, None), (None, None, None, "", 0, 0.9))
    assert got == [(0.2, None, 1), (0.4, None, 2), (round(0.2 + 0.4 * (0.5 + 0.5 * 0.6), 4), 0.6, 2), (0.6, None, 2), (0.6, None, 1), (0.9, None, 0)]


def test_siblings_open_at_once_are_not_guessed(spark):
    got = bars(spark, ("A", "open", (0.0, 0.5), "1", 1, None), ("B", "open", (0.5, 1.0), "2", 1, None), (None, None, None, None, None, 0.7),
               (None, None, None, None, 1, 0.3), ("A", "close", None, "1", 1, None), (None, None, None, None, 1, 0.5))
    assert got[2] == (0.7, None, 0) and got[3] == (0.3, None, 1) and got[5] == (0.75, 0.5, 1)


def test_a_chain_without_spans_reads_as_written(spark):
    got = bars(spark, (None, None, None, None, 0, 0.1), ("A", "open", None, "1", None, None), (None, None, None, "1", 1, 0.9), (None, None, None, None, None, 0.95))
    assert got == [(0.1, None, 0), (None, None, 0), (0.9, None, 1), (0.95, None, 1)]


def test_the_farthest_of_many_calls_that_go_back(spark):
    """Calls side by side whose marks go up and down: at each line the run stands where the farthest of them stands now."""
    rng, calls = random.Random(8), [str(i) for i in range(1, 10)]
    spans = {c: sorted((round(rng.random(), 2), round(rng.random(), 2))) for c in calls}
    events = [("T", "open", tuple(spans[c]), c, 1, None) for c in calls]
    lines = [(rng.choice(calls), round(rng.random(), 3)) for _ in range(150)]
    got = bars(spark, *events, *[(None, None, None, c, 1, f) for c, f in lines])
    now = {c: 0.0 for c in calls}
    for (call, fraction), shown in zip(lines, got[len(calls):]):
        now[call] = fraction
        most = max(low + (high - low) * now[c] for c, (low, high) in spans.items())
        assert shown[0] == round(most, 4)


def test_progress_needs_no_python(spark):
    frame = spark.createDataFrame([(1, 1, False, None, None, None, None, "", 0, 0.5)], BAR)
    plan = plan_of(progress_tree(frame, ["n"]))
    assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("data", [[], [(1, 1, True, None, None, None, None, None, None, 0.5)], [(1, 1, None, "", None, None, None, None, None, None)]])
def test_progress_of_little(spark, data):
    got = rows(progress_tree(spark.createDataFrame(data, BAR), ["n"]))
    assert [(r["fraction"], r["own_fraction"], r["depth"]) for r in got] == [(d[9], None, 0) for d in data]
