"""Worked expectations for the report, event and ledger operators."""

import hashlib
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlens.functions import args as fa
from runlens.operators import artifacts, benchmark, catalogue, events, ledger, series
from runlens.operators.ordered import top_per_group
from runlens.sources import files, tables

RECORD = ("n long, tool string, path string, status string, warmup boolean, total_seconds double, error_message string, "
          "concurrency long, window_seconds double, peak_mib map<string,long>, baseline_mib map<string,long>")


def record(n, seconds, status="ok", warmup=False, error=None):
    return (n, "T", "local", status, warmup, seconds, error, 1, 60.0, {"0": 5, "1": 9}, {"0": 1})


def test_warmup_counted_and_left_out(spark):
    df = spark.createDataFrame([record(1, 100.0, warmup=True), record(2, 2.0), record(3, 4.0)], RECORD)
    row = rows(benchmark.latency_table(df, ["n"]))[0]
    assert (row["runs"], row["warmup_discarded"], row["n"], row["median_s"], row["max_s"]) == (3, 1, 2, 3.0, 4.0)


def test_group_without_success_keeps_its_row(spark):
    df = spark.createDataFrame([record(2, 1.0, "failed", error="b"), record(1, 1.0, "failed", error="a" * 200)], RECORD)
    row = rows(benchmark.latency_table(df, ["n"]))[0]
    assert (row["n"], row["median_s"], row["failed"], row["first_error"]) == (0, None, 2, "a" * 160)


def test_concurrency_tail(spark):
    df = spark.createDataFrame([record(i, float(v)) for i, v in enumerate((1, 2, 3, 10))], RECORD)
    row = rows(benchmark.concurrency_table(df, ["n"]))[0]
    assert (row["p50_s"], row["p95_s"], row["peak_vram_mib"], row["throughput_jobs_per_min"]) == (2.5, 10.0, 9, 4.0)


def test_queue_ranked_by_total(spark):
    waits = [("often", 4_000_000)] * 10 + [("once", 30_000_000), ("once", 10_000)]
    got = rows(ledger.queue_ranking(spark.createDataFrame(waits, "tool string, waited_us long")))
    assert [r["tool"] for r in got] == ["often", "once"]
    assert (got[1]["queued"], got[1]["total_wait"], got[0]["mean_wait"]) == (1, 30.01, 4.0)


def test_uptime_may_exceed_a_long(spark):
    """Sums of open and of ended runs; the mean is of the whole sum, and a tool without a name is counted like another."""
    runs = [("t", -2 * 10 ** 18, None, None)] * 3 + [(None, -4 * 10 ** 18, 4 * 10 ** 18, "done")] * 2 + [("u", 0, 5_000_000, "failed")]
    got = rows(ledger.tool_uptime(spark.createDataFrame(runs, "tool string, start_us long, end_us long, outcome string"), 2 * 10 ** 18))
    assert [(r["tool"], r["runs"], r["seconds"], r["longest"], r["mean"]) for r in got] == [
        ("(unnamed)", 2, 1.6e13, 8e12, 8e12), ("t", 3, 1.2e13, 4e12, 4e12), ("u", 1, 5.0, 5.0, 5.0)]


def test_pause_is_not_work(spark):
    runs = spark.createDataFrame([(1, 0, 100_000_000), (2, 0, None)], "run_id long, start_us long, end_us long")
    spans = spark.createDataFrame([(1, "paused", 10_000_000, 40_000_000), (1, "paused", 50_000_000, None), (1, "running", 0, 9_000_000)],
                                  "run_id long, phase string, start_us long, end_us long")
    assert rows(ledger.paused_split(runs, spans)) == [{"run_id": 1, "seconds": 70.0, "paused_seconds": 30.0}]


def test_history_is_bounded_to_the_newest(spark):
    runs = spark.range(100).select(F.col("id").alias("run_id"), F.col("id").alias("end_us"))
    assert [r["run_id"] for r in rows(ledger.history_compact(runs, 10, 3), "run_id")] == list(range(90, 100))
    assert ledger.history_compact(runs, 40, 3).count() == 100


EVENT = ("run_id long, n long, at_us long, phase string, depth long, tool string, is_log boolean, fraction double, message string, "
         "level string, audience string, server boolean, measured long")


def event(n, phase="running", depth=0, tool=None, log=False, level=None):
    return (1, n, n * 10, phase, depth, tool, log, None, f"m{n}", level, None, False, None)


def test_terminal_closes_and_is_no_span(spark):
    df = spark.createDataFrame([event(1, "received"), event(2, "running"), event(3, "running"), event(4, "done"), event(5, "running")], EVENT)
    got = rows(events.phase_spans(df, ["n"]), "number")
    assert [(r["phase"], r["start_us"], r["end_us"]) for r in got] == [("received", 10, 20), ("running", 20, 40), ("running", 50, None)]


def test_markers_pair_and_the_last_stays_open(spark):
    df = spark.createDataFrame([event(1, depth=1, tool="A"), event(2, depth=2, tool="B"), event(3, depth=2, tool="B"),
                                event(4, depth=2, tool="C")], EVENT)
    got = rows(events.nested_calls(df, ["n"]), "number")
    assert [(r["tool"], r["start_us"], r["end_us"]) for r in got] == [("A", 10, None), ("B", 20, 30), ("C", 40, None)]
    assert rows(events.open_chain(df, ["n"])) == [{"run_id": 1, "chain": "A>C"}]


def test_cap_marks_once_and_lets_the_end_through(spark, hot):
    df = spark.createDataFrame([event(n) for n in range(1, 40)] + [event(40, "done")], EVENT)
    got = rows(events.cap_events(df, ["n"], 25), "n")
    assert [r["n"] for r in got] == [*range(1, 27), 40]
    assert [r["n"] for r in got if r["truncated"]] == [26]


def test_logs_kept_by_class(spark):
    lines = [event(n, log=True, level="info") for n in range(1, 6)] + [event(6, log=True, level="error"), event(7, log=True, level="debug")]
    got = rows(events.notable_logs(spark.createDataFrame(lines, EVENT), ["n"], 2), "n")
    assert [r["n"] for r in got] == [4, 5, 6]


def test_ends_before_starts(spark):
    spans = spark.createDataFrame([("running", 0, 10), ("running", 10, 20), ("running", 15, 30)], "phase string, start_us long, end_us long")
    got = rows(series.concurrency_curve(spans), "at_us", "kind")
    assert [(r["at_us"], r["open"]) for r in got] == [(0, 1), (10, 0), (10, 1), (15, 2), (20, 1), (30, 0)]
    assert got[0]["peak"] == 2


@pytest.mark.parametrize("data, solo", [
    ([(1, 0, 10, 0), (2, 10, 20, 0)], {1: True, 2: True}), ([(1, 0, 10, 0), (2, 5, 20, 0)], {1: False, 2: False}),
    ([(1, 0, 30, 0), (2, 5, 10, 1)], {1: False, 2: True}), ([(1, 0, None, 0), (2, 50, 60, 0)], {1: False, 2: False})])
def test_solo(spark, data, solo):
    df = spark.createDataFrame(data, "run_id long, start_us long, end_us long, depth long")
    assert {r["run_id"]: r["solo"] for r in rows(ledger.solo_runs(df, ["run_id"]))} == solo


def solo_by_hand(data):
    """Every run's answer from one pass over all starts and ends in order, a missing start first."""
    place = lambda r: ((r[1] is not None, r[1] or 0), 1, r[0])
    events = sorted([(place(r), 1, r) for r in data] + [(((True, r[2]), -1, r[0]), -1, r) for r in data if r[2] is not None], key=lambda e: e[0])
    found, live = {}, 0
    for at, (_, delta, r) in enumerate(events):
        if delta == 1:
            after = next((x[1] for _, d, x in events[at + 1:] if d == 1 and x[1] is not None), None)
            found[r[0]] = live == r[3] and (after is None or (r[2] is not None and after >= r[2]))
        live += delta
    return found


@pytest.mark.parametrize("instants", [2, 30, 100_000])
def test_solo_in_slices(spark, hot, instants):
    """Many runs, few or many instants, in slices; some runs are open, of no length or without a start."""
    rng = random.Random(instants)
    data = [(i, rng.choice([None, 0]) if i % 40 == 0 else rng.randrange(instants), None, rng.randrange(3)) for i in range(400)]
    data = [(i, s, None if s is None or i % 50 == 1 else s + rng.choice([0, 1, 1, 5]), d) for i, s, _, d in data]
    df = spark.createDataFrame(data, "run_id long, start_us long, end_us long, depth long").repartition(5)
    got = ledger.solo_runs(df, ["run_id"])
    assert got.columns == ["run_id", "start_us", "end_us", "depth", "solo"]
    got = rows(got)
    assert {r["run_id"]: r["solo"] for r in got} == solo_by_hand(data)
    assert sorted((r["run_id"], r["start_us"], r["end_us"], r["depth"]) for r in got) == data


@pytest.mark.parametrize("limit", ["3", "1000"])
def test_solo_of_repeated_runs(spark, limit):
    """One of the runs that come twice sees what comes next, and as many before it as if it were the first."""
    df = spark.createDataFrame([(1, 0, 5, 0)] * 2 + [(2, 10, 12, 1)] * 3 + [(3, 20, 21, 0)], "run_id long, start_us long, end_us long, depth long")
    spark.conf.set("runlens.hotRows", limit)
    try:
        got = sorted((r["run_id"], r["solo"]) for r in rows(ledger.solo_runs(df, ["run_id"])))
    finally:
        spark.conf.unset("runlens.hotRows")
    assert got == [(1, False), (1, True), (2, False), (2, False), (2, False), (3, True)]


def test_no_task_gets_all_runs(spark, hot):
    """Starts and ends are dealt by slice, once, and sorted once; no key is the same for all of them."""
    df = spark.createDataFrame([(i, i, i + 3, 0) for i in range(300)], "run_id long, start_us long, end_us long, depth long")
    plan = ledger.solo_runs(df, ["run_id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(coalesce(_all" not in plan
    assert plan.count("Exchange hashpartitioning(_slice") == 1 and plan.count("Sort [_slice") == 1


def test_nearest_has_a_reach(spark):
    samples = spark.createDataFrame([(1, 0, 1, 1.0), (1, 2_000_000, 2, 2.0), (1, 60_000_000, 3, 3.0)], "k long, at_us long, id long, value double")
    asked = spark.createDataFrame([(1, 1_000_000, 1), (1, 3_000_000, 2), (1, 200_000_000, 3), (2, 5, 4)], "k long, at_us long, id long")
    got = {r["id"]: r["value"] for r in rows(series.asof_nearest(asked, samples, ["k"], "value"))}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: None}
    last = {r["id"]: r["value"] for r in rows(series.asof_last(asked, samples, ["k"], "value"))}
    assert last == {1: 1.0, 2: 2.0, 3: 3.0, 4: None}


def test_points_inside_a_call_come_before_it(spark):
    tools = spark.createDataFrame([("A",), ("B",), ("C",)], "tool string")
    calls = spark.createDataFrame([("A", 1, "B", True), ("A", 2, "view", False), ("B", 1, "C", True), ("C", 1, "A", True), ("C", 2, "gone", True)],
                                  "caller string, pos int, callee string, is_call boolean")
    got = rows(catalogue.stop_points(tools, calls).filter("tool = 'A'"), "position")
    assert [r["point"] for r in got] == ["B/C/A", "B/C/gone", "B/C", "B", "view"]


def test_a_chain_of_calls_may_be_long(spark):
    n = 130
    tools = spark.createDataFrame([(f"t{i}",) for i in range(n)], "tool string")
    calls = spark.createDataFrame([(f"t{i}", 1, f"t{i + 1}", True) for i in range(n)], "caller string, pos int, callee string, is_call boolean")
    got = rows(catalogue.stop_points(tools, calls).filter("tool = 't0'"), "position")
    assert [r["point"] for r in got] == ["/".join(f"t{i}" for i in range(1, k + 1)) for k in range(n, 0, -1)]


TREE = {"empty": b"", "_x": b"1", ".x": b"22", "a/_SUCCESS": b"", "a/.hidden/deep/er": b"333", "a/b c%20é#.bin": b"4444", "_temporary/0/part": b"5"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, content in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (root / "bare" / "folder").mkdir(parents=True)
    (root / "gone").symlink_to(root / "nowhere")
    (root / "a" / "up").symlink_to(root)
    return root


@pytest.mark.parametrize("form", ["{}", "{}/", "file:{}", "file://{}", "file://{}/"])
def test_every_file_of_a_tree(spark, tree, form):
    """Empty and hidden files, links that lead nowhere, none twice by a link to a folder; by relative name whatever the root is written like."""
    root = form.format(tree)
    sizes = {r["name"]: r["size"] for r in rows(files.list_files(spark, root))}
    assert sizes == {n: len(c) for n, c in TREE.items()} | {"gone": None}
    found = {r["name"]: (r["sha256"], r["size"]) for r in rows(files.file_inventory(spark, root))}
    assert found == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in TREE.items()} | {"gone": (None, None)}


def test_roots_that_are_no_folder(spark, tree):
    assert [(r["name"], r["size"]) for r in rows(files.file_inventory(spark, f"{tree}/.x"))] == [(".x", 2)]
    assert rows(files.file_inventory(spark, f"{tree}/none")) == [] and rows(files.list_files(spark, f"{tree}/bare")) == []


def test_a_wide_tree_is_walked_in_tasks(spark, tmp_path):
    names = {f"{i % 100}/{i % 7}/{i}.txt" for i in range(700)} | {f"f{i}" for i in range(150)}
    for name in names:
        (tmp_path / "wide" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "wide" / name).touch()
    found = files.list_files(spark, f"{tmp_path}/wide")
    assert sorted(r["name"] for r in rows(found)) == sorted(names)
    assert found.rdd.getNumPartitions() >= files.FOLDERS


def test_entries_of_a_dataset_tree(spark, tmp_path):
    for name, content in {"A/models/x": b"12", "A/models/_y/p/q": b"3", "A/models/_y/r": b"", "A/models/.z": b"4", "A/models/skip": b"5", "B/testfiles/empty": b"", "loose": b"6"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = rows(files.dataset_listing(spark, f"file:{tmp_path}", ["skip"]), "tool", "entry")
    assert [tuple(r.values()) for r in got] == [("A", "models", "_y", "folder", 1), ("A", "models", "x", "file", 2), ("B", "testfiles", "empty", "file", 0)]


def test_files_of_any_length_have_a_hash(spark, tmp_path):
    contents = {"left/a b%20.bin": b"x" * 3_000_000, "right/a b%20.bin": b"x" * 2_999_999 + b"y", "left/d/é#.bin": b"z" * 2000,
                "right/d/é#.bin": b"z" * 2000, "left/short": b"s", "right/short": b"t"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    sides = {side: files.file_inventory(spark, f"{tmp_path}/{side}") for side in ("left", "right")}
    for side, found in sides.items():
        expected = {(n.partition("/")[2], hashlib.sha256(c).hexdigest(), len(c)) for n, c in contents.items() if n.startswith(side)}
        assert {(r["name"], r["sha256"], r["size"]) for r in rows(found)} == expected
    status = {r["name"]: r["status"] for r in rows(artifacts.compare_artifacts(sides["left"], sides["right"]))}
    assert status == {"a b%20.bin": "differing", "d/é#.bin": "identical", "short": "differing"}
    assert files.Tree(str(tmp_path)).sha256("none") is None


def test_parameters_that_differ(spark, monkeypatch):
    params = spark.createDataFrame([("a", "same", "1"), ("b", "same", "1"), ("c", "same", "1"), ("a", "some", "1"), ("b", "some", None), ("a", "usual", "default"),
                                    ("b", "none", None), ("a", "two", "1"), ("b", "two", "2"), ("c", "two", "2")], "config string, param string, value string")
    assert [tuple(r.values()) for r in rows(benchmark.config_diff(params), "param")] == [("some", "a=1;b=default;c=default"), ("two", "a=1;b=2;c=2")]
    monkeypatch.setattr(benchmark, "MOST_CONFIGS", 2)
    with pytest.raises(ValueError, match="at most 2 configurations"):
        benchmark.config_diff(params)


def test_the_listing_has_the_run_s_record(spark):
    from runlens.plans.bindings import EVENT_ORDER, events as event_log
    log = event_log(spark, "/root/testdata/sf0.001").filter("run_id < 6")
    records = spark.createDataFrame([(1, "T", "c", "b", 7), (2, "U", None, None, 0)], "run_id long, tool string, client string, batch_id string, start_us long")
    got = events.live_listing(log, EVENT_ORDER, records=records).collect()
    assert [r.started_us for r in got] == sorted((r.started_us for r in got), reverse=True) and got[-1].run_id == 1 and got[-1].started_us == 7
    assert {(r.run_id, r.tool, r.client, r.batch_id) for r in got if r.run_id in (1, 2)} <= {(1, "T", "c", "b"), (2, "U", None, None)}
    assert all(r.chain is not None for r in got) and all(r.tool is None for r in got if r.run_id not in (1, 2))


def test_json_paths(spark):
    def side(text):
        return spark.createDataFrame([("x", text)], "name string, content string")

    left, right = '{"a": {"b": 1, "c": [1, {"d": 2}]}, "l": [1], "same": 1}', '{"a": {"b": 2, "c": [1, {"d": 3}]}, "l": [1, 2], "same": 1, "new": {"x": 1}}'
    got = rows(artifacts.json_key_diff(side(left), side(right)), "path")
    assert [r["path"] for r in got] == ["a.b", "a.c[1].d", "l[length]", "new"]
    assert rows(artifacts.json_key_diff(side("{"), side("{}"))) == [{"name": "x", "readable": False, "path": None}]
    assert rows(artifacts.json_key_diff(side("[1]"), side('{"a": 1}')))[0]["path"] == "<root>"


def test_fingerprint_does_not_depend_on_order(spark):
    files = [("t", f"a{i}.py", f"text {i}") for i in range(30)]
    schema = "tree string, path string, content string"
    one = artifacts.tree_fingerprint(spark.createDataFrame(files, schema).repartition(5)).first().digest
    two = artifacts.tree_fingerprint(spark.createDataFrame([*reversed(files), ("t", "x/__pycache__/a.pyc", "?")], schema)).first().digest
    other = artifacts.tree_fingerprint(spark.createDataFrame([*files[1:], ("t", "b0.py", "text 0")], schema)).first().digest
    assert one == two != other


def test_fingerprint_by_its_rule(spark, tmp_path):
    """The digest over path, zero byte, bytes, zero byte of files in the order of pathlib, as it is defined."""
    contents = {"pkg/__init__.py": b"def run():\n    pass\n", "pkg/b.py": b"X = 1\n", "pkg.py": b"# top\n", "pkg/a/é.py": b"\xff\x00", "a-b/x": b"", "a/x": b"1",
                "a.pyc": b"?", "pkg/__pycache__/b.py": b"?", ".pyc": b"kept", "z/.pyo": b"kept too", "x.pyo": b"?"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    expected = hashlib.sha256()
    for path in sorted(p for p in tmp_path.rglob("*") if p.is_file()):
        if "__pycache__" not in path.parts and path.suffix not in (".pyc", ".pyo"):
            expected.update(path.relative_to(tmp_path).as_posix().encode() + b"\0" + path.read_bytes() + b"\0")
    df = spark.createDataFrame([("t", n, c) for n, c in contents.items()] + [("u", "only", None), (None, "p", b"q")], "tree string, path string, content binary")
    got = {r["tree"]: (r["files"], r["digest"]) for r in rows(artifacts.tree_fingerprint(df.repartition(3)))}
    assert got["t"] == (8, expected.hexdigest())
    assert got["u"] == (1, hashlib.sha256(b"only\0\0").hexdigest()) and got[None] == (1, hashlib.sha256(b"p\0q\0").hexdigest())


def test_headers_are_read_alone(spark, tmp_path):
    """Files that agree are joined; of each only the beginning is read, and one that does not agree is named."""
    head = ",".join(f"column_{i}" for i in range(800))
    for n in range(3):
        (tmp_path / f"f{n}.csv").write_bytes((head + "\r\n" + ",".join(["1"] * 800) + "\r\n").encode())
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "other.csv").write_text("x\n1\n")
    (tmp_path / "empty.csv").touch()
    assert files.Tree(str(tmp_path)).first_line("f0.csv") == head.encode()
    assert tables.union_csv_dir(spark, f"file:{tmp_path}").count() == 3
    (tmp_path / "G.CSV").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="f0.csv has different columns from G.CSV"):
        tables.union_csv_dir(spark, str(tmp_path))
    with pytest.raises(ValueError, match="No .csv file"):
        tables.union_csv_dir(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("text, value", [(" a, ,b ", ["a", "b"]), ('["x", "y,z"]', ["x", "y,z"]), ("[broken", None), ("", [])])
def test_lists(spark, text, value):
    assert spark.range(1).select(fa.parse_list(F.lit(text)).alias("v")).first().v == value


@pytest.mark.parametrize("text, good", [("0.2, 1.0", True), ("(0.2, 0.9)", True), ("0.2", False), ("0.2,x", False), ("1.4, 1", False)])
def test_vec2(spark, text, good):
    row = spark.range(1).select(fa.parse_vec2(F.lit(text), (0.0, 1.0), (1.5, 0.5)).alias("v")).first().v
    assert (row.error is None) == good


def test_the_copy_met_first_on_a_walk_stays(spark):
    """Files of a folder come before its folders, whatever their names."""
    files = spark.createDataFrame([("a/b/x", 9, "h"), ("a/z", 9, "h"), ("c", 9, "h"), ("a/y", 1, "h")], "path string, size long, sha256 string")
    got = rows(artifacts.exact_dedup(files, 5), "path")
    assert got == [{"path": "a/b/x", "keeper": "c", "freed": 9}, {"path": "a/z", "keeper": "c", "freed": 9}]
    assert rows(artifacts.exact_dedup(files.filter("path <> 'c'"), 5), "path") == [{"path": "a/b/x", "keeper": "a/z", "freed": 9}]


def test_long_gaps_are_opened_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ledger, "GAP_BLOCK", 7)
    received = spark.createDataFrame([("u", 3), ("u", 40)], "upload string, part long")
    expected = spark.createDataFrame([("u", 100), ("v", 2)], "upload string, parts long")
    got = sorted((r.upload, r.missing) for r in ledger.sequence_gaps(received, expected, ["upload"]).collect())
    assert got == [("u", n) for n in range(100) if n not in (3, 40)] + [("v", 0), ("v", 1)]


def test_many_rows_per_group_are_kept(spark):
    df = spark.range(3000).withColumn("g", F.lit(1))
    assert top_per_group(df, ["g"], [F.col("id")], 1500).count() == 1500


def test_a_json_document_is_compared_at_every_depth(spark):
    deep = lambda x: '{"a": [{"b": {"c": [1, {"d": %s}]}}], "n": 1.0}' % x
    side = lambda text: spark.createDataFrame([("x", text)], "name string, content string")
    assert [r["path"] for r in rows(artifacts.json_key_diff(side(deep("1")), side(deep('"1"'))))] == ["a[0].b.c[1].d"]
    assert rows(artifacts.json_key_diff(side(deep("1")), side(deep("1.0")))) == []
