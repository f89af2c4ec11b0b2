"""Exact dedup, suffix dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import runlens.llm.common as common
import runlens.llm.jaccard as jaccard
import runlens.llm.suffix_dedup as suffix
from runlens.llm.common import FREED, KEY, documents, in_buckets, shuffles_freed, written
from runlens.llm.exact_dedup import DedupIndex, exact_dedup, without_copies
from runlens.llm.induced import suffix_order
from runlens.llm.jaccard import Likeness, near_copies, one_of_each
from runlens.llm.planes import unpacked
from runlens.llm.suffix_dedup import suffix_dedup
from tests.llm.conftest import rows_of

SMALL = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_groups(odd):
    got = [r.asDict() for r in exact_dedup(odd).collect()]
    rows = [(r.doc_id, lowered(r.text)) for r in odd.collect()]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(text.encode()).hexdigest()].append(doc_id)
    assert len(got) == len(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(dict.fromkeys(groups, 1))
    for r in got:
        ids = groups[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
        assert not r["kept"] or r["doc_id"] == best


def test_exact_with_colliding_digests(docs):
    df = docs([(i, f"Text {i % 7}") for i in range(40)])
    weak = exact_dedup(df, digest=lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1).cast("binary"))
    assert rows_of(weak) == rows_of(exact_dedup(df))


def test_exact_state_goes_on(spark, docs, tmp_path):
    index = DedupIndex(spark, str(tmp_path / "index"))
    arrivals = lambda ids: docs([(i, "x") for i in ids]).select(
        F.unhex(F.sha2("text", 256)).alias("digest"), "doc_id", F.col("doc_id").alias("locator"))
    index.ingest(arrivals([1, 5]))
    index.ingest(arrivals([3]))
    assert [(r.n, r.keeper.doc_id) for r in index.records().collect()] == [(3, 5)]


def test_exact_without_copies_keeps_columns(odd, docs):
    left = without_copies(odd)
    assert left.columns == odd.columns
    assert left.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_dedup(docs([])).count() == 0


def removed_by_force(texts, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} by looking at every window in turn."""
    seen, out = set(), {}
    for doc_id, text in sorted(texts.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("common", [2, 5000])
def test_suffix_windows(docs, monkeypatch, common):
    monkeypatch.setattr(suffix, "POSTINGS_PER_SLICE", 50)
    monkeypatch.setattr(suffix, "BYTES_PER_SHARD", 4000)
    rng = random.Random(1)
    passage = "".join(rng.choice("abcde ") for _ in range(300))
    texts = {i: "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 900))) for i in range(40)}
    for i in range(0, 40, 3):
        at = rng.randrange(0, len(texts[i]) + 1)
        texts[i] = texts[i][:at] + passage[rng.randrange(0, 150) :] + texts[i][at:]
    texts |= {40: "ab" * 400, 41: texts[3], 42: None, 43: "", 44: "z" * 99, 45: "z" * 100, 46: "z" * 350}
    got = {r[0]: tuple(r[1:]) for r in rows_of(suffix_dedup(docs(list(texts.items())), common=common), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert got == removed_by_force(texts)


def test_suffix_odd_rows(odd, docs):
    got = rows_of(suffix_dedup(odd), "doc_id", "n_bytes", "n_removed")
    assert len(got) == odd.count()
    # The long text of row 7 comes three times: once only its own repeats go, twice all of it.
    assert sorted(r[2] for r in got if r[0] == 7 and r[1] == 2000) == [1995, 2000, 2000]
    assert suffix_dedup(docs([])).count() == 0


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in (blocks.apply(i).name() for i in range(blocks.size())) if name.startswith("shuffle_")}


def test_suffix_shuffles_texts_once_and_frees_the_files(docs, spark, monkeypatch):
    seen = {}

    def noted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen[name] = spark.conf.get(FREED, "false"), plan.count("Exchange hashpartitioning(__row_key")
        return written(df, name)

    monkeypatch.setattr(suffix, "written", noted)
    setting, tables = spark.conf.get(FREED, None), spark.catalog.listTables()
    assert suffix_dedup(docs([(i, f"{i % 7} " * 200) for i in range(50)])).where("n_removed > 0").count() == 50
    # What was found is dealt by row; the texts lie that way already.
    assert seen["changed"] == ("true", 1)
    assert spark.conf.get(FREED, None) == setting and spark.catalog.listTables() == tables


def test_shuffles_are_freed_when_a_write_ends(spark):
    before = shuffle_files(spark)
    with shuffles_freed(spark):
        kept = written(spark.range(1000).repartition(3, "id"), "freed")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and kept.count() == 1000


def test_buckets_are_joined_where_they_lie(docs, spark):
    with in_buckets(docs([(i, "x" * i) for i in range(50)]), "some", "doc_id") as stored:
        joined = stored.join(spark.range(40).withColumnRenamed("id", "doc_id").hint("merge"), "doc_id")
        assert joined.count() == 40
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_suffix_windows_of_common_anchors_are_hashed_together(monkeypatch):
    class Frame:
        def mapInPandas(self, work, schema):
            return work

    calls, hashes = [], suffix.window_hashes
    monkeypatch.setattr(suffix, "window_hashes", lambda data, count, length: (calls.append(count), hashes(data, count, length))[1])
    texts = [f"{i:03d} " + "x" * 40 + f" {i % 3} " + "y" * 80 for i in range(50)]
    runs = [[np.array([2, 9]), np.array([3, 4]), np.array([7, 8]), np.array([True, True])] for _ in texts]
    batch = pd.DataFrame([(i, text, *r) for i, (text, r) in enumerate(zip(texts, runs))], columns=[KEY, "text", *suffix.RUNS])
    out = pd.concat(list(suffix.pieces(Frame(), 100, 1)(iter([batch]))))
    assert len(calls) == 1
    first, again = {}, []
    for i, text in enumerate(texts):
        for at in (2, 3, 4, 9, 10, 11, 12):
            if first.setdefault(text[at : at + 100], (i, at)) != (i, at):
                again.append((i, at))
    known = out[out["bytes"].map(len) == 0]
    found = zip(np.concatenate([unpacked(b, 8) for b in known["keys"]]).tolist(), np.concatenate([unpacked(b, 5) for b in known["starts"]]).tolist())
    assert sorted(found) == sorted(again)
    content = b"".join(out["bytes"])
    assert {content[i : i + 100].decode() for i in range(0, len(content), 100)} == set(first)
    # A window's name depends on its bytes only.
    one = out[out["bytes"].map(len) > 0].iloc[0]
    starts = np.frombuffer(one["bytes"], dtype=np.uint8)
    assert unpacked(one["anchors"], 8).tolist() == [int(hashes(starts[i : i + 100], 1, 100)[0]) for i in range(0, len(starts), 100)]


def test_suffix_order_of_bytes_of_any_value_and_long_repeats(monkeypatch):
    rng, sorted_ = np.random.default_rng(3), []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda values, *a, **k: (sorted_.append(len(values)) if values.dtype == np.int64 else None, argsort(values, *a, **k))[1])
    for round_ in range(60):
        base = rng.integers(0, [2, 3, 256][round_ % 3], 400).astype(np.uint8)
        data = np.concatenate([base, base[: rng.integers(0, 300)], np.zeros(rng.integers(0, 250), np.uint8), base[rng.integers(0, 200) :]])
        order = suffix_order(data, 100)
        content = data.tobytes()
        assert sorted(order.tolist()) == list(range(len(content)))
        windows = [content[i : i + 100] for i in order.tolist()]
        assert windows == sorted(windows)
    # What is told apart is not sorted again.
    sorted_.clear()
    suffix_order(rng.integers(0, 256, 200_000).astype(np.uint8), 100)
    assert sum(sorted_) < 20_000


def test_suffix_order_with_queues_on_disk():
    rng = np.random.default_rng(0)
    for _ in range(60):
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 80))).astype(np.uint8)
        order = suffix_order(data, 100, memory=int(rng.integers(0, 200)))
        text = data.tobytes()
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))


def components_by_force(texts, n, percent):
    sets, parent = {}, {i: i for i in texts}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets[i] = set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} if words else set()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[i]), root(i)) for i in texts), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, monkeypatch, n, percent):
    for name in ("POSTINGS_PER_BLOB", "POSTINGS_PER_SLICE"):
        monkeypatch.setattr(jaccard, name, 300)
    rng = random.Random(2)
    texts = {}
    for group in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 30, 80]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
            texts[len(texts)] = " ".join(words)
    texts |= {90: None, 91: "", 92: "two Words", 93: "two words", 94: "two  words\n", 95: "one", 96: "word " * 50}
    assert rows_of(near_copies(docs(list(texts.items())), Likeness(n, percent)), "doc_id", "n_shingles", "component_id") == components_by_force(texts, n, percent)


def test_jaccard_odd_rows(odd, docs):
    found = near_copies(odd)
    assert found.count() == odd.count()
    assert found.where("doc_id = 7 and n_shingles = 1").select("component_id").distinct().count() == 1
    left = one_of_each(odd)
    assert left.columns == odd.columns
    assert left.where("doc_id = 7").count() == 2  # of the repeated row one; the other text of that id stays
    assert near_copies(docs([])).count() == 0


def test_jaccard_on_the_small_table(spark):
    table = documents(spark, SMALL)
    texts = {r.doc_id: r.text for r in table.collect()}
    assert rows_of(near_copies(table), "doc_id", "n_shingles", "component_id") == components_by_force(texts, 3, 90)


def test_key_is_unique(odd):
    assert exact_dedup(odd).select(KEY).distinct().count() == odd.count()


def test_batches_of_texts_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"size": [int(batch["text"].str.len().sum())]})

    texts = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) AS text")
    before = spark.conf.get(common.BATCH)
    with common.small_batches(spark):
        found = [r[0] for r in texts.mapInPandas(sizes, "size bigint").collect()]
    assert sum(found) == 40_000_000 and max(found) <= common.BATCH_BYTES + 1_000_000
    assert spark.conf.get(common.BATCH) == before


def test_jaccard_hands_over_small_batches_and_writes_few_files(docs, monkeypatch):
    seen = {}

    def written(df, name):
        seen.setdefault(name, []).append((df.sparkSession.conf.get(common.BATCH), out := common.written(df, name)))
        return out

    monkeypatch.setattr(jaccard, "written", written)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words, f"a{i % 40}"]) + f" g{i // 40} " * 30) for i in range(400)]
    spark = docs([]).sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = near_copies(docs(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert all(batch == str(common.BATCH_BYTES) for name in ("sets", "live", "numbered") for batch, _ in seen[name])
    assert seen["step"] and all(len(out.inputFiles()) <= spark.sparkContext.defaultParallelism
                                for name in ("step", "parents", "labels") for _, out in seen[name])
    expected = components_by_force(dict(rows), 3, 90)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == expected
