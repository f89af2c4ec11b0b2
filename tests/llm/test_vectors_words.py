"""Token counts, whitening and spelling variants against brute force."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import runlens.llm.whitening as whitening
from check import TABLES, compare
from runlens.llm.common import documents
from runlens.llm.queries import ORACLES, QUERIES
from runlens.llm.spelling import near_words, spelling_forms, spelling_variants
from runlens.llm.tokens import Pieces, characters_within, model_path, prefix_counts, token_counts, tokens_within, truncated
from runlens.llm.whitening import rotated, whiten
from tests.llm.conftest import ODD, rows_of

SMALL = "/root/testdata/sf0.001"
LETTERS = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def strange_texts():
    rnd = random.Random(11)
    parts = ["the", "ing", " ", "  ", "é", "中", "\x00", "😀", "12", "..", "==", "\t", "\n", "ation", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "aaaa"]
    return [*[t for t in ODD if t is not None], " " * 70, "▁▁ a", *["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(60)]]


def test_counts_of_whole_texts(spark, docs, odd):
    model = library()
    for table in (odd, documents(spark, SMALL), docs(list(enumerate(strange_texts())))):
        expected = sorted(((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 4096)
                           for r in table.collect()), key=repr)
        assert rows_of(token_counts(table), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected


def test_counts_of_every_prefix(spark, docs):
    model, texts = library(), [t[:200] for t in strange_texts()]
    for r in prefix_counts(docs([*enumerate(texts), (-1, None)])).collect():
        text = texts[r.doc_id] if r.doc_id >= 0 else ""
        assert r.counts == [len(model.encode(text[:p])) for p in range(len(text) + 1)]


def test_counts_without_memory():
    pieces = Pieces(model_path())
    long = "ab" * 3000
    assert pieces.count(long) == len(library().encode(long)) and not pieces.known


def test_questions_of_the_table(spark, docs):
    model, texts = library(), [t[:120] for t in strange_texts()[:30]]
    table = docs([*enumerate(texts), (99, None)]).withColumns({"__of": F.lit(1), "__kept": F.lit(2)})
    counts = prefix_counts(table)
    for budget in (0, 1, 7, 1000):
        kept = truncated(table, counts, budget)
        assert kept.columns == table.columns
        for r in kept.collect():
            text = texts[r.doc_id] if r.doc_id < 99 else None
            most = max(p for p in range(len(text or "") + 1) if len(model.encode((text or "")[:p])) <= budget)
            assert r.text == (text[:most] if text is not None else None)
    got = counts.select("doc_id", tokens_within(F.col("counts"), 5).alias("five"), characters_within(F.col("counts"), 3).alias("three"))
    assert {r.doc_id: r.five for r in got.collect() if r.doc_id < 99} == {i: len(model.encode(t[:5])) for i, t in enumerate(texts)}


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def whitened_by_force(vectors, components):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    cov = centred.T @ centred / n
    values, units = np.linalg.eigh(cov)
    values, units = values[::-1][:components], units[:, ::-1][:, :components]
    return [sum(int(n * a - b) ** 2 for a, b in zip(row, sums)) for row in x], centred @ units / np.sqrt(values), values / np.trace(cov)


def same_up_to_sign(left, right):
    return all(min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8 for a, b in zip(left.T, right.T))


@pytest.mark.parametrize("stripe", [None, 2])
def test_whitening(spark, monkeypatch, stripe):
    if stripe:
        # Blocks of as many rows as dimensions, two to a stripe.
        monkeypatch.setattr(whitening, "BLOCK_BYTES", 8)
        monkeypatch.setattr(whitening, "BLOCKS_PER_STRIPE", stripe)
    rnd = np.random.default_rng(3)
    good = (rnd.normal(size=(70, 9)) * np.linspace(1, 3, 9) + rnd.normal(size=9)).astype(np.float32).tolist()
    good += [good[0], good[0], [0.0] * 9]
    bad = [None, [], [None] * 9, [1.0] * 8 + [None], [float("nan")] * 9, [1.0] * 8 + [float("inf")], [1.0] * 8]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(None, good[1], None), (3, good[2], 1)]
    table = vectors_of(spark, rows).repartition(5).withColumns({"key": F.lit(1), "index": F.lit(2), "id": F.lit(3), "x": F.lit(4)})
    used = [r for r in rows if r[0] is None or r[0] < 1000]
    deviation, expected, explained = whitened_by_force([r[1] for r in used], 5)
    found = whiten(table, 5)
    got = sorted(found.rows.collect(), key=lambda r: (r.deviation, repr(r.id)))
    order = sorted(range(len(used)), key=lambda i: (deviation[i], repr(used[i][0])))
    assert [(r.id, r.deviation) for r in got] == [(used[i][0], deviation[i]) for i in order]
    assert same_up_to_sign(np.array([r.whitened for r in got]), expected[order])
    assert found.n == len(used) and np.allclose(found.explained, explained) and found.identity_error < 1e-10


def test_whitening_without_variance(spark):
    assert whiten(vectors_of(spark, [])).rows.collect() == []
    assert whiten(vectors_of(spark, [(1, None, 0)])).rows.collect() == []
    for rows in ([(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]):
        assert rows_of(whiten(vectors_of(spark, rows)).rows) == [(r[0], 0, []) for r in rows]
    flat = whiten(vectors_of(spark, [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(6)]))
    assert len(flat.eigenvalues) == 1 and flat.identity_error < 1e-10


def test_whitening_with_one_very_long_vector(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, v, 0) for i, v in enumerate(rnd.normal(size=(50, 6)).tolist())] + [(99, [3e9] + [1.0] * 5, 0)]
    found = whiten(vectors_of(spark, rows), 6)
    assert len(found.eigenvalues) >= 1 and found.identity_error < 1e-4
    # A vector so long that the square of its distance is beyond a long has no deviation.
    assert {r.id: r.deviation is None for r in found.rows.collect()}[99]


def test_rotations():
    rnd = np.random.default_rng(5)
    a = rnd.normal(size=(7, 7))
    a = a @ a.T
    values, vectors = rotated(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1]) and np.allclose(vectors @ np.diag(values) @ vectors.T, a)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def forms_by_force(counts):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()), key=repr)


def counts_by_force(rows):
    counts = Counter()
    for doc_id, text in rows:
        runs = "".join(c if c in LETTERS else " " for c in text or "").split()
        for run in runs:
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_spelling_by_force(spark, docs, odd):
    rnd = random.Random(6)
    texts = []
    for i in range(60):
        words = [rnd.choice(["abcabcabc", "ABCABCABC", "aaaaaaa", "aaaaaaaa", "éèàçñüöß", "Éèàçñüöß", "separate", "seperate", "separrate", "a×b÷cdefgh"]) for _ in range(30)]
        texts.append((i, rnd.choice([" ", "\n", "-"]).join(words)))
    for table in (odd, docs(texts), docs([*texts, *texts[:3], (None, "separatee separatee")]).withColumns({"word": F.lit(1), "run": F.lit(2), "n": F.lit(3)})):
        expected = forms_by_force(counts_by_force([(r.doc_id, r.text) for r in table.collect()]))
        assert rows_of(spelling_variants(table), "word", "form", "root", "n", "n_near", "form_n") == expected
    assert expected


def test_spelling_of_few_letters(spark):
    rnd = random.Random(7)
    counts = {"".join(rnd.choice("abc") for _ in range(rnd.randint(7, 9))): 10 ** rnd.randint(0, 6) for _ in range(700)}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows_of(spelling_forms(words), "word", "form", "root", "n", "n_near", "form_n") == forms_by_force(counts)
    pairs = rows_of(near_words(words), "word", "other")
    assert pairs == sorted(((a, b) for a in counts for b in counts if one_apart(a, b)), key=repr)


def test_long_words_and_chains(spark):
    long = "x" * 20_000
    counts = {long: 3, long + "y": 40, "aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10**4, "aabbbbb": 10**5}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.word: r for r in spelling_forms(words).collect()}
    assert got["aaaaaaa"].root == "aabbbbb" and got["aaaaaaa"].form == "aaaaaab"
    assert got[long].form == long + "y" and got[long + "y"].root == long + "y"
    empty = spark.createDataFrame([], "word string, n bigint")
    assert spelling_forms(empty).collect() == []


def test_spelling_matches_its_twin(spark):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    ok, text = compare(spark, db, SMALL, "op13_spelling", QUERIES["op13_spelling"], ORACLES["op13_spelling"])
    assert ok, text


def test_whitening_query(spark):
    rows = QUERIES["op12_whitening"](spark, SMALL)
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    deviation, expected, explained = whitened_by_force([r.embedding for r in table], 32)
    got = rows.orderBy("vec_id", "component").collect()
    assert len(got) == 32 * len(table)
    assert same_up_to_sign(np.array([r.whitened for r in got]).reshape(-1, 32), expected)
    assert {(r.vec_id, r.deviation) for r in got} == {(r.vec_id, d) for r, d in zip(table, deviation)}
    assert np.allclose([r.explained for r in got[:32]], explained) and got[0].identity_error < 1e-10
