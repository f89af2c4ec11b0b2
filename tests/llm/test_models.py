"""Language id and the two classifiers: held-out accuracy, folds, odd rows."""

import zlib

import numpy as np
import pytest

from runlens.llm.common import documents, labels
from runlens.llm.language import Filter, Settings, predict_languages
from runlens.llm.linear import Sample, log_count_ratios
from runlens.llm.quality import fit_hinge, score_quality
from runlens.llm.toxicity import score_toxicity
from tests.llm.conftest import rows_of

MEDIUM = "/root/testdata/sf0.01"


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language_held_out(spark):
    table = documents(spark, MEDIUM)
    truth = {r.doc_id: r.lang for r in table.collect()}
    got = predict_languages(table).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_language_odd_rows(odd, docs):
    got = {(r.doc_id, r.lang_pred) for r in predict_languages(odd).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (6, "und"), (None, "und")} <= got
    assert {lang for _, lang in got} <= {"en", "und"}
    assert predict_languages(docs([])).count() == 0
    assert rows_of(predict_languages(docs([(1, "text", None, None)])), "lang_pred", "score") == [("und", 0.0)]


def test_filter_corrects_false_positives():
    rng = np.random.default_rng(0)
    sets = {name: rng.integers(1, 1 << 62, 3000) for name in ("a", "b")}
    crowded = Filter(sets, Settings(slots=1 << 13, hashes=2))
    assert crowded.false.min() > 0.05
    strange = rng.integers(1, 1 << 62, 4000).view(np.uint64)
    assert crowded.counts(strange, np.zeros(4000, np.int64), 1).max() < 200
    own = crowded.counts(sets["a"].view(np.uint64), np.zeros(3000, np.int64), 1)[0]
    assert own[0] > 2900 and own[1] < 200


def test_filter_with_many_languages():
    sets = {f"l{i:03d}": np.arange(i * 50 + 1, i * 50 + 51) for i in range(70)}
    many = Filter(sets, Settings())
    assert all(many.counts(sets[n].view(np.uint64), np.zeros(50, np.int64), 1).argmax() == i for i, n in enumerate(many.names))


@pytest.mark.parametrize(("fn", "column", "modulus", "rest"), [(score_toxicity, "toxic", 4, 2), (score_quality, "quality", 5, 0)])
def test_classifier_held_out(spark, fn, column, modulus, rest):
    truth = {r.doc_id: r[column] for r in labels(spark, MEDIUM).collect()}
    got = fn(documents(spark, MEDIUM), labels(spark, MEDIUM)).collect()
    assert all(r.held_out == (fold(r.doc_id, modulus) == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    one, zero = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    above = sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero))
    assert above > (0.95 if column == "quality" else 0.6)


@pytest.mark.parametrize(("fn", "column"), [(score_toxicity, "toxic"), (score_quality, "quality")])
def test_classifier_odd_rows(spark, odd, docs, fn, column):
    none = spark.createDataFrame([], f"doc_id bigint, {column} int")
    got = fn(odd, none).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (5, 0), (8, 1), (9, 0), (999, 1)], none.schema)
    assert len(fn(odd, some).collect()) == odd.count()
    assert fn(docs([]), some).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    table = documents(spark, "/root/testdata/sf0.001")
    given = labels(spark, "/root/testdata/sf0.001")
    flipped = given.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    assert rows_of(score_toxicity(table, given)) == rows_of(score_toxicity(table, flipped))


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.append(rng.integers(10, 200, 20), 1 if i % 2 else 2)).astype(np.int32) for i in range(200)]
    sample = Sample(rows, np.arange(200) % 2)
    weights, bias = fit_hinge(sample, log_count_ratios(sample, 8))
    assert all((weights[r].sum() + bias > 0) == bool(y) for r, y in zip(rows, sample.labels))
