"""Toxicity: logistic regression on character n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import remainder
from runlens.llm.grams import code_points, hashed
from runlens.llm.linear import (
    Model, Sample, constant, gather, log_count_ratios, sampled_labels, score, sigmoid, texts_with,
)

BITS = 18
ORDERS = (4, 5)
SAMPLE_ROWS = 5000
BLOCK_ROWS = 500
CLASS_POWER = 0.5
THRESHOLD = 0.3
# N-grams in fewer sampled texts, or about as frequent in both classes, carry nothing.
LEAST_TEXTS = 3
LEAST_RATIO = 0.1


def char_grams(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashed 4- and 5-grams of the characters of each text, in lower case, a blank at either end."""
    points, starts = code_points([f" {text.lower()} " for text in texts])
    found = [hashed(points, n, BITS) for n in ORDERS]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield np.concatenate([grams[a : max(a, b - n + 1)] for grams, n in zip(found, ORDERS)])


def fit_logistic(sample: Sample, bits: int = BITS, penalty: float = 1.0, rounds: int = 50) -> Model:
    """Minimise log loss + penalty/2 |v|^2 over weights v of the scaled indicators, by accelerated gradient."""
    if len(set(sample.labels.tolist())) < 2:
        return constant(sample.labels, bits)
    ratios = log_count_ratios(sample, bits)
    texts = texts_with(sample, bits)
    ratios[(texts < LEAST_TEXTS) | (np.abs(ratios) < LEAST_RATIO)] = 0.0
    y = sample.labels.astype(float)
    # The rarer class counts more, by a power of the ratio of the classes.
    weight = np.where(y == 1, max(1.0, (1 / y.mean() - 1)) ** CLASS_POWER, 1.0)
    # Rows in blocks, so that what a step holds besides the sample does not grow with it. A feature
    # of no weight in front keeps every row non-empty.
    blocks = []
    curve = np.full(1 << bits, penalty)
    for at in range(0, len(y), BLOCK_ROWS):
        rows = [np.concatenate([[0], r[ratios[r] != 0]]).astype(np.int32) for r in sample.rows[at : at + BLOCK_ROWS]]
        lengths = np.array([len(r) for r in rows])
        ids, starts = np.concatenate(rows), np.cumsum(lengths) - lengths
        scaled = ratios[ids].astype(np.float32)
        scaled[starts] = 0.0
        blocks.append((ids, scaled, starts, lengths, y[at : at + BLOCK_ROWS], weight[at : at + BLOCK_ROWS]))
        # Per-coordinate steps, by a bound on the curvature, let rare and common grams move alike.
        sums = np.add.reduceat(np.abs(scaled), starts) * weight[at : at + BLOCK_ROWS]
        curve += np.bincount(ids, weights=np.abs(scaled) * np.repeat(sums, lengths), minlength=1 << bits) * 0.25
    curve_bias = 0.25 * weight.sum()
    v, bias = np.zeros(1 << bits), 0.0
    point, point_bias, momentum = v, bias, 1.0
    for _ in range(rounds):
        gradient, shift = penalty * point, 0.0
        for ids, scaled, starts, lengths, labels, weights in blocks:
            margins = np.add.reduceat(scaled * point[ids], starts) + point_bias
            error = weights * (sigmoid(margins) - labels)
            gradient = gradient + np.bincount(ids, weights=scaled * np.repeat(error, lengths), minlength=1 << bits)
            shift += error.sum()
        new, new_bias = point - gradient / curve, point_bias - shift / curve_bias
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / after
        point, point_bias = new + pull * (new - v), new_bias + pull * (new_bias - bias)
        v, bias, momentum = new, new_bias, after
    return Model(v * ratios, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`.

    Labels of rows whose remainder is `held_out` are never read. The fit is on about `sample_rows`
    labelled rows at most. Empty and null texts get the score of a text without n-grams. Rows
    labelled both ways count as toxic; labels without a value or a document count for nothing. With
    no label at all every score is 0.5. An empty table gives no row.
    """
    rows = docs.select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), folds) == held_out)
    chosen = sampled_labels(labels, "toxic", F.max, remainder(F.col("doc_id"), folds) != held_out, sample_rows)
    model = fit_logistic(gather(docs, chosen, char_grams, BITS))
    return score(rows, model, char_grams, BITS, THRESHOLD)
