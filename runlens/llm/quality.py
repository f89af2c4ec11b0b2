"""Quality: naive Bayes support vectors, by dual coordinate descent.

Indicators of character 2- to 4-grams, as written, and of 1- to 3-grams of word shapes are scaled by
naive Bayes log-count ratios; a linear hinge-loss model is fitted on them one example at a time in
the dual. Margins become scores by a logistic curve fitted on sampled rows that the model did not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import remainder
from runlens.llm.grams import MIX, code_points, hashed
from runlens.llm.linear import (
    Model, Sample, constant, gather, log_count_ratios, sampled_labels, score, sigmoid, texts_with,
)

BITS = 18
ORDERS = (2, 3, 4)
SAMPLE_ROWS = 5000
THRESHOLD = 0.3
CALIBRATION = 5


def shapes(points: np.ndarray) -> np.ndarray:
    """A small number per word: class of its first and last character, length, and whether it repeats the word before."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    first, after = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, dtype=np.uint32)
    kind = np.full(len(points), 3, dtype=np.uint32)
    kind[(points >= 97) & (points <= 122) | (points >= 223)] = 0
    kind[(points >= 65) & (points <= 90) | (points >= 192) & (points < 223)] = 1
    kind[(points >= 48) & (points <= 57)] = 2
    length = after - first
    # Sums over a word of mixed characters with their places tell nearly all words apart.
    place = (np.arange(len(points)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(points)]])))).astype(np.uint64)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * MIX ^ place * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    mixed[space] = 0
    name = np.add.reduceat(mixed, first)
    same = np.concatenate([[False], name[1:] == name[:-1]]).astype(np.uint32)
    return kind[first] | kind[after - 1] << 2 | np.minimum(length // 4, 3).astype(np.uint32) << 4 | same << 6 | np.uint32(1 << 20)


def quality_grams(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashed n-grams of the characters of each text and of the shapes of its words."""
    points, starts = code_points([f" {text} " for text in texts])
    found = [hashed(points, n, BITS) for n in ORDERS]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        shape = shapes(points[a:b])
        yield np.concatenate([*[grams[a : max(a, b - n + 1)] for grams, n in zip(found, ORDERS)],
                              *[hashed(shape, n, BITS) for n in (1, 2, 3)]])


def fit_hinge(sample: Sample, ratios: np.ndarray, cost: float = 1.0, passes: int = 10, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights of the indicators and bias, by dual coordinate descent on the hinge loss.

    Each step takes one example and moves its dual variable, kept between 0 and `cost`, to the best value.
    """
    w, bias = np.zeros(len(ratios)), 0.0
    rows = [r[ratios[r] != 0] for r in sample.rows]
    values = [ratios[r] for r in rows]
    squared = [float(v @ v) + 1.0 for v in values]
    signs = np.where(sample.labels == 1, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (float(values[i] @ w[rows[i]]) + bias) - 1.0
            new = min(cost, max(0.0, alpha[i] - gradient / squared[i]))
            move = (new - alpha[i]) * signs[i]
            if move:
                w[rows[i]] += move * values[i]
                bias += move
                alpha[i] = new
                most = max(most, abs(move) * squared[i])
        if most < 1e-3:
            break
    return w * ratios, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps on smoothed targets."""
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * margins + shift)
        error, curve = p - target, np.maximum(p * (1 - p), 1e-9)
        h11, h12, h22 = (curve * margins * margins).sum() + 1e-3, (curve * margins).sum(), curve.sum() + 1e-3
        g1, g2 = (error * margins).sum() + 1e-3 * (slope - 1), error.sum()
        det = h11 * h22 - h12 * h12
        step1, step2 = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        scale = min(1.0, 2.0 / max(abs(step1), abs(step2), 1e-12))
        slope, shift = max(1e-3, slope - scale * step1), shift - scale * step2
    return float(slope), float(shift)


def fit_quality(sample: Sample, bits: int = BITS) -> Model:
    """The model and its calibration; with one class only, or none, the share of good rows."""
    spare = np.arange(len(sample.rows)) % CALIBRATION == 0
    fit, rest = sample.part(~spare), sample.part(spare)
    if len(set(fit.labels.tolist())) < 2:
        return constant(sample.labels, bits)
    ratios = log_count_ratios(fit, bits)
    ratios[texts_with(fit, bits) < 3] = 0.0
    weights, bias = fit_hinge(fit, ratios)
    margins = np.array([weights[r].sum() + bias for r in rest.rows])
    return Model(weights, bias, *calibrate(margins, rest.labels))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`.

    Labels of rows whose remainder is `held_out` are never read. The fit is on about `sample_rows`
    labelled rows at most. Empty and null texts get the score of a text without words. Rows labelled
    both ways count as bad; labels without a value or a document count for nothing. With no label at
    all every score is 0.5. An empty table gives no row.
    """
    rows = docs.select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), folds) == held_out)
    chosen = sampled_labels(labels, "quality", F.min, remainder(F.col("doc_id"), folds) != held_out, sample_rows)
    model = fit_quality(gather(docs, chosen, quality_grams, BITS))
    return score(rows, model, quality_grams, BITS, THRESHOLD)
