"""Linear text classifiers on n-gram indicators scaled by naive Bayes log-count ratios.

The fit is on a bounded sample of labelled rows: tasks turn those texts into hashed n-gram numbers,
and the driver fits the weights, of which there are 2**bits at any size of the corpus. Scoring reads
every text whole, in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import text_of
from runlens.llm.grams import groups

# texts -> one array of feature numbers per text, repeats included.
Features = Callable[[list[str]], Iterator[np.ndarray]]


@dataclass
class Sample:
    """Labelled texts as rows of distinct feature numbers."""

    rows: list[np.ndarray]
    labels: np.ndarray

    def part(self, chosen: np.ndarray) -> Sample:
        return Sample([self.rows[i] for i in np.flatnonzero(chosen)], self.labels[chosen])


def log_count_ratios(sample: Sample, bits: int, alpha: float = 1.0) -> np.ndarray:
    """log of how much more often a feature is in positive than in negative rows, smoothed by alpha; 0 if in none."""
    counts = np.zeros((2, 1 << bits))
    for row, label in zip(sample.rows, sample.labels):
        counts[label, row] += 1.0
    shares = [(c + alpha) / (c.sum() + alpha * len(c)) for c in counts]
    ratios = np.log(shares[1] / shares[0])
    ratios[counts[0] + counts[1] == 0] = 0.0
    return ratios


def sampled_labels(labels: DataFrame, column: str, merge: Callable[[str], Column], learn_from: Column, bound: int) -> DataFrame:
    """doc_id, label of about `bound` labelled ids at most, chosen by hash; an id labelled twice gets `merge` of its labels."""
    merged = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(learn_from)
    merged = merged.groupBy("doc_id").agg(merge(column).cast("int").alias("__label"))
    n = merged.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    return merged.where(draw < min(1.0, bound / max(1, n)))


def gather(docs: DataFrame, chosen: DataFrame, features: Features, bits: int) -> Sample:
    """The chosen rows' features. `chosen` is bounded by the sample's size, so it is broadcast."""
    from runlens.llm.grams import Distinct

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct = Distinct(bits)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in groups(texts):
                rows = [distinct(ids).astype(np.int32) for ids in features(texts[a:b])]
                yield pd.DataFrame({"label": batch["__label"].to_numpy()[a:b], "ids": [r.tobytes() for r in rows]})

    joined = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = joined.select("__label", "text").mapInPandas(work, "label int, ids binary").toPandas()
    rows = [np.frombuffer(b, dtype=np.int32) for b in found["ids"]]
    order = sorted(range(len(rows)), key=lambda i: (found["label"][i], found["ids"][i]))
    return Sample([rows[i] for i in order], found["label"].to_numpy()[order].astype(np.int64))


@dataclass
class Model:
    """score = sigmoid(slope * (weights . indicators + bias) + shift)"""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def texts_with(sample: Sample, bits: int) -> np.ndarray:
    """How many rows have each feature."""
    count = np.zeros(1 << bits)
    for row in sample.rows:
        count[row] += 1.0
    return count


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def constant(labels: np.ndarray, bits: int) -> Model:
    """Where there is only one class, or none: its share for every text."""
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    return Model(np.zeros(1 << bits), 0.0, 1.0, float(np.log(share / (1 - share))))


def score(docs: DataFrame, model: Model, features: Features, bits: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text is an empty one."""
    from runlens.llm.grams import Distinct

    weights = model.weights.astype(np.float32)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct = Distinct(bits)
        for batch in batches:
            texts = batch["text"].tolist()
            sums = np.zeros(len(texts))
            for a, b in groups(texts):
                for i, ids in enumerate(features(texts[a:b]), a):
                    sums[i] = weights[distinct(ids)].sum(dtype=np.float64)
            scores = sigmoid(model.slope * (sums + model.bias) + model.shift)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores,
                                "predicted": (scores >= threshold).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("bigint"), "held_out", text_of().alias("text"))
    return rows.mapInPandas(work, "doc_id bigint, held_out boolean, score double, predicted int")
