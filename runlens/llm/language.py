"""Language identification with a bit-sliced Bloom filter of character trigrams.

The filter has a row per slot and a bit per language. Looking a trigram up is the bitwise AND of the
rows that its hashes name: the set of all languages that have the trigram. Over a text, each
language's set bits are counted, and the count is corrected for the share of false positives that
the fill of its bit column predicts. The language with the largest corrected count is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import remainder, text_of
from runlens.llm.grams import MIX, code_points, groups

SPACE = 32
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """`documents`: about how many texts per language the filter learns from, at most. `grams`: how
    many of the commonest trigrams of a language enter. `least`: a trigram enters for a language only
    if it is at least that fraction as frequent as in the language where it is most frequent."""

    documents: int = 3000
    grams: int = 8192
    least: float = 0.05
    slots: int = 1 << 18
    hashes: int = 3


def letters_only(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, all but letters as blanks, and where each text begins."""
    points, starts = code_points([text.lower() for text in texts])
    points = points.copy()
    for point in np.flatnonzero(np.bincount(points)).tolist() if len(points) else []:
        if not chr(point).isalpha():
            points[points == point] = SPACE
    return points, starts


def trigrams(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams with a letter in the middle, packed exactly into 64 bits, and the text each is of."""
    size = max(0, len(points) - 2)
    wide = points.astype(np.uint64)
    packed = (wide[:size] << np.uint64(42)) | (wide[1 : size + 1] << np.uint64(21)) | wide[2 : size + 2]
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    good = (points[1 : size + 1] != SPACE) & (owner[:size] == owner[2 : size + 2])
    return packed[good], owner[:size][good]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, gram, n: how often each trigram comes in the texts of each language."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts = [f" {text} " for text in part["text"]]
                for a, b in groups(texts):
                    grams, counts = np.unique(trigrams(*letters_only(texts[a:b]))[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": counts})

    return docs.mapInPandas(work, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """Bit-sliced Bloom filter over the trigrams of each language."""

    def __init__(self, languages: dict[str, np.ndarray], settings: Settings):
        self.names, self.slots, self.hashes = sorted(languages), settings.slots, settings.hashes
        self.rows = np.zeros((settings.slots, max(1, -(-len(self.names) // 64))), dtype=np.uint64)
        for i, name in enumerate(self.names):
            bit = np.uint64(1) << np.uint64(i % 64)
            for at in self.places(languages[name].view(np.uint64)):
                self.rows[at, i // 64] |= bit
        bits = [(self.rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(self.names))]
        self.false = np.array([float(column.mean()) ** self.hashes for column in bits])

    def places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        first = grams * MIX
        second = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        shift = np.uint64(64 - (self.slots - 1).bit_length())
        for _ in range(self.hashes):
            yield (first >> shift).astype(np.int64)
            first = first + second

    def counts(self, grams: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """texts x languages: corrected numbers of trigrams."""
        found = None
        for at in self.places(grams):
            found = self.rows[at] if found is None else found & self.rows[at]
        total = np.bincount(owner, minlength=texts)
        out = np.zeros((texts, len(self.names)))
        for i in range(len(self.names)):
            set_ = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(owner, weights=set_, minlength=texts)
            out[:, i] = np.maximum(0.0, (hits - total * self.false[i]) / (1.0 - min(self.false[i], 0.999)))
        return out


def learn(docs: DataFrame, settings: Settings = Settings()) -> Filter:
    """A filter of the languages of `docs` (lang, text), from a bounded, hash-chosen part of each."""
    known = docs.where("lang is not null").select("doc_id", "lang", text_of().alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, settings.documents / n))]) if sizes else F.lit(None)
    if not sizes:
        return Filter({}, settings)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    counts = count_trigrams(known.where(draw < share[F.col("lang")]).select("lang", "text"))
    total = Window.partitionBy("lang")
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(total))
    best = F.max("share").over(Window.partitionBy("gram"))
    kept = shares.withColumn("best", best).where(F.col("share") >= settings.least * F.col("best"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = kept.withColumn("rank", top).where(F.col("rank") <= settings.grams).select("lang", "gram").toPandas()
    grams = {lang: part["gram"].to_numpy() for lang, part in rows.groupby("lang")}
    return Filter({lang: grams.get(lang, np.zeros(0, np.int64)) for lang in sizes}, settings)


def identify(docs: DataFrame, filter_: Filter) -> DataFrame:
    """`docs` (doc_id, text) with lang_pred and score, the share of the answer among all languages' counts.

    A null text and one without a letter are `und` with score 0, as is every text if no language was
    learnt. A text none of whose trigrams is known gets the first language and score 0. Ties go to
    the language that comes first by name.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if text is None else f" {text} " for text in batch["text"]]
            answers: list[str] = []
            scores: list[np.ndarray] = []
            for a, b in groups(texts):
                points, starts = letters_only(texts[a:b])
                n = b - a
                letters = np.concatenate([[0], np.cumsum(points != SPACE)])
                has_letter = letters[starts[1:]] > letters[starts[:-1]]
                if not filter_.names:
                    answers += [UNKNOWN] * n
                    scores.append(np.zeros(n))
                    continue
                found = filter_.counts(*trigrams(points, starts), n)
                best, all_ = found.argmax(axis=1), found.sum(axis=1)
                answers += [filter_.names[i] if ok else UNKNOWN for i, ok in zip(best, has_letter)]
                top = found[np.arange(n), best]
                scores.append(np.where(has_letter & (all_ > 0), top / np.where(all_ > 0, all_, 1.0), 0.0))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": answers,
                                "score": np.concatenate(scores) if scores else np.zeros(0)})

    rows = docs.select(F.col("doc_id").cast("bigint"), "held_out", "text")
    return rows.mapInPandas(work, "doc_id bigint, held_out boolean, lang_pred string, score double")


def predict_languages(docs: DataFrame, folds: int = 5, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `docs`; learns from the rows not held out."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), folds) == 0)
    return identify(rows, learn(rows.where(~F.col("held_out")), settings))
