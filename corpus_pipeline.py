"""The corpus pipeline: quality rules, exact dedup, near-copy dedup, mixing by source, packing.

Each stage takes what the one before kept, whole, and its decisions take effect; all but the last
return the columns of `documents`. Mixing may take a document up to three times: it then is as many
rows, and the last may end early, after the first words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm.common import documents, labels, written
from runlens.llm.exact_dedup import without_copies
from runlens.llm.jaccard import Likeness, one_of_each
from runlens.llm.mixing import mixed
from runlens.llm.packing import pack
from runlens.llm.rules import good_documents

# Near copies of the pipeline: five words and a similarity of 0.8 or more.
NEAR = Likeness(n=5, percent=80)
# Chunks that a worker of the packing stage remembers: it serves the other stages as well.
REMEMBERED = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return good_documents(docs, labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return without_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return one_of_each(docs, NEAR)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

# Binomial bounds, hash orders and tokenization have no plain SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
