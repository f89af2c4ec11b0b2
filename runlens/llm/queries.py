"""The registered queries of this package, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm.common import documents, labels
from runlens.llm.exact_dedup import exact_dedup
from runlens.llm.jaccard import near_copies
from runlens.llm.language import predict_languages
from runlens.llm.mixing import mix
from runlens.llm.oracles import ORACLES
from runlens.llm.packing import pack
from runlens.llm.pii import pseudonymise
from runlens.llm.quality import score_quality
from runlens.llm.rules import judge
from runlens.llm.spelling import spelling_variants
from runlens.llm.suffix_dedup import suffix_dedup
from runlens.llm.tokens import token_counts
from runlens.llm.toxicity import score_toxicity
from runlens.llm.whitening import whiten


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return predict_languages(documents(spark, folder))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(documents(spark, folder)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(documents(spark, folder)).select("doc_id", "n_shingles", "component_id")


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(documents(spark, folder), labels(spark, folder))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(documents(spark, folder), labels(spark, folder))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(documents(spark, folder), labels(spark, folder))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymise(documents(spark, folder))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    explained = F.array(*[F.lit(float(v)) for v in found.explained]).cast("array<double>")
    rows = found.rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation",
                       "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(found.identity_error).alias("identity_error"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(documents(spark, folder))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

__all__ = ["ORACLES", "QUERIES"]
