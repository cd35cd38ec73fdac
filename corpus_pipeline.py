"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last return the columns
of ``documents``; the last returns the ids of every text and the text that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from retenta.llm import bpe, decontaminate, near_jaccard, pii, quality
from retenta.session import stage

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SHINGLE, SIMILAR = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rule nor the learned list rejects."""
    rules = quality.learn(quality.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.accepted(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word Jaccard of 0.8 or more)."""
    return near_jaccard.one_of_each(docs, SHINGLE, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``text`` (decoded from the ids)."""
    rows = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("personal_data", personal_data), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints and the learned models are beyond SQL; the tests check the result against a plain version.
ORACLE_SQL = None
