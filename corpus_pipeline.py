"""Corpus pipeline over ``documents``: quality rules, near-duplicates, benchmark decontamination, secret scans, tokens.

Each stage takes what the one before it kept. The first four return the columns of ``documents``; the last returns one row of token
counts and digests for each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictflow.llm.bpe import encode_documents
from verdictflow.llm.common import materialize, ship_package, small_batches, table
from verdictflow.llm.decontamination import drop_contaminated
from verdictflow.llm.near_dedup import keep_one_of_each
from verdictflow.llm.quality import keep_good
from verdictflow.llm.secrets import mask_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    ship_package(spark)
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked."""
    ship_package(spark)
    small_batches(spark)
    return mask_secrets(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    small_batches(spark)
    return encode_documents(docs, forget=True)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", token_stage),
]
#: SQL cannot express the vote model, the alignment and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
