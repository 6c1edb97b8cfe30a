"""A corpus pipeline of five operators: quality rules, line dedup, near dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. The driver of a job writes each stage's result and reads it again for the next; run() does so itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vinctum.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from vinctum.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the threshold table go."""
    return quality_rules.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; so do texts of which no word is left by that."""
    return line_dedup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: five words, similarity 0.8."""
    return near_dedup.keep_one(docs, k=5, per_hundred=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in windows of benchmark items go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="document")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("decontamination", benchmark_stage), ("bpe", bpe_stage)]

#: BPE merges can't be expressed in SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
