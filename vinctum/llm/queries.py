"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, language_id, line_dedup, near_dedup, pii, quality_rules, secret_scan, sharding, shallot, substring_dedup, token_counts
from .common import table
from .sql import ORACLE_SQL  # noqa: F401


def op1_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


#: In production the key comes from the cluster's secret store; a fixed one makes the registered query repeatable.
PII_KEY = "vinctum-demo-key"


def op2_pii(spark, sf_dir):
    return pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


def op3_sharding(spark, sf_dir):
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bpe(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, per_hundred=80)


def op7_decontaminate(spark, sf_dir):
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_secret_scan(spark, sf_dir):
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op10_quality_rules(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_centroids(spark, sf_dir):
    return shallot.report(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64, scale=1024)


def op12_substring_dedup(spark, sf_dir):
    return substring_dedup.repeats(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_pii, op3_sharding, op4_bpe, op5_language_id, op6_near_dedup, op7_decontaminate, op8_secret_scan, op9_token_counts, op10_quality_rules, op11_centroids, op12_substring_dedup, op13_filter_audit)}
