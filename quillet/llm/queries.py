"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from quillet.llm.best_fit_packing import pack_documents
from quillet.llm.byte_bpe import bpe_digest
from quillet.llm.embedding_whitening import whiten
from quillet.llm.kd_sharding import kd_shards
from quillet.llm.katz_lm import katz_scores
from quillet.llm.license_scan import license_scan
from quillet.llm.line_dedup import Lines, line_dedup
from quillet.llm.merkle_manifest import verified_manifest
from quillet.llm.minhash_dedup import Sketch, near_duplicates
from quillet.llm.oracle import ORACLE_SQL
from quillet.llm.projected_ann import nearest
from quillet.llm.quality_rules import quality_rules
from quillet.llm.threshold_sketch import edited_fingerprints
from quillet.llm.toxicity import toxicity

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = kd_shards(_table(spark, sf_dir, "documents"), shards=16)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), Sketch(shingle=2, percent=80))


def op6_projected_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), Lines(least_words=1))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten(_table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").cast("long"))  # fails, never wraps, where it is no long


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_kd_sharding": op4_kd_sharding,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_projected_ann": op6_projected_ann,
        "op7_line_dedup": op7_line_dedup,
        "op8_license_scan": op8_license_scan,
        "op9_katz_lm": op9_katz_lm,
        "op10_toxicity": op10_toxicity,
        "op11_threshold_sketch": op11_threshold_sketch,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for op1; models, tokenizers, sketches and packings can't be expressed in it and are tested against brute force."""
    return dict(ORACLE_SQL)
