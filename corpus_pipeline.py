"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillet.llm.best_fit_packing import pack_documents
from quillet.llm.line_dedup import drop_repeated_lines
from quillet.llm.minhash_dedup import Sketch, keep_one_each
from quillet.llm.quality_rules import quality_filter
from quillet.llm.toxicity import toxicity_filter
from quillet.runtime import materialize

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and come from hosts that pass theirs."""
    return quality_filter(docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold."""
    return toxicity_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats up to the threshold; emptied ones go."""
    return drop_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates (two-word shingles as in op5, similarity 0.8)."""
    return keep_one_each(docs, Sketch(shingle=2, percent=80))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality),
    ("toxicity", non_toxic),
    ("line dedup", unrepeated_lines),
    ("MinHash near-dedup", one_of_each),
    ("best-fit packing", packed),
]

#: Models, sketches and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
