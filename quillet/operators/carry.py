"""Findings of earlier runs that still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators.ground import Verifier, ground, kept


def carry_forward(new: DataFrame, prior: DataFrame, files: DataFrame, verifier: Verifier | None = None) -> DataFrame:
    """New findings and, after them (origin 1), grounded prior ones at places that no new one has.

    ``prior`` has ``since_sha``; without it nothing is carried. Neither side is
    deduplicated with itself.
    """
    again = kept(ground(prior.filter(F.col("since_sha").isNotNull()).drop("since_sha"), files, verifier)).withColumn("origin", F.lit(1))
    carried = again.join(new.select("review_id", "file", "line_start").distinct(), ["review_id", "file", "line_start"], "left_anti")
    return new.unionByName(carried.select(*new.columns))


def review_counters(reviews: DataFrame, chunks: DataFrame, results: DataFrame) -> DataFrame:
    """``chunks_reviewed`` and ``chunks_skipped`` (partial plus failed) of every review, zero without chunks."""
    partial = chunks.groupBy("review_id").agg(F.count(F.lit(1)).alias("_chunks"), F.count_if("is_partial").alias("_partial"))
    failed = results.groupBy("review_id").agg(F.count_if("is_failed").alias("_failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = reviews.join(partial, "review_id", "left").join(failed, "review_id", "left")
    return joined.select(*reviews.columns, zero("_chunks").alias("chunks_reviewed"), (zero("_partial") + zero("_failed")).alias("chunks_skipped"))
