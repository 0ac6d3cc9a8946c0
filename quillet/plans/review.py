"""The whole review of many changes, as one function of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions.findings import at_least
from quillet.operators.boundaries import BoundaryProvider
from quillet.operators.carry import carry_forward, review_counters
from quillet.operators.chunk import TOKEN_BUDGET, chunk_changes
from quillet.operators.diff import FILE_HEADER, changed_lines_in_slices, diff_lines, has_changes, new_path, resolve_from_sha
from quillet.operators.ground import Verifier, ground, kept
from quillet.operators.review import dry_run, flatten
from quillet.operators.summary import build_bodies, first_summary_comment, last_reviewed_sha, prior_findings, upsert_plan
from quillet.runtime import materialize

Reviewer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Review:
    """What a run makes: per-review results, all findings, those that are posted, and the plan to post them."""

    results: DataFrame
    chunks: DataFrame
    grounded: DataFrame
    findings: DataFrame
    posted: DataFrame
    plan: DataFrame


def needed_files(reviews: DataFrame, comments: DataFrame, diffs: DataFrame) -> DataFrame:
    """``review_id, head_sha, path`` of the files that a run looks at: those a diff names as changed and those of earlier findings."""
    lines = diff_lines(diffs.select("review_id", "diff_text")).select("review_id", new_path(F.nullif(F.regexp_extract("line", FILE_HEADER, 1), F.lit(""))).alias("path"))
    earlier = prior_findings(first_summary_comment(comments).select("review_id", "body")).select("review_id", F.explode("findings.file").alias("path"))
    return lines.unionByName(earlier).dropna().distinct().join(reviews.select("review_id", "head_sha"), "review_id")


def review_changes(
    reviews: DataFrame,
    comments: DataFrame,
    diffs: DataFrame,
    files: DataFrame,
    reviewer: Reviewer = dry_run,
    verifier: Verifier | None = None,
    provider: BoundaryProvider | None = None,
    min_severity: str = "suggestion",
    token_budget: int = TOKEN_BUDGET,
) -> Review:
    """Review each of ``reviews(review_id, pr_number, base_sha, head_sha)``.

    The state of earlier runs is read from the summary comments; ``diffs(review_id,
    from_sha, diff_text)`` holds the text from each commit a review may start at.
    Results are unfiltered; what is posted is filtered by severity, except for
    reviews whose diff is empty. What the reviewer and the verifier say is written
    before use, since their calls must not be repeated.
    """
    summary = first_summary_comment(comments)
    state = reviews.join(summary.select("review_id", "ord", "body"), "review_id", "left").withColumn("since_sha", last_reviewed_sha(F.col("body")))
    state = state.withColumn("from_sha", resolve_from_sha(F.col("since_sha"), F.col("base_sha")))
    due = state.join(diffs, ["review_id", "from_sha"], "left").withColumn("changed", has_changes(F.col("diff_text")))
    due = materialize(due, "due")

    changed = materialize(changed_lines_in_slices(diff_lines(due.filter("changed"))), "changed")  # each diff is scanned once
    chunks = materialize(chunk_changes(changed, files, provider, token_budget), "chunks")
    results = materialize(reviewer(chunks.withColumnRenamed("path", "file")), "chunk-results")
    grounded = materialize(ground(flatten(results), files, verifier), "grounded")

    earlier = prior_findings(due.filter("body IS NOT NULL").select("review_id", "body")).join(due.select("review_id", "since_sha"), "review_id")
    each = earlier.select("review_id", "since_sha", F.posexplode("findings").alias("_pos", "_f"))
    prior = each.select("review_id", "since_sha", F.lit(0).alias("origin"), F.lit(0).cast("long").alias("chunk_ord"), F.col("_pos").cast("long").alias("finding_ord"), "_f.*")
    findings = materialize(carry_forward(kept(grounded), prior, files, verifier), "findings")

    counted = review_counters(due.select("review_id", "pr_number", F.col("head_sha").alias("commit_sha"), "changed"), chunks, results)
    shown = findings.join(due.select("review_id", "changed"), "review_id").filter(~F.col("changed") | at_least(F.col("severity"), min_severity)).drop("changed")
    bodies = build_bodies(counted, shown)
    current = due.filter("body IS NOT NULL").select("review_id", "ord")
    return Review(counted.drop("changed"), chunks, grounded, findings, shown, upsert_plan(current, bodies))
