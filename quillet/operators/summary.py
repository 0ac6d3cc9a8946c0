"""Summaries: rendering, the state they carry, and the plan to post them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions.findings import FIELDS, FINDING, decode_findings, severity_rank
from quillet.operators.boundaries import first_of

MARKER = "<!-- quillet:summary -->"

HEADING = "## What the review found"
NOTHING = "Nothing to report on this change."
SHA_MARKER = r"<!-- quillet:last-reviewed-sha:([0-9a-fA-F]+) -->"
FINDINGS_MARKER = r"<!-- quillet:findings:([A-Za-z0-9+/=]*) -->"

ORDER = ("origin", "chunk_ord", "finding_ord")


def title_case(word: Column) -> Column:
    return F.initcap(word)


def bullet() -> Column:
    """Lines of one finding."""
    fix = F.col("suggested_fix")
    return F.concat(
        F.lit("- **"), "file", F.lit(":"), "line_start", F.lit("** — "), "message",
        F.when(fix.isNotNull() & (fix != ""), F.concat(F.lit("\n  - suggested fix: `"), fix, F.lit("`"))).otherwise(""),
    )


def severity_sections(findings: DataFrame) -> DataFrame:
    """``review_id, severity, n, section``: heading and bullets in finding order; severities without findings have no row."""
    lines = F.array_sort(F.collect_list(F.struct(*ORDER, bullet().alias("text"))))
    grouped = findings.groupBy("review_id", "severity").agg(F.count(F.lit(1)).alias("n"), lines.alias("_l"))
    heading = F.concat(F.lit("### "), title_case(F.col("severity")), F.lit(" ("), "n", F.lit(")\n"))
    return grouped.select("review_id", "severity", "n", F.concat(heading, F.array_join(F.transform("_l", lambda x: x["text"]), "\n"), F.lit("\n")).alias("section"))


def encode_findings(findings: Column) -> Column:
    """An array of findings as base64 of JSON, in one line, so that no text can close the comment around it."""
    raw = F.base64(F.to_json(findings, {"ignoreNullFields": "false"}).cast("binary"))
    return F.regexp_replace(raw, r"[\r\n]", "")


def finding_arrays(findings: DataFrame) -> DataFrame:
    """``review_id, findings``: each review's findings in order, as an array."""
    plain = F.struct(*[F.col(f) for f in FIELDS])
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, plain.alias("f"))))
    return findings.groupBy("review_id").agg(ordered.alias("_l")).select("review_id", F.transform("_l", lambda x: x["f"]).alias("findings"))


def render(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """``review_id, text``: the summary without its state lines; ``reviews`` has the two counters."""
    sections = severity_sections(findings).groupBy("review_id").agg(
        F.array_sort(F.collect_list(F.struct((-severity_rank(F.col("severity"))).alias("o"), "section"))).alias("_s"), F.sum("n").alias("n")
    )
    joined = reviews.join(sections, "review_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    body = F.when(n == 0, F.lit(NOTHING)).otherwise(F.array_join(F.transform("_s", lambda x: x["section"]), "\n"))
    skipped = F.when(F.col("chunks_skipped") > 0, F.concat(F.lit("; cut short or failed: "), "chunks_skipped")).otherwise("")
    totals = F.concat(F.lit("Findings: "), n, F.lit("; regions looked at: "), "chunks_reviewed", skipped)
    return joined.select("review_id", F.concat(F.lit(f"{MARKER}\n\n{HEADING}\n\n"), body, F.lit("\n"), totals).alias("text"))


def build_bodies(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """``review_id, body``: the rendered summary, the reviewed commit and the encoded findings."""
    texts = render(reviews, findings)
    arrays = finding_arrays(findings)
    joined = texts.join(reviews.select("review_id", "commit_sha"), "review_id").join(arrays, "review_id", "left")
    none = F.array().cast(T.ArrayType(FINDING))
    body = F.concat("text", F.lit("\n<!-- quillet:last-reviewed-sha:"), "commit_sha", F.lit(" -->\n<!-- quillet:findings:"), encode_findings(F.coalesce("findings", none)), F.lit(" -->"))
    return joined.select("review_id", body.alias("body"))


def has_marker(body: Column) -> Column:
    return F.contains(body, F.lit(MARKER))


def first_summary_comment(comments: DataFrame) -> DataFrame:
    """The first comment of each review, in order, that is a summary."""
    return first_of(comments.filter(has_marker(F.col("body"))), ["review_id"], [F.col("ord")])


def last_reviewed_sha(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, SHA_MARKER, 1), F.lit(""))


def prior_findings(summaries: DataFrame) -> DataFrame:
    """``review_id, findings`` of ``summaries(review_id, body)``: all findings of the state line, or none if anything in it is unreadable."""
    packed = F.regexp_extract("body", FINDINGS_MARKER, 1)
    raw = F.when((packed != "") & (F.length(packed) % 4 == 0), F.try_to_binary(packed, F.lit("base64")))
    text = F.try_validate_utf8(raw.cast("string")) if hasattr(F, "try_validate_utf8") else raw.cast("string")
    return decode_findings(summaries.select("review_id", text.alias("_json")), "_json", ["review_id"]).select("review_id", "findings")


def upsert_plan(current: DataFrame, new: DataFrame) -> DataFrame:
    """``review_id, action, ord, body``: edit the summary comment there is, create one where there is none; other reviews stay."""
    there = current.select(F.col("review_id").alias("_r"), F.col("ord"))
    joined = new.join(there, F.col("review_id") == F.col("_r"), "left")
    return joined.select("review_id", F.when(F.col("_r").isNull(), "create").otherwise("edit").alias("action"), "ord", "body")


def apply_upserts(comments: DataFrame, plan: DataFrame) -> DataFrame:
    """The comments table after a plan; a created comment comes after the review's others."""
    edits = plan.filter("action = 'edit'").select("review_id", "ord", F.col("body").alias("_body"))
    edited = comments.join(edits, ["review_id", "ord"], "left").select("review_id", "ord", F.coalesce("_body", "body").alias("body"))
    last = comments.groupBy("review_id").agg(F.max("ord").alias("_last"))
    made = plan.filter("action = 'create'").drop("ord").join(last, "review_id", "left")
    return edited.unionByName(made.select("review_id", (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("ord"), "body"))

