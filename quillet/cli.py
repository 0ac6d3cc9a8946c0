"""Command line: ``local`` shows a stored result, ``dry-run`` tries a file, ``pr`` reviews a checkout."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillet.functions.findings import SEVERITIES
from quillet.functions.text import split_lines
from quillet.operators.blocks import BlockSyntax
from quillet.operators.report import run_reports, stored_reports
from quillet.operators.review import dry_run, dry_run_source, flatten
from quillet.operators.summary import apply_upserts
from quillet.plans.review import needed_files, review_changes
from quillet.runtime import build_session, materialize
from quillet.sources.files import COMMENTS, read_results
from quillet.sources.git import GitDiffSource, read_committed


def local(spark: SparkSession, path: str, min_severity: str = "suggestion") -> tuple[int, list[str]]:
    """Exit code and lines for a stored result."""
    reports = stored_reports(read_results(spark, path), min_severity).collect()  # one stored result
    return max(r.code for r in reports), [line for r in reports for line in r.text.split("\n")]


def try_file(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """A whole file through the dry run."""
    source = spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("review_id"), F.lit(path).alias("path"), split_lines(F.col("value")).alias("lines"))
    found = flatten(dry_run(dry_run_source(source))).collect()
    lines = [f"  {f.file}:{f.line_start} [{f.severity}] {f.message}" for f in found]
    return 0, ["Dry run of one chunk; no model was asked.", *lines, "", f"{len(found)} made-up finding(s)."]


def change(spark: SparkSession, args: argparse.Namespace) -> tuple[int, list[str]]:
    """A dry review of a checkout; comments are a Parquet table that is read and, unless told otherwise, written anew."""
    spark.dataSource.register(GitDiffSource)
    reviews = spark.createDataFrame([(0, args.number, args.base, args.head)], "review_id long, pr_number long, base_sha string, head_sha string")
    comments = spark.read.schema(COMMENTS).parquet(args.comments) if args.comments else spark.createDataFrame([], COMMENTS)
    from quillet.operators.summary import first_summary_comment, last_reviewed_sha

    since = first_summary_comment(comments).select(last_reviewed_sha(F.col("body"))).head(1)
    changes = f"0 {args.base} {args.head} {since[0][0] or '' if since else ''}"
    diffs = spark.read.format("git_diff").option("repo_root", args.repo_root).option("changes", changes).load().select("review_id", "from_sha", "diff_text")
    diffs = materialize(diffs, "diffs")
    files = materialize(read_committed(args.repo_root, needed_files(reviews, comments, diffs)), "files")  # as of the head, only those that matter
    made = review_changes(reviews, comments, diffs, files, provider=BlockSyntax(), min_severity=args.min_severity)
    if args.out and not args.no_post:
        apply_upserts(comments, made.plan.select("review_id", "action", "ord", "body")).write.parquet(args.out)
    return 0, run_reports(made.results, made.findings).first().text.split("\n")  # one change


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillet")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("local")
    p.add_argument("findings_json")
    p.add_argument("--min-severity", choices=SEVERITIES, default="suggestion")
    p = commands.add_parser("dry-run")
    p.add_argument("file")
    p = commands.add_parser("pr")
    p.add_argument("--repo-root", default=".")
    p.add_argument("--number", type=int, required=True)
    p.add_argument("--base", required=True)
    p.add_argument("--head", required=True)
    p.add_argument("--comments")
    p.add_argument("--out")
    p.add_argument("--no-post", action="store_true")
    p.add_argument("--min-severity", choices=SEVERITIES, default="suggestion")
    args = parser.parse_args(argv)
    spark = spark or build_session()
    code, lines = local(spark, args.findings_json, args.min_severity) if args.command == "local" else try_file(spark, args.file) if args.command == "dry-run" else change(spark, args)
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    sys.exit(main())
