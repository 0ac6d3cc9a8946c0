"""Plain-text reports: of stored results, and of runs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.findings import at_least
from quillet.operators.summary import ORDER

BROKEN = "The result breaks the schema."

#: Hundredths and a half as doubles that lie below the decimal they stand for, or go to the even digit below it. Only for
#: these do the shortest decimal and the exact value of a double from 0 to 1 round to different hundredths.
_DOWN = [m for m in ((2 * c + 1) / 200 for c in range(100)) if Decimal(f"{m:.2f}") < Decimal(m)]


def two_decimals(x: Column) -> Column:
    """A number from 0 to 1 with two decimals, rounded by its exact value, ties to the even digit."""
    lowered = F.when(x.isin(*_DOWN), x - F.lit(0.001)).otherwise(x)
    return lowered.cast("decimal(20,18)").cast("decimal(20,2)").cast("string")


def severity_line(f: Column) -> Column:
    """One line of a finding struct: severity in upper case, file and line."""
    return F.concat(F.lit("["), F.upper(f["severity"]), F.lit("] "), f["file"], F.lit(":"), f["line_start"])


def finding_text(f: Column) -> Column:
    """The lines of a finding struct in a stored result's report."""
    fix = F.when(F.coalesce(f["suggested_fix"], F.lit("")) != "", F.concat(F.lit("  suggested fix: "), f["suggested_fix"]))
    return F.concat_ws("\n", severity_line(f), F.concat(F.lit("  "), f["message"]), fix, F.concat(F.lit("  confidence: "), two_decimals(f["confidence"])), F.lit(""))


def stored_reports(results: DataFrame, min_severity: str = "suggestion") -> DataFrame:
    """``path, code, text`` of ``read_results`` rows: 0 and the findings of that severity or more in their order, or 1 where a result is not valid."""
    shown = results.withColumn("_shown", F.filter("findings", lambda f: at_least(f["severity"], min_severity)))
    listed = F.concat(F.lit("Listed "), F.size("_shown"), F.lit(" of "), F.size("findings"), F.lit("."))
    text = F.when(F.size("_shown") == 0, F.lit(f"Nothing of severity {min_severity} or more.")).otherwise(F.concat(F.array_join(F.transform("_shown", finding_text), "\n"), F.lit("\n"), listed))
    valid = F.col("is_valid")
    return shown.select("path", F.when(valid, 0).otherwise(1).cast("long").alias("code"), F.when(valid, text).otherwise(F.lit(BROKEN)).alias("text"))


def run_reports(results: DataFrame, findings: DataFrame) -> DataFrame:
    """``review_id, text``: what a run looked at, by counters and the commit's first eight signs, and a line for each finding in order."""
    line = F.concat(severity_line(F.struct("severity", "file", "line_start")), F.lit(" "), "message")
    lines = findings.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, line.alias("line")))).alias("_l"))
    head = F.concat(F.lit("Reviewed "), "chunks_reviewed", F.lit(" chunk(s) of "), F.substring("commit_sha", 1, 8), F.lit(", "), "chunks_skipped", F.lit(" skipped."))
    each = F.coalesce(F.transform("_l", lambda x: x["line"]), F.array().cast("array<string>"))
    return results.join(lines, "review_id", "left").select("review_id", F.array_join(F.concat(F.array(head), each), "\n").alias("text"))
