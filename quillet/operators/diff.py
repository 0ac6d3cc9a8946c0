"""Unified diffs to changed lines: an ordered scan as running sums.

``changed_lines`` scans each diff as a whole. ``changed_lines_in_slices`` scans
slices of it in tasks of their own: a slice is summed up by what it does to the
state that it is entered with, the sums are chained, and each slice is finished from
the state that the slices before it leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.text import is_blank, split_lines
from quillet.runtime import materialize

# Header formats of unified diffs.
FILE_HEADER = r"^\+\+\+ (.+)$"
HUNK_HEADER = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
DELETED = "/dev/null"


def resolve_from_sha(since_sha: Column, base_sha: Column) -> Column:
    """The commit to compare from: the last reviewed one, else the base."""
    return F.coalesce(F.nullif(since_sha, F.lit("")), base_sha)


def has_changes(diff_text: Column) -> Column:
    return ~is_blank(F.coalesce(diff_text, F.lit("")))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """``review_id, ord, line`` of ``diffs(review_id, diff_text)``."""
    return diffs.select("review_id", F.posexplode(split_lines(F.col("diff_text"))).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))


def new_path(raw: Column) -> Column:
    """The path of a file header; null for a deleted file."""
    return F.when(raw == DELETED, F.lit(None)).when(raw.startswith("a/") | raw.startswith("b/"), F.substring(raw, 3, 2**31 - 1)).otherwise(raw)


def changed_lines(lines: DataFrame) -> DataFrame:
    """``review_id, file_seq, path, line_no`` of each added line, from ``review_id, ord, line``.

    A file header is seen before anything else; the line counter restarts at hunk
    headers only and stands still outside a file.
    """
    review = Window.partitionBy("review_id").orderBy("ord")
    header, hunk = F.regexp_extract("line", FILE_HEADER, 1), F.regexp_extract("line", HUNK_HEADER, 1)
    kinds = lines.withColumns({"_file": F.when(header != "", header), "_start": F.when((header == "") & (hunk != ""), hunk.cast("long"))})
    running = kinds.withColumns(
        {
            "file_seq": F.count("_file").over(review).cast("long"),
            "_hunk": F.count("_start").over(review),
        }
    )
    in_file, in_hunk = Window.partitionBy("review_id", "file_seq"), Window.partitionBy("review_id", "_hunk")
    running = running.withColumns({"path": new_path(F.max("_file").over(in_file)), "_base": F.coalesce(F.max("_start").over(in_hunk), F.lit(0))})
    body = F.col("path").isNotNull() & F.col("_file").isNull() & F.col("_start").isNull() & ~F.col("line").startswith("+++") & ~F.col("line").startswith("---")
    steps = body & (F.col("line").startswith("+") | F.col("line").startswith(" ") | (F.col("line") == ""))
    before = in_hunk.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    numbered = running.withColumn("_step", steps.cast("long")).withColumn("line_no", F.col("_base") + F.coalesce(F.sum("_step").over(before), F.lit(0)))
    added = numbered.filter((F.col("_step") == 1) & F.col("line").startswith("+"))
    return added.select("review_id", "file_seq", "path", "line_no").distinct()


#: Lines of a slice where the caller names none.
SLICE_LINES = 20_000


def changed_lines_in_slices(lines: DataFrame, slice_no: Column | None = None) -> DataFrame:
    """The rows of ``changed_lines``, of diffs that are cut into slices at any line.

    ``slice_no`` ascends with ``ord`` within a review. The state between lines is the
    number of files, the path and the line counter. Within a slice, lines before its
    first file header belong to a file that only the slices before it know: their
    steps are summed apart, and count if that file turns out to have a path. Lines
    before its first hunk header are numbered from the counter it is entered with.
    """
    of = ["review_id", "_slice"]
    at = F.floor(F.col("ord") / SLICE_LINES) if slice_no is None else slice_no
    text, first = F.col("line"), F.substring("line", 1, 1)
    header = F.when(text.startswith("+++ "), F.regexp_extract("line", FILE_HEADER, 1)).otherwise("")  # most lines spare the patterns
    hunk = F.when(text.startswith("@@ -"), F.regexp_extract("line", HUNK_HEADER, 1)).otherwise("")
    kinds = lines.select("review_id", "ord", at.cast("long").alias("_slice"), F.nullif(header, F.lit("")).alias("_file"), F.nullif(hunk, F.lit("")).cast("long").alias("_start"), (first == "+").alias("_plus"), ~text.startswith("+++") & ~text.startswith("---") & (first.isin("+", " ") | (text == "")))
    kinds = materialize(kinds.toDF(*kinds.columns[:-1], "_body"), "diff-kinds")  # texts end here: what is sorted and chained are signs and numbers
    within = Window.partitionBy(*of).orderBy("ord")
    counted = kinds.withColumns({"_files": F.count("_file").over(within), "_hunks": F.count("_start").over(within)})
    counted = counted.withColumns({"_own": new_path(F.max("_file").over(Window.partitionBy(*of, "_files"))), "_base": F.max("_start").over(Window.partitionBy(*of, "_hunks"))})
    moves = F.col("_file").isNull() & F.col("_start").isNull() & F.col("_body")
    known, open_ = (moves & (F.col("_files") > 0) & F.col("_own").isNotNull()).cast("long"), (moves & (F.col("_files") == 0)).cast("long")
    stepped = counted.withColumns({"_known": known, "_open": open_})
    before = Window.partitionBy(*of, "_hunks").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    stepped = stepped.withColumns({"_known_before": F.coalesce(F.sum("_known").over(before), F.lit(0)), "_open_before": F.coalesce(F.sum("_open").over(before), F.lit(0))})

    entered = _entered_states(stepped)
    joined = stepped.join(entered, of)
    added = joined.filter(F.col("_plus") & ((F.col("_known") == 1) | ((F.col("_open") == 1) & F.col("_in_path").isNotNull())))
    number = F.coalesce("_base", "_in_counter") + F.col("_known_before") + F.when(F.col("_in_path").isNotNull(), F.col("_open_before")).otherwise(0)
    path = F.when(F.col("_files") > 0, F.col("_own")).otherwise(F.col("_in_path"))
    return added.select("review_id", (F.col("_in_files") + F.col("_files")).cast("long").alias("file_seq"), path.alias("path"), number.alias("line_no")).distinct()


def _entered_states(stepped: DataFrame) -> DataFrame:
    """``review_id, _slice, _in_files, _in_path, _in_counter``: the state each slice is entered with, one row per slice."""
    hunks = stepped.groupBy("review_id", "_slice", "_hunks").agg(
        F.count("_file").alias("files"), F.max_by("_file", F.when(F.col("_file").isNotNull(), F.col("ord"))).alias("file"), F.max("_start").alias("base"), F.sum("_known").alias("known"), F.sum("_open").alias("open")
    )
    named = F.when(F.col("file").isNotNull(), F.col("_hunks"))
    slices = hunks.groupBy("review_id", "_slice").agg(F.sum("files").alias("files"), F.max_by("file", named).alias("file"), F.max(F.struct("_hunks", "base", "known", "open")).alias("end"))
    order = Window.partitionBy("review_id").orderBy("_slice")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    chained = slices.select(
        "review_id", "_slice", F.coalesce(F.sum("files").over(earlier), F.lit(0)).alias("_in_files"), new_path(F.last("file", ignorenulls=True).over(earlier)).alias("_in_path"),
        "end", F.sum((F.col("end._hunks") > 0).cast("long")).over(order).alias("_reset"),
    )
    since = Window.partitionBy("review_id", "_reset")  # a slice with a hunk header and those after it that have none
    steps = F.col("end.known") + F.when(F.col("_in_path").isNotNull(), F.col("end.open")).otherwise(0)
    left = F.coalesce(F.max("end.base").over(since), F.lit(0)) + F.sum(steps).over(since.orderBy("_slice"))
    return chained.withColumn("_out", left).select("review_id", "_slice", "_in_files", "_in_path", F.lag("_out", 1, 0).over(order).alias("_in_counter"))


def file_groups(changed: DataFrame) -> DataFrame:
    """One row per file of a diff that has added lines."""
    return changed.groupBy("review_id", "file_seq", "path").agg(F.count(F.lit(1)).alias("n_changed"))
