"""The sliced diff scan against a plain loop, over random diffs and cuts."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillet.operators import diff

PIECES = [
    "+++ b/x", "+++ a/y", "+++ plain", "+++ /dev/null", "--- a/x", "@@ -1,2 +7,3 @@", "@@ -1 +40 @@ ctx", "@@@ -1 -1 +9 @@@", "+added", "+", "-gone", " kept", "", "++ odd", "+++odd", "---odd", "\\ No newline", "diff --git a b",
]


def scanned(lines):
    """Changed lines by a loop over the diff."""
    files, path, counter, out = 0, None, 0, set()
    for line in lines:
        if m := re.match(r"\+\+\+ (.+)$", line):
            files, raw = files + 1, m[1]
            path = None if raw == "/dev/null" else raw[2:] if raw[:2] in ("a/", "b/") else raw
        elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", line):
            counter = int(m[1])
        elif path is not None and not line.startswith(("+++", "---")):
            if line.startswith("+"):
                out.add((files, path, counter))
            counter += line.startswith(("+", " ")) or line == ""
    return out


def test_any_cut_gives_the_same_lines(spark):
    rng, rows, want = random.Random(7), [], set()
    for review in range(400):
        weights = [rng.random() ** 2 for _ in PIECES]  # some diffs hardly have headers
        lines = rng.choices(PIECES, weights, k=rng.randrange(1, 40))
        cut = 0
        for i, line in enumerate(lines):
            cut += rng.random() < 0.3
            rows.append((review, i, line, cut))
        want |= {(review, *r) for r in scanned(lines)}
    table = spark.createDataFrame(rows, "review_id long, ord long, line string, cut int").repartition(5)
    sliced = {tuple(r) for r in diff.changed_lines_in_slices(table, F.col("cut")).collect()}
    assert sliced == want and len(want) > 700
    assert {tuple(r) for r in diff.changed_lines(table.drop("cut")).collect()} == want
    assert {tuple(r) for r in diff.changed_lines_in_slices(table.drop("cut")).collect()} == want  # one slice each


def test_one_diff_is_many_tasks(spark):
    """No window but the one over slice states holds a whole review."""
    lines = spark.range(50_000).select(F.floor(F.col("id") / 1_000_000).alias("review_id"), F.col("id").alias("ord"), F.when(F.col("id") == 0, "+++ b/x").when(F.col("id") == 1, "@@ -1 +1 @@").otherwise("+l").alias("line"))
    got = diff.changed_lines_in_slices(lines, F.floor(F.col("ord") / 1000))
    assert got.agg(F.count(F.lit(1)), F.min("line_no"), F.max("line_no")).first() == (49_998, 1, 49_998)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") > 3 and "hashpartitioning(review_id" in plan
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning(review_id" in line and "_slice" not in line]
    assert len(keys) <= 2  # the chain over slices and the part of it since a hunk header


def test_no_diffs(spark):
    assert diff.changed_lines_in_slices(spark.createDataFrame([], "review_id long, ord long, line string")).count() == 0
