"""Lines and blanks against Python's own, and how often a review scans its diffs."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from quillet.functions.text import is_blank, split_lines
from quillet.operators import chunk, diff
from quillet.plans import review


def test_lines_and_blanks_are_pythons(spark):
    signs = ["a", "\n", "\r", "\x0b", "\x1d", "\x85", " ", " ", "　"]
    texts = ["".join(t) for n in range(4) for t in itertools.product(signs, repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines(F.col("t")).alias("lines"), is_blank(F.col("t")).alias("blank")).collect()
    for r in rows:
        assert r.lines == r.t.splitlines(), repr(r.t)
        assert r.blank == (not r.t.split()), repr(r.t)


def test_a_review_scans_its_diffs_once(spark, monkeypatch):
    """What follows the scan reads a written table: no plan after it holds the text of a diff."""
    plans = []
    whole = chunk.chunk_changes

    def seen(changed, *rest):
        plans.append(changed._jdf.queryExecution().optimizedPlan().toString())
        return whole(changed, *rest)

    monkeypatch.setattr(review, "chunk_changes", seen)
    reviews = spark.createDataFrame([(1, 1, "base", "head")], "review_id long, pr_number long, base_sha string, head_sha string")
    diffs = spark.createDataFrame([(1, "base", "+++ b/x.txt\n@@ -1 +1 @@\n+a\n b")], "review_id long, from_sha string, diff_text string")
    files = spark.createDataFrame([(1, "x.txt", ["a", "b"])], "review_id long, path string, lines array<string>")
    made = review.review_changes(reviews, spark.createDataFrame([], "review_id long, ord long, body string"), diffs, files)
    assert [tuple(r) for r in made.chunks.select("path", "start_line", "end_line").collect()] == [("x.txt", 1, 2)]
    assert plans
    assert "diff_text" not in plans[0]
    assert "Generate" not in plans[0]


def test_the_scan_sorts_no_text(spark):
    lines = diff.diff_lines(spark.createDataFrame([(1, "+++ b/x\n@@ -1 +1 @@\n+a")], "review_id long, diff_text string"))
    plan = diff.changed_lines_in_slices(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "diff_text" not in plan
    assert "line#" not in plan
