from __future__ import annotations

import json

from quillet.operators.summary import apply_upserts
from quillet.streaming.runs import review_pushes

PUSH = "review_id long, pr_number long, base_sha string, head_sha string, pushed_at long"


def test_each_batch_is_a_run(spark, tmp_path):
    source, state = tmp_path / "pushes", {"comments": spark.createDataFrame([], "review_id long, ord long, body string")}
    source.mkdir()
    diffs = spark.createDataFrame([(1, "b0", "+++ b/x.txt\n@@ -1 +1 @@\n+one\n"), (1, "aa2", "\n")], "review_id long, from_sha string, diff_text string")
    files = spark.createDataFrame([(1, "x.txt", ["one"], True)], "review_id long, path string, lines array<string>, is_readable boolean")
    seen = []

    def post(made):
        seen.append([(r.commit_sha, r.chunks_reviewed) for r in made.results.collect()])
        rows = [tuple(r) for r in apply_upserts(state["comments"], made.plan).select("review_id", "ord", "body").collect()]
        state["comments"] = spark.createDataFrame(rows, "review_id long, ord long, body string")

    def run():
        pushes = spark.readStream.schema(PUSH).json(str(source))
        review_pushes(pushes, lambda _: state["comments"], lambda _: diffs, lambda _: files, post, str(tmp_path / "checkpoint"), min_severity="info").awaitTermination()

    push = lambda name, rows: (source / name).write_text("\n".join(json.dumps(dict(zip(("review_id", "pr_number", "base_sha", "head_sha", "pushed_at"), r, strict=True))) for r in rows))
    push("a.json", [(1, 9, "b0", "aa1", 1), (1, 9, "b0", "aa2", 2)])
    run()
    push("b.json", [(1, 9, "b0", "aa3", 3)])
    run()
    assert seen == [[("aa2", 1)], [("aa3", 0)]]
    (body,) = [r.body for r in state["comments"].collect()]
    assert "aa3" in body and "Findings: 1; regions looked at: 0" in body
