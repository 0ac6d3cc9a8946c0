"""Golden cases of the review operators."""

from __future__ import annotations

import json
import re
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.cli import main
from quillet.functions.findings import FINDING, at_least, decode_findings, violations
from quillet.functions.text import collapse, split_lines, token_estimate
from quillet.operators import boundaries, chunk, diff, ground, review, summary
from quillet.operators.carry import carry_forward
from quillet.plans.review import review_changes
from quillet.sources.files import read_files, read_results
from quillet.sources.git import GitDiffSource

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import the tests

FILES = "review_id long, path string, lines array<string>, is_readable boolean"
ROW = "review_id long, origin int, chunk_ord long, finding_ord long, file string, line_start long, line_end long, severity string, category string, message string, suggested_fix string, code_snippet string, confidence double"


def row(file="a.py", start=1, end=None, severity="warning", message="m", fix=None, snippet="", confidence=0.8, review_id=1, origin=0, ord_=0):
    return (review_id, origin, 0, ord_, file, start, end or start, severity, "bug", message, fix, snippet, confidence)


def parsed(spark, text):
    rows = diff.changed_lines(diff.diff_lines(spark.createDataFrame([(1, text)], "review_id long, diff_text string"))).collect()
    return sorted((r.file_seq, r.path, r.line_no) for r in rows)


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f ", "\n\n", "é x"])
def test_split_lines_is_python(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(split_lines(F.col("t")).alias("x"), collapse(F.col("t")).alias("c")).first()
    assert got.x == text.splitlines()
    assert got.c == " ".join(text.split())


def test_token_estimate(spark):
    got = spark.createDataFrame([("",), ("abc",), ("x" * 41,)], "t string").select(token_estimate(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [1, 1, 10]


def test_diff_added_deleted_and_removed(spark):
    head = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,4 @@\n"
    assert parsed(spark, head + " a\n b\n+c\n+d\n") == [(1, "x", 3), (1, "x", 4)]
    assert parsed(spark, "--- a/x\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n") == []
    assert parsed(spark, "--- a/x\n+++ b/x\n@@ -1,2 +1,1 @@\n a\n-b\n") == []


def test_diff_quirks(spark):
    # text that looks like a header, a skipped "++" line, a path that comes twice, a counter that file headers don't reset
    text = "+++ b/x\n@@ -1 +5 @@\n+a\n+++b\n+c\n+++ b/x\n+d\n\\ No newline at end of file\n\n+e\n"
    assert parsed(spark, text) == [(1, "x", 5), (1, "x", 6), (2, "x", 7), (2, "x", 9)]


@pytest.mark.parametrize(("ranges", "want"), [([(1, 5), (4, 10), (20, 25)], [(1, 10), (20, 25)]), ([(1, 5), (6, 10)], [(1, 10)]), ([(1, 5), (1, 5), (2, 3)], [(1, 5)]), ([], [])])
def test_merge(spark, ranges, want):
    df = spark.createDataFrame([(1, 1, "x", a, b) for a, b in ranges], "review_id long, file_seq long, path string, start_line long, end_line long")
    assert sorted((r.start_line, r.end_line) for r in chunk.merge_ranges(df).collect()) == want


def chunks_of(spark, lines, changed, path="x.txt", budget=6000, provider=None):
    c = spark.createDataFrame([(1, 1, path, n) for n in changed], "review_id long, file_seq long, path string, line_no long")
    f = spark.createDataFrame([(1, path, lines, True)], FILES)
    return [(r.start_line, r.end_line, r.content, r.is_partial) for r in chunk.chunk_changes(c, f, provider, budget).orderBy("chunk_ord").collect()]


def test_heuristic_chunks(spark):
    lines = ["a", "b", "", "c", "d", "e"]
    assert chunks_of(spark, lines, [5]) == [(4, 6, "c\nd\ne", False)]
    assert chunks_of(spark, lines, [3]) == [(1, 6, "\n".join(lines), False)]  # a blank line takes both blocks
    assert chunks_of(spark, lines, [0, 7]) == []
    assert chunks_of(spark, lines, [5], path="y.txt") == [(4, 6, "c\nd\ne", False)]


def test_truncation(spark):
    got = chunks_of(spark, [f"line {i}" for i in range(200)], [7], budget=10)
    assert got[0][:2] == (1, 200) and got[0][3]
    assert got[0][2] == "\n".join(f"line {i}" for i in range(5))
    assert chunks_of(spark, ["x" * 100, "y"], [1], budget=10) == [(1, 2, "", True)]


def test_missing_and_unreadable_files_have_no_chunks(spark):
    c = spark.createDataFrame([(1, 1, "gone", 1), (1, 2, "dir", 1)], "review_id long, file_seq long, path string, line_no long")
    f = spark.createDataFrame([(1, "dir", ["a"], False)], FILES)
    assert chunk.chunk_changes(c, f).count() == 0


def test_python_boundaries(spark):
    provider = boundaries.PythonSyntax()
    imports = [f"import m{i}" for i in range(25)]
    assert [x[:2] for x in chunks_of(spark, imports, [12], "x.py", provider=provider)] == [(2, 22)]
    code = ["def f():", "    a = 1", "    return a", "", "def g():", "    return 2"]
    assert [x[:2] for x in chunks_of(spark, code, [2], "x.py", provider=provider)] == [(1, 3)]
    assert [x[:2] for x in chunks_of(spark, ["def f(:", "", "x"], [3], "x.py", provider=provider)] == [(3, 3)]  # doesn't parse
    klass = ["class A:", *[line for k in range(3) for line in (f"    def m{k}(self):", *["        x = 1"] * 10)]]
    assert [x[:2] for x in chunks_of(spark, klass, [3], "x.py", budget=60, provider=provider)] == [(2, 12)]


def test_language(spark):
    paths = ["a.py", "b/c.tsx", "x.PY", ".py", "d.tar.rs", "noext", "a.b/c", "end."]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(boundaries.language(F.col("p")).alias("l")).collect()
    assert [r.l for r in got] == ["python", "tsx", None, None, "rust", None, None, None]


def test_grounding_outcomes(spark):
    files = spark.createDataFrame([(1, "a.py", ["one", "two  words", "three", "four", "five"], True), (1, "dir", ["x"], False)], FILES)
    found = [
        row(snippet="one"), row("gone.py"), row(start=50), row(start=5, snippet="one", ord_=3), row(start=3, snippet="one"), row(start=2, snippet="two words"),
        row("dir"), row("../a.py"), row("./a.py", snippet="one"), row(start=4, snippet="four", message="no"),
    ]
    seen = []

    def verifier(df):
        seen.append(df.columns)
        return df.withColumn("is_valid", F.col("message") != "no")

    out = ground.ground(spark.createDataFrame(found, ROW), files, verifier).collect()
    got = sorted((r.file, r.line_start, r.code_snippet, r.outcome, r.reason or "", r.confidence) for r in out)
    assert got == sorted(
        [
            ("a.py", 1, "one", "grounded", "", 0.8), ("gone.py", 1, "", "dropped", "file_not_found", 0.8), ("a.py", 50, "", "dropped", "line_out_of_range", 0.8),
            ("a.py", 5, "one", "downweighted", "", 0.4), ("a.py", 3, "one", "grounded", "", 0.8), ("a.py", 2, "two words", "grounded", "", 0.8), ("dir", 1, "", "dropped", "file_unreadable", 0.8),
            ("../a.py", 1, "", "dropped", "file_not_found", 0.8), ("./a.py", 1, "one", "grounded", "", 0.8), ("a.py", 4, "four", "dropped", "verifier_rejected", 0.8),
        ]
    )
    assert "context" in seen[0]


def test_carry_forward(spark):
    files = spark.createDataFrame([(1, "a.py", ["one", "two"], True)], FILES)
    new = spark.createDataFrame([row(message="new"), row(message="new too")], ROW)
    prior = spark.createDataFrame([(*row(message="old"), "s"), (*row(start=2, message="kept"), "s"), (*row("gone", message="dropped"), "s"), (*row(start=2, message="no sha"), None)], ROW + ", since_sha string")
    got = sorted((r.origin, r.message) for r in carry_forward(new, prior, files).collect())
    assert got == [(0, "new"), (0, "new too"), (1, "kept")]


def test_violations_and_severity(spark):
    bad = [row(start=3, end=2), row(confidence=1.5), row(message=""), row()]
    df = spark.createDataFrame(bad, ROW).select(violations().alias("v"), at_least(F.col("severity"), "critical").alias("c"))
    assert [r.v for r in df.collect()] == [["line_end"], ["confidence"], ["message"], []]
    assert not any(r.c for r in df.collect())


VALID = {"file": "a", "line_start": "10", "line_end": 10.0, "severity": "info", "category": "bug", "message": "m", "code_snippet": "", "confidence": "0.5", "other": 1}


@pytest.mark.parametrize(
    ("change", "good"),
    [({}, True), ({"line_start": True}, True), ({"line_start": 10.5}, False), ({"file": 3}, False), ({"confidence": True}, True), ({"suggested_fix": None}, True), ({"suggested_fix": 4}, False), ({"line_end": None}, False), ({"severity": "x"}, False)],
)
def test_lax_decoding(spark, change, good):
    text = json.dumps([VALID, VALID | change])
    r = decode_findings(spark.createDataFrame([(1, text)], "k int, j string"), "j", ["k"]).first()
    assert r.readable is good and len(r.findings) == (2 if good else 0)
    if good:
        assert r.findings[0].line_start == 10 and r.findings[0].confidence == 0.5


def test_state_codec(spark):
    reviews = spark.createDataFrame([(1, 7, "abc123", 2, 1), (2, 8, "def", 0, 0)], "review_id long, pr_number long, commit_sha string, chunks_reviewed long, chunks_skipped long")
    found = spark.createDataFrame([row(message="a --> b é " + "x" * 200, fix="f", severity="info"), row(message="worse", severity="critical", ord_=1)], ROW)
    bodies = {r.review_id: r.body for r in summary.build_bodies(reviews, found).collect()}
    assert bodies[1].index("### Critical (1)") < bodies[1].index("### Info (1)") and "Findings: 2; regions looked at: 2; cut short or failed: 1" in bodies[1]
    assert "Nothing to report on this change." in bodies[2]
    cases = [(1, bodies[1]), (2, bodies[2]), (3, bodies[1].replace("findings:", "findings:=")), (4, "plain"), (5, "<!-- quillet:findings:aGVsbG8 -->"), (6, "<!-- quillet:findings://///w== -->")]
    back = {r.review_id: r.findings for r in summary.prior_findings(spark.createDataFrame(cases, "review_id long, body string")).collect()}
    assert [f.message for f in back[1]] == ["a --> b é " + "x" * 200, "worse"] and back[1][0].suggested_fix == "f" and back[1][1].suggested_fix is None
    assert all(back[k] == [] for k in (2, 3, 4, 5, 6))
    sha = spark.createDataFrame(cases, "review_id long, body string").select("review_id", summary.last_reviewed_sha(F.col("body")).alias("s")).collect()
    assert {r.review_id: r.s for r in sha} == {1: "abc123", 2: "def", 3: "abc123", 4: None, 5: None, 6: None}


def fake():
    """A transport that fails in the ways the prompt asks for; its class travels by value."""

    class Fake:
        def __init__(self):
            self.tried = {}

        def complete(self, system, prompt, max_tokens, schema, timeout):
            n = self.tried[prompt] = self.tried.get(prompt, 0) + 1
            if "busy" in prompt and n < 3:
                raise review.RateLimited
            if "down" in prompt:
                raise review.StatusError(503)
            if "denied" in prompt:
                raise review.StatusError(400)
            if schema is None:
                return '{"is_valid": "false"}' if "odd" in prompt else "no json" if "mute" in prompt else '{"is_valid": false}'
            if "garbled" in prompt and n < 2:
                return "{"
            return json.dumps({"chunk_id": "c", "findings": [VALID]})

    return Fake()


def test_live_review_and_verify(spark):
    names = "review_id long, chunk_ord long, chunk_id string, file string, start_line long, end_line long, content string, is_partial boolean"
    chunks = spark.createDataFrame([(1, i, f"c{i}", f"{w}.py", 1, 1, w, False) for i, w in enumerate(["fine", "busy", "down", "garbled"])], names)
    out = review.live_review(chunks, fake, sleep=lambda s: None).orderBy("chunk_ord").collect()
    assert [(r.is_failed, len(r.findings)) for r in out] == [(False, 1), (False, 1), (True, 0), (False, 1)]
    with pytest.raises(Exception, match="status 400"):
        review.live_review(chunks.limit(1).withColumn("content", F.lit("denied")), fake, sleep=lambda s: None).collect()
    found = spark.createDataFrame([(*row(message=m), "ctx") for m in ("odd", "plain", "mute", "down")], ROW + ", context string")
    assert {r.message: r.is_valid for r in review.live_verify(found, fake, sleep=lambda s: None).collect()} == {"odd": True, "plain": False, "mute": False, "down": False}


def test_backoff_delays():
    waits = []

    def call():
        raise review.RateLimited

    assert review._attempts(call, review.Limits(), waits.append, (ValueError,)) == (False, None)
    assert waits == [2.0, 4.0, 8.0]


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "repo"
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    root.mkdir()
    git("init", "-q", "-b", "main")
    (root / "a.py").write_text("def f():\n    return 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    base = git("rev-parse", "HEAD")
    (root / "a.py").write_text("def f():\n    return 2\n")
    git("commit", "-qam", "two")
    return root, base, git("rev-parse", "HEAD"), git


def test_git_source(spark, checkout):
    root, base, head, git = checkout
    spark.dataSource.register(GitDiffSource)
    read = lambda changes: spark.read.format("git_diff").option("repo_root", str(root)).option("changes", changes).load()
    r = read(f"3 {base} {head}\n4 {base} {head} {head}").orderBy("review_id").collect()
    assert "+    return 2" in r[0].diff_text and r[0].from_sha == base and r[1].diff_text == "" and r[1].from_sha == head
    with pytest.raises(Exception, match="git diff"):
        read(f"3 {'0' * 40} {head}").collect()
    (root / "a.py").write_text("local\n")
    assert "+local" in spark.read.format("git_diff").option("repo_root", str(root)).option("base_ref", "main").load().first().diff_text


def test_two_runs(spark, checkout, tmp_path, capsys):
    root, base, head, git = checkout
    out = str(tmp_path / "comments")
    assert main(["pr", "--repo-root", str(root), "--number", "5", "--base", base, "--head", head, "--out", out, "--min-severity", "info"], spark) == 0
    assert "Reviewed 1 chunk(s)" in capsys.readouterr().out
    again = str(tmp_path / "again")
    assert main(["pr", "--repo-root", str(root), "--number", "5", "--base", base, "--head", head, "--comments", out, "--out", again, "--min-severity", "info"], spark) == 0
    assert "Reviewed 0 chunk(s)" in capsys.readouterr().out
    bodies = [r.body for r in spark.read.parquet(again).collect()]
    assert len(bodies) == 1 and "Findings: 1; regions looked at: 0" in bodies[0]  # carried over, in the one comment


def test_local_results(spark, tmp_path, capsys):
    good = {"pr_number": 4, "commit_sha": "abc", "findings": [VALID | {"severity": s} for s in ("info", "critical", "suggestion")]}
    (tmp_path / "r.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps(good | {"findings": [{"file": "x"}]}))
    assert main(["local", str(tmp_path / "r.json")], spark) == 0
    assert "Listed 2 of 3." in capsys.readouterr().out
    assert main(["local", str(tmp_path / "r.json"), "--min-severity", "critical"], spark) == 0
    assert "Listed 1 of 3." in capsys.readouterr().out
    assert main(["local", str(tmp_path / "bad.json")], spark) == 1
    r = read_results(spark, str(tmp_path / "r.json")).first()
    assert (r.pr_number, r.chunks_reviewed, len(r.findings)) == (4, 0, 3)


def test_dry_run_command(spark, tmp_path, capsys):
    (tmp_path / "s.py").write_text("first\nsecond\n")
    assert main(["dry-run", str(tmp_path / "s.py")], spark) == 0
    assert "1 made-up finding(s)." in capsys.readouterr().out


def test_read_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"one\ntw\xffo\n")
    r = read_files(spark, str(tmp_path)).first()
    assert (r.path, r.lines, r.is_readable) == ("d/a.txt", ["one", "tw�o"], True)


def test_read_files_of_any_name(spark, tmp_path):
    names = ["a.py", "__init__.py", "_util.py", ".eslintrc.js", ".github/w.yml", "dir/x"]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("one\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("x")
    assert sorted(r.path for r in read_files(spark, str(tmp_path)).collect()) == sorted(names)
    some = {r.path: r.is_readable for r in read_files(spark, str(tmp_path), paths=["__init__.py", "dir", "gone", "../" + tmp_path.name + "/../x"]).collect()}
    assert some == {"__init__.py": True, "dir": False}
    changed = spark.createDataFrame([(0, 1, "__init__.py", 1)], "review_id long, file_seq long, path string, line_no long")
    assert chunk.chunk_changes(changed, read_files(spark, str(tmp_path))).count() == 1


def test_files_are_parsed_and_findings_verified_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def noted(word, name):
        def rows(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.write(f"{word}\n" * b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([True] * b.num_rows)], names=[*b.schema.names, name])

        return lambda df: df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())]))

    class Syntax(boundaries.PythonSyntax):
        def nodes(self, files):
            return super().nodes(noted("parse", "seen")(files).drop("seen"))

    code = ["def f():", "    return 1", "", "def g():", "    return 2"]
    files = spark.createDataFrame([(1, f"m{i}.py", code, True) for i in range(10)], FILES)
    reviews = spark.createDataFrame([(1, 7, "a", "b")], "review_id long, pr_number long, base_sha string, head_sha string")
    diffs = spark.createDataFrame([(1, sha, "+++ b/m3.py\n@@ -1,2 +1,2 @@\n def f():\n+    return 1\n") for sha in ("a", "b")], "review_id long, from_sha string, diff_text string")
    comments = spark.createDataFrame([], "review_id long, ord long, body string")
    for new in (1, 2):  # the second run has a prior finding, too
        made = review_changes(reviews, comments, diffs, files, verifier=noted("verify", "is_valid"), provider=Syntax(), min_severity="info")
        assert [(r.start_line, r.end_line) for r in made.chunks.collect()] == [(1, 2)]
        assert made.grounded.count() == made.findings.count() == made.posted.count() == 1
        assert made.plan.count() == 1
        with open(log) as f:
            calls = f.read().split()
        assert (calls.count("parse"), calls.count("verify")) == ((1, 1), (2, 3))[new - 1]
        comments = spark.createDataFrame([(1, 1, made.plan.first().body)], "review_id long, ord long, body string")


def test_empty_tables(spark):
    empty = lambda s: spark.createDataFrame([], s)
    made = review_changes(empty("review_id long, pr_number long, base_sha string, head_sha string"), empty("review_id long, ord long, body string"), empty("review_id long, from_sha string, diff_text string"), empty(FILES))
    assert made.plan.count() == made.findings.count() == made.results.count() == 0
    assert len(FINDING.names) == 9


@pytest.mark.parametrize("size", [1, 3, 200])
def test_lines_by_block(spark, size):
    lines = {"a": [f"l{i}" for i in range(1, 42)], "b": ["only"], "c": [], "d": None}
    files = spark.createDataFrame([(1, p, x) for p, x in lines.items()], "review_id long, path string, lines array<string>")
    asked = [("a", 1, 41), ("a", 3, 3), ("a", 5, 9), ("a", 41, 41), ("b", 1, 1), ("gone", 1, 1)]
    table = spark.createDataFrame([(1, *x) for x in asked], "review_id long, path string, low long, high long")
    got = {(r.path, r.low, r.high): r.lines for r in ground.lines_between(table, ground.file_blocks(files, size), size).collect()}
    assert got == {(p, a, b): lines[p][a - 1 : b] for p, a, b in asked if p != "gone"}


def test_findings_of_a_very_long_file(spark):
    """Contexts come by block: the file's lines meet no finding row and aren't shuffled whole."""
    n = 200_000
    files = spark.range(1).select(F.lit(1).cast("long").alias("review_id"), F.lit("big.txt").alias("path"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line "), i)).alias("lines"), F.lit(True).alias("is_readable"))
    at = F.col("id") * 97 + 1
    found = spark.range(2000).select(F.lit(1).cast("long").alias("review_id"), F.lit("big.txt").alias("file"), at.alias("line_start"), (at + 1).alias("line_end"), F.concat(F.lit("line "), at).alias("code_snippet"), F.lit(0.5).alias("confidence"))
    got = ground.ground(found, files)
    assert {(r.outcome, r["count"]) for r in got.groupBy("outcome").count().collect()} == {("grounded", 2000)}
    looked = ground.with_context(found, files)
    assert looked.agg(F.max(F.length("context"))).first()[0] < 100
    plan = looked._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Generate explode(CASE WHEN (size(lines")[0]
    assert re.search(r"BroadcastHashJoin \[[^]]*block", above)  # the blocks that are asked for, before any exchange of lines
