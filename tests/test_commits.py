"""Files as of commits, in a real repository."""

from __future__ import annotations

import subprocess

import pytest

from quillet.operators import ground
from quillet.plans.review import needed_files, review_changes
from quillet.sources.git import GitDiffError, change_diff, committed_files, read_committed


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    shas = []
    for k in range(3):
        (root / "src").mkdir(exist_ok=True)
        (root / "src" / "a b.go").write_text(f"package p\n\nfunc F{k}() {{\n\treturn {k}\n}}\n")
        (root / "src" / "other.txt").write_bytes(b"caf\xe9\n")
        (root / f"only{k}.txt").write_text("x\n")
        git("add", "-A")
        git("commit", "-qm", str(k))
        shas.append(git("rev-parse", "HEAD"))
    return str(root), shas


def wanted(spark, rows):
    return spark.createDataFrame(rows, "review_id long, head_sha string, path string")


def test_each_review_sees_its_commit(spark, repo):
    root, shas = repo
    rows = [(k, sha, p) for k, sha in enumerate(shas) for p in ("src/a b.go", "./src/a b.go", "src", "gone", "only1.txt", "/etc/passwd", "../x", "src/../only0.txt", "", None)]
    got = {(r.review_id, r.path): r for r in read_committed(root, wanted(spark, rows)).collect()}
    assert set(got) == {(k, p) for k in range(3) for p in ("src/a b.go", "src", "")} | {(1, "only1.txt"), (2, "only1.txt")}
    for k in range(3):
        assert got[k, "src/a b.go"].lines[2] == f"func F{k}() {{" and got[k, "src/a b.go"].is_readable
        assert got[k, "src"].lines is None and not got[k, "src"].is_readable
    text = read_committed(root, wanted(spark, [(1, shas[0], "src/other.txt")])).first()
    assert text.lines == ["caf�"]
    assert read_committed(root, wanted(spark, [])).count() == 0


def test_an_unknown_commit_is_an_error(spark, repo):
    root, shas = repo
    with pytest.raises(GitDiffError):
        list(committed_files(root, [(1, shas[0], "src"), (2, "0" * 40, "src")]))
    with pytest.raises(Exception, match="no commit"):
        read_committed(root, wanted(spark, [(1, "0" * 40, "src")])).collect()


def test_one_process_serves_a_partition(repo, monkeypatch):
    root, shas = repo
    begun, popen = [], subprocess.Popen
    monkeypatch.setattr(subprocess, "Popen", lambda *a, **k: begun.append(a) or popen(*a, **k))
    files = list(committed_files(root, [(1, s, p) for s in shas for p in ("only0.txt", "src", "src/a b.go")] * 20))
    assert len(files) == 180 and len(begun) == 1


def test_two_reviews_of_one_repository(spark, repo):
    """Only changed files are read, and each review's findings are checked against its own text."""
    root, shas = repo
    reviews = spark.createDataFrame([(k, k, shas[k - 1], shas[k]) for k in (1, 2)], "review_id long, pr_number long, base_sha string, head_sha string")
    diffs = spark.createDataFrame([(k, shas[k - 1], change_diff(root, shas[k - 1], shas[k])) for k in (1, 2)], "review_id long, from_sha string, diff_text string")
    comments = spark.createDataFrame([], "review_id long, ord long, body string")
    needed = needed_files(reviews, comments, diffs)
    assert {(r.review_id, r.path) for r in needed.collect()} >= {(1, "only1.txt"), (2, "only2.txt")}
    files = read_committed(root, needed)
    assert not files.filter("path = 'only0.txt' OR path = 'src/other.txt'").head(1)
    made = review_changes(reviews, comments, diffs, files, min_severity="info")
    text = {(r.review_id, r.path): r.content for r in made.chunks.collect()}
    assert text[1, "only1.txt"] == text[2, "only2.txt"] == "x"
    found = spark.createDataFrame([(1, "only2.txt"), (2, "only2.txt"), (2, "src")], "review_id long, file string").selectExpr("review_id", "file", "1L AS line_start", "1L AS line_end", "'x' AS code_snippet", "0.5D AS confidence")
    asked = found.selectExpr("review_id", "file AS path").join(reviews.select("review_id", "head_sha"), "review_id")
    reason = {(r.review_id, r.file): r.reason or r.outcome for r in ground.ground(found, read_committed(root, asked)).collect()}
    assert reason == {(1, "only2.txt"): "file_not_found", (2, "only2.txt"): "grounded", (2, "src"): "file_unreadable"}
