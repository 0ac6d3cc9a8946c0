from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from quillet.sources.git import GitDiffSource, GitPushSource


def git(root, *args):
    who = ["-c", "user.name=t", "-c", "user.email=t@example.org"]
    return subprocess.run(["git", "-C", str(root), *who, *args], capture_output=True, check=True, text=True).stdout.strip()


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git(root, "init", "-q", "-b", "main")
    commit(root, "one")
    return root


def commit(root, text):
    (root / "a.txt").write_text(text + "\n")
    git(root, "add", "a.txt")
    git(root, "commit", "-q", "-m", text)
    return git(root, "rev-parse", "HEAD")


def test_filters_choose_changes_before_git_runs(spark, repo):
    base, head = git(repo, "rev-parse", "HEAD"), commit(repo, "two")
    gone = "0" * 40  # git fails for each of these changes, so rows show that it wasn't asked
    changes = "\n".join([f"{i} {gone} {gone}" for i in (1, 2, 4, 5)] + [f"3 {base} {head}"])
    spark.dataSource.register(GitDiffSource)
    read = lambda: spark.read.format("git_diff").option("repo_root", str(repo)).option("changes", changes).option("pushdown", "true").load()
    for chosen in ("review_id = 3", "review_id IN (3, 9)", "review_id > 2 AND review_id < 4", "review_id >= 3 AND review_id <= 3", f"head_sha = '{head}'", f"from_sha = '{base}' AND diff_text LIKE '%+two%'", f"head_sha IS NOT NULL AND from_sha IN ('{base}')"):
        df = read().filter(chosen)
        assert [r.review_id for r in df.collect()] == [3], chosen
        assert df.rdd.getNumPartitions() == 1
    assert read().filter("review_id = 3 AND diff_text LIKE '%three%'").count() == 0
    assert read().filter("review_id = 77").count() == 0
    assert read().filter("head_sha IS NULL").count() == 0
    for all_read in ("true", "review_id = 3 OR diff_text = ''", "review_id <> 3"):
        with pytest.raises(Exception, match="git diff"):
            read().filter(all_read).collect()
    plain = spark.read.format("git_diff").option("repo_root", str(repo)).option("changes", changes).load()
    with pytest.raises(Exception, match="git diff"):
        plain.filter("review_id = 3").collect()


def test_a_stream_of_pushes_goes_on_where_it_stood(spark, repo, tmp_path):
    spark.dataSource.register(GitPushSource)
    base = git(repo, "rev-parse", "main")
    push = lambda number, sha: git(repo, "update-ref", f"refs/pull/{number}/head", sha)
    git(repo, "checkout", "-q", "-b", "work")
    seen = []

    def run():
        seen.clear()
        source = spark.readStream.format("git_pushes").option("repo_root", str(repo)).load()
        keep = lambda df, _: seen.extend(df.select("review_id", "base_sha", "head_sha", (F.col("pushed_at") > 0).alias("dated")).collect())
        query = source.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(tuple(r) for r in seen)

    first, second = commit(repo, "w1"), commit(repo, "w2")
    push(7, first)
    push(12, second)
    git(repo, "update-ref", "refs/pull/odd/head", first)  # no number
    assert run() == [(7, base, first, True), (12, base, second, True)]
    assert run() == []
    third = commit(repo, "w3")
    push(7, second)
    push(7, third)
    assert run() == [(7, base, third, True)]
    git(repo, "update-ref", "-d", "refs/pull/12/head")
    assert run() == []
    push(12, second)
    assert run() == [(12, base, second, True)]
