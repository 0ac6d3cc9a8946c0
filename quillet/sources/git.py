"""Diffs and committed files of git repositories."""

from __future__ import annotations

import operator
import subprocess
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)

from quillet.functions.text import split_lines
from quillet.operators.ground import relative
from quillet.sources.files import decode_utf8

#: Files of an Arrow batch.
_ROWS = 50


class GitDiffError(RuntimeError):
    """git could not produce the diff; an empty one is never made up instead."""


def _git(repo_root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo_root, *args], capture_output=True)
    if done.returncode:
        raise GitDiffError(f"git {' '.join(args)} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", errors="replace")


def run_git_diff(repo_root: str, *args: str) -> str:
    return _git(repo_root, "diff", *args)


def change_diff(repo_root: str, base_sha: str, head_sha: str, since_sha: str | None = None) -> str:
    """Between two commits, from the last reviewed one if there is any."""
    return run_git_diff(repo_root, since_sha or base_sha, head_sha)


def local_diff(repo_root: str = ".", base_ref: str = "main") -> str:
    """Working tree against a ref."""
    return run_git_diff(repo_root, base_ref)


class _Change(InputPartition):
    def __init__(self, review_id: int, repo_root: str, from_sha: str, head_sha: str | None) -> None:
        self.review_id, self.repo_root, self.from_sha, self.head_sha = review_id, repo_root, from_sha, head_sha


class GitDiffSource(DataSource):
    """``spark.read.format("git_diff")``: one partition per change.

    Options: ``repo_root``; ``changes``: lines of ``review_id base_sha head_sha
    [since_sha]``, or ``base_ref`` for the working tree (review 0); ``pushdown``: if
    true, filters on the other columns choose changes before git runs, for which the
    session needs ``spark.sql.python.filterPushdown.enabled``. The checkout must be at
    the same place on every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return "review_id long, from_sha string, head_sha string, diff_text string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return (_FilteringReader if self.options.get("pushdown", "false").lower() == "true" else _GitDiffReader)(self.options)


class _GitDiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("repo_root", ".")
        self.changes, self.ref = options.get("changes"), options.get("base_ref", "main")

    def partitions(self) -> list[InputPartition]:
        if self.changes is None:
            return [_Change(0, self.root, self.ref, None)]
        rows = [line.split() for line in self.changes.splitlines() if line.strip()]
        return [_Change(int(r[0]), self.root, r[3] if len(r) > 3 else r[1], r[2]) for r in rows]

    def read(self, partition: _Change) -> Iterator[tuple]:
        text = local_diff(partition.repo_root, partition.from_sha) if partition.head_sha is None else change_diff(partition.repo_root, partition.from_sha, partition.head_sha)
        yield partition.review_id, partition.from_sha, partition.head_sha, text


#: Tests of a value that is there; a null passes none of them but IsNull.
_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, many: x in many}


class _FilteringReader(_GitDiffReader):
    """Takes the filters that a change's ids and commits can answer; what the text must answer stays with Spark."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.taken: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            known = getattr(f, "attribute", None) in (("review_id",), ("from_sha",), ("head_sha",))
            if known and isinstance(f, (IsNull, IsNotNull, *_TESTS)):
                self.taken.append(f)
            else:
                yield f

    def _passes(self, change: _Change, f: Filter) -> bool:
        value = getattr(change, f.attribute[0])
        if isinstance(f, IsNull | IsNotNull):
            return (value is None) == isinstance(f, IsNull)
        return value is not None and f.value is not None and _TESTS[type(f)](value, f.value)

    def partitions(self) -> list[InputPartition]:
        return [c for c in super().partitions() if all(self._passes(c, f) for f in self.taken)]

    def read(self, partition: _Change | None) -> Iterator[tuple]:
        return iter(()) if partition is None else super().read(partition)  # Spark asks once where no partition is left


class _Push(InputPartition):
    def __init__(self, review_id: int, head_sha: str) -> None:
        self.review_id, self.head_sha = review_id, head_sha


class GitPushSource(DataSource):
    """``spark.readStream.format("git_pushes")``: the heads of changes as they move, in the columns that ``review_pushes`` takes.

    Options: ``repo_root``; ``refs``: pattern of the changes' refs, whose ``*`` is the
    change's number (default ``refs/pull/*/head``); ``base_ref``: what they are to be
    merged into (default ``main``). An offset holds the head of every ref, so a batch
    is the refs whose head differs from the last offset's, and a restart goes on where
    the checkpoint stands. Pushes between two batches are one, its diff holds the
    others. A deleted ref gives no row and counts as new when it comes again.
    """

    @classmethod
    def name(cls) -> str:
        return "git_pushes"

    def schema(self) -> str:
        return "review_id long, pr_number long, base_sha string, head_sha string, pushed_at long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _PushReader(self.options)


class _PushReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.base = options.get("repo_root", "."), options.get("base_ref", "main")
        self.refs = options.get("refs", "refs/pull/*/head")

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        before, after = self.refs.split("*")
        rows = (line.split(" ") for line in _git(self.root, "for-each-ref", "--format=%(refname) %(objectname)", self.refs).splitlines())
        numbers = ((name.removeprefix(before).removesuffix(after), sha) for name, sha in rows)
        return {number: sha for number, sha in numbers if number.isdecimal()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Push(int(n), sha) for n, sha in sorted(end.items()) if start.get(n) != sha]

    def read(self, partition: _Push) -> Iterator[tuple]:
        base = _git(self.root, "merge-base", self.base, partition.head_sha).strip()
        when = int(_git(self.root, "show", "-s", "--format=%ct", partition.head_sha))
        yield partition.review_id, partition.review_id, base, partition.head_sha, when

    def commit(self, end: dict) -> None:
        """The refs themselves are the source: nothing is kept for batches that are done."""


def committed_files(repo_root: str, wanted: Iterable[tuple[int, str, str]]) -> Iterator[tuple[int, str, bytes | None, bool]]:
    """``review_id, path, content, is_readable`` of (review_id, commit, path), by one git process that answers in turn."""
    done: subprocess.Popen | None = None
    commits: set[str] = set()
    try:
        for review_id, commit, path in wanted:
            if done is None:
                done = subprocess.Popen(["git", "-C", repo_root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
            if commit not in commits and _object(done, f"{commit}^{{commit}}") is None:
                raise GitDiffError(f"{repo_root} has no commit {commit}")
            commits.add(commit)
            found = None if "\n" in path or "\r" in path else _object(done, f"{commit}:{path}")
            if found is not None:
                kind, content = found
                yield review_id, path, content if kind == "blob" else None, kind == "blob"
    finally:
        if done is not None:
            done.stdin.close()
            done.stdout.close()
            done.wait()


def _object(git: subprocess.Popen, name: str) -> tuple[str, bytes | None] | None:
    """Kind and content of an object; null if there is none. A submodule's commit is known by name only."""
    git.stdin.write(name.encode() + b"\n")
    git.stdin.flush()
    head = git.stdout.readline()
    if not head:
        raise GitDiffError(f"git gave no answer about {name}")
    if head.endswith(b" submodule\n"):
        return "commit", None
    if head.endswith((b" missing\n", b" ambiguous\n")):
        return None
    _, kind, size = head.rsplit(b" ", 2)
    content = git.stdout.read(int(size))
    git.stdout.read(1)
    return kind.decode(), content


def read_committed(repo_root: str, wanted: DataFrame) -> DataFrame:
    """``review_id, path, lines, is_readable`` of ``wanted(review_id, head_sha, path)``: each review sees the files of its own commit, whatever is checked out.

    The pairs are dealt over partitions, each of which keeps one git process; the
    repository must be at the same place on every executor. A path that the commit
    doesn't have gives no row, a directory or submodule one that isn't readable;
    absolute and climbing paths match nothing. An unknown commit is an error. A
    symbolic link is the text that git stores for it.
    """
    schema = "review_id long, path string, content binary, is_readable boolean"

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = ((r["review_id"], r["head_sha"], r["path"]) for b in batches for r in b.to_pylist())
        files = committed_files(repo_root, asked)
        while rows := list(islice(files, _ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.bool_()), strict=True)], ["review_id", "path", "content", "is_readable"])

    pairs = wanted.select(F.col("review_id").cast("long").alias("review_id"), "head_sha", relative(F.col("path")).alias("path")).dropna().distinct()
    raw = pairs.repartition("review_id", "path").mapInArrow(partition, schema)
    return raw.select("review_id", "path", split_lines(decode_utf8(F.col("content"))).alias("lines"), "is_readable")
