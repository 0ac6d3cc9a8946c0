"""Repository files, stored review results and comment tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillet.functions.findings import FIELDS, decode_findings
from quillet.functions.text import split_lines


def decode_utf8(content: Column) -> Column:
    """Text of bytes, with the replacement sign where they aren't UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


class RepoFilesSource(DataSource):
    """``spark.read.format("repo_files")``: files of a checkout that is at the same place on every executor.

    Options: ``root``; ``paths``: relative paths, one a line (else all files below the
    root but those of ``.git``). A path that can't be read, such as a directory, has no
    content and isn't readable; one that doesn't exist gives no row.
    """

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "path string, content binary, is_readable boolean"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _RepoFilesReader(self.options)


class _Paths(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _RepoFilesReader(DataSourceReader):
    def __init__(self, options: dict, each: int = 200) -> None:
        self.root, self.wanted, self.each = options["root"], options.get("paths"), each

    def _all(self) -> Iterator[str]:
        for folder, inner, names in os.walk(self.root):
            inner[:] = sorted(d for d in inner if d != ".git")
            yield from (os.path.relpath(os.path.join(folder, n), self.root) for n in sorted(names))

    def partitions(self) -> list[InputPartition]:
        paths = list(self._all()) if self.wanted is None else list(dict.fromkeys(p for p in self.wanted.split("\n") if p))
        return [_Paths(paths[i : i + self.each]) for i in range(0, len(paths), self.each)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        top = os.path.realpath(self.root)
        for path in partition.paths:
            full = os.path.realpath(os.path.join(top, path))
            if not os.path.exists(full) or os.path.commonpath([top, full]) != top:  # nothing outside the checkout
                continue
            try:
                with open(full, "rb") as f:
                    yield path, f.read(), True
            except OSError:
                yield path, None, False


def read_files(spark: SparkSession, root: str, review_id: int = 0, paths: list[str] | None = None) -> DataFrame:
    """``review_id, path, lines, is_readable`` of all files of a checkout, or of those in ``paths``; paths are relative."""
    spark.dataSource.register(RepoFilesSource)
    source = spark.read.format("repo_files").option("root", unquote(urlparse(root).path))
    raw = (source if paths is None else source.option("paths", "\n".join(paths))).load()
    return raw.select(F.lit(review_id).cast("long").alias("review_id"), "path", split_lines(decode_utf8(F.col("content"))).alias("lines"), "is_readable")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results, one JSON document per file: ``path, pr_number, commit_sha, chunks_reviewed, chunks_skipped, findings, is_valid``.

    A file that is no JSON, lacks a required field or holds an invalid finding is not valid.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    v = F.try_parse_json("value")
    get = lambda p, kind: F.try_variant_get(v, p, kind)
    head = raw.select("path", get("$.pr_number", "bigint").alias("pr_number"), get("$.commit_sha", "string").alias("commit_sha"), F.coalesce(get("$.chunks_reviewed", "bigint"), F.lit(0)).alias("chunks_reviewed"), F.coalesce(get("$.chunks_skipped", "bigint"), F.lit(0)).alias("chunks_skipped"))
    found = decode_findings(raw.select("path", F.to_json(get("$.findings", "variant")).alias("_json")), "_json", ["path"])
    valid = F.col("pr_number").isNotNull() & F.col("commit_sha").isNotNull() & F.coalesce("readable", F.lit(False))
    return head.join(found, "path").select("path", "pr_number", "commit_sha", "chunks_reviewed", "chunks_skipped", "findings", valid.alias("is_valid"))


def result_findings(results: DataFrame) -> DataFrame:
    """Findings of valid results, flattened; ``review_id`` is the change's number."""
    each = results.filter("is_valid").select(F.col("pr_number").alias("review_id"), F.posexplode("findings").alias("_pos", "_f"))
    return each.select("review_id", F.lit(0).alias("origin"), F.lit(0).cast("long").alias("chunk_ord"), F.col("_pos").cast("long").alias("finding_ord"), *[F.col(f"_f.{n}").alias(n) for n in FIELDS])


COMMENTS = T.StructType([T.StructField("review_id", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("body", T.StringType())])


def post(plan: DataFrame, connect) -> None:  # noqa: ANN001
    """Carry out an upsert plan, one connection per partition: ``edit(review_id, ord, body)`` or ``create(review_id, body)``."""

    def partition(rows) -> None:  # noqa: ANN001
        client = None
        for r in rows:
            client = client or connect()
            client.edit(r.review_id, r.ord, r.body) if r.action == "edit" else client.create(r.review_id, r.body)

    plan.foreachPartition(partition)
