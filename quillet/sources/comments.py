"""Comments of reviews as a data source that writes, and a folder that can stand for the service."""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quillet.operators.summary import MARKER

_ORD_DIGITS = 10
_FOLDERS = 256
_BATCH_CHARS = 4_000_000
COMMENT = "review_id long, ord long, body string"
_ROWS = pa.schema([("review_id", pa.int64()), ("ord", pa.int64()), ("body", pa.string())])


class CommentService(Protocol):
    """Where comments live. Opened once per task."""

    def find(self, review_id: int, key: str) -> int | None:
        """Number of the first comment that was made under ``key``; for the summary's key, of the first with its marker."""

    def create(self, review_id: int, body: str, key: str) -> None:
        """A new comment; with the same key again it must not make a second one."""

    def edit(self, review_id: int, ord: int, body: str) -> None: ...


class PostFailed(RuntimeError):
    """Some tasks did not post their comments; writing the same plan again finishes the work."""


def post_key(body: str) -> str:
    """What makes a comment the same one: a review has one summary, any other comment is known by its text."""
    return "summary" if MARKER in body else hashlib.sha256(body.encode()).hexdigest()


@dataclass
class Posted(WriterCommitMessage):
    created: int
    edited: int


class ReviewCommentsSink(DataSource):
    """``df.write.format("review_comments")``: each row of ``review_id, body`` becomes a comment, or the new text of the one it repeats.

    Other columns are ignored, ``action`` and ``ord`` of an upsert plan too: each task
    asks the service what is there when it writes, so a retried task, a second write of
    the same plan and a plan that is out of date all leave one summary per review.
    Options: ``service``, a factory as ``module:name`` that is called with the options.
    A null review or body is an error. A service's edits can't be taken back: an
    aborted write leaves what its tasks have posted, and the same write completes it.
    """

    @classmethod
    def name(cls) -> str:
        return "review_comments"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("comments are only added or edited: use mode append")
        missing = {"review_id", "body"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return _Writer(dict(self.options))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def _service(self) -> CommentService:
        module, _, name = self.options["service"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def write(self, iterator: Iterator[Row]) -> Posted:
        service, done = None, Posted(0, 0)
        for r in iterator:
            if r["review_id"] is None or r["body"] is None:
                raise ValueError("a comment needs a review and a body")
            service = service or self._service()
            key = post_key(r["body"])
            there = service.find(r["review_id"], key)
            if there is None:
                service.create(r["review_id"], r["body"], key)
                done.created += 1
            else:
                service.edit(r["review_id"], there, r["body"])
                done.edited += 1
        return done

    def commit(self, messages: list[Posted | None]) -> None:
        """Every task has posted: nothing is left to do."""
        if any(m is None for m in messages):
            raise PostFailed("a task gave no account of its comments")

    def abort(self, messages: list[Posted | None]) -> None:
        done = [m for m in messages if m is not None]
        lost = len(messages) - len(done)
        raise PostFailed(f"{lost} of {len(messages)} tasks failed; {sum(m.created for m in done)} comments were created and {sum(m.edited for m in done)} edited by the others")


class FolderComments:
    """A shared folder as the service: ``path/<xx>/<review>/<ord>-<key>.txt``, any URI that pyarrow reads.

    ``xx`` is one of 256 folders, by the review's number, so that many tasks can each read some. A name holds number and key, so two creators of the same comment that see the
    same folder write the same file.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(options["path"])

    def _folder(self, review_id: int) -> str:
        return f"{self.root.rstrip('/')}/{review_id % _FOLDERS:02x}/{review_id}"

    def _names(self, review_id: int) -> list[str]:
        inside = self.fs.get_file_info(pafs.FileSelector(self._folder(review_id), allow_not_found=True))
        return sorted(i.base_name for i in inside if i.base_name.endswith(".txt") and not i.base_name.startswith("_"))

    def reviews(self, folder: int) -> list[int]:
        """Reviews that have comments in one of the 256 folders."""
        inside = self.fs.get_file_info(pafs.FileSelector(f"{self.root.rstrip('/')}/{folder:02x}", allow_not_found=True))
        return [int(i.base_name) for i in inside if i.type == pafs.FileType.Directory]

    def comments(self, review_id: int) -> Iterator[tuple[int, str]]:
        """Number and text of each comment of a review."""
        for name in self._names(review_id):
            with self.fs.open_input_stream(f"{self._folder(review_id)}/{name}") as f:
                yield int(name[:_ORD_DIGITS]), f.read().decode(errors="replace")

    def _put(self, review_id: int, name: str, body: str) -> None:
        self.fs.create_dir(self._folder(review_id), recursive=True)
        draft, path = f"{self._folder(review_id)}/_{name}", f"{self._folder(review_id)}/{name}"
        with self.fs.open_output_stream(draft) as f:
            f.write(body.encode())
        self.fs.move(draft, path)

    def find(self, review_id: int, key: str) -> int | None:
        return next((int(n[:_ORD_DIGITS]) for n in self._names(review_id) if n[_ORD_DIGITS + 1 : -4] == key), None)

    def create(self, review_id: int, body: str, key: str) -> None:
        last = max((int(n[:_ORD_DIGITS]) for n in self._names(review_id)), default=0)
        self._put(review_id, f"{last + 1:0{_ORD_DIGITS}d}-{key}.txt", body)

    def edit(self, review_id: int, ord: int, body: str) -> None:
        name = next(n for n in self._names(review_id) if int(n[:_ORD_DIGITS]) == ord)
        with self.fs.open_input_stream(f"{self._folder(review_id)}/{name}") as f:
            same = f.read() == body.encode()
        if not same:  # to replace a file waits for the disk
            self._put(review_id, name, body)


def write_comments(rows: DataFrame, service: str, tasks: int | None = None, **options: str) -> None:
    """Post ``rows(review_id, body[, ord])``. Each review is in one task, its rows in the order of ``ord``.

    ``tasks`` (by default the session's shuffle partitions) post at a time at most: what
    posting takes is calls, not bytes, so few bytes are no reason for few tasks.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ReviewCommentsSink)
    order = ["review_id", "ord"] if "ord" in rows.columns else ["review_id"]
    placed = rows.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "review_id").sortWithinPartitions(*order).select("review_id", "body")
    placed.write.format("review_comments").options(service=service, **options).mode("append").save()


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``review_id, ord, body`` of a folder of comments: a task reads some of its 256 folders, and nothing lists them all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = FolderComments({"path": path})
        of = lambda rows: pa.RecordBatch.from_pylist([dict(zip(("review_id", "ord", "body"), r, strict=True)) for r in rows], _ROWS)
        for batch in batches:
            found, size = [], 0
            for folder in batch.column("id").to_pylist():
                for review_id in service.reviews(folder):
                    for ord_, body in service.comments(review_id):
                        found.append((review_id, ord_, body))
                        size += len(body)
                        if size > _BATCH_CHARS or len(found) == 1000:
                            yield of(found)
                            found, size = [], 0
            yield of(found)

    return spark.range(0, _FOLDERS, 1, 64).mapInArrow(read, COMMENT)
