"""Replies of models, kept before they are used, so that no paid call is made twice."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPLY = "key string, nth int, reply string"


@dataclass(frozen=True)
class Ledger:
    """A shared folder (any URI that pyarrow and Spark both read) of the replies of one model.

    ``calls`` holds one small file per reply, put in place by a rename when the reply
    comes in. ``tables`` holds what ``compact`` has folded into Parquet. A reply is
    known by a digest of model, system text, prompt, schema and token limit, and by
    its number among the replies to that request: a request whose first reply was
    unreadable goes on with its second. What is refused or lost on the way isn't a reply.

    Only a task that dies between the arrival of a reply and its rename calls again.
    Two attempts of one task at the same time both call, so speculation should be off.
    """

    root: str
    model: str = ""

    def request_key(self, system: str, prompt: Column, max_tokens: int, schema: dict | None) -> Column:
        head = json.dumps([self.model, system, max_tokens, schema], sort_keys=True)
        return F.sha2(F.concat(F.lit(head + "\n"), prompt).cast("binary"), 256)

    def _at(self, *parts: str) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.root)
        return fs, "/".join([root.rstrip("/"), *parts])

    def find(self, key: str, nth: int) -> str | None:
        fs, path = self._at("calls", key[:2], f"{key}-{nth}.json")
        try:
            with fs.open_input_stream(path) as f:
                return json.loads(f.read())["reply"]
        except FileNotFoundError:
            return None

    def keep(self, key: str, nth: int, reply: str) -> None:
        fs, path = self._at("calls", key[:2], f"{key}-{nth}.json")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        draft = path.replace(f"/{key}-", f"/_{key}-")  # hidden from Spark and from find
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"key": key, "nth": nth, "reply": reply}).encode())
        fs.move(draft, path)

    def _has(self, *parts: str) -> bool:
        fs, path = self._at(*parts)
        return fs.get_file_info(path).type != pafs.FileType.NotFound

    def _newest(self) -> int:
        """Number of the newest whole table, 0 if there is none."""
        fs, path = self._at("tables")
        inside = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return max((int(i.base_name) for i in inside if self._has("tables", i.base_name, "_SUCCESS")), default=0)

    def _table(self, spark: SparkSession) -> DataFrame:
        newest = self._newest()
        return spark.read.schema(REPLY).parquet(f"{self.root}/tables/{newest:06d}") if newest else spark.createDataFrame([], REPLY)

    def replies(self, spark: SparkSession) -> DataFrame:
        """``key, nth, reply`` of everything that was kept."""
        fresh = spark.range(0, 256, 1, 64).mapInArrow(self._read_calls, REPLY) if self._has("calls") else spark.createDataFrame([], REPLY)
        return self._table(spark).unionByName(fresh).dropDuplicates(["key", "nth"])

    def _read_calls(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The files of some of the 256 folders: a task reads many, and nothing lists them all."""
        for batch in batches:
            for number in batch.column("id").to_pylist():
                fs, path = self._at("calls", f"{number:02x}")
                kept = []
                for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                    if i.base_name.endswith(".json") and not i.base_name.startswith("_"):
                        with fs.open_input_stream(i.path) as f:
                            kept.append(json.loads(f.read()))
                    if len(kept) == 1000:
                        yield _replies(kept)
                        kept = []
                yield _replies(kept)

    def compact(self, spark: SparkSession) -> None:
        """Fold the small files into a new table. No run may be writing meanwhile; a failure on the way loses nothing."""
        if self._has("calls"):
            self.replies(spark).write.mode("overwrite").parquet(f"{self.root}/tables/{self._newest() + 1:06d}")
            fs, path = self._at("calls")
            fs.delete_dir(path)

    def with_known(self, requests: DataFrame) -> DataFrame:
        """Add ``_known``: the replies to ``_key`` that the table holds, in order. There are at most as many as a request has attempts."""
        known = self._table(requests.sparkSession).groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("nth", "reply"))).alias("_a"))
        return requests.join(known, "_key", "left").withColumn("_known", F.coalesce(F.transform("_a", lambda x: x["reply"]), F.array().cast("array<string>"))).drop("_a")


def _replies(kept: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k["key"] for k in kept], pa.string()), pa.array([k["nth"] for k in kept], pa.int32()), pa.array([k["reply"] for k in kept], pa.string())], names=["key", "nth", "reply"])


def remembered(call: Callable[[], str], ledger: Ledger | None, key: str | None, known: list[str]) -> Callable[[], str]:
    """``call`` for one request: its replies are first those that are known, then those in the ledger's files, then new ones."""
    if ledger is None:
        return call
    taken = 0

    def ask() -> str:
        nonlocal taken
        reply = known[taken] if taken < len(known) else ledger.find(key, taken)
        if reply is None:
            reply = call()
            ledger.keep(key, taken, reply)
        taken += 1
        return reply

    return ask
