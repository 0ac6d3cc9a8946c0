"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

A piece's place depends on its length alone, and there are at most ``capacity``
lengths. So the histogram of lengths (bounded, whatever the corpus size) goes to
the driver, which runs best-fit decreasing over it with a segment tree over the
remaining capacities; bins of equal history are one range of sequence numbers.
The plan, bounded by the capacity too, tells for each length and each running
number among the pieces of that length the sequence and the offset. Running
numbers come from the numbers within an input partition plus the partition's
offset, so no length meets in one task.

Defined cases: a null text is an empty one (a single end token); null ids are
carried; repeated rows are packed as often as they occur; pieces of equal length
are interchangeable, of equally tight sequences the one last made so tight is taken; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.batches import bounded, text_groups
from quillet.llm.word_tokens import WordTokenizer
from quillet.runtime import materialize

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_IDS_ARROW = _PIECE_ARROW.append(pa.field("ids", pa.list_(pa.int64())))


class RemainingTree:
    """Segment tree over remaining capacities 0..capacity with the number of open bins of each."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = self.size + remaining
        while i:
            self.total[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least ``need`` that an open bin has, or -1."""
        i = self.size + need
        if self.total[i]:
            return need
        while i > 1:
            if not i & 1 and self.total[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.total[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


@dataclass
class Plan:
    """Rows in order of (length, first): pieces first.. of a length go to ``per_bin`` places in each sequence from ``bin`` on."""

    length: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 44) + self.first
        at = np.searchsorted(key, (length << 44) + number, side="right") - 1
        k = number - self.first[at]
        return self.bin[at] + k // self.per_bin[at], self.offset[at] + k % self.per_bin[at] * length


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over a histogram of lengths.

    Pieces of one length that meet bins of one remaining capacity are placed
    together: the tightest bin stays the tightest until it can't take another,
    so each bin takes ``remaining // length`` pieces in turn.
    """
    tree, open_bins, rows, bins = RemainingTree(capacity), defaultdict(list), [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left, number = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining < 0:
                remaining, fit = capacity, capacity // length
                start, have = bins, -(-left // fit)
                bins += have
            else:
                fit = remaining // length
                start, have = open_bins[remaining].pop()
                tree.add(remaining, -have)
            full = min(have, left // fit)
            if full:
                rows.append((length, number, start, fit, capacity - remaining))
                _open(tree, open_bins, remaining - fit * length, start, full)
                left, number = left - full * fit, number + full * fit
            if full < have:
                some = min(left, fit)
                if some:
                    rows.append((length, number, start + full, some, capacity - remaining))
                    _open(tree, open_bins, remaining - some * length, start + full, 1)
                    left, number, full = left - some, number + some, full + 1
                if full < have:
                    _open(tree, open_bins, remaining, start + full, have - full)
    table = np.array(sorted(rows) or np.empty((0, 5)), dtype=np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(c) for c in table.T), bins=bins)


def _open(tree: RemainingTree, open_bins: dict, remaining: int, start: int, bins: int) -> None:
    open_bins[remaining].append((start, bins))
    tree.add(remaining, bins)


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    words = WordTokenizer.of(tokenizer)
    end = np.array([END_ID], dtype="<u4").tobytes()
    step, schema = 4 * capacity, _IDS_ARROW if with_ids else _PIECE_ARROW
    for doc_ids, texts in text_groups(batches):
        out: list[list] = [[] for _ in schema]
        for doc_id, blob in zip(doc_ids, words.encode_all(texts), strict=True):
            blob += end
            for k, at in enumerate(range(0, len(blob), step)):
                part = blob[at : at + step]
                row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else []))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``capacity`` ids of every whole text; only longer texts are cut."""
    plain = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(lambda it: _cut(it, tokenizer, capacity, with_ids), PIECES + (", ids array<long>" if with_ids else ""))


def _place(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column("length").to_numpy(zero_copy_only=False)
        seq, off = plan.place(length, batch.column("_number").to_numpy(zero_copy_only=False))
        keep = [n for n in batch.schema.names if n != "_number"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*keep, "sequence_id", "offset"])


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1..capacity.

    ``pieces`` is written once, as its rows must keep their partitions between
    numbering and placing.
    """
    numbered = materialize(pieces.withColumn("_part", F.spark_partition_id()), "pieces")
    within = Window.partitionBy("_part", "length").orderBy(*[c for c in ("doc_id", "piece") if c in pieces.columns] or ["length"])
    counts = materialize(numbered.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_p"), F.col("length").alias("_l"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_best_fit(histogram, capacity)
    ranked = numbered.withColumn("_k", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_l")))
    ranked = ranked.select(*pieces.columns, (F.col("_k") + F.col("_before")).cast("long").alias("_number"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(lambda it: _place(it, plan), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; ``with_ids`` adds the token ids."""
    return pack_best_fit(token_pieces(docs, tokenizer, capacity, with_ids=with_ids), capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """One row per sequence with its token ids; needs pieces that carry ``ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", F.flatten(F.transform("_parts", lambda x: x["ids"])).alias("ids"))
