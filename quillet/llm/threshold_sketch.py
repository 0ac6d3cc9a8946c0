"""Fingerprints of texts: every shingle hash below a fixed fraction of the range.

A text's shingles are its runs of ``width`` code points (a shorter text is one
shingle), hashed to 42 bits. The sketch holds every distinct hash in the lowest
``fraction`` of the range, and where there is none the least one, so that short
texts have a sketch too. What is held depends on the text only, so sketches of
very unequal texts compare, and the union of sketches (less a least hash above the
fraction, once there is another below) is the sketch of the texts together.

A fingerprint is the sorted hashes, seven signs each, in an alphabet whose order
is that of the numbers. ``likeness`` and ``containment`` are column functions over
fingerprints, ``merged`` the fingerprint of each group.

``edited_fingerprints`` compares each text with an edit of itself and with the
next text by descending id. Texts are shuffled once: ids are cut into buckets of
near equal counts, each bucket is a sorted run of a partition, and its last text
gets the first of the bucket after it as an extra row. A hot id's rows (nulls
count as one) are spread over several buckets by a hash of their texts.

Defined cases: a null text is an empty one, which has no shingles and an empty
fingerprint; two empty ones are alike (1), an empty and another are not (0); rows
without an id come last; rows that share an id are ordered by a hash of their
texts, so equal rows follow each other; a single row is its own next; very long
texts are hashed in blocks; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.batches import bounded

SIGNS = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
LENGTH = 7
BITS = 6 * LENGTH
BLOCK = 1 << 16
_OUT_BYTES = 4 << 20
_NO_ID = -(2**63)

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@dataclass(frozen=True)
class Threshold:
    """``width``: code points of a shingle; ``halvings``: hashes below 2^-halvings of the range are held."""

    width: int = 12
    halvings: int = 4

    def __post_init__(self) -> None:
        if self.width < 1 or not 0 <= self.halvings < BITS:
            raise ValueError("width must be positive and halvings within the hash")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(width: int) -> np.ndarray:
    """Odd multipliers of a shingle's places."""
    return np.array([pow(0x9E3779B97F4A7C15, width - i, 2**64) for i in range(width)], np.uint64)


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 42-bit hash of each run of ``width`` code points, in place order."""
    wide = codes.astype(np.uint64) + np.uint64(1)
    if len(wide) < width:
        wide = np.concatenate([wide, np.zeros(width - len(wide), np.uint64)])  # 0 is no code point here
    n = len(wide) - width + 1
    h = np.zeros(n, np.uint64)
    for i, p in enumerate(_powers(width)):
        h += wide[i : i + n] * p
    for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mix)
    h ^= h >> np.uint64(31)
    return h >> np.uint64(64 - BITS)


def sketch(codes: np.ndarray, t: Threshold = Threshold()) -> np.ndarray:
    """Sorted distinct hashes that are held of a text's code points."""
    if not len(codes):
        return np.empty(0, np.uint64)
    limit, held, least = np.uint64(1 << (BITS - t.halvings)), [], []
    for at in range(0, max(1, len(codes) - t.width + 1), BLOCK):
        h = shingle_hashes(codes[at : at + BLOCK + t.width - 1], t.width)
        held.append(h[h < limit])
        least.append(h.min())
    found = np.unique(np.concatenate(held))
    return found if len(found) else np.array([min(least)], np.uint64)


_ALPHABET = np.frombuffer(SIGNS.encode(), np.uint8)


def written(held: np.ndarray) -> str:
    """A sketch as a fingerprint."""
    places = np.arange(LENGTH - 1, -1, -1, dtype=np.uint64) * np.uint64(6)
    return _ALPHABET[((held[:, None] >> places) & np.uint64(63)).astype(np.intp)].tobytes().decode()


def near(a: np.ndarray, b: np.ndarray) -> float:
    """Common hashes as a share of all hashes of two sketches."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def hashes(fingerprint: Column) -> Column:
    """The hashes of a fingerprint, as an array of seven signs each."""
    n = (F.length(fingerprint) / LENGTH).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(fingerprint, (i - 1) * LENGTH + 1, F.lit(LENGTH)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """Common hashes as a share of all; 1 for two empty fingerprints."""
    x, y = hashes(a), hashes(b)
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / either)


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b has; 1 for an empty a."""
    x = hashes(a)
    return F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.array_intersect(x, hashes(b))) / F.size(x))


def merged(prints: DataFrame, keys: list[str], t: Threshold = Threshold()) -> DataFrame:
    """``keys, fingerprint`` of all texts of a group, from ``keys, fingerprint`` of each; a group's size is that of its sketch."""
    limit = written(np.array([1 << (BITS - t.halvings)], np.uint64)) if t.halvings else "~"
    each = prints.select(*keys, F.explode_outer(hashes(F.col("fingerprint"))).alias("_h")).distinct()
    held = F.array_sort(F.collect_list(F.when(F.col("_h") < limit, F.col("_h"))))
    grouped = each.groupBy(*keys).agg(held.alias("_held"), F.min("_h").alias("_least"))
    return grouped.select(*keys, F.when(F.size("_held") > 0, F.array_join("_held", "")).otherwise(F.coalesce("_least", F.lit(""))).alias("fingerprint"))


def _buckets_of(cuts: np.ndarray, ids: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Buckets ascend with (id, tie); an id that is several cuts has as many buckets."""
    low = np.searchsorted(cuts, ids, "left")
    several = np.searchsorted(cuts, ids, "right") - low
    return low + np.minimum((tie.astype(float) + 2.0**63) / 2.0**64 * several, np.maximum(several - 1, 0)).astype(np.int64)


def _edits(t: Threshold):  # noqa: ANN202
    """Of sorted runs ``bucket, extra, doc_id, text``: the result of each row that has a next one in its run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (c.split() for c in RESULT.split(", "))])
        out, size, last = [], 0, None
        for batch in batches:
            buckets, extras, ids = (batch.column(i).to_pylist() for i in range(3))
            for bucket, extra, doc_id, text in zip(buckets, extras, ids, batch.column(3), strict=True):
                if extra and (last is None or last[0] != bucket):
                    continue  # a further copy of the row that the run's last one needed
                codes = code_points(text.as_py())
                own = sketch(codes, t)
                if last is not None and last[0] == bucket:
                    done = _compared(*last[1:], codes, own, t)
                    out.append(done)
                    size += len(done[3]) + len(done[4]) + 200
                    if size > _OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                last = None if extra else (bucket, doc_id, codes, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows


def _compared(doc_id: int | None, codes: np.ndarray, own: np.ndarray, after: np.ndarray, after_held: np.ndarray, t: Threshold) -> tuple:
    half = len(codes) // 2
    edited = np.concatenate([codes[: len(codes) - half], after[:half]])
    held = sketch(edited, t)
    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(codes), digest, written(own), written(held), near(own, held), near(own, after_held)


def edited_fingerprints(docs: DataFrame, t: Threshold = Threshold(), buckets: int | None = None) -> DataFrame:
    """RESULT of each document: its fingerprint, that of its edited text, and the likeness to that and to the next document."""
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_id": F.coalesce("doc_id", F.lit(_NO_ID)), "_tie": F.xxhash64("text")})
    shares = [i / n for i in range(1, n)]
    cuts = np.array((rows.agg(F.percentile_approx("_id", shares, 100 * n)).first()[0] if shares else None) or [], np.int64)  # n - 1 numbers
    place = F.pandas_udf(lambda i, tie: pd.Series(_buckets_of(cuts, i.to_numpy(), tie.to_numpy())), "long")
    heads = rows.select("_id", "_tie").groupBy(place("_id", "_tie").alias("b")).agg(F.max(F.struct("_id", "_tie")).alias("h")).orderBy("b").collect()  # a row per bucket
    top_id, top_tie, before = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    for k, r in enumerate(heads):
        top_id[r["b"]], top_tie[r["b"]] = r["h"]["_id"], r["h"]["_tie"]
        before[r["b"]] = heads[(k + 1) % len(heads)]["b"]  # the run whose last row comes before this bucket's first

    def dealt(ids: pd.Series, ties: pd.Series) -> pd.DataFrame:
        i, tie = ids.to_numpy(), ties.to_numpy()
        b = _buckets_of(cuts, i, tie)
        return pd.DataFrame({"own": b, "also": np.where((top_id[b] == i) & (top_tie[b] == tie), before[b], -1)})

    placed = rows.withColumn("_b", F.pandas_udf(dealt, "own long, also long")("_id", "_tie"))
    run = lambda b, extra: F.struct(b.alias("bucket"), F.lit(extra).alias("extra"))
    both = F.array(run(F.col("_b.own"), False), run(F.col("_b.also"), True))
    copied = placed.withColumn("_r", F.explode(F.filter(both, lambda r: r["bucket"] >= 0)))
    runs = copied.repartitionById(n, F.col("_r.bucket").cast("int")).sortWithinPartitions(F.col("_r.bucket"), F.col("_r.extra"), F.col("_id").desc(), F.col("_tie").desc())
    return runs.select("_r.bucket", "_r.extra", "doc_id", "text").mapInArrow(_edits(t), RESULT)
