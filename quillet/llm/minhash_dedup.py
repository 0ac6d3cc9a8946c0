"""Near-duplicates by SetSketch registers.

A document's set of word shingles becomes registers: the minimum of each of m
hash functions, spaced exponentially and truncated to 16 bits. They merge by
maximum and agree with about the Jaccard similarity, so bands of them find
candidates. A candidate's similarity is first estimated from the three counts of
larger, smaller and equal registers by maximum likelihood; what isn't clearly
below the threshold is confirmed on the full sets.

Documents of equal sets are one class and only its smallest id is compared. A
band's bucket is not expanded into pairs: first every member meets the bucket's
smallest member, then a random one, and members that are by then in one component
need not meet. In a bucket that still holds several components, each member outside the
largest one is compared with all members of that, block by block, where only found
links leave the task; those that are then still in different components meet each
other, with size and bit-distance bounds in the join.

Defined cases: a null text, or one without words, has no shingles and links with
nothing; a text of fewer words than a shingle is one shingle; a row with a null id
takes no part (component null, kept); rows that share an id are one node, so they
share a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.batches import bounded, text_groups
from quillet.llm.components import components, merged
from quillet.llm.worker_tables import claim, register
from quillet.runtime import materialize

#: Up to so many ids (about 16 MB) a list of documents to read again is broadcast.
BROADCAST_IDS = 500_000
KEPT_WORDS = 200_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Sketch:
    shingle: int = 5  # words
    percent: int = 80  # least similarity
    bands: int = 24
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    seed: int = 1

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class _Words:
    """64-bit hashes of words, with a bounded table of those seen by this worker."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: only A-Z and ASCII white space
        if len(self.known) > KEPT_WORDS:
            self.known = {w: h for w in set(words) if (h := self.known.get(w)) is not None}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_words = _Words()
register("shingles", lambda: setattr(_words, "known", {}))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    h = _words.hashes(text or "")
    if not len(h):
        return h
    k = min(size, len(h))
    acc = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * _M1 + h[j : len(h) - k + 1 + j]
    acc = (acc ^ (acc >> np.uint64(32))) * _M2
    return np.unique(acc ^ (acc >> np.uint64(29)))


def multipliers(s: Sketch) -> np.ndarray:
    return np.random.default_rng(s.seed).integers(0, 2**63, s.registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers_of(items: np.ndarray, factors: np.ndarray, s: Sketch) -> np.ndarray:
    """Exponentially spaced, truncated minima of the hashes of a set that isn't empty."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        part = items[at : at + 1024, None] * factors[None, :]
        part ^= part >> np.uint64(31)
        np.minimum(least, (part * _M2).min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 1.0) / (2.0**64 + 4096.0)) / s.rate
    return np.clip(np.floor(1.0 - np.log(exponential) / math.log(s.base)), 0, 65535).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, s: Sketch) -> np.ndarray:
    """Jaccard similarity of each pair of register rows that makes their joint order most likely."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    grid = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (s.base - 1) / s.base) / math.log(s.base)
    up, down = p(u - (1 - u) * grid), p(1 - u - u * grid)
    floor = 1e-12
    like = more * np.log(up + floor) + less * np.log(down + floor) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, 0) + floor)
    return grid[np.arange(len(grid)), like.argmax(1)]


_SKETCH = "doc_id long, n_shingles long, set_id binary, registers binary"


def _sketch(batches: Iterator[pa.RecordBatch], s: Sketch) -> Iterator[pa.RecordBatch]:
    claim("shingles")
    factors = multipliers(s)
    for ids, texts in text_groups(batches):
        n, sets, regs = [], [], []
        for t in texts:
            items = shingle_set(t, s.shingle)
            n.append(len(items))
            sets.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
            regs.append(registers_of(items, factors, s).tobytes() if len(items) else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "registers"])


def _stack(column: pa.Array, s: Sketch) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, s.registers)


def _band_keys(batch: pa.RecordBatch, s: Sketch) -> np.ndarray:
    """A row of band keys for each row of registers; equal keys of different bands don't occur."""
    regs = _stack(batch.column("registers"), s).astype(np.uint64).reshape(-1, s.bands, s.rows)
    acc = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64) * _M1, regs.shape[:2]).copy()
    for j in range(s.rows):
        acc = (acc ^ (acc >> np.uint64(29))) * _M1 + regs[:, :, j]
    acc = (acc ^ (acc >> np.uint64(32))) * _M2
    return acc ^ (acc >> np.uint64(29))


def _bands(batches: Iterator[pa.RecordBatch], s: Sketch) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), s.bands)
        yield pa.RecordBatch.from_arrays([pa.array(_band_keys(batch, s).view(np.int64).ravel()), pa.array(node, pa.int64())], names=["band", "node"])


def _bits(batches: Iterator[pa.RecordBatch], s: Sketch) -> Iterator[pa.RecordBatch]:
    """Four bits of each register's hash, sixteen to a long: how many differ bounds the similarity. And the keys of all bands."""
    for batch in batches:
        if not batch.num_rows:
            continue
        four = (_stack(batch.column("registers"), s).astype(np.uint64) * _M1) >> np.uint64(60)
        four = np.pad(four, ((0, 0), (0, -s.registers % 16))).reshape(len(four), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
        packed = np.bitwise_or.reduce(four, axis=2).view(np.int64)
        keys = _band_keys(batch, s).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(list(packed), pa.list_(pa.int64())), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "n", "bits", "keys"])


def _likely(batches: Iterator[pa.RecordBatch], s: Sketch) -> Iterator[pa.RecordBatch]:
    least = s.percent / 100 - 4.5 * math.sqrt(s.percent * (100 - s.percent) / 1e4 / s.registers)
    for batch in batches:
        if not batch.num_rows:
            continue
        n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n_a", "n_b"))
        j = estimate(n_a, n_b, _stack(batch.column("r_a"), s), _stack(batch.column("r_b"), s), s)
        yield batch.select(["a", "b"]).filter(pa.array(j >= least))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    claim("shingles")
    for ids, texts in text_groups(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shingle_set(t, size).view(np.int64) for t in texts], pa.list_(pa.int64()))], names=["node", "items"])


def _size_bound(a: str, b: str, s: Sketch) -> Column:
    """Sets of sizes so different cannot reach the threshold."""
    return 100 * F.least(a, b) >= s.percent * F.greatest(a, b)


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, s: Sketch) -> DataFrame:
    """Of the candidate pairs (a, b), those whose full sets reach the threshold."""
    a = reps.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    b = reps.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    sized = pairs.join(a, "a").join(b, "b").filter(_size_bound("n_a", "n_b", s))
    likely = materialize(sized.mapInArrow(lambda it: _likely(it, s), "a long, b long"), "likely")
    sets = _read_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), s)
    both = likely.join(sets.withColumnsRenamed({"node": "a", "items": "i_a"}), "a").join(sets.withColumnsRenamed({"node": "b", "items": "i_b"}), "b")
    shared, total = F.size(F.array_intersect("i_a", "i_b")), F.size("i_a") + F.size("i_b")
    return both.filter(100 * shared >= s.percent * (total - shared)).select("a", "b")


def _read_sets(docs: DataFrame, nodes: DataFrame, s: Sketch) -> DataFrame:
    """``node, items``: the full shingle sets of some documents, from their texts."""
    ids = materialize(nodes, "to-read")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    full = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(ids, "node", "left_semi")
    return materialize(full.mapInArrow(lambda it: _sets(it, s.shingle), "node long, items array<long>"), "sets")


def near_duplicates(docs: DataFrame, s: Sketch = Sketch()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(plain.mapInArrow(lambda it: _sketch(it, s), _SKETCH), "sketches")
    classes = rows.filter("doc_id IS NOT NULL AND set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    reps = materialize(classes, "classes")

    banded = reps.select("node", "registers").mapInArrow(lambda it: _bands(it, s), "band long, node long")
    shared = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot")).filter("members > 1"), "buckets")
    members = materialize(banded.join(shared.select("band", "pivot"), "band"), "members")

    stars = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(confirm(stars, reps, docs, s), "links")
    found = materialize(components(links), "components")

    open_members = _unsettled(members, found)
    stars = open_members.filter("component <> pivot_component").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    found = merged(found, materialize(confirm(stars.join(links, ["a", "b"], "left_anti"), reps, docs, s), "links"))

    open_members = _unsettled(members, found)
    found = merged(found, _links_to_components(open_members, found, docs, s))
    found = merged(found, materialize(confirm(_remaining_pairs(open_members, found, reps, s), reps, docs, s), "links"))
    of_set = reps.join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("_component"))
    joined = rows.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with a random pivot and the largest component of the bucket."""
    labelled = members.select("band", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled, "labelled")
    held = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("band", "node").alias("h"), "node")).alias("p"))
    mixed = held.groupBy("band").agg(F.count(F.lit(1)).alias("held"), F.max(F.struct("n", "component", F.col("p.node").alias("node"))).alias("m")).filter("held > 1")
    mixed = mixed.select("band", F.col("m.node").alias("pivot"), F.col("m.component").alias("pivot_component"))
    return materialize(labelled.join(mixed, "band"), "unsettled")


def _links_to_components(unsettled: DataFrame, found: DataFrame, docs: DataFrame, s: Sketch) -> DataFrame:
    """Links (a, b) between members outside a bucket's largest component and that component: one for each member and block that has any."""
    asking = materialize(unsettled.filter("component <> pivot_component").select("node", F.col("pivot_component").alias("component")).distinct(), "asking")
    groups = asking.groupBy("component").agg(F.count(F.lit(1)).alias("asking"))
    core = unsettled.filter("component = pivot_component").select("node", "component").distinct().unionByName(found).distinct().join(groups, "component")
    sizes = core.groupBy("component").agg(F.count(F.lit(1)).alias("held"), F.first("asking").alias("asking"))
    parts = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
    sizes = materialize(sizes.select("component", parts("asking", 256).alias("x_parts"), parts("held", 512).alias("y_parts")), "component-parts")
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = asking.join(sizes, "component").select("node", "component", F.lit(True).alias("asks"), deal("x_parts").alias("x"), every("y_parts").alias("y"))
    y = core.select("node", "component").join(sizes, "component").select("node", "component", F.lit(False).alias("asks"), deal("y_parts").alias("y"), every("x_parts").alias("x"))
    both = materialize(x.unionByName(y), "to-compare")
    sets = _read_sets(docs, both.select("node").distinct(), s)
    met = both.join(sets, "node").groupBy("component", "x", "y").applyInArrow(lambda t: _compare(t, s.percent), "a long, b long")
    return materialize(met, "component-links")


def _compare(table: pa.Table, percent: int) -> pa.Table:
    asks, node = table["asks"].to_numpy(zero_copy_only=False).astype(bool), table["node"].to_numpy()
    items = [np.array(x.as_py(), np.int64) for x in table["items"]]
    held = np.flatnonzero(~asks)
    a, b = [], []
    if len(held):
        sizes = np.array([len(items[i]) for i in held])
        flat, owner = np.concatenate([items[i] for i in held]), np.repeat(np.arange(len(held)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for i in np.flatnonzero(asks):
            low, high = np.searchsorted(flat, items[i], "left"), np.searchsorted(flat, items[i], "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(held))
            near = np.flatnonzero((100 * shared >= percent * (sizes + len(items[i]) - shared)) & (node[held] != node[i]))
            if len(near):
                a.append(node[i])
                b.append(node[held[near[0]]])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _remaining_pairs(unsettled: DataFrame, found: DataFrame, reps: DataFrame, s: Sketch) -> DataFrame:
    """Pairs in a bucket, both outside its largest component, that are by now (``found``) in different ones and may still reach the threshold."""
    outside = unsettled.filter("component <> pivot_component").select("band", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    bits = reps.join(outside.select("node").distinct(), "node").select("node", "n", "registers").mapInArrow(lambda it: _bits(it, s), "node long, n long, bits array<long>, keys array<long>")
    known = materialize(outside.join(bits, "node"), "remaining")
    words = -(-s.registers // 16)
    side = lambda x: known.select("band", F.col("node").alias(f"{x}"), F.col("component").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"k_{x}"), *[F.col("bits")[i].alias(f"{x}{i}") for i in range(words)])
    lowest = F.lit(0x1111111111111111)  # of each four bits

    def differing(i: int) -> Column:
        z = F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3)).bitwiseAND(lowest))

    q = (1 - s.percent / 100) * 15 / 16  # of registers that differ, at the threshold
    near = sum((differing(i) for i in range(1, words)), differing(0)) <= int(s.registers * q + 4.5 * math.sqrt(s.registers * q * (1 - q)))
    earlier = lambda x: F.slice(f"k_{x}", 1, F.array_position(f"k_{x}", F.col("band")).cast("int") - 1)
    first = ~F.arrays_overlap(earlier("x"), earlier("y"))  # a pair meets in the first band that it shares
    met = side("x").join(side("y"), "band").filter((F.col("x") < F.col("y")) & (F.col("c_x") != F.col("c_y")) & _size_bound("n_x", "n_y", s) & near & first)
    return met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def keep_one_each(docs: DataFrame, s: Sketch = Sketch()) -> DataFrame:
    """The document of smallest id of each group; of rows that share an id one stays, rows with a null id all do."""
    groups = materialize(near_duplicates(docs, s).filter("doc_id IS NOT NULL"), "groups")
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if groups.filter("kept").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    return left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(left.filter("doc_id IS NULL"))
