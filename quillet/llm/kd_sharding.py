"""Shards by a k-d tree over document metadata.

Rows of equal text form a unit, so copies share a shard. A node of the tree is
split at the weighted median (weights: bytes) of the dimension in which it is
widest, as a share of the whole table's width, until there are as many leaves as
shards; with ``target_bytes`` that number follows from the table's bytes. Medians
are found by digits: one histogram of at most 2^16 digits per node and pass, so
no node's rows meet in one task and only one row per node reaches the driver.

Only a unit above a whole shard's bytes (fewer than ``shards`` of them exist) is
dealt into smaller ones by its rows' ids, since no shard could hold it.

``target_bytes`` makes at most ``MOST_SHARDS`` shards, since a row of each node of
a level comes to the driver; more are refused, never made larger in silence.

Defined cases: a null text has size 1 and the checksum of no bytes; null lang,
source or id count as 0 on their axis; repeated rows each take a slot; rows that
tie in every coordinate and hash stay together; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.runtime import materialize

SHARDS = 16
MOST_SHARDS = 65_536
DIMENSIONS = ("d_size", "d_lang", "d_source", "d_id")
_AXIS = 2**31 - 1
_DIGITS = 16


def describe(docs: DataFrame) -> DataFrame:
    """Sizes, checksums and coordinates of every row; the text itself goes no further."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    hashed = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.shiftright(F.crc32(F.col(c).cast("binary")), 1))
    size = (F.octet_length(text) + 1).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        F.floor(F.log2(size.cast("double")) * F.lit(float(2**25))).cast("long").alias("d_size"),
        hashed("lang").alias("d_lang"),
        hashed("source").alias("d_source"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d_id"),
    )


def _key() -> Column:
    """The coordinate along ``_dim``, then a hash of the unit that decides between equal ones; below 2^62."""
    coordinate = F.coalesce(*[F.when(F.col("_dim") == i, F.col(d)) for i, d in enumerate(DIMENSIONS)])
    return F.shiftleft(coordinate, 31) + F.shiftrightunsigned(F.xxhash64("_text", "size", "_sub"), 33)


def _of_nodes(like: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """One row per node of a level (at most as many as shards), for a broadcast."""
    return F.broadcast(like.sparkSession.createDataFrame(rows, f"_node long, {columns}"))


def split_level(units: DataFrame, todo: dict[int, int], extent: dict[str, int]) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """Cut each node of ``todo`` (node -> shards) once: (node, dimension, highest key on the left), and the shards of the new nodes."""
    widths = units.groupBy("_node").agg(F.sum("weight").alias("total"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS])
    dims, goal, below, prefix = {}, {}, {}, {}
    for r in widths.filter(F.col("_node") >= 0).collect():  # a row per node
        if (node := r["_node"]) in todo:
            wide = [r[d] / extent[d] if extent[d] else 0.0 for d in DIMENSIONS]
            dims[node], below[node], prefix[node] = wide.index(max(wide)), 0, 0
            goal[node] = r["total"] * (todo[node] // 2) // todo[node]
    if not dims:
        return [], {}
    keyed = units.join(_of_nodes(units, list(dims.items()), "_dim int"), "_node").select("_node", _key().alias("_key"), "weight")
    cuts, made = [], {}
    for shift in (48, 32, 16, 0):
        state = _of_nodes(units, [(n, prefix[n], goal[n] - below[n]) for n in dims], "_prefix long, _need long")
        at = keyed.join(state, "_node")
        if shift < 48:
            at = at.filter(F.shiftright("_key", shift + _DIGITS) == F.col("_prefix"))
        digits = at.groupBy("_node", "_need", F.shiftright("_key", shift).alias("_p")).agg(F.sum("weight").alias("w"))  # at most 2^16 per node
        upto = digits.withColumn("upto", F.sum("w").over(Window.partitionBy("_node").orderBy("_p")))
        for r in upto.filter(F.col("upto") >= F.col("_need")).groupBy("_node").agg(F.min(F.struct("_p", "w", "upto")).alias("m")).collect():  # a row per node
            node, m = r["_node"], r["m"]
            upper = below[node] + m["upto"]
            prefix[node], below[node] = m["_p"], upper - m["w"]
            if shift == 0:  # the unit at the median goes where it leaves less difference
                goes_left = upper - goal[node] <= goal[node] - below[node]
                cuts.append((node, dims[node], m["_p"] if goes_left else m["_p"] - 1))
                made |= {2 * node + 1: todo[node] // 2, 2 * node + 2: todo[node] - todo[node] // 2}
    return cuts, made


def assign_leaves(units: DataFrame, shards: int) -> DataFrame:
    """Add ``shard``: the leaf's number from left to right."""
    extent = units.agg(*[F.coalesce(F.max(d) - F.min(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first().asDict()
    at, first, level = units.withColumn("_node", F.lit(0).cast("long")), {0: 0}, {0: shards}
    while todo := {node: n for node, n in level.items() if n > 1}:
        cuts, made = split_level(at, todo, extent)
        if not cuts:
            break
        for node, _, _ in cuts:
            first |= {2 * node + 1: first[node], 2 * node + 2: first[node] + made[2 * node + 1]}
        level = {n: k for n, k in level.items() if k == 1} | made
        at = at.join(_of_nodes(at, cuts, "_dim int, _cut long"), "_node", "left")
        child = F.when(F.col("_cut").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + F.when(_key() <= F.col("_cut"), 1).otherwise(2))
        at = materialize(at.withColumn("_node", child).drop("_dim", "_cut"), "kd-level")
    return at.join(_of_nodes(at, list(first.items()), "shard int"), "_node").drop("_node")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; shards are of near equal bytes."""
    rows = materialize(describe(docs), "metadata")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes)) if target_bytes else SHARDS
    if shards > MOST_SHARDS:
        raise ValueError(f"{shards} shards are more than {MOST_SHARDS}")
    per_shard = total / shards
    groups = rows.groupBy("_text", "size").agg(F.count(F.lit(1)).alias("n"))
    heavy = groups.filter(F.col("n") * F.col("size") > per_shard).select(F.col("_text"), F.col("size"), F.ceil(F.col("n") * F.col("size") / F.lit(max(per_shard / 16, 1.0))).alias("_parts"))
    dealt = rows.join(F.broadcast(heavy), ["_text", "size"], "left")  # fewer than ``shards`` rows
    dealt = dealt.withColumn("_sub", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"))).drop("_parts")
    first = [F.min_by(d, F.col("doc_id")).alias(d) for d in DIMENSIONS if d != "d_size"]
    units = dealt.groupBy("_text", "size", "_sub").agg(F.sum("size").alias("weight"), F.first("d_size").alias("d_size"), *first)
    low, high = rows.agg(F.min("d_id"), F.max("d_id")).first()
    span = max(1, (high or 0) - (low or 0))
    scaled = F.floor((F.coalesce("d_id", F.lit(0)).cast("double") - F.lit(float(low or 0))) / F.lit(float(span)) * F.lit(float(_AXIS - 1))).cast("long")
    units = units.withColumn("d_id", scaled).fillna(0, ["d_lang", "d_source"])
    units = materialize(units, "units")
    placed = assign_leaves(units, shards).select("_text", "size", "_sub", "shard")
    return with_slots(dealt.join(placed, ["_text", "size", "_sub"]).select("doc_id", "size", "text_crc32", "shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard: numbers within a partition plus the partition's offset."""
    kept = materialize(rows.withColumn("_part", F.spark_partition_id()), "sharded")
    counts = kept.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", "shard").orderBy("doc_id", "text_crc32")) - 1
    return kept.withColumn("_k", within).join(offsets, ["_part", "shard"]).select(*rows.columns, (F.col("_k") + F.col("_before")).cast("long").alias("slot"))
