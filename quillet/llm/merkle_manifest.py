"""A Merkle manifest of a dataset: a tree per group, one over the groups, and a proof for every row.

Rows become leaves where they lie. Leaves (not texts) are sorted by range on group
and order and written with their number in the partition; how many rows of a group
each partition holds gives the place of the partition's first one in the group.
Runs of a group within a partition build every complete, aligned subtree they hold,
a window of ``FAN ** LEVELS`` leaves at most; what stays ragged at the ends of a
run goes by its coordinate (group, window) to one task per window, which makes the
window's root. Window roots are built up in the same way, ``LEVELS`` levels a
round, to one subroot per group; the subroots are the leaves of the tree over the
groups, built by the same steps. No group's rows meet in one task or the driver.

A path lists, level by level from the leaf, the digests left and right of the node
in its run of ``FAN``. Paths are made for leaves up to their run's subtree and
for the tops of subtrees up to the root; the two are joined by coordinate, and
proofs and folded roots follow from them by column functions.

Defined cases: nulls are leaves' ``-``; a null group is a group of its own and comes
first; rows without an id come first in their group and are never tampered with;
rows that share an id follow in the order of their leaves; repeated rows are leaves
each; an empty text has length 0, which is not null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.runtime import materialize

FAN = 3
LEVELS = 6
WINDOW = FAN**LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def tagged(value: Column) -> Column:
    """A value with its length in front, so that neighbours can't run into each other; '-' for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a document, with ``text`` as its text."""
    return digest(*[tagged(F.col(f)) for f in FIELDS[:-1]], tagged(text))


# --- subtrees ----------------------------------------------------------------------------------------------------------------------


def complete_subtrees(nodes: list[str], first: int, total: int) -> list[list[tuple[int, str]]]:
    """Nodes of each level that follow wholly from ``nodes``, which stand at ``first`` and after in a level of ``total``.

    A level's nodes are contiguous; element k is the list of (index, digest) of level k.
    """
    held, have = [[(first + i, x) for i, x in enumerate(nodes)]], total
    while len(held) <= LEVELS and have > 1:
        below = held[-1]
        low, end = below[0][0], below[-1][0] + 1
        parents = range(-(-low // FAN), -(-end // FAN) if end == have else end // FAN)
        if not len(parents):
            break
        held.append([(p, _h(*(x for _, x in below[p * FAN - low : min(p * FAN + FAN, have) - low]))) for p in parents])
        have = -(-have // FAN)
    return held


def path_up(held: list[list[tuple[int, str]]], index: int) -> tuple[int, int, str, list[str], list[str]]:
    """The top that a node of the lowest level reaches: its level, index and digest, and what lies left and right on the way."""
    left, right, level = [], [], 0
    while level + 1 < len(held) and held[level + 1][0][0] <= index // FAN <= held[level + 1][-1][0]:
        low = held[level][0][0]
        run = held[level][max(index // FAN * FAN - low, 0) : index // FAN * FAN + FAN - low]
        left.append("".join(x for i, x in run if i < index))
        right.append("".join(x for i, x in run if i > index))
        index, level = index // FAN, level + 1
    return level, index, held[level][index - held[level][0][0]][1], left, right


_TOP = [("top_level", pa.int32()), ("top_index", pa.int64()), ("top", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]
_TOP_SQL = "top_level int, top_index long, top string, left array<string>, right array<string>"


def _runs(keep: list[tuple[str, pa.DataType]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows ``keep..., run, group, place, total, node`` in that order: each with the top of its complete subtree and the path to it.

    Rows of one run and group whose places follow each other and lie in one window are built together.
    """
    schema = pa.schema([*keep, ("group", pa.string()), ("place", pa.int64()), ("total", pa.int64()), *_TOP])

    def built(rows: list[tuple]) -> list[tuple]:
        *_, first, total, _ = rows[0]
        held = complete_subtrees([r[-1] for r in rows], first, total)
        return [(*r[: len(keep)], *r[-4:-1], *path_up(held, r[-3])) for r in rows]

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *_, run, group, place, _, _ = row
                if window and ((run, group, place - 1) != window[-1][-5:-2] or place % WINDOW == 0):
                    out += built(window)
                    window = []
                window.append(row)
                if len(out) > 2000:
                    yield _batch(out, schema)
                    out = []
        out += built(window) if window else []
        if out:
            yield _batch(out, schema)

    return partition


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_TOPS = "group string, total long, level int, index long, top_level int, top_index long, top string, left array<string>, right array<string>"


def _finish_window(rows: pa.Table) -> pa.Table:
    """Ragged tops ``group, total, level, index, node`` of one window (``WINDOW`` rows at most): each with its path to the window's root."""
    schema = pa.schema([("group", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), *_TOP])
    tops = list(zip(*(c.to_pylist() for c in rows.columns), strict=True))
    group, total = tops[0][:2]
    known = {(level, index): node for _, _, level, index, node in tops}
    siblings: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for level in range(LEVELS):
        if total <= FAN**level:
            break
        runs: dict[int, list[tuple[int, str]]] = {}
        for index in sorted(i for at, i in known if at == level):
            runs.setdefault(index // FAN, []).append((index, known[level, index]))
        for parent, run in runs.items():
            known[level + 1, parent] = _h(*(x for _, x in run))
            siblings |= {(level, i): run for i, _ in run}
    out = []
    for _, _, level, index, _ in tops:
        left, right, at, i = [], [], level, index
        while (at, i) in siblings:
            left.append("".join(x for k, x in siblings[at, i] if k < i))
            right.append("".join(x for k, x in siblings[at, i] if k > i))
            at, i = at + 1, i // FAN
        out.append((group, total, level, index, at, i, known[at, i], left, right))
    return pa.Table.from_batches([_batch(out, schema)])


# --- the tree of each group ------------------------------------------------------------------------------------------------------


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows sorted by range with ``run, place, total``: the partition, the place in the group and the group's size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ordered = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())  # partition and row in it
    kept = materialize(ordered.select("*", F.shiftright("_at", 33).alias("run"), F.col("_at").bitwiseAND(F.lit(2**33 - 1)).alias("_row")).drop("_at"), "sorted")
    counts = kept.groupBy("run", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))  # a row per partition and group in it
    before = Window.partitionBy(group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("run", group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    joined = kept.join(materialize(offsets, "offsets"), ["run", group])
    return joined.withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_shift")


def _size(level: str) -> Column:
    return F.expr(f"cast(power({FAN}, {level}) as long)")


def _finished(tops: DataFrame) -> DataFrame:
    """_TOPS of ``group, total, level, index, node``: what is a whole window or tree is its own top, the rest is finished by window."""
    done = (F.col("level") == LEVELS) | (F.col("total") <= _size("level"))
    none = F.array().cast("array<string>")
    straight = tops.filter(done).select("group", "total", "level", "index", F.col("level").alias("top_level"), F.col("index").alias("top_index"), F.col("node").alias("top"), none.alias("left"), none.alias("right"))
    ragged = tops.filter(~done).withColumn("_window", F.expr(f"index * cast(power({FAN}, level) as long) div {WINDOW}"))
    joined = ragged.groupBy("group", "_window").applyInArrow(lambda t: _finish_window(t.select(["group", "total", "level", "index", "node"])), _TOPS)
    return materialize(straight.unionByName(joined), "tops")


@dataclass(frozen=True)
class Trees:
    """``rows``: each row with its top and the path to it; ``rounds``: _TOPS of each round of levels; ``roots``: group, root."""

    rows: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame


def group_trees(rows: DataFrame, keep: list[tuple[str, pa.DataType]], group: str, order: list[str], node: str) -> Trees:
    """The tree over each group's nodes, in the order of ``order``; ``keep`` are columns that rows hold on to."""
    columns = ", ".join([*(f"{n} {'long' if kind == pa.int64() else 'string'}" for n, kind in keep), "group string, place long, total long", _TOP_SQL])
    at = placed(rows, group, order).sortWithinPartitions("run", group, "place")
    arranged = at.select(*[n for n, _ in keep], "run", F.col(group).alias("group"), "place", "total", node)
    local = materialize(arranged.mapInArrow(_runs(keep), columns), "subtrees")
    first = F.col("place") == F.col("top_index") * _size("top_level")  # a top's leftmost row speaks for it
    tops = local.filter(first).select("group", "total", F.col("top_level").alias("level"), F.col("top_index").alias("index"), F.col("top").alias("node"))
    rounds, most = [], local.agg(F.max("total")).first()[0] or 0
    while True:
        rounds.append(_finished(tops))
        most = -(-most // WINDOW)
        if most <= 1:
            break
        above = rounds[-1].filter(F.col("total") > WINDOW).select("group", F.expr(f"(total + {WINDOW - 1}) div {WINDOW}").alias("total"), F.lit(0).alias("level"), F.col("top_index").alias("index"), F.col("top").alias("node"))
        tops = above.distinct()
    last = [r.filter(F.col("total") <= WINDOW).select("group", F.col("top").alias("root")).distinct() for r in rounds]
    return Trees(local, rounds, reduce(DataFrame.unionByName, last))


def paths(trees: Trees, above: DataFrame) -> DataFrame:
    """``group, level, index, left, right`` of each top of the first round and the columns of ``above(group, left, right, ...)``, whose path follows.

    The path above a group's root joins that group's last round, which has a window's rows at most.
    """
    more = [c for c in above.columns if c not in ("group", "left", "right")]
    beyond = above.withColumnsRenamed({"left": "_left", "right": "_right"})
    found = None
    for r in reversed(trees.rounds):
        ends = r.filter(F.col("total") <= WINDOW).join(beyond, "group")
        if found is not None:
            upper = found.filter("level = 0").select("group", F.col("index").alias("top_index"), F.col("left").alias("_left"), F.col("right").alias("_right"), *more)
            ends = ends.unionByName(r.filter(F.col("total") > WINDOW).join(upper, ["group", "top_index"]))
        found = ends.select("group", "level", "index", F.concat("left", "_left").alias("left"), F.concat("right", "_right").alias("right"), *more)
    return found


def _of_rows(trees: Trees, above: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, group, left, right`` of each row, its whole path, and the further columns of ``above``."""
    tops = paths(trees, above).withColumnsRenamed({"level": "top_level", "index": "top_index", "left": "_l", "right": "_r"})
    joined = trees.rows.join(tops, ["group", "top_level", "top_index"])
    more = [c for c in above.columns if c not in ("group", "left", "right")]
    return joined.select(*keep, "group", F.concat("left", "_l").alias("left"), F.concat("right", "_r").alias("right"), *more)


def merkle_manifest(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, found_leaf, subroot, root, left, right`` of every row.

    ``found`` is the text as it is found when the dataset is checked (else the text
    itself); ``found_leaf`` is null where it makes the same leaf. The path's
    element k holds the digests left and right of the node in its run on level k.
    """
    group = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))  # null before all others
    own, other = leaf(F.col("text")), leaf(F.col("text") if found is None else found)
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("group"), own.alias("leaf"), F.nullif(other, own).alias("found_leaf"))
    kept = [("doc_id", pa.int64()), ("leaf", pa.string()), ("found_leaf", pa.string())]
    each = group_trees(materialize(leaves, "leaves"), kept, "group", ["doc_id", "leaf"], "leaf")
    subroots = each.roots.select(F.col("group").alias("member"), F.col("root").alias("subroot"), F.lit("").alias("group"))
    whole = group_trees(subroots, [("member", pa.string()), ("subroot", pa.string())], "group", ["member"], "subroot")
    none = F.array().cast("array<string>")
    upper = _of_rows(whole, whole.roots.select("group", none.alias("left"), none.alias("right"), "root"), ["member", "subroot"])
    upper = materialize(upper.select(F.col("member").alias("group"), "left", "right", "subroot", "root"), "group-paths")
    rows = _of_rows(each, upper, ["doc_id", "leaf", "found_leaf"])
    return rows.select("doc_id", F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1)).alias("source"), "leaf", "found_leaf", "subroot", "root", "left", "right")


def proof(left: Column, right: Column) -> Column:
    """All siblings of a path, level by level."""
    return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "")


def folded(node: Column, left: Column, right: Column) -> Column:
    """The root that follows from a leaf and a path."""
    steps = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(steps, node, lambda x, s: digest(s["a"], x, s["b"]))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Manifest, proofs and the check of them, after line breaks were taken out of every other text."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle_manifest(docs, found)
    root = folded(F.coalesce("found_leaf", "leaf"), F.col("left"), F.col("right"))
    made = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("left"), F.col("right")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
