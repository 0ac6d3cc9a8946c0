"""Nearest neighbours by largest inner product, over stable projections in k-d trees.

Vectors get one more component so that all have the same length; then the largest
inner product is the smallest Euclidean distance. Gaussian (2-stable) projections
to a few dimensions are indexed by one k-d partition of the whole table: its cuts
are fitted on at most ``sample`` rows (those of smallest hash), every row is put
into its cell, and cells of more than ``block`` rows are dealt into parts. Each part
has a k-d tree of its own.

For a vector at the distance of a query's k-th best so far, its squared projected
distance over its squared distance is chi-square distributed. A query first searches
a part of its own cell. With the k-th best of that it goes on to the parts of the
cells that such a vector would be in with a probability of at least 1 -
``confidence``. Within a part it visits leaves in order of their projected distance,
verifies their vectors by true distance and stops by the same test. Nothing is capped.

Defined cases: vectors that are null, zero, hold null or non-finite components, or
aren't of the table's most frequent dimension (of equally frequent ones the
smallest), and rows with a null id, take no part. Rows of a query's own id are no
candidates of it; an id repeated among queries is searched once, by its smallest
vector; among candidates each id counts once, by its best score. Equal scores go
to the smaller id. With fewer than k candidates all are returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.runtime import materialize


@dataclass(frozen=True)
class Index:
    k: int = 20
    dimensions: int = 8  # even
    confidence: float = 0.97
    leaf: int = 256
    block: int = 4096  # rows of a part, about
    query_block: int = 8192  # queries that meet a part in one task, about
    sample: int = 20_000  # rows that the cuts are fitted on, at most
    least_fit: int = 8  # of these rows in each cell
    seed: int = 11

    def cells(self, rows: int) -> int:
        """A power of two, at most sample / least_fit."""
        most = max(1, min(rows, self.sample) // self.least_fit)
        return 1 << min((-(-rows // self.block) - 1).bit_length(), most.bit_length() - 1)


def chi_square_quantile(p: float, dimensions: int) -> float:
    """By bisection on the closed form for even dimensions."""
    upper = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
    low, high = 0.0, 1.0
    while upper(high) > 1 - p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if upper(middle) > 1 - p else (low, middle)
    return high


class Projection:
    def __init__(self, width: int, length: float, s: Index) -> None:
        """``length`` bounds every vector's norm."""
        self.length = length
        self.axes = np.random.default_rng(s.seed).normal(size=(width + 1, s.dimensions))

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length**2 - (vectors * vectors).sum(1), 0.0))
        return np.column_stack([vectors, rest]) @ self.axes

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.axes[:-1]


class Cuts:
    """A k-d partition: the axis and the place of each cut, level by level."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.cells = cells
        self.axis, self.place = np.zeros(cells - 1, np.int64), np.full(cells - 1, np.inf)
        held = {0: points}
        for node in range(cells - 1):
            part = held.pop(node)
            if len(part):
                axis = int(np.argmax(part.max(0) - part.min(0)))
                self.axis[node], self.place[node] = axis, np.sort(part[:, axis])[(len(part) - 1) // 2]
            left = part[:, self.axis[node]] <= self.place[node]
            held[2 * node + 1], held[2 * node + 2] = part[left], part[~left]

    def of(self, points: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.cells.bit_length() - 1):
            node = 2 * node + 1 + (points[every, self.axis[node]] > self.place[node])
        return node - (self.cells - 1)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        x = points[:, axis, None]
        gap = np.maximum(np.maximum(low[None, :, axis] - x, x - high[None, :, axis]), 0.0)
        out += gap * gap
    return out


class KdTree:
    """Leaves of a k-d tree: row numbers, and the box that each leaf's points fill."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                self.leaves.append(np.sort(rows))
                continue
            part = points[rows]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            half = len(rows) // 2
            order = np.argpartition(part[:, axis], half)
            todo += [rows[order[:half]], rows[order[half:]]]
        self.low = np.array([points[r].min(0) for r in self.leaves])
        self.high = np.array([points[r].max(0) for r in self.leaves])


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; the rounding errors of their sums are summed up, too."""
    products = (a * b).T.copy()
    total, lost = products[0], np.zeros(len(a))
    for p in products[1:]:
        s = total + p
        z = s - total
        lost += (total - (s - z)) + (p - z)
        total = s
    return total + lost


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Part:
    """Rows of a part by distinct vectors, in order of their smallest ids, and the tree over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: Projection, s: Index) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, inverse = np.unique(vectors.view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by_id = np.argsort(first)
        place = np.empty(len(first), np.int64)
        place[by_id] = np.arange(len(first))
        group = place[inverse.ravel()]
        self.vectors = vectors[first[by_id]]
        self.ids = ids[np.argsort(group, kind="stable")]
        self.sizes = np.bincount(group)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.only = np.where(self.sizes == 1, self.ids[self.starts], -1), self.sizes == 1
        self.most = int(np.unique(ids, return_counts=True)[1].max())  # vectors of one id
        self.projection, self.s = projection, s
        self.tree = KdTree(projection.rows(self.vectors), s.leaf)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of the k best ids of each query that score ``floor`` at least."""
        s, n, length = self.s, len(self.vectors), self.projection.length
        width, kth = min(n, (s.k + 8) * self.most), s.k * self.most - 1
        best, rows = np.full((len(queries), width), -np.inf), np.zeros((len(queries), width), np.int64)
        bound = floor.copy()  # of the score that may still count
        norms = np.sqrt((queries * queries).sum(1))
        slack, tiny = 1e-9 * np.maximum(1.0, norms * length), 1e-12 * length * length
        quantile = chi_square_quantile(s.confidence, s.dimensions)
        distances = box_distances(self.projection.queries(queries), self.tree.low, self.tree.high)
        order = np.argsort(distances, axis=1, kind="stable")
        active = np.arange(len(queries))
        for r in range(len(self.tree.leaves)):
            squared = np.maximum(norms[active] ** 2 + length * length - 2 * bound[active], 0.0)  # infinite without a bound
            active = active[distances[active, order[active, r]] <= quantile * squared + tiny]
            leaf_of = order[active, r]
            by_leaf = np.argsort(leaf_of, kind="stable")
            for some in np.split(active[by_leaf], np.flatnonzero(np.diff(leaf_of[by_leaf])) + 1):
                if not len(some):
                    continue
                leaf = self.tree.leaves[order[some[0], r]]
                score = queries[some] @ self.vectors[leaf].T
                score[(self.only[0][leaf] == query_ids[some][:, None]) & self.only[1][leaf]] = -np.inf
                least = np.maximum(bound[some] - slack[some], best[some, -1])
                hit = np.flatnonzero((score > least[:, None]).any(1))
                if not len(hit):
                    continue
                some = some[hit]
                both = np.concatenate([best[some], score[hit]], axis=1)
                where = np.concatenate([rows[some], np.broadcast_to(leaf, (len(some), len(leaf)))], axis=1)
                ranked = np.lexsort((where, -both), axis=1)[:, :width] if len(some) < 8 else self._largest(both, where, width)
                best[some], rows[some] = np.take_along_axis(both, ranked, 1), np.take_along_axis(where, ranked, 1)
                if kth < width:
                    bound[some] = np.maximum(bound[some], best[some, kth])
        q, column = np.nonzero(best > -np.inf)
        group = rows[q, column]
        score = exact_products(queries[q], self.vectors[group]) if len(q) else np.empty(0)
        owner, k = _spread(np.minimum(self.sizes[group], s.k + 1))
        q, score, ids = q[owner], score[owner], self.ids[self.starts[group][owner] + k]
        keep = (ids != query_ids[q]) & (score >= floor[q])
        q, score, ids = q[keep], score[keep], ids[keep]
        keep = np.lexsort((-score, ids, q))
        q, score, ids = q[keep], score[keep], ids[keep]
        keep = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]))[: len(q)]
        q, score, ids = q[keep], score[keep], ids[keep]
        keep = np.lexsort((ids, -score, q))
        q, score, ids = q[keep], score[keep], ids[keep]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < s.k], ids[rank < s.k], score[rank < s.k]

    @staticmethod
    def _largest(score: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
        """Places of the ``width`` largest of each row, largest first; of equal ones those of smaller ids."""
        if score.shape[1] > 4 * width:
            few = np.argpartition(-score, 2 * width, axis=1)[:, : 2 * width]
            cut = np.take_along_axis(score, few, 1)
            ranked = np.lexsort((np.take_along_axis(where, few, 1), -cut), axis=1)[:, :width]
            last = np.take_along_axis(cut, ranked[:, -1:], 1)
            if not ((score >= last).sum(1) > 2 * width).any() or np.isinf(last).all():  # else equal ones may have been left out
                return np.take_along_axis(few, ranked, 1)
        return np.lexsort((where, -score), axis=1)[:, :width]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


_FOUND = "query_id long, vec_id long, score double"


def _search(table: pa.Table, projection: Projection, s: Index) -> pa.Table:
    asks = table["asks"].to_numpy().astype(bool)
    ids, floor = table["vec_id"].to_numpy(), table["floor"].to_numpy()
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    query, found, score = empty
    if asks.any() and not asks.all():
        vectors = _matrix(table["vector"], len(ids))
        query, found, score = Part(ids[~asks], vectors[~asks], projection, s).search(ids[asks], vectors[asks], floor[asks])
    return pa.table([pa.array(ids[asks][query]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])


def _points(batches: Iterator[pa.RecordBatch], projection: Projection) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(projection.rows(_matrix(batch.column("vector"), batch.num_rows))), pa.list_(pa.float64()))], names=["point"])


def _indexed(batches: Iterator[pa.RecordBatch], projection: Projection, cuts: Cuts) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            points = projection.rows(_matrix(batch.column("vector"), batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts.of(points).astype(np.int32)), pa.array(list(points), pa.list_(pa.float64()))], names=["vec_id", "vector", "cell", "point"])


def _asked(batches: Iterator[pa.RecordBatch], projection: Projection, boxes: tuple[np.ndarray, ...], s: Index) -> Iterator[pa.RecordBatch]:
    """A row of each query for every part that may still hold one of its best, but that of its own cell which it has searched."""
    cells, parts, low, high = boxes
    quantile, length = chi_square_quantile(s.confidence, s.dimensions), projection.length
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            vectors, floor = _matrix(some.column("vector"), some.num_rows), some.column("floor").to_numpy()
            squared = np.maximum((vectors * vectors).sum(1) + length * length - 2 * floor, 0.0)
            near = box_distances(projection.queries(vectors), low, high) <= (quantile * squared + 1e-12 * length * length)[:, None]
            row, box = np.nonzero(near)
            owner, part = _spread(parts[box])
            row, cell = row[owner], cells[box][owner]
            new = (cell != some.column("cell").to_numpy()[row]) | (part != some.column("part").to_numpy()[row])
            row, cell, part = row[new], cell[new], part[new]
            taken = some.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([taken.column("vec_id"), taken.column("vector"), taken.column("floor"), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], names=["vec_id", "vector", "floor", "cell", "part"])


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(finite & F.exists(v, lambda x: x != 0.0))
    rows = materialize(rows, "vectors")
    sizes = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return materialize(rows.filter(F.size(v) == F.lit(sizes["n"] if sizes else 0)).distinct(), "vectors")  # repeated rows would fill parts


def nearest(table: DataFrame, is_query: Column, s: Index = Index(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of every row for which ``is_query`` (over ``vec_id``) holds."""
    rows = valid_vectors(table, id_col, vector_col)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    stat = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("length"), F.sum(is_query.cast("long")).alias("q"), F.max(F.size("vector")).alias("width")).first()
    if not stat["n"]:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    projection = Projection(stat["width"], float(stat["length"]) * (1 + 1e-12), s)
    sample = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(s.sample).select("vector").mapInArrow(lambda it: _points(it, projection), "point array<double>").toArrow()
    cuts = Cuts(_matrix(sample["point"], sample.num_rows), s.cells(stat["n"]))
    indexed = materialize(rows.mapInArrow(lambda it: _indexed(it, projection, cuts), "vec_id long, vector array<double>, cell int, point array<double>"), "cells")
    sides = [f(F.col("point")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(s.dimensions)]
    found = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *sides).collect()  # a row per cell: at most sample / least_fit
    cells, parts = np.array([r["cell"] for r in found], np.int64), np.array([-(-r["n"] // s.block) for r in found], np.int64)
    boxes = cells, parts, *(np.array([[r[f"{name}{i}"] for i in range(s.dimensions)] for r in found]) for name in ("low", "high"))
    of_cell = F.broadcast(rows.sparkSession.createDataFrame(list(zip(cells.tolist(), parts.tolist(), strict=True)), "cell int, parts int"))

    deal = lambda *c: F.pmod(F.xxhash64(*c, F.lit(5)), F.col("parts")).cast("int").alias("part")
    none = F.lit(float("-inf"))
    held = indexed.join(of_cell, "cell").select(F.lit(False).alias("asks"), "vec_id", "vector", none.alias("floor"), "cell", deal("vec_id", "vector"))
    queries = indexed.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("vector", "cell")).alias("v")).select("vec_id", "v.*")
    asking = queries.join(of_cell, "cell").select(F.lit(True).alias("asks"), "vec_id", "vector", none.alias("floor"), "cell", deal("vec_id"))
    own = materialize(held.unionByName(asking).groupBy("cell", "part").applyInArrow(lambda t: _search(t, projection, s), _FOUND), "own-cells")

    floors = own.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= s.k, F.min("score")).alias("floor"))
    bounded = asking.drop("floor").join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    asked = bounded.select("vec_id", "vector", "floor", "cell", "part").mapInArrow(lambda it: _asked(it, projection, boxes, s), "vec_id long, vector array<double>, floor double, cell int, part int")
    blocks = max(1, math.ceil((stat["q"] or 0) / s.query_block))
    asked = materialize(asked.withColumn("by", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int")), "asked")
    met = held.join(asked.select("cell", "part", "by").distinct(), ["cell", "part"])
    both = met.select("asks", "vec_id", "vector", "floor", "cell", "part", "by").unionByName(asked.select(F.lit(True).alias("asks"), "*"))
    others = both.groupBy("cell", "part", "by").applyInArrow(lambda t: _search(t, projection, s), _FOUND)
    best = own.unionByName(others).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= s.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
