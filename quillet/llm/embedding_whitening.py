"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers ``x = floor(64 c) + 1,000,000``. The fit list holds each
distinct vector once. Every task adds up the sums and cross-products of its vectors
less a shift, as integers of any size: products are made in blocks and limbs small
enough for floating point to be exact, and added up as integers. Partial sums are
merged in two steps, a matrix row at a time; the driver gets one matrix. There
``n XtX - S St`` is formed exactly, then divided by n squared into doubles, and only
then decomposed. Each vector's projection starts from the exact ``n x - S``.

Defined cases: a null vector, one without entries, and one with an entry that is
null, not finite or beyond 2^55 has no rows; vectors of another length than the most
frequent (the shorter of equally frequent ones) have none, since they have no
place in the same matrix; repeated rows have rows each and count once in the fit;
rows without an id are kept; a direction without spread, up to rounding, makes no
component, so vectors that are all equal give an empty result, as an empty table
does; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.batches import bounded
from quillet.runtime import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries whose integers leave this bound count as not finite.
MOST = 2.0**55
_LIMB = 18
_BLOCK = 4096


# --- exact sums ------------------------------------------------------------------------------------------------------------------


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Parts of integers, each below 2^18 in size, lowest first: their sum by powers of 2^18 is ``y``."""
    parts = []
    while True:
        low = ((y + (1 << (_LIMB - 1))) & ((1 << _LIMB) - 1)) - (1 << (_LIMB - 1))
        parts.append(low.astype(np.float64))
        y = (y - low) >> _LIMB
        if not y.any():
            return parts


def cross_products(y: np.ndarray) -> np.ndarray:
    """YtY of 64-bit integers as integers of any size; a block's limbs stay below 2^53 in every sum."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for at in range(0, len(y), _BLOCK):
        parts = _limbs(y[at : at + _BLOCK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[i:], i):
                p = (a.T @ b).astype(np.int64).astype(object)
                total += (p if i == j else p + p.T) * (1 << (_LIMB * (i + j)))
    return total


def column_sums(y: np.ndarray) -> np.ndarray:
    """Sums of columns as integers of any size."""
    low, high = y & 0xFFFFFFFF, y >> 32
    return low.sum(axis=0).astype(object) + high.sum(axis=0).astype(object) * (1 << 32)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


_PART = "part int, i int, sums array<string>"


def _partial_sums(vectors: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors: row 0 is n and the sums, row i + 1 the cross-products of dimension i, less the shift."""
    n, sums, cross = 0, None, None
    for batch in vectors:
        if batch.num_rows:
            y = _matrix(batch.column(0)) - SHIFT
            more = column_sums(y), cross_products(y)
            n += len(y)
            sums, cross = more if sums is None else (sums + more[0], cross + more[1])
    if n:
        rows = [[n, *sums], *cross]
        yield _parts(0, enumerate(rows))


def _parts(part: int, rows) -> pa.RecordBatch:  # noqa: ANN001
    rows = [(part, i, [str(v) for v in row]) for i, row in rows]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "i", "sums"])


def _merge(partials: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows of one (i, part) that follow each other."""
    at, held = None, None
    for batch in partials:
        for part, i, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = [int(v) for v in sums]
            if (i, part) == at:
                held = [a + b for a, b in zip(held, row, strict=True)]
            else:
                if at is not None:
                    yield _parts(at[1], [(at[0], held)])
                at, held = (i, part), row
    if at is not None:
        yield _parts(at[1], [(at[0], held)])


@dataclass(frozen=True)
class Scatter:
    """Exact moments of a fit list: its size, sums by dimension and ``n XtX - S St``."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    @staticmethod
    def of(vectors: DataFrame) -> Scatter | None:
        """Of ``vectors(x)``, arrays of one length; null without any."""
        slots = math.isqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
        partial = vectors.select("x").mapInArrow(_partial_sums, _PART)
        once = partial.select((F.spark_partition_id() % slots).alias("part"), "i", "sums").repartition("i", "part").sortWithinPartitions("i", "part").mapInArrow(_merge, _PART)
        twice = once.select(F.lit(0).alias("part"), "i", "sums").repartition("i").sortWithinPartitions("i").mapInArrow(_merge, _PART)
        rows = {r["i"]: [int(v) for v in r["sums"]] for r in twice.collect()}  # a row per dimension
        if not rows:
            return None
        n, *sums = rows[0]
        s = np.array(sums, object)
        cross = np.array([rows[i + 1] for i in range(len(sums))], object)
        return Scatter(n, [v + n * SHIFT for v in sums], n * cross - np.outer(s, s))  # a shift moves no scatter

    def covariance(self) -> np.ndarray:
        square = self.n * self.n
        return np.array([[v / square for v in row] for row in self.scatter], float)  # correctly rounded quotients of integers


@dataclass(frozen=True)
class Whitening:
    """``axes``: unit eigenvectors as columns by falling ``values``; ``trace`` of the covariance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @staticmethod
    def of(moments: Scatter, components: int = COMPONENTS) -> Whitening:
        v = moments.covariance()
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1], axes[:, ::-1]
        rank = int((values > max(values[0], 0.0) * len(v) * np.finfo(float).eps).sum())
        k = min(components, rank)
        return Whitening(moments.n, moments.sums, axes[:, :k], values[:k], float(np.trace(v)))

    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact ``n x - S``; 64-bit integers where they can't overflow."""
        s = np.array(self.sums, object)
        if len(x) and self.n * int(np.abs(x).max()) + max(map(abs, self.sums)) < 2**62:
            return x * self.n - s.astype(np.int64)
        return x.astype(object) * self.n - s

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(float) / self.n) @ self.axes / np.sqrt(self.values)


def squares(deviations: np.ndarray) -> list[int]:
    """Exact sums of squares by row."""
    if deviations.dtype != object and (not deviations.size or float(np.abs(deviations).max()) ** 2 * deviations.shape[1] < 2.0**62):
        return (deviations * deviations).sum(axis=1).tolist()
    wide = deviations.astype(object)
    return (wide * wide).sum(axis=1).tolist()


# --- tables ----------------------------------------------------------------------------------------------------------------------


def whole_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x`` of rows whose vector is whole: integers by ``floor(64 c) + 1,000,000``."""
    c = F.col(vector)
    fits = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) * SCALE < MOST))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long") + SHIFT)
    good = table.filter(c.isNotNull() & (F.size(c) > 0) & F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    lengths = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    return good.filter(F.size("x") == (lengths[0]["d"] if lengths else 0))


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, measured on all of it."""
    k = len(w.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = w.project(w.deviations(_matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array(made[:, i]) for i in range(k)], [f"w{i}" for i in range(k)])

    made = fit.select("x").mapInArrow(rows, ", ".join(f"w{i} double" for i in range(k)))
    cells = [(i, j) for i in range(k) for j in range(i + 1)]
    row = made.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in cells)


_ROW = "vec_id long, deviation decimal(38,0), whitened array<double>"


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation decimal, whitened, explained, identity_error``, a row per whole vector and component."""
    vectors = whole_vectors(bounded(table), vector)
    fit = materialize(vectors.select("x").distinct(), "fit-list")
    moments = Scatter.of(fit)
    w = Whitening.of(moments, components) if moments else None
    result = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return table.sparkSession.createDataFrame([], result)
    error, explained = identity_error(fit, w), w.explained()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dev = w.deviations(_matrix(batch.column(1)))
            made = w.project(dev)
            off = pa.array([Decimal(v) for v in squares(dev)], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), off, lists], ["vec_id", "deviation", "whitened"])

    def share(i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(e) for e in explained]), i)

    each = vectors.select("vec_id", "x").mapInArrow(rows, _ROW).select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return each.select("vec_id", (F.col("_i") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share(F.col("_i") + 1).alias("explained"), F.lit(error).alias("identity_error"))
