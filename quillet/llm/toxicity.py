"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first letters (so
that inflected forms share a term), each hashed to one of ``Settings.buckets``
buckets. The machine adds a weight per bucket and, through one short vector per
bucket, a weight per pair of them: a pair such as an insult and the mention of a
group can count for more than both alone, or though neither counts alone. Every
bucket of the sample has parameters; pairs count by the mean over a text's terms,
and only if they lower the loss on rows that they were not learnt from.

The machine is fitted on the driver on a bounded sample: of each class at most
``Settings.per_class`` labelled rows outside the held-out fold, those of smallest
id hash. Classes are weighted back to their shares among all labelled rows.
Everything else runs over all rows and whole texts.

Defined cases: a null or empty text has no terms and gets the score of the bias
alone; rows without a label or with a null id are scored and never learnt from;
labels repeated for an id count as toxic if one of them is; without labels of
both classes every score is the share of toxic labels (0.0 without labels);
repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.batches import bounded, text_groups
from quillet.llm.worker_tables import claim, register

THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
PREFIXES = (5,)
KEPT_WORDS = 150_000

_edges = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Settings:
    per_class: int = 3000  # labelled rows of a class to fit on, at most
    buckets: int = 2**18  # that terms are hashed to
    rank: int = 4
    sparse_steps: int = 100
    steps: int = 200  # batches at least, of weights without l1
    epochs: int = 8  # passes over the sample at least
    batch: int = 256
    rate: float = 0.4
    l1: float = 4.0  # standard errors
    l2: tuple[float, ...] = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)  # of a component of unit spread; chosen on held-out rows of the sample
    folds: int = 4  # one of which is held out for that
    gain: float = 0.002  # of mean loss that pairs must bring
    smoothing: float = 30.0  # rows that a bucket must be well above for its vector to move freely
    subspace_steps: int = 12
    pair_steps: int = 150  # downhill from there, at most; how many is chosen on the same held-out rows
    pair_rate: float = 30.0  # of vectors, as pairs count by a text's mean
    seed: int = 7


class Terms:
    """Hashed terms of texts, with a bounded table of the words seen by this worker."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def of(self, text: str) -> np.ndarray:
        words = set(text.lower().split())
        if len(self.known) > KEPT_WORDS:
            self.known = {w: t for w in words if (t := self.known.get(w)) is not None}
        known = self.known
        for word in words.difference(known):
            core = _edges.sub("", word)
            terms = {zlib.crc32(core.encode())} | {zlib.crc32(f"{core[:n]}*".encode()) for n in PREFIXES if len(core) >= n} if core else set()
            known[word] = np.array(sorted(terms), "<u4").tobytes()
        return np.unique(np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4"))


_terms = Terms()
register("toxicity", lambda: setattr(_terms, "known", {}))


class Machine:
    """w0 + sum of w_i + mean over a text's n terms of half the sums <v_i, v_j>, over the buckets that terms are hashed to."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.bias, self.w, self.v = bias, w, v

    def score(self, terms: np.ndarray) -> float:
        i = bucket(terms, len(self.w))
        v = self.v[i].astype(np.float64)
        z = self.bias + self.w[i].sum(dtype=np.float64) + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()) / max(1, len(i))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def bucket(terms: np.ndarray, buckets: int) -> np.ndarray:
    """Place of each 32-bit term in a table of a power of two of buckets."""
    return (terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


class Sample:
    """Rows of the sample as places of a sparse matrix, over the buckets that they use."""

    def __init__(self, docs: list[np.ndarray], toxic: np.ndarray, share: float, used: np.ndarray | None = None) -> None:
        self.toxic, n1 = toxic, toxic.sum()
        self.sizes = np.array([len(d) for d in docs])
        self.starts = np.cumsum(self.sizes) - self.sizes
        every = np.concatenate(docs)
        self.used = np.unique(every) if used is None else used
        self.flat = np.searchsorted(self.used, every)
        self.weight = np.where(toxic > 0, share * len(docs) / n1, (1 - share) * len(docs) / (len(docs) - n1))
        each = self.sums(np.repeat(self.weight, self.sizes))
        self.errors = np.sqrt(share * (1 - share) * each) / len(docs)
        self.counts = np.bincount(self.flat, minlength=len(self.used))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Values of places added up by bucket."""
        return np.bincount(self.flat, weights=values, minlength=len(self.used))

    def rows(self, values: np.ndarray) -> np.ndarray:
        """Values of buckets added up by row."""
        return np.add.reduceat(values[self.flat], self.starts, axis=0)

    def pairs(self, v: np.ndarray) -> np.ndarray:
        """What each column of vectors adds to each row: the mean over its terms of half their pairs."""
        return 0.5 * (self.rows(v) ** 2 - self.rows(v * v)) / self.sizes[:, None]

    def loss(self, z: np.ndarray) -> float:
        return float((self.weight * (np.logaddexp(0.0, z) - self.toxic * z)).mean())


def fit(docs: list[np.ndarray], toxic: np.ndarray, share: float, s: Settings = Settings()) -> Machine:
    """Fit on logistic loss; ``share`` is the share of toxic rows to restore.

    All buckets of the sample have parameters. Weights are learnt together under l1, which
    holds a weight at zero while what the others leave unexplained is within ``l1`` standard
    errors of none for it; those that aren't zero go on without l1. Vectors follow from what
    weights leave: the steepest way to lower the loss by pairs is along the leading
    eigenvectors of the residuals' co-occurrence matrix, and each is as long as lowers the
    loss most under l2. How many there are and how strong l2 is, is settled by the loss on
    rows that the weights and vectors were not fitted on; where pairs tell nothing, that
    is none. From there weights and vectors go on downhill together, as far as that loss
    falls.
    """
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    if not n1 or not n0:
        p = min(max(share, 0.0), 1.0)
        bias = -30.0 if p <= 0 else 30.0 if p >= 1 else float(np.log(p / (1 - p)))
        return Machine(bias, np.zeros(2, np.float32), np.zeros((2, s.rank), np.float32))
    docs, toxic = [bucket(d, s.buckets) for d, _ in zip(docs, toxic, strict=True)], np.asarray(toxic, np.float64)
    some = [len(d) > 0 for d in docs]
    docs, toxic = [d for d, x in zip(docs, some, strict=True) if x], toxic[some]
    whole = Sample(docs, toxic, share)
    rank, l2, steps = settled_pairs(docs, toxic, share, whole.used, s)
    bias, w = linear_weights(whole, s)
    v = np.zeros((len(whole.used), s.rank))
    if rank:
        found, bias = scaled_vectors(whole, bias, w, leading_vectors(whole, bias, w, s)[:, :rank], l2)
        bias, w = beside(whole, bias, w, whole.pairs(found).sum(1), s)  # a weight may only count once the pairs do
        for bias, w, found in islice(refined(whole, bias, w, found, s), steps):
            pass
        v[:, : found.shape[1]] = found
    all_w, all_v = np.zeros(s.buckets, np.float32), np.zeros((s.buckets, s.rank), np.float32)
    all_w[whole.used], all_v[whole.used] = w, v
    return Machine(bias, all_w, all_v)


def settled_pairs(docs: list[np.ndarray], toxic: np.ndarray, share: float, used: np.ndarray, s: Settings) -> tuple[int, float, int]:
    """Number of vector components, l2 of their first lengths and number of steps after that of the least loss on a part of the rows, the others being fitted on; 0 where pairs don't lower it."""
    part = np.random.default_rng(s.seed).permutation(len(docs)) % s.folds == 0
    if any(not toxic[p].sum() or toxic[p].all() for p in (part, ~part)):
        return 0, 0.0, 0
    learning, other = (Sample([docs[i] for i in np.flatnonzero(p)], toxic[p], share, used) for p in (~part, part))
    bias, w = linear_weights(learning, s)
    v, straight = leading_vectors(learning, bias, w, s), other.rows(w)
    without, tried = other.loss(bias + straight), []
    for rank in range(1, v.shape[1] + 1):
        for l2 in s.l2:
            scaled, moved = scaled_vectors(learning, bias, w, v[:, :rank], l2)
            tried.append((other.loss(moved + straight + other.pairs(scaled).sum(1)), -rank, l2))
    loss, rank, l2 = min(tried, default=(np.inf, 0, 0.0))
    if loss >= without:
        return 0, 0.0, 0
    scaled, moved = scaled_vectors(learning, bias, w, v[:, :-rank], l2)
    moved, w = beside(learning, moved, w, learning.pairs(scaled).sum(1), s)
    losses = [loss, *(other.loss(b + other.rows(ws) + other.pairs(vs).sum(1)) for b, ws, vs in islice(refined(learning, moved, w, scaled, s), s.pair_steps))]
    least = int(np.argmin(losses))
    return (-rank, l2, least) if losses[least] < without - s.gain else (0, 0.0, 0)


def refined(sample: Sample, bias: float, w: np.ndarray, v: np.ndarray, s: Settings) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Bias, weights and vectors after each downhill step on those that aren't zero, over the whole sample, every bucket at the pace of its count."""
    n, free, live = len(sample.toxic), w != 0, v != 0
    pace = n * sample.counts / (sample.counts + s.smoothing) ** 2
    length, loss = 1.0, np.inf
    state = bias, w, v
    while True:
        bias, w, v = state
        with np.errstate(over="ignore", invalid="ignore"):
            sums = sample.rows(v)
            z = bias + sample.rows(w) + 0.5 * (sums**2 - sample.rows(v * v)).sum(1) / sample.sizes
            now = sample.loss(z)
        if not now <= loss:  # too far, or beyond all numbers: back to the last state, with half the step
            length *= 0.5
            if length < 1e-6:
                break
        else:
            kept, loss, length = state, now, length * 1.5
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - sample.toxic) * sample.weight / n
            each = np.repeat(g / sample.sizes, sample.sizes)
            m = np.repeat((g / sample.sizes)[:, None] * sums, sample.sizes, axis=0)
            dv = np.stack([sample.sums(m[:, f]) for f in range(v.shape[1])], axis=1) - sample.sums(each)[:, None] * v
            dw = np.where(free, sample.sums(np.repeat(g, sample.sizes)), 0.0)
            moves = g.sum(), pace * dw, np.where(live, pace[:, None] * dv, 0.0)
            yield kept
        state = tuple(x - length * k * d for x, k, d in zip(kept, (1.0, 0.2, s.pair_rate), moves, strict=True))


def linear_weights(sample: Sample, s: Settings) -> tuple[float, np.ndarray]:
    """Bias and weights: under l1, then those that aren't zero without it."""
    p = float((sample.weight * sample.toxic).mean())
    return freed_weights(sample, *beside(sample, float(np.log(p / (1 - p))), np.zeros(len(sample.used)), np.zeros(len(sample.toxic)), s), s)


def beside(sample: Sample, bias: float, w: np.ndarray, pairs: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Bias and weights under l1, beside what the pairs add."""
    return sparse_weights(bias, w, pairs, sample.flat, sample.starts, sample.sizes, sample.toxic, sample.weight, s.l1 * sample.errors, s.sparse_steps)


def freed_weights(sample: Sample, bias: float, w: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Weights that aren't zero go on without l1, in adaptive steps over batches."""
    free = np.flatnonzero(w)
    if not len(free):
        return bias, w
    place = np.full(len(sample.used), -1)
    place[free] = np.arange(len(free))
    at = place[sample.flat]
    row, column = np.repeat(np.arange(len(sample.toxic)), sample.sizes)[at >= 0], at[at >= 0]
    own, squared, squared_bias = w[free], np.full(len(free), 1e-8), 1e-6
    ends = np.searchsorted(row, np.arange(len(sample.toxic) + 1))
    rng = np.random.default_rng(s.seed)
    for _ in range(max(s.epochs, -(-s.steps * s.batch // len(sample.toxic)))):
        order = rng.permutation(len(sample.toxic))
        for k in range(0, len(order), s.batch):
            rows = order[k : k + s.batch]
            n = ends[rows + 1] - ends[rows]
            first = np.cumsum(n) - n
            ids = column[np.repeat(ends[rows] - first, n) + np.arange(n.sum())]
            z = bias + np.bincount(np.repeat(np.arange(len(rows)), n), weights=own[ids], minlength=len(rows))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - sample.toxic[rows]) * sample.weight[rows] / len(rows)
            dw = np.bincount(ids, weights=np.repeat(g, n), minlength=len(free))
            squared += dw * dw
            squared_bias += g.sum() ** 2
            own = own - s.rate * dw / np.sqrt(squared)
            bias -= s.rate * g.sum() / np.sqrt(squared_bias)
    w = w.copy()
    w[free] = own
    return float(bias), w


def leading_vectors(sample: Sample, bias: float, w: np.ndarray, s: Settings) -> np.ndarray:
    """Leading eigenvectors, by subspace steps, of the sum over rows of residual / terms times (x xt - diagonal).

    Buckets are scaled by their counts, so that frequent terms don't win by that alone, nor
    rare ones by rows that happen to share them. Entries within ``l1`` standard deviations of
    chance are zero, as the many terms that tell nothing must not add up.
    """
    z = bias + sample.rows(w)
    r = (sample.toxic - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * sample.weight / sample.sizes
    scale = (np.sqrt(sample.counts) / (sample.counts + s.smoothing))[:, None]
    diagonal = sample.sums(np.repeat(r, sample.sizes))[:, None]

    def times(q: np.ndarray) -> np.ndarray:
        u = scale * q
        m = np.repeat(r[:, None] * sample.rows(u), sample.sizes, axis=0)
        return scale * (np.stack([sample.sums(m[:, f]) for f in range(m.shape[1])], axis=1) - diagonal * u)

    q = np.linalg.qr(np.random.default_rng(s.seed).normal(size=(len(sample.used), min(s.rank + 4, len(sample.used)))))[0]
    for _ in range(s.subspace_steps):
        q = np.linalg.qr(times(q))[0]
    h = q.T @ times(q)
    values, turned = np.linalg.eigh((h + h.T) / 2)
    leading = [i for i in np.argsort(-values) if values[i] > 0][: s.rank]  # a pair of like vectors can only add
    v, chance = q @ turned[:, leading], (sample.counts / (sample.counts + s.smoothing))[:, None]  # how an entry varies by chance, up to a factor
    there = sample.counts > 0
    spread = np.median(np.abs(v[there]) / chance[there], axis=0) / 0.6745
    return scale * np.sign(v) * np.maximum(np.abs(v) - s.l1 * spread * chance, 0.0)


def scaled_vectors(sample: Sample, bias: float, w: np.ndarray, v: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Vectors whose columns are as long as lowers the loss most under l2, never turned round, and the bias beside them: Newton steps on a handful of numbers."""
    straight, x = sample.rows(w), sample.pairs(v)
    norm = np.sqrt((sample.weight[:, None] * x * x).mean(0))
    norm = np.where(norm > 0, norm, 1.0)  # a component without pairs stays as it is
    x = np.column_stack([np.ones(len(x)), x / norm])
    a = np.zeros(x.shape[1])
    a[0] = bias
    ridge = np.diag([0.0, *[l2] * v.shape[1]])
    free = np.ones(len(a), bool)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(straight + x @ a, -30, 30)))
        g = x.T @ (sample.weight * (p - sample.toxic)) / len(x) + ridge @ a
        free = (a > 0) | (g < 0)
        free[0] = True
        h = (x.T * (sample.weight * np.maximum(p * (1 - p), 1e-6))) @ x / len(x) + ridge
        step = np.zeros(len(a))
        step[free] = np.linalg.solve(h[np.ix_(free, free)] + 1e-9 * np.eye(free.sum()), g[free])
        moved = a - step
        moved[1:] = np.maximum(moved[1:], 0.0)
        if np.abs(moved - a).max() < 1e-8:
            break
        a = moved
    return v * np.sqrt(a[1:] / norm), float(a[0])


def sparse_weights(bias: float, w: np.ndarray, pairs: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, l1: np.ndarray, steps: int) -> tuple[float, np.ndarray]:
    """Bias and weights, beside what the pairs add, by accelerated proximal gradient steps over the whole sample, each bucket at a pace that bounds its curvature."""
    n, t = len(toxic), 1.0
    ahead, ahead_bias = w, bias
    pace = 4.0 * n / np.maximum(np.bincount(flat, weights=np.repeat(weight * (sizes + 1), sizes), minlength=len(l1)), 1e-9)
    bias_pace = 4.0 * n / (weight * (sizes + 1)).sum()
    for _ in range(steps):
        z = ahead_bias + pairs + np.add.reduceat(ahead[flat], starts)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * weight / n
        moved = ahead - pace * np.bincount(flat, weights=np.repeat(g, sizes), minlength=len(l1))
        new = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0.0)
        new_bias = ahead_bias - bias_pace * g.sum()
        if ((ahead - new) * (new - w)).sum() > 0:  # the momentum points uphill
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    return bias, w


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("toxicity")
    for toxic, texts in text_groups(batches):
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array([_terms.of(t).tobytes() for t in texts], pa.binary())], names=["toxic", "terms"])


def _score_rows(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    claim("toxicity")
    for batch in batches:
        at = batch.schema.names.index("_text")
        scores = [machine.score(_terms.of(t.as_py() or "")) for t in batch.column(at)]
        keep = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(scores, pa.float64())], names=[*keep, "_score"])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    """Fit the machine on labelled documents outside the held-out fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    few = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_class) for c in (0, 1)]
    sample = few[0].unionByName(few[1])  # at most 2 * per_class rows of 12 bytes
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("toxic", "text")
    rows = texts.mapInArrow(_term_rows, "toxic int, terms binary").toArrow()
    order = sorted(range(rows.num_rows), key=lambda i: (rows["toxic"][i].as_py(), rows["terms"][i].as_py()))  # the fit doesn't depend on the order of partitions
    rows = rows.take(pa.array(order, pa.int64()))
    return fit([np.frombuffer(x.as_py(), "<u4") for x in rows["terms"]], rows["toxic"].to_numpy().astype(np.float64), share, settings)


def score_with(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` as it is plus ``_score``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return bounded(docs).withColumn("_text", F.col(text_col)).mapInArrow(lambda it: _score_rows(it, machine), f"{kinds}, _score double")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    machine = learn(docs, labels, settings)
    scored = score_with(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), machine)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def toxicity_filter(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with the columns they had."""
    machine = learn(docs, labels, settings)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_t"))
    return score_with(rows, machine, "_t").filter(F.col("_score") < threshold).select("_row.*")
