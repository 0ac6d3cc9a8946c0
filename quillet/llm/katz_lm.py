"""Katz backoff scores of whole texts, learnt from the texts themselves.

Tokens are the lower-cased (A-Z) words of a text and one end. A bigram seen in
training has its Good-Turing discounted relative frequency; any other one has
its history's backoff weight times the unigram probability (c + 1) / (N + V + 1),
where V + 1 counts one unknown word. The weight divides what the discounts leave
by the unigram mass of the words not seen after the history, so each history's
distribution sums to one exactly. A history never seen backs off with weight one.

How it runs: texts become blocks of some million tokens (numbers into the
block's own vocabulary). A block sends its distinct unigrams and bigrams, already
summed, as sorted and delta-coded keys to key ranges; a range adds up all blocks
and answers each with the totals in the order it sent them, so a frequent word is
one key per block. Each range is a part of the stored count tables; only the
counts of counts come to the driver. What a history leaves over is summed by the
first block that has the bigram, and backoff weights are joined to the bigrams
that need them.

Defined cases: a null text is an empty one (an end alone); a row with a null id is
learnt from and not held out; repeated rows count as often as they occur; without
training rows every probability is the unigram one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.batches import bounded, text_groups
from quillet.llm.worker_tables import claim, register
from quillet.runtime import materialize

FOLDS, HELD_OUT = 7, 2

#: Tokens of a block, and keys that a range of the exchange takes, about.
BLOCK_TOKENS = 800_000
RANGE_KEYS = 1_000_000

#: Good-Turing holds for counts up to this; larger ones lose a constant share of one.
LARGEST_DISCOUNTED = 5

#: Histories with at least 1 / HOT of all training tokens (at most HOT of them) are broadcast.
HOT = 1000

KEPT_WORDS = 300_000
_END, _START = np.uint64(1), np.uint64(2)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words:
    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        used = set(words)
        if len(self.known) > KEPT_WORDS:
            self.known = {w: h for w in used if (h := self.known.get(w)) is not None}
        known = self.known
        for w in used.difference(known):
            known[w] = max(3, xxhash.xxh64_intdigest(w))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_words = _Words()
register("katz", lambda: setattr(_words, "known", {}))


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: small or slowly growing numbers take little."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


def _bigram_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (history ^ (history >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) + word * _M2
    h = (h ^ (h >> np.uint64(32))) * _M1
    return h ^ (h >> np.uint64(29))


_BLOCK = "task long, block long, doc_ids binary, known_id binary, held binary, lengths binary, tokens binary, vocabulary binary, n_tokens long, n_words long"


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    claim("katz")
    task, number = TaskContext.get().partitionId(), 0
    ids: list = []
    hashes: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        lengths = np.array([len(h) for h in hashes], np.int64)
        vocabulary, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        held = np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids], np.uint8)
        row = [task, number, _pack(np.array([i or 0 for i in ids], np.int64)), _pack(np.array([i is not None for i in ids], np.uint8)), _pack(held), _pack(lengths), _pack(place[inverse]), _pack(vocabulary[order]), int(lengths.sum()), len(order)]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], names=[c.split()[0] for c in _BLOCK.split(", ")])

    for some_ids, texts in text_groups(batches):
        for i, text in zip(some_ids, texts, strict=True):
            ids.append(i)
            hashes.append(np.append(_words.hashes(text.encode().lower().split()), _END))  # of bytes: only A-Z and ASCII white space
            size += len(hashes[-1])
            if size >= block_tokens:
                yield block()
                ids, hashes, size, number = [], [], 0, number + 1
    if ids:
        yield block()


class Block:
    """A block's tokens, its distinct words and bigrams, and their training counts."""

    def __init__(self, row: dict) -> None:
        self.ids, self.known_id, self.held = _unpack(row["doc_ids"], "<i8"), _unpack(row["known_id"], "u1"), _unpack(row["held"], "u1")
        self.lengths, self.vocabulary = _unpack(row["lengths"], "<i8"), _unpack(row["vocabulary"], "<u8")
        self.words = _unpack(row["tokens"], "<u4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.training = ~self.held.astype(bool)[self.doc]
        starts = np.cumsum(self.lengths) - self.lengths
        self.histories = np.empty(len(self.words), np.int64)  # numbers of words; the start is one more
        self.histories[1:] = self.words[:-1]
        self.histories[starts] = len(self.vocabulary)
        self.word_order = np.argsort(self.vocabulary)
        self.word_keys = self.vocabulary[self.word_order]
        self.word_counts = np.bincount(self.words[self.training], minlength=len(self.vocabulary))[self.word_order]
        names = np.append(self.vocabulary, _START)
        self.bigram_keys, first, self.bigrams = np.unique(_bigram_keys(names[self.histories], self.vocabulary[self.words]), return_index=True, return_inverse=True)
        self.bigram_counts = np.bincount(self.bigrams[self.training], minlength=len(self.bigram_keys))
        self.bigram_history, self.bigram_word = self.histories[first], self.words[first]


def _bounds(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


_ASK = "range long, task long, block long, keys binary, counts binary"


def _ask(batches: Iterator[pa.RecordBatch], word_ranges: int, bigram_ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            b = Block(row)
            out: list[list] = [[], [], [], [], []]
            for keys, counts, ranges, base in ((b.word_keys, b.word_counts, word_ranges, 0), (b.bigram_keys, b.bigram_counts, bigram_ranges, word_ranges)):
                cuts = [0, *np.searchsorted(keys, _bounds(ranges)).tolist(), len(keys)]
                for r, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if y > x:
                        for column, value in zip(out, (base + r, row["task"], row["block"], _pack_sorted(keys[x:y]), _pack(counts[x:y].astype(np.uint32))), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.binary()) for x in out[3:])], names=["range", "task", "block", "keys", "counts"])


_TOTALS = "range long, task long, block long, totals binary, owned binary, tokens long, kinds long, " + ", ".join(f"n{r} long" for r in range(1, LARGEST_DISCOUNTED + 2))


def _totals(table: pa.Table) -> pa.Table:
    """Add up the counts of a range over all blocks; answer each block in its own order."""
    order = np.lexsort((table["block"].to_numpy(), table["task"].to_numpy()))
    table = table.take(pa.array(order))
    keys = [_unpack_sorted(x.as_py()) for x in table["keys"]]
    counts = np.concatenate([_unpack(x.as_py(), "<u4") for x in table["counts"]])
    distinct, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
    owned = np.zeros(len(inverse), np.uint8)
    owned[first[totals > 0]] = 1
    ends = np.cumsum([len(k) for k in keys])
    answers = [(_pack(t.astype(np.uint64)), _pack(o)) for t, o in zip(np.split(totals[inverse], ends[:-1]), np.split(owned, ends[:-1]), strict=True)]
    n = len(answers)
    once = lambda value: pa.array([int(value)] + [0] * (n - 1), pa.int64())
    columns = [table["range"], table["task"], table["block"], pa.array([a for a, _ in answers], pa.binary()), pa.array([o for _, o in answers], pa.binary()), once(totals.sum()), once((totals > 0).sum())]
    return pa.table([*columns, *(once((totals == r).sum()) for r in range(1, LARGEST_DISCOUNTED + 2))], names=[c.split()[0] for c in _TOTALS.split(", ")])


def discounts(n: list[int]) -> np.ndarray:
    """Factor for counts 0..k (Katz's form of Good-Turing); the last entry is what larger counts lose.

    ``n[r - 1]`` is the number of bigrams of count r, up to k + 1. Where the
    counts of counts give no factor between 0 and 1 (small corpora), half a
    count is taken off.
    """
    k = len(n) - 1
    d = np.ones(k + 2)
    common = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        good = n[r - 1] and common < 1
        d[r] = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if good else 0.0
        if not 0.01 < d[r] < 0.999:
            d[r] = 1 - 0.5 / r
    d[k + 1] = min(max(k * (1 - d[k]), 0.05), 0.95)
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    k = len(d) - 2
    small = np.minimum(counts, k)
    return np.where(counts > k, counts - d[k + 1], d[small] * counts)


#: A document's row: the task that made its block, the block's number there, and the document's in the block.
_PLACE = ["task", "block", "row"]

_SCORED = "kind int, task long, block long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, history long, x double, y double"


def _score(blocks: pa.Table, answers: pa.Table, model: dict) -> pa.Table:
    """Rows of kind 0: documents; 1: what a history's own bigrams take (x) and their unigram mass (y); 2: documents' backoffs (x times)."""
    row = blocks.to_pylist()[0]
    b = Block(row)
    answers = answers.take(pa.array(np.argsort(answers["range"].to_numpy())))
    parts = [(r.as_py(), _unpack(t.as_py(), "<u8"), o.as_py()) for r, t, o in zip(answers["range"], answers["totals"], answers["owned"], strict=True)]
    word_totals = np.concatenate([t for r, t, _ in parts if r < model["word_ranges"]]).astype(np.int64)
    bigram_totals = np.concatenate([t for r, t, _ in parts if r >= model["word_ranges"]]).astype(np.int64)
    owned = np.concatenate([_unpack(o, "u1") for r, _, o in parts if r >= model["word_ranges"]]).astype(bool)
    counts = np.empty(len(b.vocabulary), np.int64)
    counts[b.word_order] = word_totals
    total = model["n"] + model["v"] + 1
    unigram = (counts + 1) / total
    history_counts = np.append(counts, model["training_docs"])
    docs = len(b.lengths)

    seen = bigram_totals > 0
    probability = np.zeros(len(bigram_totals))
    probability[seen] = discounted(bigram_totals[seen], model["d"]) / history_counts[b.bigram_history[seen]]
    logs = np.log10(np.where(seen, np.where(seen, probability, 1.0), unigram[b.bigram_word]))
    score = np.bincount(b.doc, weights=logs[b.bigrams], minlength=docs)
    base = np.bincount(b.doc, weights=np.log10(unigram)[b.words], minlength=docs)
    known = np.bincount(b.doc, weights=counts[b.words] > 0, minlength=docs).astype(np.int64)

    names = np.append(b.vocabulary, _START).view(np.int64)
    mine = np.flatnonzero(owned & seen)
    h, at = np.unique(b.bigram_history[mine], return_inverse=True)
    taken = np.bincount(at, weights=probability[mine], minlength=len(h))
    mass = np.bincount(at, weights=unigram[b.bigram_word[mine]], minlength=len(h))

    back = np.flatnonzero(~seen[b.bigrams] & (history_counts[b.histories] > 0))
    pair, times = np.unique(b.doc[back] * (len(b.vocabulary) + 1) + b.histories[back], return_counts=True)
    pair_doc, pair_history = np.divmod(pair, len(b.vocabulary) + 1)

    n = (docs, len(h), len(pair))
    rest = n[1] + n[2]
    nulls = lambda kind: pa.nulls(rest, kind)
    return pa.table(
        [
            pa.array(np.repeat(np.array([0, 1, 2], np.int32), n)),
            pa.array(np.full(sum(n), row["task"])),
            pa.array(np.full(sum(n), row["block"])),
            pa.concat_arrays([pa.array(np.arange(docs)), pa.nulls(n[1], pa.int64()), pa.array(pair_doc)]),
            pa.concat_arrays([pa.array(b.ids, mask=b.known_id == 0), nulls(pa.int64())]),
            pa.concat_arrays([pa.array(b.held.astype(bool)), nulls(pa.bool_())]),
            pa.concat_arrays([pa.array(b.lengths), nulls(pa.int64())]),
            pa.concat_arrays([pa.array(known), nulls(pa.int64())]),
            pa.concat_arrays([pa.array(base, pa.float64()), nulls(pa.float64())]),
            pa.concat_arrays([pa.array(score, pa.float64()), nulls(pa.float64())]),
            pa.concat_arrays([pa.nulls(docs, pa.int64()), pa.array(names[h]), pa.array(names[pair_history])]),
            pa.concat_arrays([pa.nulls(docs, pa.float64()), pa.array(taken, pa.float64()), pa.array(times.astype(np.float64))]),
            pa.concat_arrays([pa.nulls(docs, pa.float64()), pa.array(mass, pa.float64()), pa.nulls(n[2], pa.float64())]),
        ],
        names=[c.split()[0] for c in _SCORED.split(", ")],
    )


def katz_scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = materialize(plain.mapInArrow(lambda it: _blocks(it, block_tokens), _BLOCK), "lm-blocks")
    size = blocks.agg(F.sum("n_tokens").alias("t"), F.sum("n_words").alias("w")).first()
    word_ranges, bigram_ranges = (max(4, math.ceil((n or 0) / range_keys)) for n in (size["w"], size["t"]))

    asked = blocks.mapInArrow(lambda it: _ask(it, word_ranges, bigram_ranges), _ASK)
    totals = materialize(asked.groupBy("range").applyInArrow(_totals, _TOTALS), "lm-totals")
    words = totals.filter(F.col("range") < word_ranges).agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    pairs = totals.filter(F.col("range") >= word_ranges).agg(F.sum("tokens").alias("n"), *[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, LARGEST_DISCOUNTED + 2)]).first()
    training = plain.select(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT, F.lit(True)).cast("long").alias("t")).agg(F.sum("t")).first()[0]
    model = {"n": words["n"] or 0, "v": words["v"] or 0, "training_docs": training or 0, "word_ranges": word_ranges, "d": discounts([pairs[f"n{r}"] or 0 for r in range(1, LARGEST_DISCOUNTED + 2)])}

    answers = totals.select("range", "task", "block", "totals", "owned")
    scored = blocks.groupBy("task", "block").cogroup(answers.groupBy("task", "block")).applyInArrow(lambda left, right: _score(left, right, model), _SCORED)
    scored = materialize(scored, "lm-scored")
    weights = scored.filter("kind = 1").groupBy("history").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    weights = weights.select("history", F.log10((1 - F.col("x")) / (1 - F.col("y"))).alias("weight"))
    backoffs = scored.filter("kind = 2").select(*_PLACE, "history", F.col("x").alias("times"))
    out = scored.filter("kind = 0").join(backed_off(backoffs, weights), _PLACE, "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("backoff", F.lit(0.0))).alias("score"))


def backed_off(backoffs: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of the logarithms of the backoff weights per row; frequent histories don't meet in one task."""
    uses = materialize(backoffs.groupBy("history").agg(F.sum("times").alias("uses")), "lm-uses")
    all_uses = uses.agg(F.sum("uses")).first()[0] or 0.0
    hot = uses.filter(F.col("uses") >= F.lit(max(1.0, all_uses / HOT))).select("history")  # at most HOT rows
    hot = materialize(weights.join(F.broadcast(hot), "history", "left_semi"), "lm-hot")
    near = backoffs.join(F.broadcast(hot), "history", "left")
    rare = near.filter("weight IS NULL").drop("weight").join(weights.join(F.broadcast(hot.select("history")), "history", "left_anti"), "history")
    done = near.filter("weight IS NOT NULL").select(*_PLACE, "times", "weight").unionByName(rare.select(*_PLACE, "times", "weight"))
    return done.groupBy(*_PLACE).agg(F.sum(F.col("times") * F.col("weight")).alias("backoff"))
