"""Byte-level BPE by replaying the merges over a corpus of distinct pieces.

Each batch of texts is split into pieces; the pieces not yet known form one
corpus, kept as linked neighbours. An inverted index from merge rank (that is,
token pair) to positions is filled once; ranks are taken in order, and a merge
touches only the two neighbours of its position. Merges of different pairs to
the same bytes share a rank. Should a merge create a pair of lower rank, the
positions left wait until that pair is done, which is the order a piece would
see on its own.

Defined cases: a null text is an empty one; the bytes of a text are its UTF-8
form; an empty table gives an empty result; repeated rows and null ids are
carried; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.batches import bounded, text_groups
from quillet.llm.worker_tables import claim, register

#: Entries kept by a worker: units are white space plus what follows it.
KEPT_UNITS = 250_000
KEPT_PIECES = 500_000
KEPT_LENGTH = 48

#: The replay takes so many new pieces at a time, at most (bytes).
CORPUS_BYTES = 2_000_000

_units = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_odd_space = re.compile(r"[^\S \n]")  # of any kind, the separators U+001C to U+001F included

#: Marks that end a unit as one piece where letters precede them; none is part of a contraction.
_MARKS = ".,!?;:|*#$%&)"
_loaded: dict[tuple[str, str], ByteBpe] = {}
register("byte bpe", _loaded.clear)


class ByteBpe:
    """The pattern must take an optional space with letters, and other marks, as pieces of their own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        self.two_bytes = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.pair_rank = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.known_units: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {}

    @staticmethod
    def of(path: str, pattern: str) -> ByteBpe:
        """The encoder of this worker for a file of ranks."""
        claim("byte bpe")
        if (path, pattern) not in _loaded:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            _loaded[path, pattern] = ByteBpe(ranks, pattern)
        return _loaded[path, pattern]

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece after all merges."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        n = len(data)
        ranks = np.full(n, -1, np.int64)  # of the pair that starts at each position; none crosses the end of a piece
        ranks[:-1] = self.two_bytes[data[:-1].astype(np.int64) * 256 + data[1:]]
        ranks[ends - 1] = -1
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        first = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        index = {r: places.tolist() for r, places in zip(ranks[order[first]].tolist(), np.split(order, first[1:]), strict=True)} if len(order) else {}
        first_token, last_token = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        first_token[0] = True
        first_token[ends[:-1]] = True
        last_token[ends - 1] = True
        starts, stops = first_token.tolist(), last_token.tolist()  # a token keeps the position of its first byte, `stops` follows its end
        pair, token = ranks.tolist(), self.byte_ids[data].tolist()
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        pair_rank = self.pair_rank
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()
            for k, i in enumerate(places):
                if pair[i] != rank:
                    continue
                j = right[i]
                token[i] = rank
                token[j] = pair[j] = -1
                pair[i] = -1
                lower = False
                if stops[j]:
                    stops[i] = True
                else:
                    after = right[j]
                    right[i] = after
                    left[after] = i
                    if (r := pair_rank.get((rank << 32) | token[after])) is not None:
                        pair[i] = r
                        lower = r < rank
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heapq.heappush(heap, r)
                if not starts[i]:
                    before = left[i]
                    if (r := pair_rank.get((token[before] << 32) | rank)) is not None:
                        pair[before] = r
                        lower = lower or r < rank
                        if r in index:
                            index[r].append(before)
                        else:
                            index[r] = [before]
                            heapq.heappush(heap, r)
                    else:
                        pair[before] = -1
                if lower and k + 1 < len(places):
                    if rank in index:
                        index[rank].extend(places[k + 1 :])
                    else:
                        index[rank] = places[k + 1 :]
                        heapq.heappush(heap, rank)
                    break
        merged = np.array(token, np.int64)
        alive = merged >= 0
        packed, at = merged[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [packed[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Replay the merges over the pieces that aren't known yet."""
        corpus: list[str] = []
        size = 0
        for piece in pieces.difference(self.known_pieces):
            corpus.append(piece)
            size += len(piece)
            if size > CORPUS_BYTES:
                self.known_pieces.update(zip(corpus, self.replay([p.encode() for p in corpus]), strict=True))
                corpus, size = [], 0
        self.known_pieces.update(zip(corpus, self.replay([p.encode() for p in corpus]), strict=True))

    def pieces(self, unit: str) -> list[str]:
        """The pattern's pieces of a unit; a space, letters and marks need no search."""
        core = unit.rstrip(_MARKS)
        if core.isalpha() or core[:1] == " " and core[1:].isalpha():
            return [core, unit[len(core) :]] if len(core) < len(unit) else [core]
        return self.pattern.findall(unit)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text, the new pieces of all texts being one corpus."""
        split = [None if _odd_space.search(t) else _units.findall(t) for t in texts]
        used = set().union(*(units for units in split if units is not None))
        if len(self.known_units) > KEPT_UNITS:  # keep what is in use
            self.known_units = {u: ids for u in used if (ids := self.known_units.get(u)) is not None}
        new = used.difference(self.known_units)
        pieces_of = {u: self.pieces(u) for u in new}
        whole = [self.pattern.findall(t) if units is None else None for t, units in zip(texts, split, strict=True)]
        needed = {p for ps in [*pieces_of.values(), *(w for w in whole if w)] for p in ps}
        if len(self.known_pieces) > KEPT_PIECES:
            self.known_pieces = {p: ids for p in needed if (ids := self.known_pieces.get(p)) is not None}
        self.learn(needed)
        known, known_pieces = self.known_units, self.known_pieces
        for u, ps in pieces_of.items():
            known[u] = known_pieces[ps[0]] if len(ps) == 1 else b"".join(map(known_pieces.__getitem__, ps))
        for units, ps in zip(split, whole, strict=True):
            yield b"".join(map(known_pieces.__getitem__, ps)) if units is None else b"".join(map(known.__getitem__, units))
        for u in new:
            if len(u) > KEPT_LENGTH:
                del known[u]
        for p in needed:
            if len(p) > KEPT_LENGTH:
                del known_pieces[p]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _digest(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = ByteBpe.of(path, pattern)
    for ids, texts in text_groups(batches):
        rows = [(len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(bpe.decode(p)).hexdigest()) for p in bpe.encode_all(texts)]
        n, a, b = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = ByteBpe.of(path, pattern)
    for ids, texts in text_groups(batches):
        lists = [np.frombuffer(p, "<u4").astype(np.int64) for p in bpe.encode_all(texts)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = ByteBpe.of(path, pattern)
    for batch in batches:
        data = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` of every whole text."""
    plain = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(lambda it: _encode(it, path, pattern), "doc_id long, ids array<long>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``data``: the bytes that the ids stand for (null ids: null)."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, path, pattern), "doc_id long, data binary")


def bpe_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts and digests of ids and decoded bytes, without shipping either."""
    plain = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(lambda it: _digest(it, path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
