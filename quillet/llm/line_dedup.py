"""Line deduplication by a segment-partition edit join.

Lines of at least ``least_words`` words are compared across all documents; of
lines within the threshold of each other the earliest (by document id, then
line number) stays. The threshold is ``edits`` edits of characters (none for
lines under 8 * edits characters) or, as it grows with the line, one edit of a
word for every ``words_per_edit`` words of the shorter line: a changed word is one
edit, however long it is. Equal lines are one class.

A line of length l is split into edits + 1 segments; a line within the threshold
has one of them as a substring near its place, so each line probes keys of
(segment number, segment) with the few substrings that can match
(multi-match-aware selection), its own segments among them. Most substrings serve
for more than one length, so lengths aren't part of the key but compared where lines
meet. One edit of a word leaves one half of a line, so the halves are keys in the
same way. Where more word edits are allowed their segments aren't numbered: e edits
leave one of e + 1 runs of at least (n - e) / (e + 1) words untouched. Of every
window of that many words the shingle of least hash is a key (winnowing), so lines
within the threshold share one, at places and with word counts that differ by at
most e. Edits of characters touch few words, so lines of many words meet by these
keys alone.

Nothing emits the pairs of a key. A key's lines are read in order of their first
occurrence, and each line is paired with the earliest one that may be within
the threshold by places, word counts and the parities of character and word
classes (an edit changes two of them at most). The pairs are verified with a banded
bit-parallel edit distance. A line whose earliest partner of a key fails while
others of that key may still come before the earliest found so far is compared with
those in order until one succeeds; blocks of a key's lines are dealt to tasks for
that, and one link at most leaves a block for each line.

A class of lines is dropped where an earlier class is linked to it, and all
occurrences but the first are dropped where it isn't.

Defined cases: a null text has no lines; rows with a null id are left alone; rows
that share an id are taken as the same document; lines of fewer words, and lines of
spaces only, are never dropped; lines are compared without the white space at
their ends; lines under 8 * edits characters only match equal ones; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.batches import bounded, text_groups
from quillet.llm.worker_tables import claim, register
from quillet.runtime import materialize

_ENDS = "\t\n\x0b\x0c\r "

#: Up to so many wanted lines (some 10 MB) the list of documents to read again is broadcast.
BROADCAST_LINES = 300_000

#: Lines that occur in at least 1 / HOT of all places (at most HOT of them) are joined by broadcast.
HOT = 1000


@dataclass(frozen=True)
class Lines:
    edits: int = 2
    least_words: int = 5
    words_per_edit: int = 20
    shingle: int = 6  # words, at most words_per_edit / 2
    block: int = 1024  # lines of a key that are held in memory; those of a larger key are dealt out in blocks of so many

    @property
    def least_chars(self) -> int:
        return max(8 * self.edits, self.edits + 1)

    @property
    def many_words(self) -> int:
        """From so many words on the keys of word runs also find lines within ``edits`` edits of characters."""
        classes = 2
        while _run_after_edits(classes * self.words_per_edit, self) < self.shingle:
            classes += 1
        return classes * self.words_per_edit


def word_edits(words: int, s: Lines) -> int:
    """Edits of words allowed where the shorter line has so many."""
    return words // s.words_per_edit


def _run_after_edits(words: int, s: Lines) -> int:
    """Longest run of words that stays, at least, where each edit of a character touches two neighbouring words at most."""
    return -(-(words - 2 * s.edits) // (s.edits + 1))


def run_classes(s: Lines) -> list[tuple[int, float, int]]:
    """Least and largest word count of lines that share a run of so many words, for two, three or more edits of the shorter."""
    n, last, out = s.words_per_edit, max(3, s.many_words // s.words_per_edit), []
    for e in range(2, last + 1):
        run = -(-(e * n - e) // (e + 1))
        if e * n >= s.many_words:
            run = min(run, _run_after_edits(e * n, s))
        out.append((e * n, (e + 1) * n - 1 + max(e, s.edits) if e < last else math.inf, run))
    return out


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the edits + 1 segments of a line; the last ones are the longer."""
    base, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        size = base + (i > edits - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, indexed: int, edits: int) -> list[tuple[int, int, int]]:
    """Segment number, start and length of the substrings of a line that may equal a segment of a line of length ``indexed``."""
    delta, out = length - indexed, []
    for i, (start, size) in enumerate(segments(indexed, edits)):
        low = max(0, start - i, start + delta - (edits - i))
        high = min(length - size, start + i, start + delta + (edits - i))
        out += [(i, at, size) for at in range(low, high + 1)]
    return out


def cuts(length: int, least: int, most: int, edits: int) -> list[tuple[int, int, int]]:
    """The probes of a line for all lines of ``least`` to ``most`` that aren't longer, each once: many are the same for several lengths."""
    return sorted({cut for indexed in range(max(least, length - edits), min(most, length) + 1) for cut in probes(length, indexed, edits)})


#: What the ``place`` of an entry says if it isn't the place of a run of words: that it is one of words, or else
#: (from ``_LENGTH`` down) that it is one of characters, the line's length and whether it is the line's own segment.
_ANYWHERE, _LENGTH = -3, -4


def _char_place(length: int, own: bool) -> int:
    return _LENGTH - 2 * length - own


_plans: dict[tuple, np.ndarray] = {}
register("lines", _plans.clear)


def _plan(length: int, s: Lines) -> np.ndarray:
    """Seed, from, to and place of the probes of a line of so many characters; those that are its own segments say so."""
    if (length, s) not in _plans:
        own = segments(length, s.edits)
        rows = [(i, a, a + n, _char_place(length, own[i] == (a, n))) for i, a, n in cuts(length, s.least_chars, length, s.edits)]
        if len(_plans) > 5000:
            _plans.clear()
        _plans[length, s] = np.array(rows, np.int64).reshape(-1, 4).T
    return _plans[length, s]


def _halves(words: int, s: Lines) -> np.ndarray:
    """Seed, from, to and place of the halves of a line of so many words."""
    if ("halves", words, s) not in _plans:
        rows = [(i, a, a + n, _ANYWHERE) for i, a, n in cuts(words, s.words_per_edit, 2 * s.words_per_edit - 1, 1)]
        _plans["halves", words, s] = np.array(rows, np.int64).reshape(-1, 4).T
    return _plans["halves", words, s]


def _cut_all(sizes: np.ndarray, plan: Callable[[int, Lines], np.ndarray], s: Lines) -> tuple[np.ndarray, ...]:
    """The item, seed, from, to and place of all parts of items of these sizes."""
    kinds, kind = np.unique(sizes, return_inverse=True)
    plans = [plan(n, s) for n in kinds.tolist()]
    counts = np.array([p.shape[1] for p in plans])
    owner, k = _spread(counts[kind])
    return owner, *np.concatenate(plans, axis=1)[:, (np.cumsum(counts) - counts)[kind][owner] + k]


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def _powers_up_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.where(np.arange(n + 1) > 0, np.uint64(x), np.uint64(1)), dtype=np.uint64) for x in (_BASE, _INVERSE)]
    return _powers


register("line powers", _powers.clear)


_marks: list[np.ndarray] = []


def _char_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of characters, read from a table unless there are others than its 65,536."""
    if not _marks:
        _marks.append(_mix(np.arange(1 << 16, dtype=np.uint64) + _M2))
    if len(codes) and codes.max() >= 1 << 16:
        return _mix(codes.astype(np.uint64) + _M2)
    return _marks[0].take(codes)


def _sums(values: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Sums of which ``(sums[end] - sums[start]) * power[start]`` depends on the values from start to end alone."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, inverse, out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of so many parts: the item of each part, and the part's number within it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


_digest = xxhash.xxh3_128_digest


class Part:
    """The compared lines of some texts, as arrays."""

    def __init__(self, ids: list[int], firsts: list[int], texts: list[str], s: Lines) -> None:
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        space = np.ones(len(self.codes) + 2, bool)
        np.less(self.codes - np.uint32(9), 5, out=space[1:-1])
        space[1:-1] |= self.codes == 32
        change = np.flatnonzero(space[1:] != space[:-1])
        self.word_start, self.word_end = change[::2], change[1::2]
        breaks = np.flatnonzero(self.codes == 10)
        first = np.concatenate([[0], np.searchsorted(self.word_start, breaks)])
        words = np.diff(np.append(first, len(self.word_start)))
        line = np.flatnonzero((words >= s.least_words) & (words > 0))
        self.first, self.words = first[line], words[line]
        self.start, self.end = self.word_start[self.first], self.word_end[self.first + self.words - 1]
        sizes = np.array([len(t) for t in texts])
        text_start = np.cumsum(sizes + 1) - sizes - 1
        doc = np.searchsorted(text_start, self.start, "right") - 1
        self.doc_id = np.array(ids, np.int64)[doc]
        self.line_no = line - np.searchsorted(breaks, text_start)[doc] + np.array(firsts, np.int64)[doc]
        view = memoryview(self.codes).cast("B")
        digests = b"".join([_digest(view[4 * a : 4 * b]) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)])
        self.line, self.mark = np.frombuffer(digests, "<i8").reshape(-1, 2).T

    def __len__(self) -> int:
        return len(self.line)

    def take(self, rows: np.ndarray) -> None:
        """Keep some of the lines."""
        for name in ("first", "words", "start", "end", "doc_id", "line_no", "line", "mark"):
            setattr(self, name, getattr(self, name)[rows])

    def hash_all(self) -> None:
        power, inverse = _powers_up_to(len(self.codes) + 1)
        n = len(self.codes)
        self.sums = _sums(_char_hashes(self.codes), inverse[:n])
        self.power = power

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of slices of the text that depend on their characters alone."""
        return _mix((self.sums[end] - self.sums[start]) * self.power[start])

    def word_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed words of some lines, and how many each has."""
        owner, k = _spread(self.words[rows])
        at = self.first[rows][owner] + k
        return self.slices(self.word_start[at], self.word_end[at]), self.words[rows]


def _pieces(batches: Iterator[pa.RecordBatch], s: Lines, most: int = 400_000) -> Iterator[Part]:
    """Texts as parts of about ``most`` characters; a longer one is cut where a line ends."""
    for all_ids, all_texts in text_groups(batches, most):
        ids, firsts, texts = [], [], []
        for doc_id, text in zip(all_ids, all_texts, strict=True):
            at, number = 0, 0
            while len(text) - at > 2 * most and (cut := text.find("\n", at + most)) >= 0:
                yield Part([doc_id], [number], [text[at:cut]], s)
                number += text.count("\n", at, cut) + 1
                at = cut + 1
            ids.append(doc_id)
            firsts.append(number)
            texts.append(text[at:])
        yield Part(ids, firsts, texts, s)


def _parities(bits: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Exclusive or of each slice; slices aren't empty and don't overlap."""
    if not len(start):
        return bits[:0]
    return np.bitwise_xor.reduceat(np.append(bits, bits[:1]), np.column_stack([start, end]).ravel())[::2]


_LINE = "doc_id long, line_no int, line long, mark long, words int, odd int, p long, q long"


def _lines(batches: Iterator[pa.RecordBatch], s: Lines) -> Iterator[pa.RecordBatch]:
    """Each compared line: its two hashes, its words, and the parities of its character classes and (in two halves) its word classes."""
    claim("lines")
    for part in _pieces(batches, s):
        if not len(part):
            continue
        part.hash_all()
        odd = _parities(np.uint32(1) << (part.codes & np.uint32(31)), part.start, part.end)
        hashed, counts = part.word_rows(np.arange(len(part)))
        kind, end = hashed >> np.uint64(57), np.cumsum(counts)
        one = np.uint64(1) << (kind & np.uint64(63))
        p, q = (_parities(np.where((kind >> np.uint64(6)) == half, one, np.uint64(0)), end - counts, end) for half in (0, 1))
        columns = [pa.array(part.doc_id), pa.array(part.line_no.astype(np.int32)), pa.array(part.line), pa.array(part.mark), pa.array(part.words.astype(np.int32)), pa.array(odd.view(np.int32)), pa.array(p.view(np.int64)), pa.array(q.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _LINE.split(", ")])


#: Windows compare so much of a shingle's hash, then its place.
_PLACE = np.uint64((1 << 32) - 1)


def winnowed(words: np.ndarray, counts: np.ndarray, classes: list[tuple[int, float, int]], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hash and place (among all words) of the shingles kept of lines of ``counts`` hashed words, for each class of lines, such that equal runs of ``run`` words share one."""
    size = len(words) - shingle + 1
    hashed = np.zeros(size, np.uint64)
    for i in range(shingle):
        hashed ^= words[i : i + size]
        hashed *= _M1
        hashed ^= hashed >> np.uint64(29)
    least = {1: (hashed & ~_PLACE) | np.arange(size, dtype=np.uint64)}  # least of so many shingles from each on
    ends, of_line = np.repeat(np.cumsum(counts), counts), np.repeat(counts, counts)
    for low, high, run in classes:
        window = run - shingle + 1
        half = 1 << (window.bit_length() - 1)
        for n in [1 << i for i in range(1, window.bit_length())]:
            if n not in least:
                least[n] = np.minimum(least[n // 2][: -(n // 2)], least[n // 2][n // 2 :])
        starts = size - window + 1
        whole = (np.arange(run, starts + run) <= ends[:starts]) & (of_line[:starts] >= low) & (of_line[:starts] <= high)
        at = (np.minimum(least[half][:starts], least[half][window - half :])[whole] & _PLACE).astype(np.int64)
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at  # they only go forward
        yield hashed[at], at, run


_ENTRY = "key long, line long, place int"
_DEALT = "bucket int, key array<long>, line array<long>, place array<int>"


def _entries(batches: Iterator[pa.RecordBatch], s: Lines) -> Iterator[pa.RecordBatch]:
    """The keys by which lines may meet."""
    claim("lines")
    seen: set[int] = set()  # spares repeats within the task; nothing depends on it
    classes = run_classes(s)
    for part in _pieces(batches, s):
        _, once = np.unique(part.line, return_index=True)
        lines = part.line[once].tolist()
        part.take(once[[x not in seen for x in lines]] if lines else once)
        seen.update(lines)
        if len(seen) > 200_000:
            seen.clear()
        if not len(part):
            continue
        part.hash_all()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        length = part.end - part.start
        few = np.flatnonzero((length >= s.least_chars) & (part.words < s.many_words + s.edits)) if s.edits else np.empty(0, np.int64)
        if len(few):
            owner, seed, a, b, place = _cut_all(length[few], _plan, s)
            start = part.start[few][owner]
            out.append((_mix(part.slices(start + a, start + b) ^ _mix(seed.astype(np.uint64))), part.line[few][owner], place))
        one = np.flatnonzero((part.words >= s.words_per_edit) & (part.words <= 2 * s.words_per_edit))
        if len(one):
            hashed, counts = part.word_rows(one)
            power, inverse = _powers_up_to(len(hashed) + 1)
            sums = _sums(hashed, inverse[: len(hashed)])
            owner, seed, a, b, place = _cut_all(counts, _halves, s)
            start = (np.cumsum(counts) - counts)[owner]
            half = _mix((sums[start + b] - sums[start + a]) * power[start + a])
            out.append((_mix(half ^ _mix(seed.astype(np.uint64) + _M1)), part.line[one][owner], place))
        rows = np.flatnonzero(part.words >= classes[0][0])
        if len(rows):
            hashed, counts = part.word_rows(rows)
            first = np.cumsum(counts) - counts
            line_of, _ = _spread(counts)
            for key, at, run in winnowed(hashed, counts, classes, s.shingle):
                owner = line_of[at]
                out.append((key ^ np.uint64(run), part.line[rows][owner], at - first[owner]))
        if out:
            key, line, place = (np.concatenate(x) for x in zip(*out, strict=True))
            yield _entry_batch([key.view(np.int64), line, place.astype(np.int32)])


def _entry_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "line", "place"])


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Entries as a row of arrays for each bucket of keys, some ``most`` entries at a time: most keys are met once, so rows of their own would cost more than they tell."""
    held, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.num_rows
        if size and (batch is None or size >= most):
            columns = [np.concatenate(x) for x in zip(*([c.to_numpy() for c in b.columns] for b in held), strict=True)]
            bucket = ((columns[0].view(np.uint64) >> np.uint64(17)) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
            order, counts = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)
            some = np.flatnonzero(counts)
            ends = pa.array(np.append(0, np.cumsum(counts[some])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *lists], names=["bucket", "key", "line", "place"])
            held, size = [], 0


def _split(entries: list[list[np.ndarray]], known: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries of keys that several lines have or that are ``known`` to be such, once for each line, by key and line; and the others."""
    key, line, place = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.argsort(key)
    several = _several(key[order], known)
    alone, order = order[~several], order[several]
    order = order[np.lexsort((line[order], key[order]))]
    rest, (key, line, place) = [c[alone] for c in (key, line, place)], [c[order] for c in (key, line, place)]
    if len(key):
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])))
        least, most = np.minimum.reduceat(place, start), np.maximum.reduceat(place, start)
        key, line, place = key[start], line[start], np.where((least == most) | (least < 0), least, _ANYWHERE).astype(np.int32)
    several = _several(key, known)
    return [c[several] for c in (key, line, place)], [np.concatenate([x, c[~several]]) for x, c in zip(rest, (key, line, place), strict=True)]


def _several(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of sorted keys occur again, or are known."""
    if not len(key):
        return np.empty(0, bool)
    same = key[1:] == key[:-1]
    again = np.append(same, False) | np.append(False, same)
    return again | np.isin(key, known) if len(known) else again


def _shared(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Of entries, those of keys that several lines have, once for each line. They come in order of buckets, or as plain rows of one bucket.

    A bucket is held. Beyond ``most`` entries those of keys that are known to have several
    lines don't stay, so a very common key isn't held; a line of it may come twice then.
    """
    held, size, bound, bucket, known = [], 0, most, None, np.empty(0, np.int64)
    for batch in batches:
        dealt = "bucket" in batch.schema.names
        number = batch.column("bucket").to_numpy() if dealt else np.zeros(min(1, batch.num_rows), np.int32)
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist() if len(number) else []
        for a, b in itertools.pairwise([*starts, len(number)]):
            if held and number[a] != bucket:
                yield _entry_batch(_split(held, known)[0])
                held, size, bound, known = [], 0, most, known[:0]
            bucket = number[a]
            columns = [batch.column(n) for n in ("key", "line", "place")]
            held.append([(c.slice(a, b - a).flatten() if dealt else c).to_numpy(zero_copy_only=False) for c in columns])
            size += len(held[-1][0])
            if size >= bound:
                shared, rest = _split(held, known)
                yield _entry_batch(shared)
                held, size, known = [rest], len(rest[0]), np.union1d(known, shared[0])
                bound = max(most, 2 * size)
    if held:
        yield _entry_batch(_split(held, known)[0])


_MEMBER = "key long, line long, mark long, place int, doc_id long, line_no int, words int, odd int, p long, q long"
_NAMES = [c.split()[0] for c in _MEMBER.split(", ")]


class Members:
    """Lines of keys, in order of key and first occurrence."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.columns = columns

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> Members:
        return cls({n: batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy() for n in _NAMES})

    def __getitem__(self, rows: np.ndarray | slice) -> Members:
        return Members({n: c[rows] for n, c in self.columns.items()})

    def __len__(self) -> int:
        return len(self.columns["key"])

    def join(self, other: Members) -> Members:
        return Members({n: np.concatenate([c, other.columns[n]]) for n, c in self.columns.items()})

    def changed_words(self, least: np.ndarray, s: Lines) -> np.ndarray:
        """How far counts of words may differ in all where the shorter of two lines has ``least`` words."""
        edits = least // s.words_per_edit
        return np.where(least >= s.many_words, np.maximum(2 * edits, 3 * s.edits), 2 * edits)

    def maybe_near(self, i: np.ndarray, j: np.ndarray, s: Lines, other: Members | None = None) -> np.ndarray:
        """Whether lines i and lines j (of ``other``) of a key may be within the threshold; shapes broadcast."""
        names = ("line", "mark", "place", "words", "odd", "p", "q")
        x, y = {n: self.columns[n][i] for n in names}, {n: (other or self).columns[n][j] for n in names}
        bits = lambda n, kind: np.bitwise_count((x[n] ^ y[n]).view(kind)).astype(np.int32)
        least = np.minimum(x["words"], y["words"])
        edits = least // s.words_per_edit
        drift = np.where(least >= s.many_words, np.maximum(edits, s.edits), edits)
        anywhere = (x["place"] == _ANYWHERE) | (y["place"] == _ANYWHERE)
        run = (np.abs(x["words"] - y["words"]) <= drift) & (anywhere | (np.abs(x["place"] - y["place"]) <= drift)) & (bits("p", np.uint64) + bits("q", np.uint64) <= self.changed_words(least, s))
        by_run = (x["place"] >= _ANYWHERE) & (y["place"] >= _ANYWHERE) & run
        chars = (x["place"] <= _LENGTH) & (y["place"] <= _LENGTH) & ((x["place"] | y["place"]) & 1 == 1)  # one's own segment
        by_segment = chars & (np.abs((x["place"] + 1 >> 1) - (y["place"] + 1 >> 1)) <= s.edits) & (bits("odd", np.uint32) <= 2 * s.edits)
        return (by_run | by_segment) & ((x["line"] != y["line"]) | (x["mark"] != y["mark"]))


#: kind 0: a line and the earliest of a key that it may be near to; 1: a line that may have others there
#: (last_doc, last_no: place of the last one seen); 2: a line of a key that has such ones. Each says where its line and its partner
#: occur first, and what else the search needs to know of it, so the classes of all lines aren't joined again.
_MET = "kind int, key long, block int, line long, mark long, place int, doc_id long, line_no int, words int, odd int, p long, q long, c_line long, c_mark long, last_doc long, last_no int"
_FACTS = ("words", "odd", "p", "q")


def _met(kind: int, rows: Members, block: np.ndarray | int, other: Members | None = None) -> pa.RecordBatch:
    n, x = len(rows), rows.columns
    none = lambda t: pa.nulls(n, t)
    y = other.columns if other is not None else None
    columns = [
        pa.array(np.full(n, kind, np.int32)), pa.array(x["key"]), pa.array(np.broadcast_to(np.asarray(block, np.int32), n).copy()), *(pa.array(x[c]) for c in ("line", "mark", "place", "doc_id", "line_no")),
        *(pa.array(x[c]) if kind else none(pa.int32() if c in ("words", "odd") else pa.int64()) for c in _FACTS),
        none(pa.int64()) if y is None else pa.array(y["line"]), none(pa.int64()) if y is None else pa.array(y["mark"]), none(pa.int64()) if y is None else pa.array(y["doc_id"]), none(pa.int32()) if y is None else pa.array(y["line_no"]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _MET.split(", ")])


def _meet(m: Members, s: Lines, tell: bool = True) -> Iterator[pa.RecordBatch]:
    """Whole keys of at most ``block`` lines each, or a key's first block, whose lines are told elsewhere."""
    key = m.columns["key"]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    run = np.diff(np.append(starts, len(key)))
    owner, place = _spread(run)
    first, met = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    rows, back = np.flatnonzero(place >= 1), 1
    while len(rows):
        near = rows[m.maybe_near(rows, rows - back, s)]
        first[near] = near - back  # the farthest back is the earliest
        met[near] += 1
        back += 1
        rows = rows[place[rows] >= back]
    some = np.flatnonzero(met)
    yield _met(0, m[some], 0, m[first[some]])
    more = np.flatnonzero(met > 1)
    if len(more):
        yield _met(1, m[more], 0, m[first[more]])
        if tell:
            yield _met(2, m[np.isin(owner, owner[more])], 0)


def _meet_first_block(m: Members, number: int, block: Members, s: Lines) -> Iterator[pa.RecordBatch]:
    """Lines of a larger key, ``number`` of which came before, with the key's first block; all may have others."""
    earliest = []
    for at in range(0, len(m), 256):
        rows = np.arange(at, min(len(m), at + 256))
        near = m.maybe_near(rows[:, None], np.arange(len(block))[None, :], s, block)
        earliest.append(np.where(near.any(1), near.argmax(1), -1))
    first = np.concatenate(earliest)
    some = np.flatnonzero(first >= 0)
    blocks = (number + np.arange(len(m))) // s.block
    yield _met(0, m[some], blocks[some], block[first[some]])
    yield _met(1, m, blocks, block[first])  # -1: the block's last line, as none of it may be near
    yield _met(2, m, blocks)


def _select(batches: Iterator[pa.RecordBatch], s: Lines) -> Iterator[pa.RecordBatch]:
    """Candidates among lines sorted by key and first occurrence; holds a block of a key and a batch at most."""
    held: Members | None = None  # of the key that may go on
    block, number = None, 0  # first block of a key that has more, and how many of its lines have passed
    for batch in batches:
        if not batch.num_rows:
            continue
        m = Members.of(batch)
        m = held.join(m) if held is not None else m
        key = m.columns["key"]
        if block is not None:
            go_on = int(np.searchsorted(key != block.columns["key"][0], True)) if key[0] == block.columns["key"][0] else 0
            if go_on:
                yield from _meet_first_block(m[:go_on], number, block, s)
            number += go_on
            m, key = m[go_on:], key[go_on:]
            if not len(m):
                held = None
                continue
            block = None
        last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        whole, held = m[:last], m[last:]
        runs = np.diff(np.append(np.flatnonzero(np.append(True, key[:last][1:] != key[:last][:-1])), last)) if last else np.empty(0, np.int64)
        yield from _meet_runs(whole, runs, s)
        if len(held) > s.block:
            block, rest, number = held[:s.block], held[s.block:], s.block
            yield from _meet(block, s, tell=False)
            yield _met(2, block, 0)
            yield from _meet_first_block(rest, number, block, s)
            number, held = number + len(rest), None
    if held is not None:
        yield from _meet_runs(held, np.array([len(held)]), s)


def _meet_runs(m: Members, runs: np.ndarray, s: Lines) -> Iterator[pa.RecordBatch]:
    """Whole keys; those of more than ``block`` lines one by one."""
    ends = np.cumsum(runs)
    small = np.repeat(runs <= s.block, runs)
    yield from _meet(m[np.flatnonzero(small)], s)
    for a, b in zip((ends - runs)[runs > s.block].tolist(), ends[runs > s.block].tolist(), strict=True):
        block = m[a : a + s.block]
        yield from _meet(block, s, tell=False)
        yield _met(2, block, 0)
        yield from _meet_first_block(m[a + s.block : b], s.block, block, s)


def within(a: str | list[bytes], b: str | list[bytes], edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: equal ends are cut off, then a band of 2 * edits + 1 diagonals is kept as bits."""
    if abs(len(a) - len(b)) > edits:
        return False
    x, n = 0, min(len(a), len(b))
    if a[:n] == b[:n]:
        return True
    step = 1 << (n.bit_length() - 1)
    while step:
        if x + step <= n and a[x : x + step] == b[x : x + step]:
            x += step
        step >>= 1
    a, b, n = a[x:], b[x:], n - x
    y, step = 0, 1 << max(0, n.bit_length() - 1)
    while step:
        if y + step <= n and a[len(a) - y - step : len(a) - y] == b[len(b) - y - step : len(b) - y]:
            y += step
        step >>= 1
    a, b = a[: len(a) - y], b[: len(b) - y]
    return banded(a, b, edits) <= edits


def banded(a: str | list[bytes], b: str | list[bytes], edits: int) -> int:
    """Edit distance if at most ``edits``, else edits + 1.

    Bit d of lane e of ``reach`` tells that with e edits the diagonal d (b's place
    minus a's, plus edits) is alive at the current character of ``a``; a step over
    one character moves every diagonal of every lane at once. Lanes are one bit apart.
    """
    width, m = 2 * edits + 1, len(b)
    lane = width + 1
    ones = ((1 << lane * (edits + 1)) - 1) // ((1 << lane) - 1)
    full = (1 << width) - 1
    every = full * ones
    skips = [(ones * (full >> n) & every, n * (lane + 1)) for n in (1 << i for i in range(edits.bit_length()))]  # n characters of b left out, in n lanes more
    where: dict[str | bytes, int] = {}
    for j, c in enumerate(b[:edits]):
        where[c] = where.get(c, 0) | 1 << (j + edits)
    reach = 1 << edits
    for stays, by in skips:
        reach |= (reach & stays) << by & every
    for i, c in enumerate(a):
        if i + edits < m:  # no further ahead than the band: unlike texts end early
            y = b[i + edits]
            where[y] = where.get(y, 0) | 1 << (i + 2 * edits)
        match = where.get(c, 0) >> i & full
        reach = reach & match * ones | (reach | reach >> 1 & every) << lane & every
        if not reach:
            return edits + 1
        for stays, by in skips:
            reach |= (reach & stays) << by & every
    end = m - len(a) + edits
    return next((e for e in range(edits + 1) if 0 <= end < width and reach >> e * lane + end & 1), edits + 1)


def near_lines(a: str, b: str, s: Lines) -> bool:
    if within(a, b, s.edits if min(len(a), len(b)) >= s.least_chars else 0):
        return True
    x, y = a.encode().split(), b.encode().split()
    edits = word_edits(min(len(x), len(y)), s)
    if not edits or abs(len(x) - len(y)) > edits:
        return False
    m, n = Counter(x), Counter(y)
    apart = {w for w, _ in m.items() ^ n.items()}
    if len(apart) > 2 * edits:
        return False
    more = [m[w] - n[w] for w in apart]
    return max(sum(k for k in more if k > 0), -sum(k for k in more if k < 0)) <= edits and within(x, y, edits)  # an edit is one word more or less on either side


def _verify(batches: Iterator[pa.RecordBatch], s: Lines) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [near_lines(a, b, s) for a, b in zip(batch.column("t_x").to_pylist(), batch.column("t_c").to_pylist(), strict=True)]
        yield batch.select([c.split()[0] for c in _FOUND.split(", ")]).filter(pa.array(near, pa.bool_()))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the lines whose places are asked for; of rows that share an id, those that have them there."""
    for batch in batches:
        line, mark, text = [], [], []
        for whole, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            lines = (whole.as_py() or "").split("\n")
            for x in wanted.as_py():
                t = lines[x["line_no"]].strip(_ENDS) if x["line_no"] < len(lines) else ""
                if _digest(t.encode("utf-32-le", "surrogatepass")) == struct.pack("<2q", x["line"], x["mark"]):
                    line.append(x["line"])
                    mark.append(x["mark"])
                    text.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(mark, pa.int64()), pa.array(text, pa.string())], names=["line", "mark", "t"])


def line_texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``line, mark, t`` of the lines listed (line, mark, doc_id, line_no), read again from the documents that have them first."""
    at = lines.select("doc_id", F.struct("line_no", "line", "mark").alias("x"))
    at = materialize(at.groupBy("doc_id").agg(F.collect_list("x").alias("wanted")), "line-wanted")  # bounded by the document's lines
    n = at.agg(F.sum(F.size("wanted"))).first()[0] or 0
    found = docs.join(F.broadcast(at) if n <= BROADCAST_LINES else at, "doc_id").select("text", "wanted")
    return materialize(found.mapInArrow(_wanted, "line long, mark long, t string").dropDuplicates(["line", "mark"]), "line-texts")


_FOUND = "line long, mark long, doc_id long, line_no int, c_doc long, c_no int"


def _search(table: pa.Table, s: Lines) -> pa.Table:
    """For each line that asks, the earliest of a block of its key that it is near to, after the last one seen and before its bound."""
    column = lambda name: table[name].cast(pa.int64()).fill_null(0).to_numpy()
    dealt = ("key", "block", "part")
    order = np.lexsort((column("line_no"), column("doc_id"), column("asks").astype(bool), *(column(c) for c in reversed(dealt))))
    table = table.take(pa.array(order))
    asks, m, texts = column("asks").astype(bool), Members.of(table), table["t"]
    new = np.append(True, np.any([column(c)[1:] != column(c)[:-1] for c in dealt], axis=0))
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)[group]
    end = start + np.bincount(group, weights=~asks).astype(np.int64)[group]  # those that ask come last
    pair = lambda a, b: list(zip(column(a).tolist(), column(b).tolist(), strict=True))
    place, last, until = pair("doc_id", "line_no"), pair("last_doc", "last_no"), pair("until_doc", "until_no")
    asking = np.flatnonzero(asks)
    low = np.array([bisect_right(place, last[i], start[i], end[i]) for i in asking], np.int64)
    high = np.array([bisect_left(place, until[i], start[i], end[i]) for i in asking], np.int64)
    sizes = np.maximum(high - low, 0)
    counted: dict[int, np.ndarray] = {}

    def counts_of(rows: np.ndarray) -> np.ndarray:
        """How many words of each of 128 classes lines have."""
        for i in rows.tolist():
            if i not in counted:
                counted[i] = np.bincount([zlib.crc32(w) & 127 for w in texts[i].as_py().encode().split()], minlength=128).astype(np.int32)
        return np.stack([counted[i] for i in rows.tolist()])

    out: list[tuple[int, int]] = []
    for some in np.split(np.arange(len(asking)), np.flatnonzero(np.diff(np.cumsum(sizes) // 100_000)) + 1):
        owner, k = _spread(sizes[some])
        i, j = asking[some][owner], low[some][owner] + k
        near = m.maybe_near(i, j, s)
        i, j = i[near], j[near]
        for likely in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
            x, likely = int(i[likely[0]]), j[likely]
            if len(likely) > 8 and m.columns["place"][x] >= _ANYWHERE:
                apart = np.abs(counts_of(likely) - counts_of(np.array([x]))).sum(1)
                likely = likely[apart <= m.changed_words(np.minimum(m.columns["words"][likely], m.columns["words"][x]), s)]
            text = texts[x].as_py()
            for y in likely.tolist():
                if near_lines(text, texts[y].as_py(), s):
                    out.append((x, y))
                    break
    x, y = np.array(out, np.int64).reshape(-1, 2).T
    c = m.columns
    return pa.table([pa.array(c[n][at].astype(t)) for n, at, t in (("line", x, np.int64), ("mark", x, np.int64), ("doc_id", x, np.int64), ("line_no", x, np.int32), ("doc_id", y, np.int64), ("line_no", y, np.int32))], names=[c.split()[0] for c in _FOUND.split(", ")])


def line_links(docs: DataFrame, classes: DataFrame, s: Lines) -> DataFrame:
    """Links of line classes (line, mark, and doc_id and line_no of the first of them) to earlier ones (c_doc, c_no): to the earliest within the threshold, if any, and maybe more."""
    texts = docs.select("doc_id", "text")
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = texts.mapInArrow(lambda it: _dealt(_entries(it, s), buckets), _DEALT).repartition("bucket").sortWithinPartitions("bucket")
    shared = materialize(entries.mapInArrow(_shared, _ENTRY), "line-keys")
    about = classes.select("line", "mark", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), *_FACTS)
    members = shared.join(about.hint("shuffle_hash"), "line").select(*_NAMES).repartition("key").sortWithinPartitions("key", "doc_id", "line_no")
    met = materialize(members.mapInArrow(lambda it: _select(it, s), _MET), "line-met")

    pairs = met.filter("kind = 0").select("line", "mark", "doc_id", "line_no", "c_line", "c_mark", F.col("last_doc").alias("c_doc"), F.col("last_no").alias("c_no"))
    pairs = materialize(pairs.distinct(), "line-pairs")
    partner = pairs.select("c_line", "c_mark", "c_doc", "c_no").toDF("line", "mark", "doc_id", "line_no")
    compared = met.filter("kind = 2").select(*partner.columns)  # the search may ask for these
    found = line_texts(docs, pairs.select(*partner.columns).unionByName(partner).unionByName(compared).distinct())
    both = pairs.join(found.withColumnRenamed("t", "t_x"), ["line", "mark"]).join(found.toDF("c_line", "c_mark", "t_c"), ["c_line", "c_mark"])
    links = materialize(both.mapInArrow(lambda it: _verify(it, s), _FOUND), "line-links")

    owners = least_partner(links).select("line", "mark", F.col("linked").alias("until"))
    asks = met.filter("kind = 1").join(owners, ["line", "mark"], "left")
    last = F.struct(F.col("last_doc").alias("doc_id"), F.col("last_no").alias("line_no"))
    asks = asks.withColumn("until", F.coalesce("until", F.struct("doc_id", "line_no"))).filter(last < F.col("until"))
    facts = ("line", "mark", "place", "doc_id", "line_no", *_FACTS)
    asks = materialize(asks.select("key", "block", *facts, "last_doc", "last_no", F.col("until.doc_id").alias("until_doc"), F.col("until.line_no").alias("until_no")), "line-asks")
    if asks.isEmpty():
        return links
    every = asks.withColumn("part", F.explode(F.sequence(F.lit(0), "block")))
    wanting = asks.select("key", F.col("block").alias("by")).distinct()
    held = met.filter("kind = 2").select("key", "block", *facts).join(wanting, "key").filter("by >= block")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    held = held.select(F.lit(False).alias("asks"), "key", F.col("by").alias("block"), F.col("block").alias("part"), *facts, *none("long", "last_doc"), *none("int", "last_no"), *none("long", "until_doc"), *none("int", "until_no"))
    group = materialize(every.select(F.lit(True).alias("asks"), *held.columns[1:]).unionByName(held), "line-groups")
    full = group.join(found, ["line", "mark"])
    tasks = max(1, math.ceil(group.count() / (4 * s.block)))
    dealt = F.pmod(F.xxhash64("key", "block", "part"), F.lit(tasks))  # several blocks at a time, none of more than twice s.block rows
    found = full.groupBy(dealt.alias("dealt")).applyInArrow(lambda t: _search(t, s), _FOUND)
    return links.unionByName(materialize(found, "line-links"))


def least_partner(links: DataFrame) -> DataFrame:
    """``line, mark, at, linked``: first occurrences of each linked class and of the earliest class that it is linked to."""
    at, other = F.struct("doc_id", "line_no"), F.struct(F.col("c_doc").alias("doc_id"), F.col("c_no").alias("line_no"))
    return links.groupBy("line", "mark").agg(F.min(at).alias("at"), F.min(other).alias("linked"))


def line_classes(lines: DataFrame, lo: int | None, hi: int | None, most: int | None) -> DataFrame:
    """``line, mark, n, first`` (doc_id, line_no) and the facts of equal lines of documents from ``lo`` to ``hi``, numbered up to ``most``.

    Spark sorts rows to find the least of structs, so places are compared as numbers wherever they fit into a long.
    """
    same = [F.min(c).alias(c) for c in _FACTS]
    classes, count = lines.groupBy("line", "mark"), F.count(F.lit(1)).alias("n")
    if lo is None or (hi - lo + 1) * (most + 1) >= 1 << 63:
        return classes.agg(count, F.min(F.struct("doc_id", "line_no")).alias("first"), *same)
    low, each = F.lit(lo).cast("long"), F.lit(most + 1).cast("long")
    found = classes.agg(count, F.min((F.col("doc_id") - low) * each + F.col("line_no")).alias("at"), *same)
    line_no = F.col("at") % each
    first = F.struct((F.call_function("div", F.col("at"), each) + low).alias("doc_id"), line_no.cast("int").alias("line_no"))
    return found.select("line", "mark", "n", first.alias("first"), *_FACTS)


def dropped_lines(docs: DataFrame, s: Lines = Lines()) -> DataFrame:
    """``doc_id, line_no, first_doc_id`` of every line to drop, and the document that keeps it."""
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    lines = materialize(docs.mapInArrow(lambda it: _lines(it, s), _LINE), "lines")
    places, *span = lines.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.max("line_no")).first()
    classes = materialize(line_classes(lines, *span), "line-classes")
    linked = least_partner(line_links(docs, classes, s))
    owner = F.when(F.col("linked") < F.col("first"), F.col("linked"))
    several = classes.filter("n > 1").select("line", "mark", "n", "first")
    judged = several.join(linked, ["line", "mark"], "full").withColumns({"n": F.coalesce("n", F.lit(1)), "first": F.coalesce("first", "at")})  # a linked class that isn't among them is one line
    judged = materialize(judged.select("line", "mark", "n", "first", owner.alias("owner")).filter("n > 1 OR owner IS NOT NULL"), "line-judged")
    often = F.broadcast(judged.filter(F.col("n") > places / HOT))  # fewer than HOT rows
    line = lines.select("line", "mark", "doc_id", "line_no")
    rest = line.join(often.select("line", "mark"), ["line", "mark"], "left_anti").join(judged.hint("shuffle_hash"), ["line", "mark"])
    at = F.struct("doc_id", "line_no")
    hit = line.join(often, ["line", "mark"]).unionByName(rest).filter(F.col("owner").isNotNull() | (at > F.col("first")))
    return hit.select("doc_id", "line_no", F.coalesce("owner.doc_id", "first.doc_id").alias("first_doc_id")).distinct()


def line_dedup(docs: DataFrame, s: Lines = Lines()) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped_lines, first_doc_ids`` of every row."""
    dropped = dropped_lines(docs, s).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "first_doc_id"))).alias("d"))  # bounded by the document's lines
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = sizes.join(dropped, "doc_id", "left").withColumn("d", F.coalesce("d", F.array().cast("array<struct<line_no:int,first_doc_id:bigint>>")))
    return out.select("doc_id", "n_lines", F.size("d").cast("long").alias("n_dropped"), F.col("d.line_no").alias("dropped_lines"), F.col("d.first_doc_id").alias("first_doc_ids"))


def drop_repeated_lines(docs: DataFrame, s: Lines = Lines()) -> DataFrame:
    """``docs`` without the dropped lines; a document of which nothing but spaces is left goes, others keep their columns."""
    dropped = dropped_lines(docs, s).groupBy("doc_id").agg(F.collect_list("line_no").alias("_d")).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_key"))
    joined = rows.join(dropped, F.col("_key") == F.col("_id"), "left")
    left = F.array_join(F.filter(F.split("_row.text", "\n"), lambda x, i: ~F.array_contains("_d", i)), "\n")
    out = joined.withColumn("_left", F.when(F.col("_d").isNull(), F.col("_row.text")).otherwise(left)).filter(F.col("_d").isNull() | F.col("_left").rlike(r"[^\x20\x09-\x0D]"))
    cols = [F.col("_left").alias("text") if c == "text" else F.when(F.col("_d").isNull(), F.col("_row.n_chars")).otherwise(F.length("_left")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*cols)
