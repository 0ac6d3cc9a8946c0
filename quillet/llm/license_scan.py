"""Licence scans by the Dice coefficient over word bigrams.

Windows slide over the words of the whole text, whatever its lines. A window can
only reach the threshold t with a template of n bigrams if it holds n * t / (2 - t)
of them, and it needs at most (2 - t) / t times the template's words; the best
windows begin and end with a bigram of the template. So windows are only measured
from a template's bigrams on, where enough of them are near each other. Of windows
that overlap the one of the largest coefficient counts, then the longest, then the first.

Headers of one family differ in a word or two, which a coefficient over a hundred
bigrams hardly shows. So the name of a window is settled among near templates: of two,
that one counts of whose own bigrams, those the other lacks, the window has the larger
share, if the window reaches the threshold with it.

Defined cases: a null or empty text has no windows and no licence; of several
templates with the same coefficient the first in the list names the licence; rows
with a null id and repeated rows are scanned like any other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm.batches import bounded, text_groups
from quillet.llm.licence_texts import TEMPLATES

THRESHOLD = 0.85
#: Templates of other licences with at least this coefficient are near.
NEAR = 0.5

_word = re.compile(r"[a-z0-9]+")


def normalise(text: str) -> list[str]:
    return _word.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        self.threshold = threshold
        sized = sorted((len(b), i, name, b) for i, (name, text) in enumerate(templates) if (b := bigrams(normalise(text))))
        self.sizes = [n for n, *_ in sized]
        self.templates = sized
        t = threshold
        words = [len(normalise(text)) for _, text in templates]
        self.needs = {i: (math.ceil(n * t / (2 - t) - 1e-9), math.floor(words[i] * (2 - t) / t + 1e-9) - 1) for n, i, *_ in sized}  # bigrams at least, places at most
        self.named = {i: (name, b) for _, i, name, b in sized}
        self.owners: dict[tuple[str, str], list[int]] = defaultdict(list)
        for _, i, _, b in sized:
            for pair in b:
                self.owners[pair].append(i)

        self.near = {i: [j for _, j, other, c in sized if other != name and dice(b, c) >= NEAR] for _, i, name, b in sized}

    def settled(self, found: set, template: int) -> int:
        """The template that names a window of bigrams, of the one that found it and those near it."""
        for j in self.near[template]:
            mine, its = self.named[template][1], self.named[j][1]
            own, other = mine - its, its - mine
            if other and dice(found, its) >= self.threshold and len(found & other) * max(1, len(own)) > len(found & own) * len(other):
                template = j
        return template

    def best(self, found: set) -> tuple[float, str] | None:
        """The best template for a passage's bigrams, if it reaches the threshold."""
        n, t = len(found), self.threshold
        low, high = n * t / (2 - t) - 1e-9, n * (2 - t) / t + 1e-9
        best = None
        for size, i, name, b in self.templates[bisect_left(self.sizes, low) : bisect_right(self.sizes, high)]:
            score = 2 * len(found & b) / (n + size)
            if score >= t and (best is None or (-score, i) < best[0]):
                best = (-score, i), name
        return (-best[0][0], best[1]) if best else None

    def _window(self, pairs: list[tuple[str, str]], at: int, end: int, template: int) -> tuple[float, int, int, int, int] | None:
        """The best window from place ``at`` on that ends before ``end``, as a heap entry: -coefficient, -length, start, template, end."""
        b = self.named[template][1]
        seen: set[tuple[str, str]] = set()
        hits, best = 0, None
        for k in range(at, min(end, at + self.needs[template][1])):
            pair = pairs[k]
            new = pair not in seen
            seen.add(pair)
            if pair in b:  # a repeated one lengthens the window
                hits += new
                score = 2 * hits / (len(seen) + len(b))
                if score >= self.threshold and (best is None or (-score, at - k - 1) < best[:2]):
                    best = -score, at - k - 1, at, template, k + 1
        return best

    def windows(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """First and last word, licence and coefficient of the best windows that don't overlap."""
        pairs = list(zip(words, words[1:], strict=False))
        owners = self.owners
        places: dict[int, list[int]] = defaultdict(list)
        for k, pair in enumerate(pairs):
            if pair in owners:
                for i in owners[pair]:
                    places[i].append(k)
        heap = []
        for i, at in places.items():
            least, most = self.needs[i]
            for x, y in zip(at, at[least - 1 :], strict=False):
                if y - x < most and (entry := self._window(pairs, x, len(pairs), i)):
                    heap.append(entry)
        heapq.heapify(heap)
        taken: list[tuple[int, int, int, float]] = []  # first and last word, template, coefficient
        while heap:
            score, _, start, i, end = heapq.heappop(heap)
            next_ = bisect_left(taken, (start,))
            if next_ and taken[next_ - 1][1] >= start or next_ < len(taken) and taken[next_][0] == start:
                continue
            limit = taken[next_][0] - 1 if next_ < len(taken) else len(pairs)
            if end <= limit:
                insort(taken, (start, end, i, -score))
            elif entry := self._window(pairs, start, limit, i):
                heapq.heappush(heap, entry)
        out = []
        for start, end, i, score in taken:
            found = set(pairs[start:end]) if self.near[i] else set()
            j = self.settled(found, i)
            out.append((start, end, self.named[j][0], score if j == i else dice(found, self.named[j][1])))
        return out

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """First and last line, licence and coefficient of each window found."""
        found = self.windows(normalise(text))
        if not found:
            return []
        ends, n = [], 0
        for line in text.split("\n"):
            n += len(normalise(line))
            ends.append(n)
        return [(bisect_right(ends, first), bisect_right(ends, last), name, score) for first, last, name, score in found]


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Licences from a folder with one full text per file; a file's name without its ending names the licence."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.(txt|md)$", "")
    rows = spark.read.text(path, wholetext=True).select(name.alias("name"), "value").collect()  # the templates, as many as there are licences
    return sorted((r["name"], r["value"]) for r in rows)


def _scan(batches: Iterator[pa.RecordBatch], threshold: float, templates: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, threshold)
    for ids, texts in text_groups(batches):
        all_hits = [scanner.scan(t) for t in texts]
        best = [min(((-h[3], h[0], h[2]) for h in hits), default=None) for hits in all_hits]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(h) for h in all_hits], pa.int64()),
            pa.array([b and b[2] for b in best], pa.string()),
            pa.array([b and -b[0] for b in best], pa.float64()),
            pa.array([[x[2] for x in h] for h in all_hits], pa.list_(pa.string())),
            pa.array([[x[0] for x in h] for h in all_hits], pa.list_(pa.int32())),
            pa.array([[x[1] for x in h] for h in all_hits], pa.list_(pa.int32())),
            pa.array([[x[3] for x in h] for h in all_hits], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_hits", "licence", "score", "licences", "first_lines", "last_lines", "scores"])


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licences found in every whole text, with the lines they take and their coefficients.

    ``templates`` are (licence, text) pairs; full texts can be added with ``read_templates``.
    """
    plain = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id long, n_hits long, licence string, score double, licences array<string>, first_lines array<int>, last_lines array<int>, scores array<double>"
    return plain.mapInArrow(lambda it: _scan(it, threshold, templates), kinds)
