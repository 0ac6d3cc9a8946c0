"""Lines meet by few keys, none of them lost; classes of equal lines are found without sorting, whatever the document ids."""

from __future__ import annotations

import random

import pytest

from quillet.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, most, letters):
    text = text[:]
    for _ in range(rng.randint(0, most)):
        at = rng.randint(0, len(text))
        text[at : at + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
    return text


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_cuts_of_several_lengths_are_few_and_meet_every_near_line(edits):
    rng, met = random.Random(edits), 0
    for _ in range(2000):
        a = [rng.choice("abc") for _ in range(rng.randint(edits + 1, 24))]
        short, long_ = sorted(("".join(a), "".join(changed(rng, a, edits, "abc"))), key=len)
        if len(short) > edits and distance(short, long_) <= edits:
            own = {(i, short[p : p + n]) for i, (p, n) in enumerate(line_dedup.segments(len(short), edits))}
            assert own & {(i, long_[p : p + n]) for i, p, n in line_dedup.cuts(len(long_), edits + 1, len(long_), edits)}
            met += 1
    assert met > 1000
    assert all(len(line_dedup.cuts(n, 16, n, 2)) <= 9 for n in range(16, 400))  # twelve with a key for each length


def test_lines_have_few_keys(docs, prose):
    s = line_dedup.Lines(least_words=1)
    for words, most in ((10, 9), (30, 13)):  # before: 12, and some 20
        lines = prose(200, words, seed=words, vocabulary=4000)
        table = docs(lines, partitions=1).select("doc_id", "text")
        assert table.mapInArrow(lambda it: line_dedup._entries(it, s), line_dedup._ENTRY).count() <= most * len(lines)


def test_one_changed_word_whatever_the_spaces(docs, prose):
    rng, rows = random.Random(6), []
    for n in (20, 21, 30, 39, 40):
        for line in prose(6, n, seed=40 + n, vocabulary=3000):
            for at in (0, n // 2 - 1, n // 2, n - 1):
                words = line.split()
                words[at] = "".join(rng.choices("qxz", k=9))
                rows.append(("  " if at else " \t").join(words))
            rows.append(" ".join(line.split()[1:]) if n > 20 else line)
            rows.append(line)
    split = [r.split() for r in rows]
    want = {}
    for i, x in enumerate(split):
        found = [j for j in range(i) if len(set(x) & set(split[j])) > 10 and distance(x, split[j]) <= min(len(x), len(split[j])) // 20]
        if found:
            want[i] = found[0]
    got = {r.doc_id: r.first_doc_ids[0] for r in line_dedup.line_dedup(docs(rows)).collect() if r.n_dropped}
    assert got == want and len(want) > 40


def test_bands_of_many_edits():
    rng = random.Random(8)
    for _ in range(3000):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        b, edits = changed(rng, a, 12, "abcd"), rng.randint(0, 9)
        assert line_dedup.banded(a, b, edits) == min(distance(a, b), edits + 1)


@pytest.mark.parametrize("ids", [[5, 3, 9], [-(1 << 62), 1 << 62, -7], [-(1 << 63), (1 << 63) - 1, 0]])
def test_first_places_of_equal_lines(docs, ids):
    texts = ["a b c d e\nf g h i j\na b c d e", "f g h i j\nk l m n o", "k l m n o"]
    least = {x: min((i, n) for i, t in zip(ids, texts, strict=True) for n, y in enumerate(t.split("\n")) if x == y) for t in texts for x in t.split("\n")}
    want = {i: ([n for n, x in enumerate(t.split("\n")) if (i, n) != least[x]], [least[x][0] for n, x in enumerate(t.split("\n")) if (i, n) != least[x]]) for i, t in zip(ids, texts, strict=True)}
    got = {r.doc_id: (r.dropped_lines, r.first_doc_ids) for r in line_dedup.line_dedup(docs(texts, ids=ids)).collect()}
    assert got == want


def test_classes_are_found_without_sorting(spark):
    lines = spark.createDataFrame([(4, 0, 1, 2, 3, 4, 5, 6), (3, 7, 1, 2, 3, 4, 5, 6), (3, 9, 1, 2, 3, 4, 5, 6)], line_dedup._LINE)
    small, wide = line_dedup.line_classes(lines, 3, 4, 9), line_dedup.line_classes(lines, -(1 << 62), 1 << 62, 9)
    assert "SortAggregate" not in small._jdf.queryExecution().executedPlan().toString()
    assert small.schema.simpleString() == wide.schema.simpleString() and small.collect() == wide.collect()
    assert [(r.n, tuple(r.first)) for r in small.collect()] == [(3, (3, 7))]
