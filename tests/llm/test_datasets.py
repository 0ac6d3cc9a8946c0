"""Fingerprints, manifests and whitening, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from quillet.llm import embedding_whitening, merkle_manifest
from quillet.llm import threshold_sketch as ts

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def slow_sketch(text, t):
    runs = {text[i : i + t.width] for i in range(max(1, len(text) - t.width + 1))} if text else set()
    each = {int(ts.shingle_hashes(ts.code_points(r), t.width)[0]) for r in runs}
    low = {h for h in each if h < 2 ** (ts.BITS - t.halvings)}
    return low or ({min(each)} if each else set())


def test_fingerprints(docs, prose):
    base = prose(30, 80, seed=61)
    texts = [*ODD, *base, base[0], base[0] + " more", "\n".join(base) * 40, "\U0001f600é" * 30]
    table = docs([*texts, "no id", None], ids=[*range(len(texts)), None, None])
    got = ts.edited_fingerprints(table).collect()
    assert len(got) == len(texts) + 2
    t, by_id = ts.Threshold(), {r.doc_id: r for r in got if r.doc_id is not None}
    for i, raw in enumerate(texts):
        text, r = raw or "", by_id[i]
        if i:
            after = texts[i - 1] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            assert r.edited_sha256 == sha(edited)
            a, b, c = (slow_sketch(x, t) for x in (text, edited, after))
            assert r.near_edited == (len(a & b) / len(a | b) if a | b else 1)
            assert r.near_next == (len(a & c) / len(a | c) if a | c else 1)
        assert r.n_chars == len(text)
        assert r.fingerprint == ts.written(np.array(sorted(slow_sketch(text, t)), np.uint64))
    assert by_id[len(ODD)].fingerprint == by_id[len(ODD) + 30].fingerprint
    assert {r.n_chars for r in got if r.doc_id is None} == {0, 5}


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_every_row_has_its_next(docs, buckets):
    """Ids that repeat, one of them for a third of the rows, in any number of buckets."""
    rng = random.Random(buckets)
    ids = [5] * 20 + [rng.choice([None, *range(12)]) for _ in range(40)]
    texts = [f"{rng.random()} text" for _ in ids]
    got = ts.edited_fingerprints(docs(texts, ids=ids), buckets=buckets).collect()
    tie = {r.text: r.h for r in docs(texts).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    want = []
    for (i, a), (_, b) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(a) // 2
        want.append((i, sha(a[: len(a) - half] + b[:half])))
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_fingerprints_of_little(docs):
    assert ts.edited_fingerprints(docs(["x"]).filter("false")).count() == 0
    one = ts.edited_fingerprints(docs(["abcdef"])).first()
    assert (one.near_next, one.edited_sha256) == (1.0, sha("abcabc"))
    same = ts.edited_fingerprints(docs(["same"] * 9, ids=[1] * 9)).collect()
    assert len(same) == 9 and {r.near_next for r in same} == {1.0}


def test_sketches_merge_and_contain(spark, prose):
    t = ts.Threshold(width=8, halvings=2)
    texts = prose(6, 200, seed=62)
    prints = [(k // 3, ts.written(ts.sketch(ts.code_points(x), t))) for k, x in enumerate([*texts, "short", ""])]
    table = spark.createDataFrame(prints, "g long, fingerprint string")
    whole = {r.g: r.fingerprint for r in ts.merged(table, ["g"], t).collect()}
    for g in (0, 1):
        want = sorted(set().union(*(slow_sketch(x, t) for x in texts[3 * g : 3 * g + 3])))
        assert whole[g] == ts.written(np.array(want, np.uint64))
    assert whole[2] == ts.written(np.array(sorted(slow_sketch("short", t)), np.uint64))
    pairs = spark.createDataFrame([(prints[0][1], whole[0]), (prints[0][1], whole[1]), ("", ""), ("", whole[0])], "a string, b string")
    got = [(r.c, round(r.j, 3)) for r in pairs.select(ts.containment(F.col("a"), F.col("b")).alias("c"), ts.likeness(F.col("a"), F.col("b")).alias("j")).collect()]
    own, groups = slow_sketch(texts[0], t), [set().union(*(slow_sketch(x, t) for x in texts[3 * g : 3 * g + 3])) for g in (0, 1)]
    assert got == [*((len(own & g) / len(own), round(len(own & g) / len(own | g), 3)) for g in groups), (1.0, 1.0), (1.0, 0.0)]


def slow_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of ``(doc_id, source, lang, n_chars, text)``, sorted."""
    tag = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def grow(nodes):
        proofs, levels = [[] for _ in nodes], [[(x, [i]) for i, x in enumerate(nodes)]]
        while len(levels[-1]) > 1:
            runs = [levels[-1][i : i + 3] for i in range(0, len(levels[-1]), 3)]
            for run in runs:
                for k, (_, leaves) in enumerate(run):
                    for i in leaves:
                        proofs[i].append((run[:k], run[k + 1 :]))
            levels.append([(sha("".join(x for x, _ in run)), [i for _, own in run for i in own]) for run in runs])
        text = lambda run: "".join(x for x, _ in run)
        return levels[-1][0][0], [[(text(a), text(b)) for a, b in p] for p in proofs]

    groups = {}
    for r in rows:
        tampered = r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[4].replace("\n", "")
        groups.setdefault(r[1], []).append((r[0], sha("".join(map(tag, r))), sha("".join(map(tag, (*r[:4], tampered))))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: grow([x[1] for x in groups[s]]) for s in names}
    root, upper = grow([trees[s][0] for s in names])
    out = []
    for s, high in zip(names, upper, strict=True):
        for (doc_id, leaf, found), low in zip(groups[s], trees[s][1], strict=True):
            node = found
            for a, b in [*low, *high]:
                node = sha(a + node + b)
            out.append((doc_id, leaf, trees[s][0], root, sha("".join(a + b for a, b in [*low, *high])), node, node == root))
    return sorted(out, key=repr)


def manifest_rows(table):
    return [tuple(r) for r in table.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("sources", [1, 4, 30])
def test_manifest(docs, prose, sources):
    n = 1700  # more than two windows of one source
    rng = random.Random(sources)
    texts = [f"line {i}\nmore {i % 5}" if i % 3 else f"one {i}" for i in range(n)]
    where = [f"h{rng.randrange(sources)}" if sources < 30 or rng.random() < 0.6 else "" if i % 7 else None for i in range(n)]
    table = docs(texts, sources=where, partitions=5)
    got = sorted((tuple(r) for r in merkle_manifest.verified_manifest(table).collect()), key=repr)
    assert got == slow_manifest(manifest_rows(table))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(docs, spark):
    texts = [*ODD, "a\nb", "a\nb", "a\nb", None]
    table = docs(texts, ids=[*range(len(ODD)), 3, 3, None, None], sources=["é", "z", None, "", "s", "é", "z", None, "é", "é", "é", None])
    table = table.unionByName(table.filter("doc_id = 1")).withColumn("lang", F.when(F.col("doc_id") != 2, F.col("lang")))
    got = sorted((tuple(r) for r in merkle_manifest.verified_manifest(table).collect()), key=repr)
    assert got == slow_manifest(manifest_rows(table)) and len(got) == len(texts) + 1
    assert merkle_manifest.verified_manifest(table.filter("false")).count() == 0
    one = merkle_manifest.verified_manifest(docs(["x"])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("")


def test_subtrees_of_any_cut():
    """A run cut anywhere: what is built and what stays ragged cover the leaves, in the right nodes."""
    rng = random.Random(4)
    for _ in range(200):
        total = rng.randrange(1, 60)
        nodes = [sha(str(i)) for i in range(total)]
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        low = rng.randrange(total)
        high = rng.randrange(low, total) + 1
        held = merkle_manifest.complete_subtrees(nodes[low:high], low, total)
        for k, level in enumerate(held):
            assert all(levels[k][i] == x for i, x in level)
            inside = [i for i in range(len(levels[k])) if low <= i * 3**k and min((i + 1) * 3**k, total) <= high]
            assert [i for i, _ in level] == inside
        for i in range(low, high):
            level, index, node, left, right = merkle_manifest.path_up(held, i)
            x = nodes[i]
            for a, b in zip(left, right, strict=True):
                x = sha(a + x + b)
            assert node == x == levels[level][index]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, x string, component int, whitened double").repartition(3)


def slow_whitening(rows):
    """n, covariance and deviations by rational arithmetic."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    cov = [[float(sum((Fraction(v[a]) - Fraction(s[a], n)) * (Fraction(v[b]) - Fraction(s[b], n)) for v in fit) / n) for b in range(d)] for a in range(d)]
    return n, np.array(cov), {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in x.items()}, x, s


@pytest.mark.parametrize("d,scale", [(5, 1.0), (24, 1.0), (4, 1e9)])
def test_whitening(spark, d, scale):
    rng = np.random.default_rng(d)
    mix = rng.normal(size=(d, d))
    good = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(90, d)) @ mix * scale)]
    good += [(90 + i, good[0][1]) for i in range(60)]  # copies count once
    odd = [(200, None), (201, []), (202, [1.0] * (d - 1)), (203, [None] + [1.0] * (d - 1)), (204, [float("nan")] * d), (205, [float("inf")] + [1.0] * (d - 1)), (206, [1e300] * d)]
    n, cov, dev, x, s = slow_whitening(good)
    got = embedding_whitening.whiten(vectors(spark, good + odd)).collect()
    values, axes = np.linalg.eigh(cov)
    k = min(16, d)
    assert len(got) == 150 * k and {r.n for r in got} == {n} and {r.vec_id for r in got} == {i for i, _ in good}
    assert all(int(r.deviation) == dev[r.vec_id] for r in got)
    assert got[0].identity_error < 1e-6
    signs = {}
    for r in got:
        e, v = values[-r.component], axes[:, -r.component]
        want = sum(float(Fraction(n * a - b, n)) * q for a, b, q in zip(x[r.vec_id], s, v, strict=True)) / math.sqrt(e)
        assert r.explained == pytest.approx(e / np.trace(cov), rel=1e-9)
        sign = signs.setdefault(r.component, 1 if abs(r.whitened - want) < abs(r.whitened + want) else -1)
        assert sign * r.whitened == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_exact_products():
    rng = np.random.default_rng(9)
    for top in (10, 2**30, 2**61):
        y = rng.integers(-top, top, size=(5000, 4))
        wide = y.astype(object)
        assert (embedding_whitening.cross_products(y) == wide.T @ wide).all()
        assert (embedding_whitening.column_sums(y) == wide.sum(axis=0)).all()


def test_whitening_of_little(spark):
    assert embedding_whitening.whiten(vectors(spark, [(1, [1.0])]).filter("false")).count() == 0
    assert embedding_whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)])).count() == 0
    flat = embedding_whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0]), (None, [4.0, 2.0, 3.0])])).collect()
    assert [r.component for r in flat] == [1, 1, 1] and flat[0].explained == 1.0 and {r.vec_id for r in flat} == {1, 2, None}
