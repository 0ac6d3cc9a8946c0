"""Operators that look across documents, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD

from quillet.llm import katz_lm, kd_sharding, line_dedup, minhash_dedup, projected_ann
from quillet.llm.components import components, merged
from quillet.runtime import materialize


def reach(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(i, i + 1) for i in range(30)], [(5, 1), (7, 5), (9, 8), (8, 9), (4, 4)], [(0, i) for i in range(1, 40)]])
def test_components(spark, pairs):
    got = components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"))
    pairs = [p for p in pairs if p[0] != p[1]]
    want = reach(pairs, {n for p in pairs for n in p})
    assert {r.node: r.component for r in got.collect()} == want


def test_components_after_further_links(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    found = components(spark.createDataFrame(pairs[:20], "a long, b long"))
    for a, b in ((20, 20), (20, 35), (35, 45)):
        found = merged(found, materialize(spark.createDataFrame(pairs[a:b], "a long, b long"), "links"))
    pairs = [p for p in pairs if p[0] != p[1]]
    want = reach(pairs, {n for p in pairs for n in p})
    got = {r.node: r.component for r in found.collect()}
    assert all(got[n] == c for n, c in want.items()) and all(got[n] == n for n in got.keys() - want.keys())


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join("changed" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, prose, k):
    base = prose(12, 60, seed=7)
    hot = [edited(base[0], 0.06, s) for s in range(60)]
    texts = [*ODD, *base, *[edited(t, 0.03, 99) for t in base[:6]], *hot, base[3], base[3].upper(), "a", "b c", "B C"]
    ids = list(range(500, 500 + len(texts)))
    random.Random(1).shuffle(ids)
    table = docs([*texts, base[1], base[2]], ids=[*ids, ids[len(ODD) + 1], None])
    sets = {i: shingles(t, k) for i, t in zip(ids, texts, strict=True)}
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = reach(pairs, ids)
    rows = minhash_dedup.near_duplicates(table, minhash_dedup.Sketch(shingle=k)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])
    kept = minhash_dedup.keep_one_each(table, minhash_dedup.Sketch(shingle=k))
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_near_duplicates_of_nothing(docs):
    assert minhash_dedup.near_duplicates(docs(["x"]).filter("false")).count() == 0


def test_registers_estimate_and_merge():
    s = minhash_dedup.Sketch(bands=64)
    f, rng = minhash_dedup.multipliers(s), np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8, 0.95):
        items = rng.integers(0, 2**63, 3000).astype(np.uint64)
        n = int(3000 * 2 * share / (1 + share) / 2) * 2 // 2
        a, b = items[:1500], np.concatenate([items[:n][:1500], items[1500 : 3000 - n]])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = (minhash_dedup.registers_of(np.unique(x), f, s) for x in (a, b))
        got = minhash_dedup.estimate(np.array([len(a)]), np.array([len(b)]), ra[None], rb[None], s)[0]
        assert abs(got - j) < 0.12
        assert (minhash_dedup.merge_registers(ra, rb) == minhash_dedup.registers_of(np.union1d(a, b), f, s)).all()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance_and_probes(edits):
    rng = random.Random(edits)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = a[:]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        a, b = "".join(a), "".join(b)
        near = distance(a, b) <= edits
        assert line_dedup.within(a, b, edits) == near
        short, long_ = sorted((a, b), key=len)
        if near and len(short) > edits:
            cuts = line_dedup.segments(len(short), edits)
            assert any(long_[p : p + n] == short[cuts[i][0] : cuts[i][0] + n] for i, p, n in line_dedup.probes(len(long_), len(short), edits))


def test_line_dedup(docs, prose):
    lines = prose(30, 9, seed=8)
    near = [x[:4] + "#" + x[5:] for x in lines[:8]] + [x[:-1] for x in lines[8:12]] + [x + "zz" for x in lines[12:14]] + [x + "zzz" for x in lines[14:16]]
    rng, texts = random.Random(2), [*ODD]
    for _ in range(25):
        texts.append("\n".join(rng.choice([*lines, *near, "short one", "", f"  {lines[0]} "]) for _ in range(rng.randint(1, 7))))
    ids = list(range(40, 40 + len(texts)))
    random.Random(5).shuffle(ids)
    table = docs([*texts, texts[10], texts[12]], ids=[*ids, ids[10], None])
    places = sorted((i, n, x.strip("\t\n\x0b\x0c\r ")) for i, t in zip(ids, texts, strict=True) for n, x in enumerate((t or "").split("\n")) if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 5)
    first = {}
    for i, n, x in places:
        first.setdefault(x, (i, n))
    owner = {x: min([at, *(o for y, o in first.items() if x != y and min(len(x), len(y)) >= 16 and distance(x, y) <= 2)]) for x, at in first.items()}
    want = defaultdict(list)
    for i, n, x in places:
        if owner[x] < first[x] or (i, n) > first[x]:
            want[i].append((n, owner[x][0] if owner[x] < first[x] else first[x][0]))
    rows = line_dedup.line_dedup(table).collect()
    assert len(rows) == len(texts) + 2 and sum(map(len, want.values())) > 20
    for r in rows:
        assert list(zip(r.dropped_lines, r.first_doc_ids, strict=True)) == want.get(r.doc_id, []), r.doc_id
    left = {r.doc_id: r for r in line_dedup.drop_repeated_lines(table).collect() if r.doc_id is not None}
    assert line_dedup.drop_repeated_lines(table).columns == table.columns
    for i, t in zip(ids, texts, strict=True):
        gone = {n for n, _ in want.get(i, [])}
        rest = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
        if gone and not rest.strip("\t\n\x0b\x0c\r "):
            assert i not in left
        else:
            assert (left[i].text or "") == rest and (not gone or left[i].n_chars == len(rest))
    assert line_dedup.line_dedup(table.filter("false")).count() == 0


def test_long_lines_with_changed_words_are_linked(docs, prose):
    rng, kinds, rows = random.Random(3), "abcdefghijk", []
    for line in prose(40, 45, seed=21, vocabulary=3000) + prose(10, 130, seed=22, vocabulary=3000) + prose(20, 21, seed=23, vocabulary=3000):
        words = line.split()
        rows.append(line)
        for edits in (1, 2, 3, len(words) // 20, len(words) // 20 + 1):
            changed = words[:]
            for at in sorted(rng.sample(range(len(words)), edits), reverse=True):
                changed[at : at + 1] = rng.choice(([], ["".join(rng.choices(kinds, k=9))], [changed[at], "additional"]))
            rows.append(" ".join(changed))
    rng.shuffle(rows)
    rows = list(dict.fromkeys(rows))
    split = [r.split() for r in rows]
    want = {}
    for i, x in enumerate(split):
        for j in range(i):
            y = split[j]
            near = abs(len(x) - len(y)) <= 9 and len(set(x) & set(y)) > len(x) / 2 and distance(x, y) <= min(len(x), len(y)) // 20
            if near or (abs(len(rows[i]) - len(rows[j])) <= 2 and len(set(x) & set(y)) > len(x) / 2 and distance(rows[i], rows[j]) <= 2):
                want[i] = j
                break
    got = {r.doc_id: r.first_doc_ids[0] for r in line_dedup.line_dedup(docs(rows)).collect() if r.n_dropped}
    assert got == want and len(want) > 100


def test_many_near_copies_make_few_pairs(spark, docs, prose):
    rng, base = random.Random(7), prose(1, 60, seed=31, vocabulary=3000)[0].split()
    texts = []
    for _ in range(2000):
        words = base[:]
        words[rng.randrange(60)] = "".join(rng.choices("klmnop", k=8))
        texts.append(" ".join(words))
    s = line_dedup.Lines(block=256)
    table = docs(texts)
    plain = table.select("doc_id", "text")
    entries = plain.mapInArrow(lambda it: line_dedup._entries(it, s), line_dedup._ENTRY).repartition("key").sortWithinPartitions("key", "line")
    shared = entries.mapInArrow(line_dedup._shared, line_dedup._ENTRY)
    about = plain.mapInArrow(lambda it: line_dedup._lines(it, s), line_dedup._LINE)
    members = shared.join(about, "line").select(*line_dedup._NAMES).repartition("key").sortWithinPartitions("key", "doc_id", "line_no")
    met = members.mapInArrow(lambda it: line_dedup._select(it, s), line_dedup._MET)
    pairs = met.filter("kind = 0").select("line", "c_line").distinct().count()
    assert 1999 <= pairs <= 20 * 2000  # all pairs would be two millions
    rows = line_dedup.line_dedup(table, s).collect()
    assert sum(r.n_dropped for r in rows) == len(set(texts)) - 1 + len(texts) - len(set(texts))


@pytest.mark.parametrize("block", [3, 1024])
def test_blocks_of_a_key_lose_no_link(docs, prose, block):
    rng, base = random.Random(9), [x.split() for x in prose(6, 44, seed=33, vocabulary=3000)]
    passage, rows = prose(1, 30, seed=34, vocabulary=3000)[0].split(), []
    for k in range(90):  # many lines hold one passage, few of them are near each other
        words = passage + [f"w{k // 3}x{i}" for i in range(14)]
        words[rng.randrange(30, 44)] = f"n{k}"
        rows.append(" ".join(words))
    rows += [" ".join(b[:20] + [f"z{k}"] + b[21:]) for b in base for k in range(4)]
    rng.shuffle(rows)
    split = [r.split() for r in rows]
    want = {}
    for i, x in enumerate(split):
        found = [j for j in range(i) if len(set(x) & set(split[j])) >= 40 and distance(x, split[j]) <= 2]
        if found:
            want[i] = found[0]
    got = {r.doc_id: r.first_doc_ids[0] for r in line_dedup.line_dedup(docs(rows), line_dedup.Lines(block=block)).collect() if r.n_dropped}
    assert got == want and len(want) >= 60


def test_lines_of_rows_that_share_an_id(docs, prose):
    a, b = prose(2, 30, seed=35, vocabulary=3000)
    near = " ".join(["changed", *a.split()[1:]])
    rows = line_dedup.line_dedup(docs([a, b, near], ids=[1, 1, 2])).collect()
    assert [(r.n_dropped, r.first_doc_ids) for r in rows if r.doc_id == 2] == [(1, [1])]


def test_short_lines_and_very_long_texts(docs):
    one = line_dedup.Lines(least_words=1)
    rows = {r.doc_id: r.dropped_lines for r in line_dedup.line_dedup(docs(["yes\nno", "no\n\nyes \nyep"]), one).collect()}
    assert rows == {0: [], 1: [0, 2]}
    long_ = "\n".join(f"line number {i} of a very long text with some words {i * 7919}" for i in range(40_000))  # over two million characters
    rows = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs([long_, "a line of its own here\n" + long_[-60:]]), line_dedup.Lines(edits=0)).collect()}
    assert rows[0] == 0 and rows[1] == 0
    word = "x" * 2_500_000
    rows = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs([word, word]), one).collect()}
    assert rows == {0: 0, 1: 1}


def brute_katz(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["</s>"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c, b, starts = Counter(), Counter(), 0
    for _, words, held in texts:
        if not held:
            c.update(words)
            b.update(zip(["<s>", *words], words, strict=False))
            starts += 1
    n, v, kinds = sum(c.values()), len(c), Counter(b.values())
    d = katz_lm.discounts([kinds[r] for r in range(1, 7)])
    history = Counter(c) + Counter({"<s>": starts})
    p = lambda w: (c[w] + 1) / (n + v + 1)
    less = lambda r: r - d[6] if r > 5 else d[r] * r
    taken, mass = Counter(), Counter()
    for (h, w), r in b.items():
        taken[h] += less(r) / history[h]
        mass[h] += p(w)
    weight = {h: (1 - taken[h]) / (1 - mass[h]) for h in taken}
    for h in list(taken)[:20]:
        assert sum(less(b[h, w]) / history[h] if b[h, w] else weight[h] * p(w) for w in c) + weight[h] * p("?") == pytest.approx(1)
    out = []
    for i, words, held in texts:
        score = sum(math.log10(less(b[h, w]) / history[h] if b[h, w] else weight.get(h, 1.0) * p(w)) for h, w in zip(["<s>", *words], words, strict=False))
        out.append((-1 if i is None else i, held, len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10(p(w)) for w in words), 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize(("block", "keys"), [(4_000_000, 3_000_000), (150, 60)])
def test_katz(docs, prose, block, keys):
    texts = [*ODD, *prose(60, 25, seed=9, vocabulary=60), "a", "a"]
    ids = [*range(len(texts) - 2), None, 7]
    got = katz_lm.katz_scores(docs(texts, ids=ids), block, keys).collect()
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    want = brute_katz(list(zip(ids, texts, strict=True)))
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5:] for r in rows], [w[5:] for w in want], atol=2e-6)


def test_katz_totals_beyond_32_bits():
    keys = np.array([5, 9], np.uint64)
    rows = [(0, t, 0, katz_lm._pack_sorted(keys), katz_lm._pack(np.array([3_000_000_000, 1], np.uint32))) for t in range(2)]
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    answer = katz_lm._totals(pa.table(columns, names=["range", "task", "block", "keys", "counts"])).to_pylist()
    assert [katz_lm._unpack(r["totals"], "<u8").tolist() for r in answer] == [[6_000_000_000, 2]] * 2
    assert [r["tokens"] for r in answer] == [6_000_000_002, 0]


def test_katz_without_training_rows(docs):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz_lm.katz_scores(docs(["a b"], ids=[held])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) == (True, 3, 0, 0, 0.0)
    assert katz_lm.katz_scores(docs(["x"]).filter("false")).count() == 0


def test_discounts_stay_factors():
    for n in ([0] * 6, [10, 5, 3, 2, 1, 1], [5, 50, 1, 0, 0, 9], [1000, 300, 150, 90, 60, 45]):
        d = katz_lm.discounts(n)
        assert all(0 < x < 1 for x in d[1:])


@pytest.mark.parametrize("block", [4096, 40])
def test_nearest(spark, block):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 12)).astype(np.float32)
    vectors[:150] /= np.linalg.norm(vectors[:150], axis=1)[:, None]
    vectors[40:80] = vectors[40]  # one vector many times
    rows = [(i, x.tolist(), "t") for i, x in enumerate(vectors)]
    bad = [(1000, None, "t"), (1020, [0.0] * 12, "t"), (1040, [float("nan")] + [1.0] * 11, "t"), (1060, [None] + [1.0] * 11, "t"), (1080, [1.0] * 3, "t"), (None, [1.0] * 12, "t"), (1100, [float("inf")] + [1.0] * 11, "t")]
    table = spark.createDataFrame(rows + bad + [(3, rows[3][1], "t"), (20, rows[20][1], "t")], "vec_id long, embedding array<float>, score string").repartition(3)
    got = defaultdict(list)
    from pyspark.sql import functions as F

    for r in projected_ann.nearest(table, F.col("vec_id") % 20 == 0, projected_ann.Index(block=block)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x, hits = vectors.astype(np.float64), 0
    assert sorted(got) == list(range(0, 300, 20))
    for q in got:
        exact = sorted((-math.fsum(x[i] * x[q]), i) for i in range(300) if i != q)[:20]
        assert [g[0] for g in got[q]] == list(range(1, 21))
        assert all(g[2] == math.fsum(x[g[1]] * x[q]) for g in got[q])
        assert [(-g[2], g[1]) for g in got[q]] == sorted((-g[2], g[1]) for g in got[q])
        hits += len({i for _, i in exact} & {g[1] for g in got[q]})
    assert hits >= 0.95 * 20 * len(got)
    few = table.filter("vec_id < 8")
    assert projected_ann.nearest(few, F.col("vec_id") % 20 == 0).count() == 7
    assert projected_ann.nearest(table.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block", [4096, 40])
def test_repeated_rows_take_no_places(spark, block):
    from pyspark.sql import functions as F

    vectors = np.random.default_rng(5).normal(size=(200, 8)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(vectors)]
    near = [(i, (x * 0.999).astype(np.float32).tolist()) for i, x in enumerate(vectors)]  # an id with several vectors counts once, too
    schema, s = "vec_id long, embedding array<float>", projected_ann.Index(block=block, leaf=8)
    once = spark.createDataFrame(rows, schema)
    for table, first in ((spark.createDataFrame(rows * 2, schema), rows), (spark.createDataFrame(rows * 3 + near, schema), rows + near)):
        got = defaultdict(list)
        for r in projected_ann.nearest(table.repartition(3), F.col("vec_id") % 20 == 0, s).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert all(len(g) == len(set(g)) == 20 for g in got.values()) and len(got) == 10
        hits = 0
        for q, g in got.items():
            asked = np.array(min(x for i, x in first if i == q), np.float64)
            best = defaultdict(lambda: -math.inf)
            for i, x in first:
                best[i] = max(best[i], math.fsum(np.array(x, np.float64) * asked))
            hits += len(set(g) & set(sorted((i for i in best if i != q), key=lambda i: (-best[i], i))[:20]))
        assert hits >= 0.95 * 200
    assert projected_ann.nearest(once, F.col("vec_id") % 20 == 0, s).count() == 200


def test_chi_square_quantile():
    assert projected_ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert projected_ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_shards(docs, prose):
    texts = [*ODD, *[t[: 30 + 9 * i] for i, t in enumerate(prose(200, 300, seed=10))], *["copy " * 20] * 60, *["pair of texts"] * 2]
    table = docs([*texts, "null id"], ids=[*range(len(texts)), None], sources=[f"s{i % 5}" if i % 9 else None for i in range(len(texts) + 1)])
    rows = kd_sharding.kd_shards(table, shards=16).collect()
    sizes, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        data = b"" if r.doc_id is None else (texts[r.doc_id] or "").encode()
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
            places[data].add(r.shard)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = 5001  # one text can't be split
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) <= mean + longest and min(sizes.values()) >= mean - longest
    assert all(len(p) == 1 for t, p in places.items() if texts.count(t.decode()) * (len(t) + 1) < mean / 4)
    by_bytes = kd_sharding.kd_shards(table, target_bytes=int(mean * 4)).select("shard").distinct().count()
    assert by_bytes in (4, 5)
    assert kd_sharding.kd_shards(table.filter("false"), shards=4).count() == 0
    assert {r.shard for r in kd_sharding.kd_shards(docs(["a"]), shards=4).collect()} <= {0, 1, 2, 3}
