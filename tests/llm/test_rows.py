"""Operators that look at one document at a time, against brute force."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import ODD
from tokenizers import Tokenizer

from quillet.llm import best_fit_packing as packing
from quillet.llm import byte_bpe, license_scan, quality_rules, toxicity
from quillet.llm.licence_texts import TEMPLATES

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_measures(docs, prose):
    again = "one two three four five six"
    texts = [*ODD, *prose(5, 30), f"{again} x {again}", " ".join(["a b c d e f"] * 4), "# * $ %%% | <b>\nq\nq\nq", "w " * 5]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_bad_hosts_lose_their_documents(docs, prose):
    good, junk = prose(60, 40, seed=1), [x + " $ % | # * < > $ $ $ $" for x in prose(40, 40, seed=2)]
    table = docs([*good, *junk, good[0], None], sources=["good"] * 60 + ["bad"] * 40 + [None, "good"])
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(table).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 100))
    assert not got[101]
    kept = quality_rules.quality_filter(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_beta_prior():
    assert quality_rules.beta_prior(0, 0, 0, 0.0) == (0.0, 1.0)
    mean, weight = quality_rules.beta_prior(4, 400, 40, 4 * 100 * 0.1**2)  # hosts that don't differ
    assert mean == 0.1 and weight > 1000
    mean, weight = quality_rules.beta_prior(2, 200, 100, 100.0)  # hosts that differ wholly
    assert mean == 0.5 and weight == pytest.approx(1.0)


def test_quality_of_nothing(docs, spark):
    empty = docs(["x"]).filter("false")
    assert quality_rules.quality_rules(empty).count() == quality_rules.quality_filter(empty).count() == 0


def best_fit_decreasing(lengths, capacity):
    """Remaining capacities of the bins, by the textbook."""
    bins = []
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(bins, length)
        bisect.insort(bins, (capacity if i == len(bins) else bins.pop(i)) - length)
    return bins


def test_packing_round_trip(docs, prose):
    texts = [*ODD, *prose(40, 120, seed=3), " ".join(prose(1, 3000, seed=4))]
    table = docs([*texts, texts[9]], ids=[*range(len(texts)), None])
    rows = packing.pack_documents(table, WORDS, capacity=256, with_ids=True).collect()
    encoder = Tokenizer.from_file(WORDS)
    pieces = {}
    for r in rows:
        ids = np.array(r.ids, "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length <= 256
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == [*encoder.encode(t or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in own] == [256 * k for k in range(len(own))] and all(r.length == 256 for r in own[:-1])
    assert len(pieces[None]) == len(pieces[9])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) == len(best_fit_decreasing([r.length for r in rows], 256))
    whole = packing.assemble(packing.pack_documents(table, WORDS, capacity=256, with_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in rows)
    assert packing.pack_documents(table.filter("false"), WORDS).count() == 0


def test_special_tokens_are_the_library_s(docs):
    texts = ["abc <|endoftext|> def", "Abc<|endoftext|>DEF <|ENDOFTEXT|> x <|startoftext|>. Y", "<|startoftext|><|endoftext|>\n<|endoftext|", "日本 É.<|endoftext|>́ x, <|EndOfText|>"]
    encoder = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(docs(texts), WORDS, capacity=256, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: [*encoder.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 65, 20), rng.integers(1, 40, 20), strict=True)}
    plan, bins = packing.plan_best_fit(counts, 64), best_fit_decreasing([n for n, c in counts.items() for _ in range(c)], 64)
    assert plan.bins == len(bins)
    filled = {}
    for length, n in counts.items():
        for s, o in zip(*(x.tolist() for x in plan.place(np.full(n, length), np.arange(n))), strict=True):
            filled.setdefault(s, []).append((o, length))
    assert sorted(64 - sum(n for _, n in parts) for parts in filled.values()) == bins
    assert all(sorted(p)[0][0] == 0 for p in filled.values())


def test_plan_rejects_what_does_not_fit():
    with pytest.raises(ValueError, match="outside"):
        packing.plan_best_fit({65: 1}, 64)
    assert packing.plan_best_fit({}, 64).bins == 0


def library_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_tiktoken(docs, prose):
    texts = [*ODD, *prose(20, 60, seed=5), "it's  we'll\t\n x  ", "日本語 123,456!! (naïve)", "\n\n  \n", "don't. 'S O'Neil...", "a b \r\n c"]
    encoding = library_encoding()
    got = {r.doc_id: r for r in byte_bpe.bpe_digest(docs(texts), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, t
    encoded = byte_bpe.bpe_encode(docs(texts), RANKS, public_tokenizers.PATTERN)
    decoded = {r.doc_id: bytes(r.data) for r in byte_bpe.bpe_decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert decoded == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert byte_bpe.bpe_digest(docs(["x"]).filter("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_replay_waits_for_lower_ranks():
    # after "ab" (rank 300) a pair of lower rank appears and comes first
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 299, b"ab": 300, b"bb": 301}
    bpe = byte_bpe.ByteBpe(ranks, r"\p{L}+")
    encoding = tiktoken.Encoding("t", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})
    for text in ("ababc", "abcabab", "bbabbbc", "abbabc", "bbbbb"):
        assert np.frombuffer(bpe.replay([text.encode()])[0], "<u4").tolist() == encoding.encode_ordinary(text)


def test_licences_against_all_templates(docs, prose):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
    broken = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    cut = "\n".join(re.findall(r".{1,70}(?:\s|$)", mit))
    texts = [*ODD, "intro line here\nReleased under the MIT license", "Licensed under CC BY-NC 4.0.", "text\n" + cut + "\nmore text of another kind", mit, broken, *prose(5, 50)]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(texts)).collect()}
    names = [got[i].licence for i in range(len(ODD), len(texts))]
    assert names[:4] == ["MIT", "CC-BY-NC-4.0", "MIT", "MIT"] and names[5:] == [None] * 5
    assert (got[len(ODD) + 2].first_lines, got[len(ODD) + 2].n_hits) == ([1], 1)
    assert all(got[i].n_hits == 0 for i in range(len(ODD)))
    scanner = license_scan.Scanner(TEMPLATES, 0.6)
    for line in [mit, "Licensed under the Apache License", *mit.split(". "), *prose(20, 8)]:
        found = license_scan.bigrams(license_scan.normalise(line))
        every = [license_scan.dice(found, license_scan.bigrams(license_scan.normalise(t))) for _, t in TEMPLATES]
        best = scanner.best(found)
        assert (best[0] if best else None) == (max(every) if max(every) >= 0.6 else None)
    assert license_scan.license_scan(docs(["x"]).filter("false")).count() == 0


def test_licences_inside_lines_and_next_to_each_other(docs, prose):
    full = [(n, t) for n, t in TEMPLATES if n in ("MIT", "ISC") and len(t) > 300]
    lines = ["\n".join(re.findall(r".{1,70}(?:\s|$)", t)) for _, t in full]
    words = " ".join(prose(1, 300, seed=12))
    texts = ["x\nCopyright 2020 Foo. Released under the MIT License.", f"{words} {full[0][1]} {words} {full[1][1]} {words}", f"{lines[0]}\n\n{lines[1]}", "Released under\nthe MIT License. Licensed under CC BY 4.0.", words]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(texts)).collect()}
    assert [got[i].licences for i in range(5)] == [["MIT"], [n for n, _ in full], [n for n, _ in full], ["MIT", "CC-BY-4.0"], []]
    assert [list(zip(got[i].first_lines, got[i].last_lines, strict=True)) for i in (0, 1, 3)] == [[(1, 1)], [(0, 0)] * 2, [(0, 1), (1, 1)]]
    first = lines[0].count("\n")
    assert (got[2].last_lines[0], got[2].first_lines[1]) == (first, first + 2)
    assert all(s == 1.0 for i in range(4) for s in got[i].scores)


GNU_V2 = """This {w} is free software; you can redistribute it and/or modify
it under the terms of the GNU {t} Public License as published by
the Free Software Foundation; either version {v} of the License, or
(at your option) any later version.

This {w} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {t} Public License for more details.

You should have received a copy of the GNU {t} Public License{more}
along with this {w}; if not, {end}"""
HEADS = [
    ("GPL-2.0", GNU_V2.format(w="program", t="General", v="2", more="", end="write to the Free Software\nFoundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")),
    ("GPL-2.0", GNU_V2.format(w="file", t="General", v="2", more=" ", end="see <http://www.gnu.org/licenses/>.")),
    ("GPL-3.0", GNU_V2.format(w="program", t="General", v="3", more="", end="see <https://www.gnu.org/licenses/>.")),
    ("LGPL-2.1", GNU_V2.format(w="library", t="Lesser General", v="2.1", more="", end="write to the Free Software\nFoundation, Inc., 59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")),
    ("LGPL-3.0", GNU_V2.format(w="program", t="Lesser General", v="3", more=" and the", end="see <https://www.gnu.org/licenses/>.")),
    ("AGPL-3.0", GNU_V2.format(w="program", t="Affero General", v="3", more="", end="see <https://www.gnu.org/licenses/>.")),
    ("Apache-2.0", next(t for n, t in TEMPLATES if n == "Apache-2.0" and len(t) > 200)), ("MPL-2.0", next(t for n, t in TEMPLATES if n == "MPL-2.0")),
    ("BSD-2-Clause", next(t for n, t in TEMPLATES if n == "BSD-2-Clause" and len(t) > 200)), ("BSD-3-Clause", next(t for n, t in TEMPLATES if n == "BSD-3-Clause" and len(t) > 200)),
    ("BSD-style", "// Use of this source code is governed by a BSD-style license"), ("MIT-style", "# Use of this source code is governed by an MIT-style license that can be\n# found in the LICENSE file."),
]


def test_headers_of_every_family(docs, prose):
    """Near templates are told apart by the bigrams in which they differ, with comment signs and small changes, too."""
    words = prose(2, 60, seed=77)
    texts = [x for _, t in HEADS for x in (t, f"{words[0]}\n\n" + "\n".join(f" * {line}" for line in t.split("\n")) + f"\n{words[1]}")]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(texts)).collect()}
    for k, (name, _) in enumerate(HEADS):
        assert [got[2 * k].licences, got[2 * k + 1].licences] == [[name]] * 2, (name, got[2 * k].licences, got[2 * k].scores)


def test_windows_are_the_best_of_all(prose):
    scanner = license_scan.Scanner(TEMPLATES, 0.7)
    short = [t for _, t in TEMPLATES if len(t) < 130]
    for seed, text in enumerate(short):
        words = license_scan.normalise(f"{prose(1, 6, seed=seed)[0]} {text} extra {text[: len(text) * 2 // 3]} {short[seed - 1]} {prose(1, 3, seed=seed)[0]}")
        got = scanner.windows(words)
        every = [license_scan.dice(license_scan.bigrams(words[i:j]), license_scan.bigrams(license_scan.normalise(t))) for i in range(len(words)) for j in range(i + 2, len(words) + 1) for t in short]
        assert max(s for *_, s in got) == max(every) == 1.0
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_full_texts_as_templates(spark, docs, prose, tmp_path):
    full = prose(1, 400, seed=41, vocabulary=2000)[0]
    (tmp_path / "Own-1.0.txt").write_text(full)
    templates = [*TEMPLATES, *license_scan.read_templates(spark, str(tmp_path))]
    changed = full.split()
    changed[200:203] = ["other"]
    rows = license_scan.license_scan(docs([f"before {' '.join(changed)} after", "Released under the MIT License.", full[:900]]), templates=templates).collect()
    assert {r.doc_id: r.licences for r in rows} == {0: ["Own-1.0"], 1: ["MIT"], 2: []}


def toxic_rows(prose, n, seed):
    texts, toxic = prose(n, 40, seed=seed), []
    for i in range(n):
        toxic.append(int(i % 7 == 0))
        if toxic[-1]:
            texts[i] += [" you loser", " what TRASH!", " idioting"][i % 3]
    return texts, toxic


def test_toxicity_learns_and_holds_out(spark, docs, prose):
    texts, toxic = toxic_rows(prose, 600, 6)
    table = docs([*texts, *ODD, "loser"], ids=[*range(len(texts)), *range(1000, 1000 + len(ODD)), None])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(table, labels).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == table.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i in range(len(texts)) if got[i].held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    kept = toxicity.toxicity_filter(table, labels)
    assert kept.columns == table.columns
    assert kept.count() == sum(not r.predicted for r in rows)


def test_pairs_count_for_more_than_their_parts():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = (rng.random(2) < 0.5).tolist()
        rows.append(np.unique(np.array([1] * a + [2] * b + rng.integers(10, 40, 3).tolist(), np.uint32)))
        y.append(float(a and b))
    machine = toxicity.fit(rows, np.array(y), float(np.mean(y)))
    score = lambda *t: machine.score(np.array(t, np.uint32))
    assert score(1, 2) > 0.8 and score(1) < 0.2 and score(2) < 0.2


def test_pairs_count_though_their_parts_do_not():
    rng = np.random.default_rng(1)

    def made(n):
        rows, y = [], []
        for _ in range(n):
            a, b = (rng.random(2) < 0.5).tolist()
            rows.append(np.unique(np.array([1] * a + [2] * b + rng.integers(10, 70, 8).tolist(), np.uint32)))
            y.append(float(a != b))
        return rows, np.array(y)

    rows, y = made(1200)
    machine = toxicity.fit(rows, y, float(np.mean(y)))
    rows, y = made(400)
    assert np.mean([(machine.score(r) >= 0.5) == t for r, t in zip(rows, y, strict=True)]) >= 0.95


def matched_kinds(n, seed, kinds=4, each=3):
    """Insults and group mentions, rare among some fifty other words; an insult of a kind is toxic beside its own group only."""
    rng, docs, toxic = np.random.default_rng(seed), [], []
    for _ in range(n):
        terms = {int(x) for x in rng.zipf(1.3, 90) % 4000}
        insult, group = rng.integers(kinds, size=2)
        has = rng.choice(4, p=[0.35, 0.15, 0.35, 0.15])
        terms |= {10_000 + each * int(insult) + int(rng.integers(each))} if has in (1, 2) else set()
        terms |= {20_000 + each * int(group) + int(rng.integers(each))} if has in (2, 3) else set()
        docs.append(np.array(sorted(terms), np.uint32) * np.uint32(2654435761))
        toxic.append(float(has == 2 and insult == group))
    return docs, np.array(toxic)


def test_pairs_lift_held_out_scores():
    """Vectors tell what weights can't; without them the scores get worse. Where pairs tell nothing there are none."""
    docs, toxic = matched_kinds(5000, 1)
    assert 40 < np.mean([len(d) for d in docs]) and toxic.mean() < 0.15
    machine = toxicity.fit(docs, toxic, float(toxic.mean()))
    plain = toxicity.Machine(machine.bias, machine.w, machine.v * 0)
    held, truth = matched_kinds(1500, 2)
    with_pairs, without = (np.array([m.score(d) for d in held]) >= toxicity.THRESHOLD for m in (machine, plain))
    assert with_pairs[truth == 1].mean() > 0.9 and with_pairs[truth == 0].mean() < 0.01
    assert without[truth == 1].mean() < 0.2
    rng = np.random.default_rng(5)
    assert not toxicity.fit(docs, (rng.random(len(docs)) < 0.1).astype(float), 0.1).v.any()


def test_scores_are_those_of_the_pairwise_sum():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(-0.5, rng.normal(size=64).astype(np.float32), rng.normal(size=(64, 3)).astype(np.float32))
    for n in (0, 1, 2, 9, 40):
        terms = rng.integers(0, 2**32, n).astype(np.uint32)
        at = toxicity.bucket(terms, 64).tolist()
        assert all(0 <= i < 64 for i in at)
        z = -0.5 + sum(float(machine.w[i]) for i in at)
        z += sum(float(machine.v[i].astype(float) @ machine.v[j].astype(float)) for k, i in enumerate(at) for j in at[:k]) / max(1, n)
        assert machine.score(terms) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_toxicity_of_repeated_rows(spark, docs, prose):
    texts, toxic = toxic_rows(prose, 200, 8)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    once = {r.doc_id: r.score for r in toxicity.toxicity(docs(texts), labels).collect()}
    twice = toxicity.toxicity(docs(texts * 2, ids=[*range(200), *range(200)]), labels.unionByName(labels)).collect()
    assert len(twice) == 400 and all(r.score == once[r.doc_id] for r in twice)


@pytest.mark.parametrize(("labels", "want"), [([], 0.0), ([(0, 1, 0)], 0.0), ([(0, 1, 1)], 1.0)])
def test_toxicity_without_both_classes(spark, docs, labels, want):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert [round(r.score, 6) for r in toxicity.toxicity(docs(["some text", None]), table).collect()] == [want, want]
    assert toxicity.toxicity(docs(["x"]).filter("false"), table).count() == 0
