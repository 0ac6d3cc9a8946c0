from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table of given texts, with columns whose names operators use themselves."""

    def make(texts, ids=None, sources=None, partitions=3):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", sources[k] if sources else f"s{k % 3}", None if t is None else len(t), "x", 1.5, True) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, DOCS + ", host string, length double, kept boolean").repartition(partitions)

    return make


@pytest.fixture
def prose():
    """Texts of invented words, deterministic."""

    def make(n, words, seed=0, vocabulary=400):
        rng = random.Random(seed)
        known = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
        return [" ".join(rng.choice(known) for _ in range(words)) for _ in range(n)]

    return make


ODD = [None, "", " \n\t ", "a", "A a a.\na", "é  ß x\x1c!", "x" * 5000, "same text here\nsame text here\nsame text here"]
