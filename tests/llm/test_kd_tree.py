"""The k-d partition against a recursive one on one machine."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillet.llm import kd_sharding

DIMS = kd_sharding.DIMENSIONS
UNIT = "_text long, size long, _sub int, weight long, " + ", ".join(f"{d} long" for d in DIMS)


def brute(units, shards):
    """``{unit: shard}`` by sorting each node whole; ``units``: (unit, tie, weight, coordinates)."""
    extent = [max(u[3][i] for u in units) - min(u[3][i] for u in units) for i in range(len(DIMS))]
    out = {}

    def place(rows, n, first):
        if n == 1 or not rows:
            out.update({u[0]: first for u in rows})
            return
        wide = [(max(u[3][i] for u in rows) - min(u[3][i] for u in rows)) / extent[i] if extent[i] else 0.0 for i in range(len(DIMS))]
        axis = wide.index(max(wide))
        keyed = sorted(((u[3][axis], u[1]), u) for u in rows)
        goal, upto, left = sum(u[2] for u in rows) * (n // 2) // n, 0, []
        for key in sorted({k for k, _ in keyed}):
            here = [u for k, u in keyed if k == key]
            weight = sum(u[2] for u in here)
            if upto + weight >= goal:
                if upto + weight - goal <= goal - upto:
                    left += here
                break
            upto, left = upto + weight, left + here
        right = [u for u in rows if u not in left]
        place(left, n // 2, first)
        place(right, n - n // 2, first + n // 2)

    place(units, shards, 0)
    return out


@pytest.mark.parametrize(("shards", "spread"), [(16, 2**31 - 2), (7, 3), (5, 0)])
def test_leaves_are_those_of_a_recursive_tree(spark, shards, spread):
    rng = random.Random(shards)
    rows = [(i, rng.choice([9, 9, 400]), 0, rng.randint(1, 900), *[rng.randint(0, spread) for _ in DIMS]) for i in range(300)]
    table = spark.createDataFrame(rows, UNIT).repartition(5)
    tie = F.shiftrightunsigned(F.xxhash64("_text", "size", "_sub"), 33)
    units = [(r["_text"], r["tie"], r["weight"], [r[d] for d in DIMS]) for r in table.withColumn("tie", tie).collect()]
    got = {r["_text"]: r["shard"] for r in kd_sharding.assign_leaves(table, shards).collect()}
    assert got == brute(units, shards)
    assert len(set(got.values())) == shards


def test_equal_texts_stay_together_up_to_a_whole_shard(docs):
    texts = [f"text {i} " * 30 for i in range(200)] + ["copy of one text " * 20] * 6 + ["hot text " * 30] * 100
    rows = kd_sharding.kd_shards(docs(texts), shards=8).collect()
    size, shards = sum(r["size"] for r in rows) / 8, {}
    for r in rows:
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(rows) == len(texts)
    for text, where in shards.items():
        if texts.count(text) * (len(text) + 1) <= size:
            assert len(where) == 1
    assert len(shards[texts[-1]]) > 1  # more than a shard holds
