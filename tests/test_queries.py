"""Every query with SQL against another engine, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillet.plans.oracle import ORACLE_SQL
from quillet.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, other, name):
    ours = QUERIES[name](spark, SF)
    theirs = other.execute(ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    a, b = plain([tuple(r) for r in ours.collect()], ours.columns), plain(theirs.fetchall(), names)
    assert a == b
    assert a


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_merging_is_exercised(spark):
    ranges, merged = QUERIES["heuristic_ranges"](spark, SF).count(), QUERIES["merge_ranges"](spark, SF).count()
    assert ranges > merged > 0
