from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillet.operators.report import two_decimals


def same(spark, numbers):
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", two_decimals(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.x:.2f}" for r in rows]


def test_two_decimals_are_those_of_the_exact_value(spark):
    grid = [c / 1000 for c in range(1001)] + [c / 200 for c in range(201)] + [c / 1024 for c in range(1025)]
    near = [m + d for m in (0.005, 0.125, 0.375, 0.995, 0.285) for d in (-1e-15, 1e-17, 5e-17, 1e-16, 1e-12)]
    same(spark, [*grid, *near, 5e-324, 1e-20, 0.0, 1.0])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=50, max_size=200))
def test_two_decimals_of_any_number(spark, numbers):
    same(spark, numbers)
