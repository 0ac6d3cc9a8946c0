"""Connected components of a links table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.runtime import materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in ``links`` (a, b).

    Alternating stars: each node first hands the smallest node it knows to its
    larger neighbours, then to its smaller ones, until every node points at the
    smallest of its component. Each round is a written table. Null ends and
    loops are ignored; an empty table gives an empty one.
    """
    edges = materialize(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) after further ``links`` (a, b), a written table: only the components that these join are searched again."""
    if links.isEmpty():
        return found
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    named = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    named = materialize(named.select("a", "b", F.coalesce("c_a", "a").alias("u"), F.coalesce("c_b", "b").alias("v")), "named-links")
    over = components(named.select(F.col("u").alias("a"), F.col("v").alias("b"))).toDF("component", "least")
    ends = [named.select(F.col(node).alias("node"), F.col(c).alias("component")) for node, c in (("a", "u"), ("b", "v"))]
    nodes = found.unionByName(ends[0]).unionByName(ends[1]).distinct()
    return materialize(nodes.join(over, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "components")
