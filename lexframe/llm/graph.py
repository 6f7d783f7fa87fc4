"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexframe.llm.base import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node but the smallest of its component, with that smallest node. `edges` has
    long columns a and b; loops and repeats are fine. A hub's neighbours meet its minimum in a
    join, which adaptive execution splits, and never in one group. Rounds end when nothing changes;
    what a round wrote is summed up while it is written."""
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    edges = edges.where("a <> b").select(high, low).distinct()
    mark = None
    while True:
        seen = Observation()
        edges = cut_lineage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")), "edges")
        now = seen.get
        if now == mark or not now.get("n"):
            return edges
        mark = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(nearest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()
