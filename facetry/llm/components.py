"""Connected components by alternating large-star and small-star steps; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each child has one parent, and no parent is a child."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("node").agg(F.sum("child").alias("n"), F.max("parent").alias("p")).where("n > 1 or n + p > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b), long; root is the smallest node that can be reached.

    Self-loops, repeated and reversed edges are harmless; no edges give no rows and take no round.  Large-star joins each
    edge with the smallest neighbour of its end, a join whose large side is an ordinary skewed shuffle join (split by
    adaptive execution), so a node with very many edges does not become one task's group.  Rounds end when all edges are
    stars, which takes a logarithm of the longest chain."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(e):
        # large-star: the larger neighbours of u are linked to the smallest of u and its neighbours
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small-star: the smaller neighbours of u and u itself are linked to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large["a"] == low["u"]).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = written(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
