"""Connected components of an undirected graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns ``a``, ``b``): root is the least node it is connected with.

    Alternates the large-star and small-star steps until only stars are left; each
    keeps the number of edges and halves depth, so rounds grow with the
    logarithm of the longest path.  What meets at a hub is a minimum, combined
    before it is shuffled, and a join of written tables, which adaptive execution can split.
    """
    spark = edges.sparkSession
    edges = keep(edges.filter("a is not null and b is not null and a != b").select("a", "b").distinct(), "cc-edges")
    while not _settled(edges):
        before = edges
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = keep(_star(both).filter("a > u").select(F.col("a"), F.col("m").alias("b")).filter("a != b").distinct(), "cc-edges")
        larger = edges
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        joined = _star(down)
        small = joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = keep(small.filter("a != b").distinct(), "cc-edges")
        discard(spark, before, larger)
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return down.union(down.select("root", "root").distinct())


def _star(edges: DataFrame) -> DataFrame:
    """(u, a, m) for each edge u-a: m is the least of u and its neighbours."""
    # Written first: over two plain exchanges a hub's edges can be split among tasks.
    least = keep(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    return edges.select(F.col("a").alias("of"), F.col("b").alias("a")).join(least, F.col("of") == F.col("u")).select("u", "a", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node that has no other to one that leads nowhere."""
    ends = edges.select(F.greatest("a", "b").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select(F.least("a", "b"), F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.filter((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0)).isEmpty()
