"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def stars(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of every node but the roots themselves: root is the
    smallest node of the component; nodes are the ends of ``edges`` (a, b),
    which are read several times and may repeat.  Every node is first tied to
    its smallest neighbour's side (large star, then small star); edges never
    multiply, a hub only ever keeps one outgoing edge, and rounds grow with the
    logarithm of the longest path.  Each round is written to the shared folder."""
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(limit):
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        big = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("k")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours go to the smallest
        low2 = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = big.join(low2, F.col("u") == F.col("k"))
        own = F.struct("u", F.col("m").alias("v"))
        nxt = small.select(F.inline(F.when(F.col("v") == F.col("m"), F.array(own)).otherwise(
            F.array(own, F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))).distinct()
        e = cut(nxt, "edges")
        # settled when every node points to one root and no root points on
        ends = e.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                         F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        again = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if again.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges``, roots included (``stars``)."""
    e = stars(edges, limit)
    return e.union(e.select("root", "root").distinct())
