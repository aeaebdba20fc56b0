"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(pairs: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Link the kept neighbours v of each u to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    linked = pairs.where(keep).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked, least


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node without any other edge."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b), both longs; root is the least node reachable.

    The minima are partial aggregates, and the joins are plain equi-joins that
    adaptive execution can split, so a node with very many neighbours needs no
    task of its own. Loops and repeated edges are allowed. Each round is a table
    of scratch; the one before is deleted.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    name = f"edges{scratch.made}-"
    edges = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    n = 0
    while not _stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large, _ = _star(both, F.col("v") > F.col("u"))
        large = large.where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small, least = _star(down, F.lit(True))
        edges = scratch.table(small.union(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), f"{name}{n + 1}")
        scratch.drop(f"{name}{n}")
        n += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
