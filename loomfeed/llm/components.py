"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), both ways for large, towards the smaller for small: link v to the least node about u."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its least node) of every node of edges (u, v); null ends are left out.

    Each round hangs nodes on smaller ones, so a chain of n nodes takes about log n rounds; all tables are as long as the edges.
    It ends when every node hangs on one that hangs on nothing: then the edges are stars.
    """
    edges = stage_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        # Stars: no node has two parents, and no parent has one.
        parents = edges.groupBy("u").agg(F.count("*").alias("parents"))
        ends = edges.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("parents")).distinct()
        state = parents.union(ends).groupBy("u").agg(F.sum("parents").alias("parents"), F.count("*").alias("roles"))
        if not state.where("parents > 1 or roles > 1").limit(1).count():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stage_table(_star(both, large=True), "edges")
        edges = stage_table(_star(edges, large=False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return stage_table(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct(), "components")
