"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges ``(a, b)`` with ``a > b``: neighbours are handed to each node's smallest one."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u").where(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_steps: int = 60) -> DataFrame:
    """``(node, root)`` for each node of an undirected edge table; ``root`` is the smallest node reachable.

    Each step is a grouping and a join that Spark deals out by node; each round is written to the shared
    folder, so neither lineage nor the driver grows. Self-loops give a node that is its own root; edges
    with a null end are left out; an empty table gives an empty result.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    last = None
    for _ in range(max_steps):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == last:
            break
        last, before, now = state, now, materialize(_star(_star(now, True), False))
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    rooted = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = rooted.unionByName(roots)
    alone = nodes.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.unionByName(alone)
