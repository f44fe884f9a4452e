"""Graph operators: connected components and breadth-first expansion over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.shared import cut, discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges``; the component is its smallest node.

    Alternating large-star and small-star contraction: O(log^2) rounds whatever the diameter, every round one
    aggregation and join on a node. Minima are pre-aggregated and joined back rather than gathered, so a node with a
    third of all links is split like any skewed join. Self-loops yield their node as its own component; null
    endpoints are ignored; an empty table gives an empty result.
    """
    raw = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    given = cut(raw.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    loops = cut(given.where("u = v").select(F.col("u").alias("node")), "loops")
    held, e = given, given.where("u <> v")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(held)
        held = e
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).union(loops).distinct().join(e.select(F.col("u").alias("node")), "node", "left_anti")
    return found.unionByName(roots.select("node", F.col("node").alias("component")))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, level)`` of every node reached from ``seeds`` (first column) within ``depth`` directed steps.

    Each level is one join of the frontier with the edges and one anti-join with what was reached; seeds are level 0.
    """
    reached = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct().select("node", F.lit(0).alias("level")), "bfs")
    frontier = reached
    pairs = edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).where("to is not null")
    for level in range(1, depth + 1):
        new = frontier.join(pairs, "node").select(F.col("to").alias("node")).distinct().join(reached, "node", "left_anti")
        frontier = cut(new.select("node", F.lit(level).alias("level")), "bfs")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached
