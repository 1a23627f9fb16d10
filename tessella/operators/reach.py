"""What snapshots reach: closure over a directed acyclic graph of trees.

One round for each level: the frontier is joined with the edges, and what was visited before is taken off, so shared subtrees are walked once. Every
round's frontier is a table in the shared folder (``spark.checkpoint.dir``), which cuts the lineage and survives lost executors. Depth
is bounded: more than 256 levels, or a cycle of new nodes, is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

MAX_DEPTH = 256


class TooDeep(RuntimeError):
    pass


def reachable(roots: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH, keep=None) -> DataFrame:
    """(node, depth) from ``roots`` (node) over ``edges`` (parent, child); the depth is the shortest.

    ``keep``: a function of the frontier that prunes it, so that what lies below is never read.
    """
    steps = edges.select("parent", "child").where("parent <> child").distinct()
    frontier = written(roots.select("node").distinct().select("node", F.lit(0).alias("depth")), "reach")
    visited, depth = frontier, 0
    while True:
        below = frontier.join(steps, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        below = below.join(visited.select("node"), "node", "left_anti").select("node", F.lit(depth + 1).alias("depth"))
        frontier = written(keep(below) if keep else below, "reach")
        if frontier.isEmpty():
            return visited
        depth += 1
        if depth > max_depth:
            raise TooDeep(f"more than {max_depth} levels")
        visited = visited.unionByName(frontier)


def unreachable(nodes: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node").join(reachable(roots, edges).select("node"), "node", "left_anti")


def walk(snapshots: DataFrame, tree_entries: DataFrame, max_depth: int = MAX_DEPTH):
    """(live trees, referenced chunks, missing trees) of all snapshots' roots."""
    roots = snapshots.select(F.explode("roots").alias("r")).select(F.col("r.tree").alias("node")).distinct()
    edges = tree_entries.where(F.col("subtree").isNotNull()).select(F.col("tree").alias("parent"), F.col("subtree").alias("child"))
    live = reachable(roots, edges, max_depth)
    known = tree_entries.select(F.col("tree").alias("node")).distinct()
    chunks = tree_entries.join(live, F.col("tree") == F.col("node"), "left_semi").select(F.explode("chunks").alias("chunk")).distinct()
    return live, chunks, live.join(known, "node", "left_anti").select("node")
