"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two group minima and two equi-joins on node keys: no node's neighbours are gathered in a
task, and each step's edges are written to the shared checkpoint folder.  A step's first group minimum
also tells whether the edges are stars already, so that no step is made only to see that nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, settle


def _nodes(edges: DataFrame) -> DataFrame:
    """node -> m, the least of itself and its neighbours, and whether an edge of it is in the way of a star.

    Edges (u, v), u > v, each of them once, are stars around their least nodes if no node has two smaller
    neighbours, or a smaller and a larger one.
    """
    ends = edges.select("u", "v", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", "u", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.min("v").alias("m"), F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.select(dealt_anew("u").alias("n"), F.least("u", "m").alias("m"), ((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0)).alias("moves"))


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """edges (u, v) of any orderable type -> (node, component), component the least node reachable.

    Nodes without an edge to another node aren't listed.  Self-loops, repeated and reversed edges and
    an empty table are fine; edges with a null end are ignored.  Raises RuntimeError, rather than
    returning a partial result, should max_steps not be enough (steps grow with the logarithm of the
    longest path).
    """
    e = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    for _ in range(max_steps):
        nodes = settle(_nodes(e))
        if nodes.where("moves").isEmpty():
            return nodes.select(F.col("n").alias("node"), F.col("m").alias("component"))
        # large star: every larger neighbour of a node is linked with the node's least neighbour
        large = e.join(nodes.select("n", "m"), F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))
        # small star: every smaller neighbour of a node, and the node, are linked with the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u").alias("n"), "m")
        small = large.join(low, F.col("u") == F.col("n")).select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        e = settle(small.where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {max_steps} steps")
