"""Connected components of a graph given as edges, by alternating star contractions.

Every round points the larger neighbours of a node at its smallest neighbour, then every node
at the smallest of what it points at (large star, small star). The edges never become more, a
long path shrinks by a constant factor per round, and the loop ends when a round changes
nothing, at which point every node points at the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour per node. Stored, so that the join with it shuffles anew and the engine
    can split the edges of a node that many others point at."""
    return stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(_least(both), "u").withColumn("m", F.least("u", "m"))
    return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # here u > v on every edge
    near = edges.join(_least(edges), "u")
    moved = near.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges, u != v, of any orderable type -> (node, root) for every node that has an
    edge; root is the smallest node of the component."""
    oriented = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = stored(oriented, "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark or not state["n"]:
            break
        mark = state
        now = stored(_small_star(_large_star(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
