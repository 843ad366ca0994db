"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokenloom.session import stage_table


def connected(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) of every node with an edge; the label is the component's smallest node.

    `edges` has a and b. Large and small star steps alternate until no edge moves; each round is
    written to the shared folder. Hubs combine partially, their joins are left to skew handling.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stage_table(both, "edges")
    before = None
    for _ in range(max_rounds):
        current = stage_table(_small_star(_large_star(current)), "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            # A star for each component: (node, smallest node).
            found = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return found.unionByName(found.select(F.col("label").alias("node"), "label").distinct())
        before = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the least of the node and its neighbours."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    larger = near.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, point to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()
