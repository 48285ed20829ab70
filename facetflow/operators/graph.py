"""Connected components of an edge table, by alternating star contractions.

A large star links every neighbour above a node with the least node around it, a small star does the
same for the neighbours below.  Both shorten paths, so a few rounds make every component a star around
its least node.  Rounds are cut by tables in a shared folder, not by the driver: it sees one answer a
round.  The minimum of a hub is pre-aggregated, and joins against it may be split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.operators.tables import discard

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    moved = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("k"))
    return moved.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # edges point from the larger node to the smaller one
    least = edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("k"))
    down = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(moved.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether all edges lead from a node with no other edge to the least node of its component."""
    ends = edges.select(F.col("a").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    sums = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    edges: columns a and b of one orderable type, either way round, self-loops ignored.  store(df, label)
    writes a table and reads it again.
    """
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current = store(current, "edges")
    for _ in range(MOST_ROUNDS):
        if _is_settled(current):
            break
        last, current = current, store(_small_star(_large_star(current)), "edges")
        discard(last)
    else:
        raise RuntimeError(f"not settled after {MOST_ROUNDS} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
