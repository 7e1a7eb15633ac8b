"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_table, materialize


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's least neighbour (or itself)."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    # Written, so that both sides of the join are shuffled for it alone and Spark can split a node with very many neighbours.
    least = materialize(least, "least")
    return both.where("b > a").join(least.hint("merge"), F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them. a < b holds in each row."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
    found = edges.join(least.hint("merge"), F.col("b") == F.col("n"))
    return found.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionAll(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges a, b (long): root is the least node that can be reached; roots themselves are left out.

    Loops, repeated edges and edges in either direction are fine. Both stars combine before they shuffle by minimum, and
    each round's edges are written to the shared folder, so a lost executor costs one round. The number of rounds grows
    as the logarithm of the longest path. A null end is no edge. No join broadcasts, whatever the session's threshold is,
    so the driver holds no table of nodes.
    """
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, seen = materialize(now, "edges"), None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (sums.n, sums.h) == seen or not sums.n:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = sums.n, sums.h
        before, now = now, materialize(_small(_large(now)), "edges")
        drop_table(before)
