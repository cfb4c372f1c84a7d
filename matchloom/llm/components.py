"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the undirected edges (a, b); one root per component.

    In each round a node moves to the node of smallest hash within two steps and the
    graph is contracted along these moves. The image of a component under any such
    move stays connected, and with a new hash each round a constant share of the
    nodes disappears, so the number of rounds grows with the logarithm of the
    largest component. Minima are combined before they are shuffled, and the joins
    read checkpointed sides, whose hot nodes adaptive execution splits.
    """
    edges = durable(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while labels is None or not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.select(F.col("a").alias("node"), F.least(rank("a"), rank("b")).alias("m"))
        near = durable(near.groupBy("node").agg(F.min("m").alias("m")))
        two = both.join(near.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("m").alias("m"))
        moves = durable(two.select(F.col("a").alias("node"), F.col("m.id").alias("parent")))
        if labels is None:
            labels = moves.select("node", F.col("parent").alias("root"))
        else:
            labels = labels.join(moves.select(F.col("node").alias("root"), "parent"), "root", "left")
            labels = durable(labels.select("node", F.coalesce("parent", "root").alias("root")))
        a = durable(edges.join(moves.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").select("b", "pa"))
        b = a.join(moves.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b").filter("pa <> pb")
        edges = durable(b.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        turn += 1
    return labels
