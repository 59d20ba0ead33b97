"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import session
from quarry.llm import common


def connected_components(edges: DataFrame) -> DataFrame:
    """``u, v`` (long) edges to ``node, component`` rows, the component being its
    smallest node; nodes without an edge to another node are not listed.

    Each round hangs every node's larger neighbours on its smallest neighbour
    (large star), then its smaller ones (small star), until every node hangs on
    one root. Both steps are a partially aggregated minimum and a join, so no
    node's neighbours are gathered in one task. Rounds grow with the logarithm
    of the longest path; each is written once to the checkpoint folder.
    """
    tree = common.staged(edges.where("u <> v")
                         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                         .distinct())
    while True:
        both = tree.union(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v")).distinct()
        large = common.staged(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"),
                                                           F.col("m").alias("v"))
        step = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # a node hanging on two nodes, or on a node that hangs itself, needs another round
        step = common.staged(step)
        hung = step.groupBy("u").agg(F.count("*").alias("n"))
        loose, _ = session.cut_lineage_counting(
            hung.where("n > 1").select("u").union(
                step.select(F.col("v").alias("u")).join(hung, "u", "left_semi")), F.lit(True))
        done = loose.isEmpty()
        common.drop_staged(loose)
        common.drop_staged(large)
        common.drop_staged(tree)
        tree = step
        if done:
            return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
