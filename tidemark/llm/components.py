"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Contractions keep at most three quarters of the nodes on average, so 200 rounds are out of reach of any input.
MAX_ROUNDS = 200


def _priority(node: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(salt)).alias("p"), node.alias("x"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edge table (a, b); root is a member of the node's component.

    Each round every node moves to the member of its closed neighbourhood with the least random priority, and edges
    are rewritten to the new nodes. Minima are combined before the shuffle, so a node with many neighbours costs no
    more than others; every round is written to the shared folder. Self-loops are allowed, an empty table gives none.
    """
    left = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("root", F.col("node"))
    left = left.where("a <> b")
    for salt in range(MAX_ROUNDS):
        if left.isEmpty():
            return nodes
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_priority(F.col("b"), salt)).alias("near"))
        step = staged(best.select("a", F.least(F.col("near"), _priority(F.col("a"), salt))["x"].alias("to")), "contraction")
        nodes = staged(
            nodes.join(step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
        )
        moved = left.join(step, "a").select(F.col("to").alias("a"), "b").join(step.select(F.col("a").alias("b"), F.col("to").alias("t")), "b")
        left = staged(moved.where("a <> t").select(F.least("a", "t").alias("a"), F.greatest("a", "t").alias("b")).distinct(), "edges")
    raise RuntimeError("contraction did not finish")
