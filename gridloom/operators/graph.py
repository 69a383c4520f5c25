"""Dependency graphs of formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chains longer than this are not followed.
MAX_DEPTH = 64


def levels(nodes: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """node and level: 0 without needs, else one over the highest level needed; NULL for a
    chain of max_depth or more, in a cycle, or above one. edges: node, needs.

    Each round settles the nodes whose last needs the round before settled: their number of
    open needs is counted down by the edges to those, so a round reads the edges and the open
    nodes once, whatever has been settled before.
    """
    needs = _kept(_shuffled(edges, nodes.select(F.col("node").alias("needs")), "needs", "left_semi").select("node", "needs").distinct())
    open_ = needs.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    front = _kept(_shuffled(nodes.select("node"), open_, "node", "left_anti"))
    open_, found = _kept(open_), [front.withColumn("level", F.lit(0))]
    for level in range(1, max_depth):
        met = _shuffled(needs, front.withColumnRenamed("node", "needs"), "needs", "inner").groupBy("node").agg(F.count(F.lit(1)).alias("met"))
        now = _kept(_shuffled(open_, met, "node", "left").select("node", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")))
        front, open_ = now.where("n = 0").select("node"), now.where("n > 0")
        if front.isEmpty():
            break
        found.append(front.withColumn("level", F.lit(level)))
    return _shuffled(nodes, reduce(DataFrame.unionByName, found), "node", "left")


def _shuffled(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """A join that sends no side through the driver: fronts under the size of a broadcast add up over the rounds."""
    return left.hint("merge").join(right.hint("merge"), key, how)


def _kept(df: DataFrame) -> DataFrame:
    """df computed once, to a reliable checkpoint where the session has a folder for them."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.cache()
