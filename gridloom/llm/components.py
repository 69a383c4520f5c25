"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (partially aggregated) and a join that deals a
node's edges over parts, so the edges of a hub of any degree meet no single
task. Each step's edges go to a stage table, and the step before's are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_stage, spread_join, stage_table


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges u - v."""
    now = stage_table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        around = _both_ways(now)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(around.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", "v").select(F.col("v").alias("a"), "m", "u")
        small = small.select(F.col("a").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        before, now = now, stage_table(small.where("u != v").distinct(), "edges")
        drop_stage(before)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
