"""Connected components of a graph given as a table of links.

Large-star and small-star steps (Kiveris et al., 2014) alternate until the links no longer change;
then each node points to the smallest node of its component. Each step's table is checkpointed in the
cluster's shared folder, which cuts the lineage and survives lost executors. A node with very many
links is not a problem: the minima are pre-aggregated, and the joins are between written tables, of
which Spark splits a frequent key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import sizeless


def _point_to(links: DataFrame) -> DataFrame:
    """Links (a, b) with, as m, the smallest of a and all its b."""
    least = sizeless(links.groupBy("a").agg(F.min("b").alias("low")))
    return links.join(least, "a").withColumn("m", F.least("a", "low"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have links, root being the smallest node of the component.

    links: columns a and b of one orderable type, in any direction; loops and repeated rows don't matter.
    """
    now = sizeless(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s"), F.sum(F.xxhash64("b", "a") % 999_983).alias("t")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = sizeless(now.union(now.select("b", "a")))
        large = _point_to(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = sizeless(large.where("a <> b").distinct())
        small = _point_to(large)
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = sizeless(small.where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
