"""Fusion of arms: reciprocal ranks, unions by best score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import RRF_K


def rrf(arms: DataFrame, key: str) -> DataFrame:
    """query_id, key, rrf, best_rank and arm of arms (query_id, key, arm, arm_order, rank, weight).

    rrf adds weight / (60 + rank) over the arms; arm is the first in arm order, whose fields are kept.
    """
    return arms.groupBy("query_id", key).agg(
        F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("rrf"),
        F.min("rank").alias("best_rank"),
        F.min_by("arm", "arm_order").alias("arm"),
        F.count(F.lit(1)).alias("n_arms"),
    )


def union_best(rows: DataFrame, key: list[str], score: str, most: int | None = None) -> DataFrame:
    """For each key (query_id first) the row with the best score, and of these the best `most` per query."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(score, *(c for c in rest if c != score))).alias("b")).select(*key, "b.*")
    if most is None:
        return best
    order = Window.partitionBy(key[0]).orderBy(F.desc(score), *key[1:])
    return best.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= most)
