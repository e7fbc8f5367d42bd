"""Places of rows in an order within groups, where a group can have more rows than a task should read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import written


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with `place` (from 0) in their group's order and `total`, the group's rows.

    The rows are dealt out by ranges of (group, order), sorted there and written in the shared folder, so
    that a group with very many rows lies in many tasks and a row keeps its task when a part is worked out
    again. A window adds up only the counts by group and task. A null group is one of its own. Rows that
    are equal in group and order stand in any order. Columns that begin with an underscore are the operator's.
    """
    dealt = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    kept = written(dealt.withColumn("_row", F.monotonically_increasing_id()))
    task = F.shiftright("_row", 33)  # of Spark's id these bits number the task, the others its rows
    parts = kept.groupBy(F.col(group).alias("_group"), task.alias("_task")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    every = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(every.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_group", "_task", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(every).alias("total"))
    out = kept.join(written(starts), F.col(group).eqNullSafe(F.col("_group")) & (task == F.col("_task")))
    return out.withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_group", "_task", "_shift")
