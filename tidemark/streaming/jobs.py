"""Structured Streaming versions of the job-state operators.

Streams read event files as they arrive. State and results are tables in the shared folder; a batch
of a stream gives the keys that it touched with their new values, which replace the rows of these keys in
their parts of the result, so that a repeated batch changes nothing and the other parts stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.sources.store import cut, shared_folder

#: Parts that a result is cut into by a hash of its key.
PARTS = 16


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 8) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern the path may name one file or a folder of them.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")


def merge(batch: DataFrame, path: str, key: list[str]) -> None:
    """Puts the batch's rows in place of those with the same key; only the parts that it touches are written."""
    spark = batch.sparkSession
    new = cut(batch.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int")))
    spark.createDataFrame([], new.schema).write.mode("ignore").partitionBy("part").parquet(path)
    old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(new.select("part").distinct()), "part", "left_semi")
    kept = cut(old.join(new.select(*key), key, "left_anti").select(*new.columns))
    kept.unionByName(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def run(stream: DataFrame, key: list[str], folder: str) -> DataFrame:
    """All that is there now, through the stream in update mode, merged by key."""
    keep = lambda batch, number: merge(batch, f"{folder}/result", key)
    query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("part", IntegerType())])).parquet(f"{folder}/result").drop("part")


def latest_by_user(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """user_id, last_ts, n_events and failures: a job's heartbeat state."""
    state = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return run(state, ["user_id"], folder or _folder(spark))


def windowed_counts(spark: SparkSession, sf_dir: str, folder: str | None = None, files_per_batch: int = 8) -> DataFrame:
    """window_start, event_type, n and total by six hours; events more than a day behind the newest of the batches up to the last but one are left out."""
    rows = events(spark, sf_dir, files_per_batch).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    by = rows.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return run(by.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total"), ["window_start", "event_type"], folder or _folder(spark))
