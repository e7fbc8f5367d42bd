"""Publishing as snapshots: rows in buckets by their document's hash, a manifest for each version, a pointer that moves last.

    rows/FOLDER/bucket=B/   the files of one publication: whole buckets, each with all rows of its documents
    manifests/FOLDER/       which folder holds each bucket's rows in that version
    pointers/               a row per move of the pointer; the last one names the current version

A publication rewrites only the buckets that its documents lie in, into a folder of its own, reads it back, and compares it
with what should be there. Only then the manifest is written and the pointer moves; until that, and if the check fails, readers see the
version before, whose files are never touched. Going back is one more move of the pointer. Replacing a document leaves the others alone.

The number of buckets is fixed by the first publication: some hundred megabytes to a bucket, so that one document's
replacement rewrites little. Manifests and pointers have a row per bucket and per move. One writer at a time: a pointer
that moved meanwhile stops the publication, before its own moves.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.registry import verify_published

BUCKETS = 64
MANIFEST = "bucket int, folder string, key string, buckets int"
POINTERS = "move bigint, version bigint, folder string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table there, an empty one if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def history(spark: SparkSession, path: str) -> DataFrame:
    """move, version and folder of all moves of the pointer."""
    return _table(spark, f"{path}/pointers", POINTERS)


def _current(spark: SparkSession, path: str, version: int | None = None):
    """The last move, or the first that made that version; None if there is none."""
    moves = history(spark, path)
    if version is None:
        return moves.orderBy(F.desc("move")).first()
    found = moves.where(F.col("version") == version).orderBy("move").first()
    if found is None:
        raise ValueError(f"there is no version {version}")
    return found


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """bucket, folder, key and buckets of a version, by default the current one."""
    at = _current(spark, path, version)
    return _table(spark, f"{path}/manifests/{at['folder']}" if at else f"{path}/manifests/none", MANIFEST)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, parts: list, schema) -> DataFrame:
    """The rows of some of a manifest's rows: only their buckets' files are listed and read."""
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/rows/{p['folder']}/bucket={p['bucket']}" for p in parts))


def read(spark: SparkSession, path: str, schema, version: int | None = None, keys: list | None = None) -> DataFrame:
    """The rows of a version, by default the current one; of the documents in `keys` only, if given, from their buckets alone."""
    live = manifest(spark, path, version)
    parts = live.collect()
    if keys is None or not parts:
        return _rows(spark, path, parts, schema)
    key, buckets = parts[0]["key"], parts[0]["buckets"]
    asked = spark.createDataFrame([(str(k),) for k in keys], f"`{key}` string").select(_bucket(key, buckets).alias("b")).distinct()
    wanted = {r["b"] for r in asked.collect()}
    return _rows(spark, path, [p for p in parts if p["bucket"] in wanted], schema).where(F.col(key).cast("string").isin([str(k) for k in keys]))


def _move(spark: SparkSession, path: str, before, version: int, folder: str) -> None:
    if _current(spark, path) != before:
        raise RuntimeError("another publication moved the pointer meanwhile")
    move = before["move"] + 1 if before else 1
    spark.createDataFrame([(move, version, folder)], POINTERS).coalesce(1).write.mode("append").parquet(f"{path}/pointers")


def publish(new: DataFrame, path: str, key: str = "doc_id", gone: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Replaces the rows of the documents (key) in `new`, and takes out those of the keys in `gone`; returns the version that this makes.

    new: the key, content_sha, tags, and any others, the same each time. A row that is missing or too many by content_sha when read back stops the job, and the current version stays.
    """
    spark = new.sparkSession
    before = _current(spark, path)
    old = manifest(spark, path).collect()
    buckets = old[0]["buckets"] if old else buckets
    said = F.col(key).cast("string").alias("_key")
    changed = new.select(said) if gone is None else new.select(said).union(gone.select(said))
    changed = changed.distinct()
    touched = {r["b"] for r in changed.select(F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()}
    stay = _rows(spark, path, [p for p in old if p["bucket"] in touched], new.schema)
    stay = stay.join(changed, stay[key].cast("string").eqNullSafe(changed["_key"]), "left_anti")
    whole = stay.unionByName(new)
    folder = uuid.uuid4().hex
    dealt = whole.withColumn("bucket", _bucket(key, buckets)).repartition("bucket", F.pmod(F.xxhash64("content_sha"), F.lit(4)))
    dealt.write.partitionBy("bucket").parquet(f"{path}/rows/{folder}")
    back = spark.read.schema(new.schema).parquet(f"{path}/rows/{folder}")
    found = verify_published(whole, back).first()
    if found["missing"] or found["unexpected"]:
        raise ValueError(f"{found['missing']} rows are missing and {found['unexpected']} too many")
    written = {r["b"] for r in whole.select(_bucket(key, buckets).alias("b")).distinct().collect()}
    live = [(p["bucket"], p["folder"], key, buckets) for p in old if p["bucket"] not in touched] + [(b, folder, key, buckets) for b in sorted(written)]
    spark.createDataFrame(live, MANIFEST).coalesce(1).write.parquet(f"{path}/manifests/{folder}")
    version = (history(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    _move(spark, path, before, version, folder)
    return version


def go_back(spark: SparkSession, path: str, version: int) -> None:
    """Makes an earlier version the current one."""
    _move(spark, path, _current(spark, path), version, _current(spark, path, version)["folder"])
