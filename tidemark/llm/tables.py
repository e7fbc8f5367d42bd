"""What the operators share: reading tables, Arrow batches of bounded size, tokenizer files."""

from __future__ import annotations

import gc
import json
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files are removed when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text that one Arrow output batch stands for, in characters.
BATCH_CHARS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one; other columns don't matter, whatever their names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def by_size(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with some BATCH_CHARS of text each (one row at least), and that column's values."""
    for batch in batches:
        sizes = [x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > BATCH_CHARS:
                part = batch.slice(start, i - start)
                yield part, part.column(column).to_pylist()
                start, total = i, 0
            total += n
        if start < len(sizes):
            part = batch.slice(start)
            yield part, part.column(column).to_pylist()


def special_tokens(tokenizer_json: str) -> dict[str, int]:
    """The special strings that the tokenizer of that file finds in texts, longest first."""
    with open(tokenizer_json, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    return {x["content"]: x["id"] for x in sorted(added, key=lambda x: -len(x["content"]))}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints and tables in between; a folder of this machine only where Spark runs in one process."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; the shuffles that it took go with its last task, not when the driver happens to collect its garbage."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        return df.select("*").checkpoint()  # a plan takes the setting where it is made
    finally:
        conf.set(SHUFFLES_GO, before)


def sizeless(df: DataFrame) -> DataFrame:
    """A checkpoint that forgets how large Spark takes it to be, for steps that are repeated.

    A checkpoint keeps its plan's estimate, a join's is the product of both sides', and it has no bound: where each round joins
    the last one's tables its digits double, until they fill the driver.
    """
    done, spark = written(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)


def release(spark: SparkSession) -> None:
    """Have the driver look for shuffles that no table refers to any more, so that their files go before the next large shuffle.

    Python's frames go first, since they hold the JVM's.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c % 2) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda a, b: {bits}), 4294967295)"
