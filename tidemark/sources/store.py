"""Tables that a session works out once and reads again: the chunk table, its postings, its tags."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to all tasks at most.
MOST_SENT = 200_000
#: Spark's setting by which a query's shuffle files are removed when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of this machine only where Spark runs in one process."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here leave no shuffle files, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def _stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes, files and times of what lies in a folder: another stamp, another input."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    said = []
    for entry in files.listStatus(path):
        size = files.getContentSummary(entry.getPath())
        said.append((entry.getPath().getName(), size.getLength(), size.getFileCount(), entry.getModificationTime()))
    return tuple(sorted(said))


def stored_folder(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str, str], object]) -> str:
    """The folder that make(spark, sf_dir, folder) filled, at the first call of the session for that input as it is now."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir), name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
        make(spark, sf_dir, path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """make's table as Parquet in the shared folder, written at the first call of the session for that input as it is now."""

    def write(s: SparkSession, d: str, path: str) -> None:
        rows = make(s, d)
        with shuffles_go(s):
            rows.select("*").write.option("compression", "zstd").parquet(path)

    return spark.read.parquet(stored_folder(spark, sf_dir, name, write))


def stored_by(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str, int], DataFrame], key: str, parts: int) -> DataFrame:
    """As `stored`, in so many buckets by key: rows of a key lie in one task when they are read, without a shuffle.

    make(spark, sf_dir, parts) deals its rows by `repartition(parts, key)`, so that a task writes one file.
    """

    def table(path: str) -> str:
        return path.removesuffix(f"/{name}").rpartition("/")[2].replace("-", "_") + f"_{name}"

    def write(s: SparkSession, d: str, path: str) -> None:
        rows = make(s, d, parts)
        with shuffles_go(s):
            rows.select("*").write.option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(table(path))

    return spark.table(table(stored_folder(spark, sf_dir, name, write)))


def sent(rows: DataFrame) -> DataFrame:
    """rows of a query set or of its candidates (a table that is cut), sent to all tasks up to a proven bound only."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def laid_down(df: DataFrame) -> DataFrame:
    """As `cut`, for many small rows (pairs of queries and documents): a compressed file, a tenth of a checkpoint's size."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}/rows"
    with shuffles_go(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: what later steps use several times is worked out once, and survives lost executors. Its shuffles go at once."""
    shared_folder(df.sparkSession)
    with shuffles_go(df.sparkSession):
        return df.select("*").checkpoint()
