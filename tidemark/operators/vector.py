"""Vector arm: exact cosine of blocks of queries against blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lexical import top_k

#: Queries and vectors that meet in one task, and vectors that are compared at once.
QUERY_BLOCK, VECTOR_BLOCK, SLICE = 4_096, 65_536, 4_096


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row, equal ones by the smaller id."""
    n = sims.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(sims)), n), np.tile(np.arange(n), len(sims))
    least = np.partition(sims, n - k, axis=1)[:, n - k]
    row, column = np.nonzero(sims >= least[:, None])
    order = np.lexsort((ids[column], -sims[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(sims)))
    kept = np.arange(len(row)) - first[row] < k
    return row[kept], column[kept]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", least: float | None = None) -> DataFrame:
    """query_id, id, similarity (cosine, within 0 and 1) and rank of the k nearest rows for each query.

    queries and vectors: id and `embedding`; null vectors take no part. Both are dealt into blocks of a
    bounded number of rows, so that each pair of blocks meets in one task; no vector passes the driver. A
    task sends on its own k best per query only.
    """
    asked, own = (df.where("embedding is not null").select(id_col, F.col("embedding").cast("array<double>").alias("embedding")) for df in (queries, vectors))
    blocks, salts = (max(1, -(-df.count() // n)) for df, n in ((asked, QUERY_BLOCK), (own, VECTOR_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    left = asked.select(id_col, "embedding", place(blocks).alias("block"), every(salts).alias("salt"))
    right = own.select(id_col, "embedding", place(salts).alias("salt"), every(blocks).alias("block"))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        rows = []
        if q.num_rows and v.num_rows:
            names, asked = q[id_col].to_numpy(), _unit(q["embedding"])
            for i in range(0, v.num_rows, SLICE):
                part = v.slice(i, SLICE)
                ids = part[id_col].to_numpy()
                sims = np.clip(asked @ _unit(part["embedding"]).T, 0.0, 1.0)
                row, column = _best(sims, ids, k)
                rows.append(pa.table({"query_id": names[row], id_col: ids[column], "similarity": sims[row, column]}))
        return pa.concat_tables(rows) if rows else pa.table({"query_id": pa.array([], pa.int64()), id_col: pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})

    out = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(run, f"query_id bigint, {id_col} bigint, similarity double")
    if least is not None:
        out = out.where(F.col("similarity") >= least)
    return top_k(out, k, "similarity", [id_col])


def nearest_within(pools: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", least: float | None = None) -> DataFrame:
    """query_id, id, similarity and rank of the k nearest rows of each query's pool (query_id, id), as `nearest` gives them; only pairs of pools are looked at."""
    unit = lambda c: F.transform(c, lambda x: F.try_divide(x, F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y))))
    own = lambda df, name: df.where("embedding is not null").select(F.col(id_col).alias(name), unit(F.col("embedding").cast("array<double>")).alias(f"of_{name}"))
    pairs = pools.select("query_id", F.col(id_col).alias("v")).distinct().join(own(vectors, "v"), "v").join(own(queries, "query_id"), "query_id")
    dot = F.aggregate(F.zip_with("of_query_id", "of_v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    found = pairs.select("query_id", F.col("v").alias(id_col), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot, F.lit(0.0)))).alias("similarity"))
    if least is not None:
        found = found.where(F.col("similarity") >= least)
    return top_k(found, k, "similarity", [id_col])
