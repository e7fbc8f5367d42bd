"""A stored vector index: rows in cells round centroids, residual codes of a byte a dimension, additions, deletions and filters.

    centroids/      cell and unit centroid, fitted once on a bounded sample
    rows/FOLDER/    an addition's rows, sorted by cell: id, columns to filter on, code with its error, and the vector itself
    cells/FOLDER/   rows, least and mean cosine to the centroid per cell of that addition
    gone/FOLDER/    documents that a change takes out
    log/            a row per change, written last; what it doesn't name isn't there for a reader

A row's cosine to a query lies within `error` of what its code gives, and within a cell's angle of its centroid's, so that a search can
leave out whole cells and rows with certainty. `search` looks at the nearest cells, and then at the others that are likely to hold a row of the
k best, if the residuals of a cell point anywhere; with `exact` at all that could hold one, which gives what a comparison with all
vectors gives. So data without clusters make it look at more cells, not miss more rows. Similarities come from the vectors.

Vectors without a direction (null, zero, or with an element that is null or not finite) aren't indexed and find nothing.
"""

from __future__ import annotations

import uuid
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lexical import top_k
from tidemark.operators.snapshots import _table
from tidemark.sources.store import cut

#: Vectors that centroids are fitted on, and cells, at most.
SAMPLE, CELLS = 65_536, 4_096
#: Queries and coded rows that meet in one task, and rows that are compared at once.
QUERY_BLOCK, ROW_BLOCK, SLICE = 1_024, 65_536, 4_096
#: Cells that a search looks at first, share of the wanted rows that it may be expected to miss, and candidates per wanted row whose vectors are compared.
FIRST, MISSED, OVER = 8, 0.05, 4
#: What a search can be narrowed by; other keys of a filter say nothing.
FILTERS = ("payer", "state", "authority_level", "document_id", "source_type")
SLACK = 1e-9

LOG = "seq bigint, rows string, gone string"
META = ", ".join(f"{name} string" for name in FILTERS)
CODED = f"id bigint, {META}, cell int, code binary, scale double, error double, cosine double, same bigint"
ROWS = f"{CODED}, embedding array<float>, seq bigint"


def _directed(column: str = "embedding") -> Column:
    """Whether a vector has a direction."""
    c = F.col(column).cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = np.stack(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def log(spark: SparkSession, path: str) -> DataFrame:
    """seq, and the folders of rows and of gone documents, of each change."""
    return _table(spark, f"{path}/log", LOG)


def create(rows: DataFrame, path: str, cells: int | None = None, seed: int = 42) -> None:
    """Fits the centroids on at most SAMPLE of the rows (by a hash of id, in expectation) and indexes all of them.

    rows: id, embedding, and any of FILTERS. cells: by default the root of the number of rows, CELLS at most. An index without vectors has one cell.
    """
    spark = rows.sparkSession
    good = rows.where(_directed())
    n = good.count()
    share = int(min(1.0, SAMPLE / max(n, 1)) * 2**30)
    sample = good.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < share).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    wanted = min(cells or max(1, round(n**0.5)), CELLS)
    found = KMeans(featuresCol="v", k=wanted, seed=seed, distanceMeasure="cosine", maxIter=10).fit(sample).clusterCenters() if n and wanted > 1 else []
    kept = [c / np.linalg.norm(c) for c in found if np.linalg.norm(c) > 0]
    table = [(i, [float(x) for x in c]) for i, c in enumerate(kept)] or [(0, [])]
    spark.createDataFrame(table, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    change(spark, path, rows)


def _centroids(spark: SparkSession, path: str) -> np.ndarray | None:
    """All centroids by cell, CELLS at most; None for the one cell of an index that was made without vectors."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return None if len(rows) == 1 and not rows[0]["centroid"] else np.array([r["centroid"] for r in rows])


def _coded(rows: DataFrame, centroids: np.ndarray | None) -> DataFrame:
    own = [F.col(n).cast("string").alias(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in FILTERS]
    good = rows.where(_directed()).select(F.col("id").cast("long").alias("id"), *own, F.col("embedding").cast("array<float>").alias("embedding"))
    good = good.withColumn("same", F.xxhash64("embedding"))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch["embedding"])
            center = np.zeros((1, unit.shape[1])) if shared.value is None else shared.value
            dots = unit @ center.T
            cell = dots.argmax(axis=1)
            rest = unit - center[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-300) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(rest - code * scale[:, None], axis=1)
            made = {"cell": pa.array(cell, pa.int32()), "code": pa.array([c.tobytes() for c in code], pa.binary()), "scale": scale, "error": error, "cosine": dots[np.arange(len(cell)), cell]}
            yield pa.RecordBatch.from_pydict({n: made[n] if n in made else batch[n] for n in f"id {' '.join(FILTERS)} cell code scale error cosine same embedding".split()})

    return good.mapInArrow(run, f"{CODED}, embedding array<float>")


def change(spark: SparkSession, path: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
    """Takes out all earlier rows of the documents in `gone` (document_id), adds `rows` (as in `create`), both or neither; returns the change's number.

    A document that is embedded anew is in both; an id that is added twice is there twice. One writer at a time is assumed and checked before the change takes effect.
    """
    last = lambda: log(spark, path).agg(F.max("seq")).first()[0] or 0
    seq, folder = last() + 1, uuid.uuid4().hex
    if rows is not None:
        coded = _coded(rows, _centroids(spark, path)).withColumn("seq", F.lit(seq).cast("long"))
        # By cell and id, so that a cell of a third of all rows is more than one file, and a search's cells few row groups.
        coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/rows/{folder}")
        stats = spark.read.schema(ROWS).parquet(f"{path}/rows/{folder}").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"), F.avg("cosine").alias("mean"))
        stats.coalesce(1).write.parquet(f"{path}/cells/{folder}")
    if gone is not None:
        gone.select(F.col("document_id").cast("string").alias("document_id"), F.lit(seq).cast("long").alias("until")).where("document_id is not null").distinct().write.parquet(f"{path}/gone/{folder}")
    if last() != seq - 1:
        raise RuntimeError("another change was made meanwhile")
    entry = [(seq, folder if rows is not None else None, folder if gone is not None else None)]
    spark.createDataFrame(entry, LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return seq


def delete_by_document(documents: DataFrame, path: str) -> int:
    """Takes out all rows of the documents (document_id)."""
    return change(documents.sparkSession, path, gone=documents)


def _folders(spark: SparkSession, path: str, kind: str) -> list[str]:
    """A change has one; compact an index with many."""
    named = "gone" if kind == "gone" else "rows"
    return [f"{path}/{kind}/{r[named]}" for r in log(spark, path).where(F.col(named).isNotNull()).collect()]


def live(spark: SparkSession, path: str) -> DataFrame:
    """All rows that no later change took out."""
    folders, gone = (_folders(spark, path, kind) for kind in ("rows", "gone"))
    rows = spark.read.schema(ROWS).parquet(*folders) if folders else spark.createDataFrame([], ROWS)
    if not gone:
        return rows
    until = spark.read.schema("document_id string, until bigint").parquet(*gone).groupBy(F.col("document_id").alias("_doc")).agg(F.max("until").alias("_until"))
    return rows.join(until, (F.col("document_id") == F.col("_doc")) & (F.col("seq") < F.col("_until")), "left_anti")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the live rows as a new index with the same centroids, without the traces of changes."""
    spark.read.parquet(f"{path}/centroids").coalesce(1).write.parquet(f"{to}/centroids")
    change(spark, to, live(spark, path))


def _mask(rows: pa.Table, asked: dict[str, str]) -> np.ndarray:
    kept = np.ones(rows.num_rows, bool)
    for name, value in asked.items():
        kept &= pc.fill_null(pc.equal(rows[name], value), False).to_numpy()
    return kept


def _survivors(low: np.ndarray, high: np.ndarray, ids: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """The places of rows that can be among a query's k best, given bounds of their cosines.

    Rows of one vector tie, so that the k of them with the smallest ids are enough.
    """
    kept = np.arange(len(ids)) if len(ids) <= k else np.nonzero(high >= np.partition(low, len(ids) - k)[len(ids) - k])[0]
    if len(kept) <= k:
        return kept
    order = kept[np.lexsort((ids[kept], same[kept]))]
    starts = np.r_[True, same[order][1:] != same[order][:-1]]
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[run < k]


def _scan(visits: DataFrame, queries: DataFrame, coded: DataFrame, centroids: np.ndarray | None, k: int, most: int | None) -> DataFrame:
    """query_id, id, cell, low, high and same of the rows that can be a query's k best among the cells that it visits.

    visits: query_id, cell and floor (rows that are certainly below it are left out); queries: query_id, embedding, filters. most: rows per query and task, the likeliest; None gives all that the bounds allow.
    """
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(centroids)
    # CELLS bounds what is collected and broadcast.
    cells = [r["cell"] for r in visits.select("cell").distinct().collect()]
    coded = coded.where(F.col("cell").isin(cells))
    sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("blocks"))
    asked = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("turns"))
    parts = F.broadcast(cut(sizes.join(asked, "cell")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = visits.join(parts, "cell").join(queries, "query_id").withColumn("turn", place("query_id", "turns")).withColumn("block", every("blocks")).select("query_id", "embedding", "filters", "floor", "cell", "turn", "block")
    right = coded.drop("embedding", "seq", "cosine").join(parts, "cell").withColumn("block", place("id", "blocks")).withColumn("turn", every("turns")).drop("blocks", "turns")

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and v.num_rows:
            cell, names, unit = q["cell"][0].as_py(), q["query_id"].to_numpy(), _matrix(q["embedding"])
            floors = pc.fill_null(q["floor"], -np.inf).to_numpy()
            base = 0.0 if shared.value is None else unit @ shared.value[cell]
            wanted = [tuple((n, m[n]) for n in FILTERS if m.get(n)) for m in (dict(f or ()) for f in q["filters"].to_pylist())]
            for filters in set(wanted):
                mine = np.array([i for i, w in enumerate(wanted) if w == filters])
                rows = v.filter(pa.array(_mask(v, dict(filters))))
                for i in range(0, rows.num_rows, SLICE):
                    part = rows.slice(i, SLICE)
                    code = np.frombuffer(b"".join(part["code"].to_pylist()), np.int8).reshape(part.num_rows, -1)
                    ids, same, error = part["id"].to_numpy(), part["same"].to_numpy(), part["error"].to_numpy() + SLACK
                    sims = (unit[mine] @ code.T.astype(np.float64)) * part["scale"].to_numpy() + (base[mine, None] if shared.value is not None else 0.0)
                    for j, s in zip(mine, sims):
                        low, high = s - error, s + error
                        able = np.nonzero(high >= floors[j])[0]
                        at = able[_survivors(low[able], high[able], ids[able], same[able], k)]
                        if most is not None:
                            at = at[np.lexsort((ids[at], -s[at]))][:most]
                        out.append(pa.table({"query_id": np.full(len(at), names[j]), "id": ids[at], "cell": np.full(len(at), cell, np.int32), "low": low[at], "high": high[at], "same": same[at]}))
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("same", pa.int64())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    return left.groupBy("cell", "turn", "block").cogroup(right.groupBy("cell", "turn", "block")).applyInArrow(run, "query_id bigint, id bigint, cell int, low double, high double, same bigint")


def _reach(stats: list, expected: float | None, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cell its number, the angle that holds all of its rows, and how far above its centroid's cosine a row is likely to come.

    The last is where, of the cell's n rows, `expected` have a larger cosine, if their residuals point anywhere; without end for None.
    """
    cells = np.array([r["cell"] for r in stats], dtype=np.int32)
    angle = np.arccos(np.clip([r["least"] for r in stats], -1, 1))
    spread = np.sqrt(np.maximum(2 - 2 * np.array([r["mean"] for r in stats]), 0) / max(dimensions, 1))
    z = [np.inf if expected is None else NormalDist().inv_cdf(1 - min(0.5, expected / r["n"])) for r in stats]
    return cells, angle, np.where(np.isinf(z), np.inf, np.array(z) * spread)


def _visits(queries: DataFrame, centroids: np.ndarray | None, reach: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """query_id, cell, bound (of the cosines of the cell's rows, by `_reach`) and turn (from 0, nearest cells first)."""
    shared = queries.sparkSession.sparkContext.broadcast((centroids, *reach))

    def run(batches):
        center, cells, angle, above = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch["embedding"])
            near = np.zeros((len(unit), 1)) if center is None else np.clip(unit @ center[cells].T, -1, 1)
            bound = np.ones_like(near) if center is None else np.minimum(np.cos(np.maximum(np.arccos(near) - angle, 0)), near + above) + SLACK
            order = np.argsort(-near, axis=1, kind="stable")
            n = order.shape[1]
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(np.repeat(batch["query_id"].to_numpy(zero_copy_only=False), n), pa.int64()),
                "cell": cells[order].ravel(),
                "bound": np.take_along_axis(bound, order, 1).ravel(),
                "turn": pa.array(np.tile(np.arange(n), len(unit)), pa.int32()),
            })

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(run, "query_id bigint, cell int, bound double, turn int")


def search(queries: DataFrame, path: str, k: int = 10, first: int = FIRST, missed: float = MISSED, exact: bool = False) -> DataFrame:
    """query_id, id, document_id, source_type, similarity (cosine) and rank of the k nearest rows for each query, ties by id.

    queries: query_id (each once), embedding and, where wanted, filters (map<string,string>): a value of one of FILTERS must be equal, a null or
    empty value asks nothing, other keys are left out. A row without the value meets no filter on it. first: how many cells are looked at
    first, nearest ones. Further cells follow where they may hold a row of the k best: all that can if `exact`, or else all but those
    in which together `missed` of k rows are expected.
    """
    spark = queries.sparkSession
    filters = F.col("filters") if "filters" in queries.columns else F.lit(None).cast("map<string,string>")
    asked = cut(queries.where(_directed()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), filters.alias("filters")))
    centroids, rows = _centroids(spark, path), live(spark, path)
    folders = _folders(spark, path, "cells")
    schema = "cell int, n bigint, least double, mean double"
    sums = (F.sum("n").alias("n"), F.min("least").alias("least"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    stats = spark.read.schema(schema).parquet(*folders).groupBy("cell").agg(*sums).orderBy("cell").collect() if folders else []
    if not stats:
        return spark.createDataFrame([], "query_id bigint, id bigint, document_id string, source_type string, similarity double, rank bigint")
    expected = None if exact else missed * k / len(stats)
    visits = cut(_visits(asked, centroids, _reach(stats, expected, 0 if centroids is None else centroids.shape[1])))
    near = F.col("turn") < first
    most = None if exact else k * OVER
    found = cut(_scan(visits.where(near).select("query_id", "cell", F.lit(None).cast("double").alias("floor")), asked, rows, centroids, k, most))
    # A query with fewer than k rows so far has no floor: each of its other cells is looked at.
    floor = top_k(found, k, "low", ["id"]).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).alias("floor"))
    more = cut(visits.where(~near).join(floor, "query_id", "left").where("floor is null or bound >= floor").select("query_id", "cell", "floor"))
    found = cut(found.unionByName(_scan(more, asked, rows, centroids, k, most)))
    if exact:
        floor = top_k(found, k, "low", ["id"]).groupBy("query_id").agg(F.min("low").alias("floor"))
        found = found.join(floor, "query_id").where("high >= floor")
        # Of the copies of a vector, the k smallest ids over all tasks.
        found = top_k(found.withColumn("tie", F.lit(0)), k, "tie", ["id"], by=["query_id", "same"])
    else:
        found = top_k(found, most, "low", ["id"])
    double = F.col("v.embedding").cast("array<double>")
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)))
    whole = rows.select("id", "cell", "document_id", "source_type", "embedding", "seq").alias("v")
    pairs = found.select("query_id", "id", "cell").distinct().join(whole, ["id", "cell"]).join(asked.select("query_id", unit(F.col("embedding")).alias("asked")), "query_id")
    dot = F.aggregate(F.zip_with("asked", unit(double), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.select("query_id", "id", "v.document_id", "v.source_type", "v.seq", dot.alias("similarity"))
    return top_k(scored, k, "similarity", ["id", "seq"]).drop("seq")
