"""The stored vector index against a comparison with all vectors."""

import random
import tempfile

import numpy as np
import pytest

from tidemark.operators import vector_index

SCHEMA = "id long, document_id string, payer string, embedding array<float>"


def brute(queries, rows, k):
    unit = lambda e: np.array(e, np.float32).astype(float) / np.linalg.norm(np.array(e, np.float32).astype(float))
    out = {}
    for q, e, filters in queries:
        kept = [r for r in rows if all(dict(payer=r[2], document_id=r[1]).get(n) == v for n, v in (filters or {}).items())]
        sims = sorted((-round(float(unit(e) @ unit(r[3])), 9), r[0]) for r in kept)
        out[q] = [i for _, i in sims[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture
def rows():
    rng = random.Random(5)
    centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    near = lambda: [x + rng.gauss(0, 0.4) for x in rng.choice(centers)]
    made = [(i, f"d{i % 40}", rng.choice(["p", "q", None]), near()) for i in range(600)]
    made += [(1000 + i, "copies", "p", made[0][3]) for i in range(300)]  # a third of all rows is one vector
    return made


@pytest.fixture
def bad():
    return [(2000, "d1", "p", None), (2001, "d1", "p", [0.0] * 12), (2002, "d1", "p", [float("nan")] * 12), (2003, "d1", "p", [1.0, None] * 6), (2004, "d1", "p", [])]


def test_exact_search_is_a_comparison_with_all(spark, rows, bad, monkeypatch):
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 70)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector_index, "SLICE", 32)
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    vector_index.create(spark.createDataFrame(rows[::2] + bad, SCHEMA), path)
    assert vector_index.live(spark, path).count() == len(rows[::2])
    rest = rows[1::2]
    gone = {"d2", "d4", "d5"}
    assert vector_index.change(spark, path, spark.createDataFrame(rest, SCHEMA), spark.createDataFrame([(d,) for d in gone] + [(None,)], "document_id string")) == 2
    kept = [r for r in rows[::2] if r[1] not in gone] + rest
    queries = [(i, rows[i * 7][3], f) for i, f in enumerate((None, {}, {"payer": "q"}, {"document_id": "d5"}, {"payer": "none"}, None, {"payer": "p"}, {"document_id": "copies"}))]
    queries += [(50, None, None), (51, [0.0] * 12, None), (52, [-x for x in rows[0][3]], None)]
    asked = spark.createDataFrame([(q, e, None if f is None else {**f, "state": "", "source_type": None, "colour": "red"}) for q, e, f in queries], "query_id long, embedding array<double>, filters map<string,string>")
    for first in (1, 8, 99):
        got = found(vector_index.search(asked, path, 7, first=first, exact=True))
        want = brute([q for q in queries if q[0] not in (50, 51)], kept, 7)
        assert got == {q: ids for q, ids in want.items() if ids}
    assert vector_index.delete_by_document(spark.createDataFrame([("copies",)], "document_id string"), path) == 3
    kept = [r for r in kept if r[1] != "copies"]
    to = path + "-compact"
    vector_index.compact(spark, path, to)
    some = [q for q in queries if q[0] in (0, 2, 52)]
    for p in (path, to):
        assert found(vector_index.search(asked.where("query_id in (0, 2, 52)"), p, 7, exact=True)) == brute(some, kept, 7)


def test_recall_of_the_nearest_cells(spark, rows):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    distinct = rows[:600]
    vector_index.create(spark.createDataFrame(distinct, SCHEMA), path, cells=16)
    queries = [(r[0], r[3], None) for r in distinct[::20]]
    got = found(vector_index.search(spark.createDataFrame([q[:2] for q in queries], "query_id long, embedding array<float>"), path, 10))
    want = brute(queries, distinct, 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)


def test_an_empty_index(spark, rows):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    vector_index.create(spark.createDataFrame([], SCHEMA), path)
    asked = spark.createDataFrame([(1, rows[0][3])], "query_id long, embedding array<float>")
    assert vector_index.search(asked, path, exact=True).count() == 0
    vector_index.change(spark, path, spark.createDataFrame(rows[:20], SCHEMA))
    assert found(vector_index.search(asked, path, 3, exact=True)) == brute([(1, rows[0][3], None)], rows[:20], 3)
