"""What is shuffled grows with the rows that are read, not with the matches of a query set."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexical, understanding
from tidemark.sources import store

CHUNK = ["doc_id", "paragraph_index"]


def records(spark, act):
    """The rows that all stages of act() shuffle, and what it returns."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def so_far():
        context.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = so_far()
    out = act()
    return so_far() - before, out


def test_presence_of_many_queries_in_many_documents(spark):
    pick = random.Random(7)
    words = [f"w{i}" for i in range(14)] + ["rare"]
    index = [(d, p, w) for d in range(40) for p in range(6) for w in words[:14] if pick.random() < 0.45] + [(3, 1, "rare")]
    asked = []
    for q in range(300):
        own = pick.sample(words, pick.randint(1, 5))
        own = [f"{w}-{pick.choice(words)}" if pick.random() < 0.2 else w for w in own] + (["absent"] if q % 9 == 0 and len(own) < 5 else [])
        asked += [(q, item, len(set(own))) for item in set(own)]
    rows = spark.createDataFrame(asked, "query_id long, item string, n_items long")
    shuffled, found = records(spark, lambda: {r.query_id: (r.place, r.missing) for r in understanding.presence(rows, spark.createDataFrame(index, "doc_id long, paragraph_index long, token string")).collect()})
    said = {}
    for d, p, w in index:
        said.setdefault((d, p), set()).add(w)
    wanted = {}
    for q in range(300):
        items = {i for x, i, _ in asked if x == q}
        at = {i: {c for c, ws in said.items() if ws >= set(i.split("-"))} for i in items}
        docs = set.intersection(*({d for d, _ in v} for v in at.values()))
        lost = min((i for i in items if not at[i]), default=None)
        wanted[q] = ("missing" if lost else "paragraph" if set.intersection(*at.values()) else "document" if docs else "scattered", lost)
    assert found == wanted and {"missing", "paragraph", "document", "scattered"} == {v[0] for v in wanted.values()}
    assert shuffled < 12_000, "queries by documents"


@pytest.fixture(scope="module")
def common(spark):
    """60 questions with one frequent word, 500 chunks that all have it."""
    questions = spark.createDataFrame([(q, f"alpha beta{q} gamma{q % 7}") for q in range(60)], "query_id long, text string")
    chunks = spark.createDataFrame([(d, p, f"alpha beta{d} gamma{p} beta{d}") for d in range(100) for p in range(5)], "doc_id long, paragraph_index long, text string")
    return questions, chunks, lexical.postings(chunks, CHUNK).localCheckpoint()


def test_scored_sends_no_matches(spark, common):
    questions, _, index = common
    shuffled, found = records(spark, lambda: lexical.top_k(lexical.scored(questions, index, CHUNK), 3, "score", CHUNK).collect())
    assert len(found) == 180 and all(r.doc_id == r.query_id for r in found if r["rank"] == 1)
    assert shuffled < 10_000


def test_cascade_sends_no_matches(spark, common):
    questions, _, index = common
    shuffled, found = records(spark, lambda: lexical.top_k(lexical.cascade(lexical.scored(questions, index, CHUNK)), 3, "score", CHUNK).collect())
    assert all(r.doc_id == r.query_id and r.level == 3 for r in found if r.query_id % 7 < 5)
    assert shuffled < 12_000


def test_pinned_looks_at_its_own_documents_only(spark, common):
    questions, chunks, index = common
    pins = questions.selectExpr("query_id", "text", "query_id as doc_id")
    shuffled, found = records(spark, lambda: lexical.pinned(pins, chunks, index, CHUNK).collect())
    assert len(found) == 300 and all(r.score > 0.2 for r in found)
    assert shuffled < 10_000


def test_tag_filters_of_the_nearest_rows_only(spark):
    from tidemark.operators import retrieval

    codes = [["d:a", "j:state.fr"], ["j:payor.acme"], ["p:x"], [], ["j:program.med"]]
    requests = spark.createDataFrame([(q, codes[q % 5]) for q in range(40)], "query_id long, codes array<string>")
    documents = spark.createDataFrame([(i, ("FR", "EN", None)[i % 3], ("Medicaid", "Commercial")[i % 2], ("Acme", None)[i % 5 == 0]) for i in range(600)], "doc_id long, state string, program string, payer string")
    tags = spark.createDataFrame([(i, k, c) for i in range(600) for n, (k, c) in enumerate((("d", "a"), ("p", "x"), ("j", "payor.acme"))) if i % (n + 2) == 0], "doc_id long, kind string, code string")
    pairs = spark.createDataFrame([(q, (q * 7 + i) % 600) for q in range(40) for i in range(6)], "query_id long, doc_id long")
    shuffled, found = records(spark, lambda: retrieval.tag_filters_of(pairs, requests, documents, tags).collect())
    every = retrieval.tag_filters(requests, documents, tags).join(pairs, ["query_id", "doc_id"]).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, every)) and found
    assert shuffled < 8_000, "as few as tables and pairs have rows, not requests by documents"


def test_tables_in_between_leave_no_shuffles(spark, tmp_path):
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, rows = files(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    done = store.cut(rows), store.stored(spark, str(tmp_path), "rows", lambda s, d: rows)
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert sorted(done[0].collect()) == sorted(done[1].collect()) == sorted(rows.collect())
