"""What a query shuffles and stores stays in proportion to the texts that it reads."""

import random

import pytest
from pyspark.sql import functions as F

from test_shuffled import CHUNK, records
from tidemark.functions.text import placed
from tidemark.operators import covers, lexical, ranking, retrieval, understanding
from tidemark.sources import store


def corpus_of(spark, docs=60, lines=5):
    rows = [(d, p, " ".join(f"w{(d * 7 + p * 3 + i) % 23}" for i in range(30))) for d in range(docs) for p in range(lines)]
    chunks = spark.createDataFrame(rows, "doc_id long, paragraph_index long, text string").localCheckpoint()
    return chunks, spark.createDataFrame([(d, f"w{d % 9}_name") for d in range(docs)], "doc_id long, name string").localCheckpoint()


def test_tokens_with_their_places(spark):
    pick = random.Random(5)
    rows = [(i, [pick.choice("abcdefgh") for _ in range(pick.randint(0, 40))]) for i in range(60)] + [(90, []), (91, ["a"] * 9), (92, [f"t{i % 5000}" for i in range(20_000)])]
    found = {r.i: [(e.token, e.places) for e in r.e] for r in spark.createDataFrame(rows, "i long, own array<string>").select("i", placed(F.col("own")).alias("e")).collect()}
    for i, own in rows:
        at = {}
        for n, t in enumerate(own, 1):
            at.setdefault(t, []).append(n)
        assert found[i] == sorted(at.items())


def test_an_index_is_made_without_shuffling_its_rows(spark):
    """Occurrences, and then the index by token, were shuffled: fourteen times the documents lay on the disk."""
    chunks, documents = corpus_of(spark)
    shuffled, n = records(spark, lambda: covers.positions(chunks, documents).count())
    assert n > 6_000 and shuffled < 600


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """An index of 300 chunks in buckets by document, and the chunks."""
    chunks, documents = corpus_of(spark)
    make = lambda s, d, parts: covers.entries(chunks.repartition(parts, "doc_id"), documents.repartition(parts, "doc_id"))
    folder = str(tmp_path_factory.mktemp("input"))
    return store.stored_by(spark, folder, "places", make, "doc_id", 6).select(*CHUNK, F.inline("entries")), chunks, documents


def test_a_stored_index_is_not_shuffled(spark, dealt):
    index, chunks, documents = dealt
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q + 2}") for q in range(20)], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, phrase string")
    best = lambda **more: lexical.top_k(covers.ranked(asked, none, more.pop("index"), chunks, **more), 3, "score", CHUNK).collect()
    moved, found = records(spark, lambda: best(index=index, dealt=True))
    other = best(index=covers.positions(chunks, documents))
    key = lambda r: (r.query_id, r["rank"])
    assert sorted(found, key=key) == sorted(other, key=key) and len(found) == 60
    assert moved < index.count() / 3


@pytest.fixture(scope="module")
def asked(spark):
    """40 questions that each meet all documents, tags of two kinds for some, and the documents that these admit."""
    codes = lambda q: [f"j:state.{'ab'[q % 2]}"] * (q % 3 == 0) + ["d:claims.general"] * (q % 4 == 0)
    requests = spark.createDataFrame([(q, f"w{q % 20} w{q % 20 + 1} w{q % 20 + 2}", codes(q)) for q in range(40)], "query_id long, text string, codes array<string>").localCheckpoint()
    admitted = [(q, d, q % 3 == 0 and q % 6 != 3 and d % 5 == q % 2, q % 4 == 0 and d % 2 == 0) for q in range(40) for d in range(60)]
    admitted = [r for r in admitted if r[2] or r[3]]
    return requests, spark.createDataFrame(admitted, "query_id long, doc_id long, strict boolean, relaxed boolean").localCheckpoint(), admitted


def found_under(spark, dealt, asked, mode):
    """Rows moved, and the documents of each question, found in the stored index under a mode of tags."""
    requests, admitted, _ = asked
    narrow = lambda rows: retrieval.tag_moded(rows, requests, admitted, mode, relaxes=False)
    none = spark.createDataFrame([], "query_id long, phrase string")
    act = lambda: covers.found(requests.select("query_id", "text"), none, dealt[0], dealt[1], narrow=narrow, dealt=True).groupBy("query_id").agg(F.collect_set("doc_id").alias("docs")).collect()
    moved, rows = records(spark, act)
    return moved, {r.query_id: set(r.docs) for r in rows}


def test_tags_meet_what_is_found_where_it_lies(spark, dealt, asked):
    """Pairs of questions and documents were shuffled to meet their tags: 40 by 60."""
    moved, found = found_under(spark, dealt, asked, "auto")
    strict, relaxed = ({q: {d for x, d, *v in asked[2] if x == q and v[i]} for q in range(40)} for i in (0, 1))
    for q, docs in found.items():
        admits = set(range(60)) if q % 3 else strict[q] or (relaxed[q] if q % 4 == 0 else set())
        assert docs <= admits
    assert set(range(40)) - set(found) == {q for q in range(40) if q % 3 == 0 and not strict[q] and q % 4} and found[12] and any(len(v) == 60 for v in found.values())
    assert moved < 1_500


def test_texts_are_not_shuffled_for_their_neighbours(spark):
    chunks = spark.createDataFrame([(d, p, p // 8, f"text {d} {p}") for d in range(50) for p in range(40)], "doc_id long, paragraph_index long, page_number long, text string").localCheckpoint()
    seeds = spark.createDataFrame([(d, 7, 0) for d in range(0, 50, 10)], "doc_id long, paragraph_index long, page_number long").localCheckpoint()
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables as small as these would be sent anyway
    try:
        moved, found = records(spark, lambda: ranking.neighbours(seeds, chunks, 2, 1).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert sorted((r.doc_id, r.seed_paragraph, r.paragraph_index) for r in found) == [(d, 7, p) for d in range(0, 50, 10) for p in (5, 6, 8, 9)]
    assert moved < 200


def test_scope_meets_what_is_found_where_it_lies(spark, dealt, asked):
    """All pairs of questions and documents were shuffled to meet the scope's."""
    scope = spark.createDataFrame([(q, d) for q in range(40) for d in range(60) if (q + d) % 11 == 0], "query_id long, doc_id long").localCheckpoint()
    none = spark.createDataFrame([], "query_id long, phrase string")
    moved, rows = records(spark, lambda: covers.found(asked[0].select("query_id", "text"), none, dealt[0], dealt[1], within=scope, dealt=True).select("query_id", "doc_id").distinct().collect())
    assert rows and all((r.query_id + r.doc_id) % 11 == 0 for r in rows) and len({r.query_id for r in rows}) == 40
    assert moved < 1_500


def test_strict_tags_meet_what_is_found_where_it_lies(spark, dealt, asked):
    moved, found = found_under(spark, dealt, asked, "strict")
    strict = {q: {d for x, d, s, _ in asked[2] if x == q and s} for q in range(40)}
    assert all(docs <= strict[q] for q, docs in found.items() if q % 3 == 0) and any(len(v) == 60 for v in found.values())
    assert moved < 1_500


def test_postings_are_counted_in_their_row(spark):
    """Making postings shuffled all lines, and then the postings by token."""
    chunks, _ = corpus_of(spark)
    shuffled, rows = records(spark, lambda: lexical.postings(chunks.union(spark.createDataFrame([(99, 0, None), (99, 1, "a b a")], chunks.schema)), CHUNK).collect())
    assert shuffled == 0 and len(rows) > 6_000 and sum(r.tf for r in rows) == 300 * 30 + 3
    assert sorted((r.token, r.tf) for r in rows if r.doc_id == 99) == [("a", 2), ("b", 1)]


def test_postings_are_packed_before_they_meet_queries(spark):
    """Each posting was a row of a shuffle."""
    index = spark.createDataFrame([(d, p, f"w{(d + p * 5 + i) % 60}") for d in range(60) for p in range(4) for i in range(25)], "doc_id long, paragraph_index long, token string").coalesce(2).localCheckpoint()
    items = [(q, f"w{q}", 2) for q in range(60)] + [(q, f"w{(q + q % 3 * 20) % 60 if q % 3 else (q + 1) % 60}", 2) for q in range(60)]
    asked = spark.createDataFrame(items, "query_id long, item string, n_items long").localCheckpoint()
    moved, rows = records(spark, lambda: {r.query_id: r.place for r in understanding.presence(asked, index).collect()})
    said = {}
    for d in range(60):
        for p in range(4):
            said[d, p] = {f"w{(d + p * 5 + i) % 60}" for i in range(25)}
    for q in range(60):
        both = {i for x, i, _ in items if x == q}
        docs = [set().union(*(said[d, p] for p in range(4))) for d in range(60)]
        assert rows[q] == ("paragraph" if any(both <= s for s in said.values()) else "document" if any(both <= s for s in docs) else "scattered"), q
    assert moved < index.count() / 3
