"""Registered queries of the retrieval arms, their fusion, and search end to end, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import content_key, normalise
from tidemark.operators import corpus, covers, fusion, lexical, lexicon, ranking, retrieval, substrings, tagging, understanding, vector, vector_index
from tidemark.operators.retrieval import CHUNK, Corpus, Options
from tidemark.plans.corpus_queries import _doc_tags, _line_tags, _lines, _meta
from tidemark.plans.oracle import AUTHORITY, CASCADE, DOC_TAGS, LINES, META, NORM, NORMAL_QUERY, SCORED, STOP, TOK, WHOLE_BAGS, distinct, expand, first_tokens
from tidemark.sources.store import stored, stored_by, stored_folder
from tidemark.sources.tables import read

K = 10


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """The index of all chunks, in the order of the texts: a line's tokens are counted in its row, and nothing is shuffled to store them."""
    return stored(spark, d, "postings", lambda s, d: lexical.postings(corpus.lines(read(s, d, "documents")).select(*CHUNK, "text"), CHUNK))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return lexical.scored(_questions(spark, d), _postings(spark, d), CHUNK)


#: Documents of which a bucket of the positional index is meant to have at most.
BUCKET = 2_500


def _places(spark: SparkSession, d: str) -> DataFrame:
    """The positional index of all chunks, stored by document: texts are dealt once, before they are cut, and nothing of the index is."""

    def make(s, d, parts):
        texts, names = read(s, d, "documents").select("doc_id", "text"), _meta(s, d).select("doc_id", "name")
        return covers.entries(corpus.lines(texts.repartition(parts, "doc_id")), names.repartition(parts, "doc_id"))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, d, "documents").count() // BUCKET))
    return stored_by(spark, d, "places", make, "doc_id", parts).select(*CHUNK, F.inline("entries"))


def _shown(df: DataFrame, *scores: str) -> DataFrame:
    """Scores to six places, once ranks are given."""
    return df.withColumns({c: F.round(c, 6) for c in scores})


def lexical_topk(spark, d):
    return _shown(lexical.top_k(_found(spark, d), K, "score", CHUNK).select("query_id", *CHUNK, "matched", "score", "rank"), "score")


def kofn_cascade(spark, d):
    return _shown(lexical.top_k(lexical.cascade(_found(spark, d)), K, "score", CHUNK).select("query_id", *CHUNK, "level", "matched", "score", "rank"), "score")


def cover_density(spark, d):
    """Chunks by cover density: all tokens of the normalised question and its expansion's phrases in the score, names before texts."""
    asked = _questions(spark, d)
    chunks = corpus.lines(read(spark, d, "documents"))
    found = covers.ranked(asked, lexicon.phrase_bags(asked), _places(spark, d), chunks, dealt=True)
    return _shown(lexical.top_k(found, K, "score", CHUNK).select("query_id", *CHUNK, "level", "matched", "score", "rank"), "score")


def _pools(spark: SparkSession, d: str) -> DataFrame:
    """query_id and doc_id: each document is pinned for one question."""
    n = read(spark, d, "benchmark").agg(F.max("item_id") + 1).scalar()
    return read(spark, d, "documents").select((F.col("doc_id") % n).alias("query_id"), "doc_id")


def pinned_pool(spark, d):
    """Each document is the pool of one question; all of its chunks are ranked, also without a match."""
    pins = _questions(spark, d).join(_pools(spark, d), "query_id")
    found = lexical.pinned(pins, _lines(spark, d), _postings(spark, d), CHUNK)
    return _shown(found.select("query_id", *CHUNK, "score"), "score")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    every = read(spark, d, "embeddings").select("vec_id", "embedding")
    return every.where("vec_id % 50 = 0"), every


def vector_topk(spark, d):
    return _shown(vector.nearest(*_vectors(spark, d), K), "similarity")


def vector_min_similarity(spark, d):
    return _shown(vector.nearest(*_vectors(spark, d), 50, least=0.5), "similarity")


def _index(spark: SparkSession, d: str) -> str:
    """An index that was made from two thirds of the vectors, and changed once: a tenth of its documents went, the other vectors came."""

    def make(s, d, path):
        chunk = F.when(F.col("vec_id") % 7 != 0, "chunk")
        rows = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 4").alias("document_id"), F.concat(F.lit("label-"), "label").alias("payer"), chunk.alias("source_type"), "embedding")
        vector_index.create(rows.where("id % 3 <> 0"), path)
        vector_index.change(s, path, rows.where("id % 3 = 0"), rows.where("document_id % 10 = 0").select("document_id"))

    return stored_folder(spark, d, "vector_index", make)


def vector_index_topk(spark, d):
    """Exact search in the changed index; some queries ask for their own label, some for chunks, all with a key that isn't known."""
    own, say = F.concat(F.lit("label-"), "label"), lambda *c: F.create_map(F.lit("colour"), F.lit("red"), *c)
    filters = F.when(F.col("vec_id") % 100 == 0, say(F.lit("payer"), own, F.lit("state"), F.lit(""))).when(F.col("vec_id") % 200 == 50, say(F.lit("source_type"), F.lit("chunk"))).otherwise(say())
    asked = read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", filters.alias("filters"))
    found = vector_index.search(asked, _index(spark, d), K, exact=True).select("query_id", F.col("id").alias("vec_id"), "document_id", "source_type", "similarity", "rank")
    return _shown(found, "similarity")


def vector_index_recall(spark, d):
    """query_id, wanted and found: how many of the k nearest of all live vectors the search in the nearest cells gives."""
    asked = _vectors(spark, d)[0].select(F.col("vec_id").alias("query_id"), "embedding")
    path = _index(spark, d)
    found = vector_index.search(asked, path, K).select("query_id", "id", F.lit(1).alias("hit"))
    exact = vector.nearest(asked.withColumnRenamed("query_id", "id"), vector_index.live(spark, path).select("id", "embedding"), K, "id")
    return exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))


def rrf_fusion(spark, d):
    """The vector arm and an arm of rows with the query's label, in the order of ids, weighted by the label's IDF."""
    rows = read(spark, d, "embeddings")
    near = vector.nearest(*_vectors(spark, d), 20).select("query_id", "vec_id", F.lit("vector").alias("arm"), F.lit(0).alias("arm_order"), "rank", F.lit(1.0).alias("weight"))
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    idf = n.select("label", F.log(rows.agg(F.count(F.lit(1))).scalar() / F.col("n")).alias("weight"))
    first = lexical.top_k(rows.select("label", "vec_id", F.lit(0.5).alias("s")), 20, "s", ["vec_id"], by=["label"])
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    tagged = asked.join(first, "label").join(idf, "label").select("query_id", "vec_id", F.lit("dtag").alias("arm"), F.lit(1).alias("arm_order"), "rank", "weight")
    fused = fusion.rrf(near.unionByName(tagged), "vec_id").withColumn("rrf", F.round("rrf", 9))
    return _shown(lexical.top_k(fused, 20, "rrf", ["best_rank", "vec_id"]).select("query_id", "vec_id", "rrf", "best_rank", "arm", "n_arms", "rank"), "rrf")


def union_of_arms(spark, d):
    """Two arms' answers by chunk, the better score of each, as many as both arms' k together."""
    found = _found(spark, d)
    a = lexical.top_k(found, K, "score", CHUNK).select("query_id", *CHUNK, F.round("score", 6).alias("score"), F.lit("or").alias("arm"))
    b = lexical.top_k(lexical.cascade(found), K, "score", CHUNK).select("query_id", *CHUNK, (F.round("score", 6) + 0.1).alias("score"), F.lit("cascade").alias("arm"))
    return _shown(fusion.union_best(a.unionByName(b), ["query_id", *CHUNK], "score", 2 * K), "score")


def assembled_answer(spark, d):
    """Lexical candidates reranked, put in balanced order and assembled to five slots with content and page dedup."""
    top = lexical.top_k(_found(spark, d), 60, "score", CHUNK)
    rows = top.join(_meta(spark, d).select("doc_id", "authority_level"), "doc_id").join(_lines(spark, d), CHUNK)
    score = F.round(ranking.rerank_score(F.col("score"), ranking.authority_score(F.col("authority_level")), ranking.length_score(F.col("text"))), 6)
    rows = rows.select(
        "query_id",
        (F.col("doc_id") * 1_000_000 + F.col("paragraph_index")).alias("id"),
        "authority_level",
        score.alias("score"),
        content_key(F.col("text"), 200).alias("content_key"),
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page_number").cast("string")).alias("page_key"),
    )
    return ranking.assemble(ranking.balanced_order(rows, 5, 0.5), 5, 0.18)


def code_lookup(spark, d):
    """Page numbers asked for as codes, such as EN-825, in names made of the pages' paths."""
    pages = read(spark, d, "pages")
    path = F.regexp_extract("url", "/([a-z]{2}/[0-9]+)", 1)
    asked = pages.where("page_id % 5 = 0").select(F.col("page_id").alias("query_id"), F.replace(path, F.lit("/"), F.lit("-")).alias("text"))
    named = pages.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("page "), F.replace(path, F.lit("/"), F.lit("-")), F.lit(" copy")).alias("name"))
    return retrieval.code_lookup(asked, named, 20)


def substring_hits(spark, d):
    """How many lines and documents hold a part of a question's text, of 6 to 36 characters, as LIKE would find it."""
    i = F.col("item_id")
    asked = read(spark, d, "benchmark").select("item_id", F.substr(normalise(F.col("text")), F.lit(4), (6 + i % 4 * 10).cast("int")).alias("pattern"))
    found = substrings.holding(asked, _lines(spark, d).select(*CHUNK, normalise(F.col("text")).alias("text")), CHUNK)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("doc_id").alias("docs"))


def metadata_scope(spark, d):
    """Each question's scope over the documents: some name a payer, a state or a program; src1 is a plan that shares what src0 and src2 publish in FR."""
    docs = _meta(spark, d)
    q = read(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("src"), (F.col("item_id") % 3).cast("string"))).alias("f_payer"),
        F.when(F.col("item_id") % 5 == 0, "FR").alias("f_state"),
        F.when(F.col("item_id") % 7 == 0, "Medicaid").alias("f_program"),
        F.when(F.col("item_id") % 11 == 0, "payer_policy").alias("f_level"),
    )
    scopes = q.select("f_payer", "f_state", "f_program", "f_level").distinct()
    values = docs.groupBy("payer", "state", "program", "authority_level").agg(F.count(F.lit(1)).alias("docs"))
    scope = retrieval.in_scope(F.col("f_payer"), F.col("f_state"), F.col("f_program"), F.col("f_level"), ("src1",), ("src0", "src2"), "FR")
    # Scopes and values are few; each is counted once, whatever the number of questions or documents.
    inside = scopes.join(F.broadcast(values), scope).groupBy("f_payer", "f_state", "f_program", "f_level").agg(F.sum("docs").alias("docs"))
    same = [q[c].eqNullSafe(inside[c]) for c in ("f_payer", "f_state", "f_program", "f_level")]
    return q.join(inside, same, "left").select("query_id", F.coalesce("docs", F.lit(0)).alias("docs"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """The questions with their vectors, tags, and required phrases; the tag arm takes the required d-tags, or else all."""
    asked = understanding.profiles(_questions(spark, d))
    selectivity = tagging.tag_statistics(_doc_tags(spark, d), read(spark, d, "documents"))
    phrases = understanding.required_phrases(understanding.term_parts(asked, selectivity))
    rows = asked.select("query_id", "text", "codes").join(phrases, "query_id", "left")
    own = lambda cs: F.transform(F.filter(cs, lambda c: c.startswith("d:")), lambda c: F.substring(c, 3, 1000))
    required = own(F.coalesce(F.transform(F.filter("phrases", lambda p: p["code"].isNotNull()), lambda p: p["code"]), F.array().cast("array<string>")))
    rows = rows.withColumn("dtags", F.when(F.size(required) > 0, required).otherwise(own(F.col("codes"))))
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return rows.join(vectors, "query_id", "left")


def _corpus(spark: SparkSession, d: str, mode: str = "corpus") -> Corpus:
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("vec_id").alias("doc_id"), F.lit(0).cast("long").alias("paragraph_index"), "embedding")
    places = None if mode == "recall" else _places(spark, d)  # first: texts are shuffled for it, while nothing else is stored
    return Corpus(_lines(spark, d), _meta(spark, d), _line_tags(spark, d), _doc_tags(spark, d), vectors, places, lexicon.bags(spark), dealt=True)


#: The options that the registered searches run with, by mode.
SEARCHES = {
    "search": Options("corpus", merge_from=0.4),
    "search_precision": Options("precision", order="canonical_first", tag_mode="strict", paragraphs=1, pages=0, merge_from=0.4),
    "search_recall": Options("recall", order="balanced", canonical_floor=0.4, tag_mode="relaxed", min_similarity=0.3, paragraphs=0),
    "search_untagged": Options("corpus", k=5, tag_mode="none", paragraphs=3, per_document=4, total=12),
}


def _searched(name: str):
    def run(spark, d):
        tables = _corpus(spark, d, SEARCHES[name].mode)
        return retrieval.search(_requests(spark, d), tables, SEARCHES[name])

    run.__name__ = name
    return run


search = _searched("search")


def search_scoped(spark, d):
    """Search in which each question may get only the documents pinned for it."""
    tables = replace(_corpus(spark, d), scope=_pools(spark, d))
    return retrieval.search(_requests(spark, d), tables, SEARCHES["search"])

QUERIES = {f.__name__: f for f in (
    lexical_topk, kofn_cascade, cover_density, pinned_pool, vector_topk, vector_min_similarity, vector_index_topk, vector_index_recall, rrf_fusion, union_of_arms, assembled_answer, code_lookup, substring_hits, metadata_scope,
    *map(_searched, SEARCHES), search_scoped,
)}

_COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_NEAR = f"""near AS (SELECT q.vec_id AS query_id, v.vec_id, greatest(0, least(1, {_COSINE})) AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM near)"""
_PLACE = "score DESC, doc_id, paragraph_index"
_KEY = "substring({}, 1, {})".format(NORM.format("{}"), "{}")


def _picked(rows: str, k: int) -> str:
    """query_id, id and slot: the rows (query_id, id, position, content_key, page_key) that a greedy pick takes in order."""
    entry = "{'ids': [id], 'cs': [content_key], 'ps': [page_key]}"
    fold = f"""list_reduce(list({entry} ORDER BY position, id), lambda a, x: CASE WHEN len(a.ids) >= {k} OR list_contains(a.cs, x.cs[1]) OR list_contains(a.ps, x.ps[1]) THEN a
      ELSE {{'ids': list_concat(a.ids, x.ids), 'cs': list_concat(a.cs, x.cs), 'ps': list_concat(a.ps, x.ps)}} END)"""
    return f"SELECT query_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS slot FROM (SELECT query_id, ({fold}).ids AS ids FROM {rows} GROUP BY 1)"


_TIER = "CASE authority_level WHEN 'contract_source_of_truth' THEN 0 WHEN 'payer_policy' THEN 1 WHEN 'operational_suggested' THEN 1 WHEN 'fyi_not_citable' THEN 2 ELSE 3 END"
_AUTH = "CASE authority_level WHEN 'contract_source_of_truth' THEN 1.0::DOUBLE WHEN 'payer_website' THEN 0.75::DOUBLE WHEN 'operational_suggested' THEN 0.65::DOUBLE WHEN 'payer_policy' THEN 0.5::DOUBLE WHEN 'fyi_not_citable' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END"
_LENGTH = "CASE WHEN length(text) < 50 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (length(text) - 50) / 450.0::DOUBLE) END"
_BALANCED = """h AS (SELECT *, ({tier} > 1)::INT AS half FROM first3), hn AS (SELECT *, row_number() OVER (PARTITION BY query_id, half ORDER BY score DESC, id) AS n FROM h),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY half, n) AS position FROM hn WHERE n <= CASE WHEN half = 0 THEN {a} ELSE {b} END)"""
# The questions' literals: pattern, and whether letters, digits and dots may not follow.
_LITERALS = ((r"\b[A-Z]{2,5}\.[A-Z]{2,5}\.[0-9]+(?:\.[0-9]+)*", True), (r"\b[A-Z][0-9]{4}\b", False), (r"\b[A-Z][0-9]{2}(?:\.[0-9]{1,4})?", True), (r"\b[0-9]{5}\b", False), (r"\b[A-Z]{2,5}-[A-Z0-9]{2,8}(?:-[A-Z0-9]+)*\b", False))


def cut(source: str) -> str:
    """query_id, text, literals and rest of a source of (query_id, text), a step for each pattern."""
    steps, before, found = [], f"(SELECT query_id, text, trim(text) AS r FROM {source})", []
    for i, (p, stop) in enumerate(_LITERALS):
        tail = "([^A-Za-z0-9.]|$)" if stop else "()"
        found.append(f"l{i}")
        steps.append(f"cut{i} AS (SELECT * EXCLUDE (r), regexp_extract_all(r, '(?i)({p}){tail}', 1) AS l{i}, regexp_replace(r, '(?i){p}{tail}', ' \\1', 'g') AS r FROM {before})")
        before = f"cut{i}"
    steps.append(f"cuts AS (SELECT query_id, text, list_concat({', '.join(found[:2])}) AS ab, {', '.join(found[2:])}, r AS rest FROM {before})")
    steps.append("asked0 AS (SELECT query_id, text, list_concat(list_concat(list_concat(ab, l2), l3), l4) AS literals, rest FROM cuts)")
    return ", ".join(steps)


def requests() -> str:
    """CTEs behind DOC_TAGS: sel, req (query_id, query, codes, dtags), phrases (query_id, phrase, weight, code)."""
    leaf = "trim(replace(string_split(code, '.')[-1], '_', ' '))"
    return f"""sel AS (SELECT kind, code, 1 - count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS s FROM doc_tags GROUP BY ALL), bq AS (SELECT item_id AS query_id, text FROM benchmark),
{expand("bq")}, {cut("bq")}, have AS (SELECT query_id, kind, code, kind || ':' || code AS tag FROM expanded WHERE place < 12),
need AS (SELECT query_id, {leaf} AS phrase, greatest(0.1::DOUBLE, s) AS weight, tag AS code FROM have JOIN sel USING (kind, code) WHERE s >= 0.65::DOUBLE AND {leaf} <> 'general'
  UNION ALL SELECT query_id, lower(unnest(literals)), 1.0::DOUBLE, NULL FROM asked0),
phrases AS (SELECT query_id, phrase, weight, code FROM (SELECT *, row_number() OVER (PARTITION BY query_id, phrase ORDER BY code IS NOT NULL, code) AS i FROM need) WHERE i = 1),
dneed AS (SELECT query_id, substring(code, 3) AS code FROM phrases WHERE code LIKE 'd:%'),
dtag AS (SELECT * FROM dneed UNION ALL SELECT query_id, code FROM have WHERE kind = 'd' AND query_id NOT IN (SELECT query_id FROM dneed)),
about AS (SELECT query_id, bool_or(regexp_matches(tag, '^j:(state|program|payor|regulatory_authority)\\..')) AS hasj, bool_or(kind <> 'j') AS hasdp FROM have GROUP BY 1)"""


_SIGNALS = {"P": ("that the", "this is", "are the"), "D": ("with", "from", "pour", "avec"), "J": ("of the", "und", "en la")}


def _signal(text: str, name: str) -> str:
    patterns = _SIGNALS[name]
    hits = " + ".join(f"contains(lower({text}), '{p}')::INT" for p in patterns)
    short = f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')) <= 20"
    return f"least(1, ({hits}) / CASE WHEN {short} THEN sqrt({len(patterns)}) ELSE {len(patterns)} END)"


def _search_sql(o: Options, scoped: bool = False) -> str:
    wanted, asked_all = 2 * o.k, o.tag_mode == "none"
    kept = {"none": "true", "strict": "st", "relaxed": "rl", "auto": "CASE WHEN anyst THEN st ELSE hasdp AND rl END"}[o.tag_mode]
    moded = lambda rows, off: f"""SELECT * EXCLUDE (st, rl, hasdp, anyst) FROM (SELECT *, bool_or(st) OVER (PARTITION BY query_id) AS anyst FROM (SELECT x.*, NOT coalesce(hasj, false) OR coalesce(strict, false) AS st,
      NOT coalesce(hasdp, false) OR coalesce(relaxed, false) AS rl, coalesce(hasdp, false) AS hasdp FROM {rows} x LEFT JOIN about USING (query_id) LEFT JOIN adm USING (query_id, doc_id))) WHERE {'true' if off else kept}"""  # noqa: E731
    arms = []
    if o.mode != "recall":
        arms.append("SELECT query_id, doc_id, paragraph_index, 'bm25' AS arm, 0 AS o, score AS similarity, rank FROM bm WHERE rank <= " + str(wanted))
    if o.mode != "precision":
        arms.append(f"SELECT query_id, doc_id, paragraph_index, 'vector' AS arm, {len(arms)} AS o, sim AS similarity, rank FROM va WHERE rank <= {wanted}")
    if o.mode != "recall":
        arms.append(f"SELECT query_id, doc_id, paragraph_index, 'dtag' AS arm, {len(arms)} AS o, 0.5::DOUBLE AS similarity, rank FROM ta WHERE rank <= {o.k}")
    vec = "vector" if o.mode == "recall" else "CASE WHEN vector IS NOT NULL THEN greatest(0, (vector - 0.5::DOUBLE) * 2) END"
    semi = "SEMI JOIN pool USING (query_id, doc_id)" if scoped else ""
    floor = 0.0 if o.mode == "recall" else 0.18
    if o.min_similarity is not None:
        floor = max([v for v in (0.55, 0.35, 0.18) if o.min_similarity >= v], default=0.0)
    fetch = wanted * (8 if o.mode == "recall" or not asked_all else 1)
    least = f"AND sim >= {o.min_similarity}::DOUBLE" if o.mode == "recall" and o.min_similarity is not None else ""
    if o.order == "canonical_first":
        order = f"ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score >= 0.55 THEN 3 WHEN score >= 0.35 THEN 2 WHEN score >= 0.18 THEN 1 ELSE 0 END DESC, {_TIER}, score DESC, id) AS position FROM first3)"
    elif o.order == "balanced":
        slots = -int(-o.k * o.canonical_floor // 1)
        order = _BALANCED.format(tier=_TIER, a=3 * slots, b=3 * (o.k - slots))
    else:
        order = "ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM first3)"
    label = "CASE WHEN score >= 0.55 THEN 'high' WHEN score >= 0.35 THEN 'medium' WHEN score >= 0.18 THEN 'low' ELSE 'abstain' END"
    sql = f"""WITH {DOC_TAGS}, {META}, {requests()}, {_COVERS},
held AS (SELECT DISTINCT query_id, m.doc_id, true AS strict, false AS relaxed FROM have h JOIN meta m ON h.kind = 'j' AND CASE WHEN h.code LIKE 'state.%' THEN m.state = upper(substring(substring(h.code, 7), 1, 2))
    WHEN h.code LIKE 'payor.%' THEN contains(lower(m.payer), replace(substring(h.code, 7), '_', ' ')) ELSE false END
  UNION ALL SELECT DISTINCT query_id, doc_id, true, false FROM have JOIN doc_tags USING (kind, code) WHERE kind = 'j' AND code LIKE 'payor.%'
  UNION ALL SELECT DISTINCT query_id, doc_id, false, true FROM have JOIN doc_tags USING (kind, code) WHERE kind <> 'j'),
adm AS MATERIALIZED (SELECT query_id, doc_id, bool_or(strict) AS strict, bool_or(relaxed) AS relaxed FROM held GROUP BY 1, 2),
pool AS (SELECT doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS query_id, doc_id FROM documents), k1 AS (SELECT * FROM k0 {semi}), k AS MATERIALIZED ({moded("k1", o.tag_mode in ("none", "relaxed"))}), {_LEVELS}, bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_PLACE}) AS rank FROM c),
vn AS (SELECT b.query_id, v.vec_id AS doc_id, 0::BIGINT AS paragraph_index, greatest(0, least(1, {_COSINE})) AS sim FROM bq b JOIN embeddings q ON q.vec_id = b.query_id, embeddings v{' WHERE v.vec_id % (SELECT max(item_id) + 1 FROM benchmark) = b.query_id AND v.vec_id IN (SELECT doc_id FROM documents)' if scoped else ''}),
vf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS i FROM vn WHERE true {least}) WHERE i <= {fetch}),
vm AS ({moded("vf", asked_all)}), va AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM vm),
tp AS (SELECT doc_id, paragraph_index, code, CASE authority_level WHEN 'contract_source_of_truth' THEN 0 WHEN 'operational' THEN 1 WHEN 'payer_policy' THEN 2 WHEN 'fyi_not_citable' THEN 3 ELSE 4 END AS p FROM line_tags JOIN meta USING (doc_id) WHERE kind = 'd'),
tf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p, doc_id, paragraph_index) AS i FROM tp) WHERE i <= {o.k}),
td AS (SELECT DISTINCT query_id, doc_id, paragraph_index, p FROM dtag JOIN {'tp' if scoped else 'tf'} USING (code) {semi}), ta AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, doc_id, paragraph_index) AS rank FROM td),
arms AS ({' UNION ALL '.join(arms)}),
fused AS (SELECT query_id, doc_id, paragraph_index, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS best_rank, arg_min(arm, o) AS arm, max(similarity) FILTER (arm = 'bm25') AS bm25, max(similarity) FILTER (arm = 'vector') AS vector,
  max(similarity) FILTER (arm = 'dtag') AS dtag FROM arms GROUP BY 1, 2, 3),
placed AS (SELECT f.*, page_number, text, authority_level, name, payer, state, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, best_rank, doc_id, paragraph_index) AS place FROM fused f JOIN lines USING (doc_id, paragraph_index) JOIN meta USING (doc_id)),
once AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN {_KEY.format("text", 400)} = '' THEN '#' || place ELSE '=' || {_KEY.format("text", 400)} END ORDER BY place) AS i FROM placed) WHERE i = 1),
ph AS (SELECT query_id, list({{'phrase': phrase, 'weight': weight, 'code': code}}) AS phrases, sum(weight) AS total FROM phrases GROUP BY 1),
seeds AS (SELECT DISTINCT doc_id, paragraph_index, page_number FROM once),
ctx AS (SELECT s.doc_id, s.paragraph_index, substring(string_agg(l.text, chr(10) ORDER BY l.paragraph_index), 1, 1500) AS context FROM seeds s JOIN lines l ON s.doc_id = l.doc_id AND abs(l.paragraph_index - s.paragraph_index) = 1
  AND l.page_number BETWEEN s.page_number - 1 AND s.page_number + 1 GROUP BY 1, 2),
own AS (SELECT doc_id, list(kind || ':' || code) AS codes, string_agg(trim(replace(string_split(code, '.')[-1], '_', ' ')) || ' | ' || replace(replace(code, '.', ' '), '_', ' '), ' | ') AS said FROM doc_tags GROUP BY 1),
dc AS (SELECT doc_id, paragraph_index, list(code) AS dcodes FROM line_tags WHERE kind = 'd' GROUP BY 1, 2),
e0 AS (SELECT o.*, b.text AS query, phrases, total, CASE WHEN phrases IS NOT NULL THEN context END AS context, CASE WHEN phrases IS NOT NULL THEN coalesce(codes, []) ELSE [] END AS codes, coalesce(dcodes, []) AS dcodes,
  CASE WHEN phrases IS NOT NULL THEN lower(name) || ' | ' || replace(replace(lower(name), '_', ' '), '-', ' ') || ' | ' || lower(payer) || ' | ' || lower(state) || ' | ' || coalesce(said, '') ELSE '' END AS meta_text,
  phrases IS NOT NULL AND coalesce(bm25, vector, dtag) >= {o.merge_from}::DOUBLE AS good FROM once o JOIN bq b USING (query_id) LEFT JOIN ph USING (query_id) LEFT JOIN ctx USING (doc_id, paragraph_index) LEFT JOIN own USING (doc_id) LEFT JOIN dc USING (doc_id, paragraph_index)),
gs AS (SELECT DISTINCT doc_id, paragraph_index, page_number FROM e0 WHERE good),
near3 AS (SELECT g.doc_id, g.paragraph_index, l.paragraph_index AS pos, trim(l.text) AS t, row_number() OVER (PARTITION BY g.doc_id, g.paragraph_index ORDER BY l.paragraph_index) AS i FROM gs g JOIN lines l ON l.doc_id = g.doc_id
  AND l.page_number = g.page_number AND abs(l.paragraph_index - g.paragraph_index) <= 3 AND l.paragraph_index <> g.paragraph_index AND trim(l.text) <> '' AND NOT (length(trim(l.text)) < 80 AND (contains(l.text, 'Provider Manual') OR contains(l.text, 'SH_')))),
block AS (SELECT doc_id, paragraph_index, string_agg(t, chr(10) || chr(10) ORDER BY pos) FILTER (t <> '') AS merged FROM (SELECT doc_id, paragraph_index, pos, t FROM near3 WHERE i <= 5
  UNION ALL SELECT doc_id, paragraph_index, paragraph_index, trim(text) FROM gs JOIN lines USING (doc_id, paragraph_index) WHERE (doc_id, paragraph_index) IN (SELECT (doc_id, paragraph_index) FROM near3)) GROUP BY 1, 2),
e1 AS (SELECT e0.* EXCLUDE (text), CASE WHEN good AND merged IS NOT NULL THEN merged ELSE text END AS text FROM e0 LEFT JOIN block USING (doc_id, paragraph_index)),
e2 AS (SELECT *, {NORM.format("text")} || CASE WHEN {NORM.format("coalesce(context, '')")} <> '' THEN ' | ' || {NORM.format("context")} ELSE '' END AS body FROM e1),
e3 AS (SELECT *, CASE WHEN phrases IS NOT NULL THEN list_sum(list_transform(phrases, lambda p: CASE WHEN (coalesce(p.code, '') LIKE 'j:%' AND list_contains(codes, p.code)) OR contains(body, p.phrase) OR contains(meta_text, p.phrase) THEN p.weight ELSE 0 END)) / total END AS coverage,
  phrases IS NOT NULL AND len(list_filter(phrases, lambda p: coalesce(p.code, '') LIKE 'd:%' AND list_contains(dcodes, substring(p.code, 3)))) > 0 AS boosted,
  {' + '.join(_signal("query", n) for n in _SIGNALS)} AS qw, {' + '.join(f'{_signal("query", n)} * {_signal("body", n)}' for n in _SIGNALS)} AS dot FROM e2),
e4 AS (SELECT *, CASE WHEN qw > 0 THEN least(1, dot / qw) END AS signal, greatest(coalesce(bm25, 0), coalesce({vec}, 0), coalesce(dtag, 0)) AS sim FROM e3),
e5 AS (SELECT *, round((0.25::DOUBLE * sim + 0.1::DOUBLE * {_AUTH} + 0.05::DOUBLE * {_LENGTH} + coalesce(0.2::DOUBLE * signal, 0) + coalesce(0.55::DOUBLE * coverage, 0))
  / (0.4::DOUBLE + CASE WHEN signal IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN phrases IS NOT NULL THEN 0.55::DOUBLE ELSE 0 END) * CASE WHEN boosted THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM e4),
e6 AS (SELECT *, max(score) OVER (PARTITION BY query_id, arm) AS best FROM e5 WHERE coverage IS NULL OR coverage >= 0.999999999::DOUBLE OR boosted),
e7 AS MATERIALIZED (SELECT *, doc_id * 1000000 + paragraph_index AS id, {_KEY.format("text", 200)} AS content_key, doc_id::VARCHAR || '/' || page_number::VARCHAR AS page_key FROM e6 WHERE best <= 0 OR score >= 0.6::DOUBLE * best),
first3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS i3 FROM e7) WHERE i3 <= {3 * o.k}), {order},
cand AS (SELECT * FROM ordered WHERE score >= {floor} AND position <= {3 * o.k}), slots AS ({_picked("cand", o.k)}),
hits2 AS MATERIALIZED (SELECT e7.query_id, doc_id, paragraph_index, page_number, text, score, slot FROM e7 JOIN slots USING (query_id, id))"""
    if not o.paragraphs:
        return f"{sql} SELECT query_id, doc_id, paragraph_index, 'hit' AS origin, score, {label} AS label, slot AS position FROM hits2"
    return f"""{sql},
nb AS (SELECT DISTINCT h.query_id, l.doc_id, l.paragraph_index, {_KEY.format("l.text", 200)} AS key FROM hits2 h JOIN lines l ON l.doc_id = h.doc_id AND abs(l.paragraph_index - h.paragraph_index) BETWEEN 1 AND {o.paragraphs} AND abs(l.page_number - h.page_number) <= {o.pages}),
nf AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY doc_id, paragraph_index) AS i FROM nb WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM hits2 h WHERE h.query_id = nb.query_id AND h.doc_id = nb.doc_id AND h.paragraph_index = nb.paragraph_index)
  AND NOT EXISTS (SELECT 1 FROM hits2 h WHERE h.query_id = nb.query_id AND {_KEY.format("h.text", 200)} = nb.key)),
bestd AS (SELECT query_id, doc_id, max(score) AS b FROM hits2 GROUP BY 1, 2),
everyone AS (SELECT query_id, doc_id, paragraph_index, 'hit' AS origin, score FROM hits2 UNION ALL SELECT query_id, doc_id, paragraph_index, 'neighbour', round(CASE WHEN b > 0 THEN 0.5::DOUBLE * b ELSE 0.15::DOUBLE END, 7) FROM nf JOIN bestd USING (query_id, doc_id) WHERE i = 1),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY origin <> 'hit', score DESC, doc_id, paragraph_index) AS i FROM everyone) WHERE i <= {o.per_document}),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin <> 'hit', score DESC, doc_id, paragraph_index) AS position FROM capped)
SELECT query_id, doc_id, paragraph_index, origin, score, CASE WHEN origin = 'hit' THEN {label} ELSE 'low' END AS label, position FROM final WHERE position <= {o.total}"""


_ALL_ASKED = "asked_phrases(kind, code, phrase) AS (VALUES " + ", ".join(f"('{k}', '{c}', '{p}')" for k, c, phrases in WHOLE_BAGS for p in phrases) + ")"
_CONTENT = distinct(f"list_filter({TOK.format('{}')}, lambda t: t NOT IN {STOP})".replace("{}", "x"))
#: The cover density of each question's chunks as CTEs behind LINES, META and expand(): k (query_id, doc_id, paragraph_index, matched, ...), then c with level and score.
_COVERS = f"""{_ALL_ASKED},
nq AS (SELECT item_id AS query_id, {NORMAL_QUERY} AS x FROM benchmark), said AS (SELECT query_id, {_CONTENT} AS ts, {first_tokens("x", 7)} AS f FROM nq),
bag AS (SELECT DISTINCT query_id, list_sort({_CONTENT}) AS g FROM (SELECT query_id, phrase AS x FROM expanded JOIN asked_phrases USING (kind, code))),
demand AS (SELECT DISTINCT query_id, g FROM (SELECT query_id, [unnest(ts)] AS g FROM said UNION ALL SELECT query_id, g FROM bag) WHERE len(g) > 0),
groups AS MATERIALIZED (SELECT query_id, row_number() OVER () AS gid, g FROM demand), terms AS MATERIALIZED (SELECT DISTINCT query_id, unnest(g) AS token FROM groups),
toks AS (SELECT doc_id, {TOK.format("name")} AS ts FROM meta), places AS MATERIALIZED (
  SELECT doc_id, paragraph_index, unnest(ts) AS token, generate_subscripts(ts, 1) AS place, 1.0::DOUBLE AS w FROM toks JOIN (SELECT doc_id, paragraph_index FROM lines) USING (doc_id)
  UNION ALL SELECT doc_id, paragraph_index, unnest(b), generate_subscripts(b, 1) + len(ts), 0.1::DOUBLE FROM (SELECT doc_id, paragraph_index, {TOK.format("text")} AS b FROM lines) JOIN toks USING (doc_id)),
ent AS MATERIALIZED (SELECT query_id, doc_id, paragraph_index, token, place, w, row_number() OVER (PARTITION BY query_id, doc_id, paragraph_index ORDER BY place) AS i FROM terms JOIN places USING (token)),
fl AS (SELECT query_id, token, regexp_matches(token, '^([a-z][0-9]{{3,5}}|[a-z]{{2}}[0-9]{{3,4}})$') AS anchor FROM (SELECT query_id, unnest(f) AS token FROM said)),
fn AS (SELECT query_id, count(*) AS n_first, count(*) FILTER (anchor) AS n_anchors FROM fl GROUP BY 1),
kc AS (SELECT query_id, doc_id, paragraph_index, count(DISTINCT token) FILTER (anchor IS NOT NULL) AS matched, count(DISTINCT token) FILTER (anchor) AS na, count(DISTINCT token) FILTER (NOT anchor) AS nr FROM ent LEFT JOIN fl USING (query_id, token) GROUP BY 1, 2, 3),
lasts AS (SELECT e.query_id, doc_id, paragraph_index, e.i, e.place, gid, max(CASE WHEN e.token = t THEN e.i END) OVER (PARTITION BY e.query_id, doc_id, paragraph_index, gid, t ORDER BY e.i) AS l
  FROM ent e JOIN (SELECT query_id, gid, unnest(g) AS t FROM groups) x USING (query_id)),
gl AS (SELECT query_id, doc_id, paragraph_index, i, gid, CASE WHEN count(l) = count(*) THEN min(l) END AS b FROM lasts GROUP BY ALL),
bl AS (SELECT query_id, doc_id, paragraph_index, i, max(b) AS b FROM gl GROUP BY ALL),
cv AS (SELECT *, lag(b) OVER (PARTITION BY query_id, doc_id, paragraph_index ORDER BY i) AS pb FROM bl WHERE b IS NOT NULL),
sm AS (SELECT query_id, doc_id, paragraph_index, i, place, sum(1 / w) OVER (PARTITION BY query_id, doc_id, paragraph_index ORDER BY i) AS inv, w FROM ent),
dens AS MATERIALIZED (SELECT cv.query_id, cv.doc_id, cv.paragraph_index, round(sum((cv.i - cv.b + 1) / (e.inv - s.inv + 1 / s.w) / (1 + (e.place - s.place) - (cv.i - cv.b))), 9) AS s
  FROM cv JOIN sm e ON e.query_id = cv.query_id AND e.doc_id = cv.doc_id AND e.paragraph_index = cv.paragraph_index AND e.i = cv.i
  JOIN sm s ON s.query_id = cv.query_id AND s.doc_id = cv.doc_id AND s.paragraph_index = cv.paragraph_index AND s.i = cv.b WHERE pb IS NULL OR cv.b > pb GROUP BY 1, 2, 3),
k0 AS MATERIALIZED (SELECT query_id, doc_id, paragraph_index, matched, coalesce(n_first, 0) AS n_first, coalesce(n_anchors > 0 AND na = n_anchors AND (n_first = n_anchors OR nr > 0), false) AS anchored, s
  FROM kc LEFT JOIN fn USING (query_id) LEFT JOIN dens USING (query_id, doc_id, paragraph_index))"""
_LEVELS = """kl AS (SELECT *, CASE WHEN bool_or(anchored) OVER (PARTITION BY query_id) THEN -1 WHEN max(matched) OVER (PARTITION BY query_id) >= greatest(3, (n_first + 1) // 2) THEN max(matched) OVER (PARTITION BY query_id) ELSE 0 END AS level FROM k),
c AS (SELECT query_id, doc_id, paragraph_index, level, matched, s / (s + 1) AS score FROM kl WHERE CASE WHEN level = -1 THEN anchored WHEN level > 0 THEN matched = level ELSE s IS NOT NULL END)"""

SQL = {
    "cover_density": f"WITH {LINES}, {META}, {expand('(SELECT item_id AS query_id, text FROM benchmark)')}, {_COVERS}, k AS (SELECT * FROM k0), {_LEVELS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_PLACE}) AS rank FROM c) SELECT query_id, doc_id, paragraph_index, level, matched, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "lexical_topk": f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_PLACE}) AS rank FROM found) SELECT query_id, doc_id, paragraph_index, matched, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "kofn_cascade": f"WITH {SCORED}, {CASCADE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_PLACE}) AS rank FROM c) SELECT query_id, doc_id, paragraph_index, level, matched, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "pinned_pool": f"""WITH {SCORED}, pins AS (SELECT doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS query_id, doc_id FROM documents)
      SELECT query_id, doc_id, paragraph_index, round(coalesce(score, 0), 6) AS score FROM pins JOIN (SELECT item_id AS query_id FROM benchmark) USING (query_id) JOIN lines USING (doc_id) LEFT JOIN found USING (query_id, doc_id, paragraph_index)""",
    "vector_topk": f"WITH {_NEAR} SELECT query_id, vec_id, round(sim, 6) AS similarity, rank FROM ranked WHERE rank <= 10",
    "vector_min_similarity": f"WITH {_NEAR} SELECT query_id, vec_id, round(sim, 6) AS similarity, rank FROM ranked WHERE sim >= 0.5 AND rank <= 50",
    "vector_index_topk": f"""WITH near AS (SELECT q.vec_id AS query_id, v.vec_id, v.vec_id // 4 AS doc, CASE WHEN v.vec_id % 7 <> 0 THEN 'chunk' END AS source_type, {_COSINE} AS sim FROM embeddings q, embeddings v
        WHERE q.vec_id % 50 = 0 AND (v.vec_id % 3 = 0 OR v.vec_id // 4 % 10 <> 0)
        AND CASE WHEN q.vec_id % 100 = 0 THEN v.label = q.label WHEN q.vec_id % 200 = 50 THEN v.vec_id % 7 <> 0 ELSE true END),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM near)
      SELECT query_id, vec_id, doc::VARCHAR AS document_id, source_type, round(sim, 6) AS similarity, rank FROM ranked WHERE rank <= 10""",
    "rrf_fusion": f"""WITH {_NEAR}, idf AS (SELECT label, ln((SELECT count(*) FROM embeddings) / count(*)) AS w FROM embeddings GROUP BY 1),
      first AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings),
      arms AS (SELECT query_id, vec_id, 'vector' AS arm, 0 AS o, rank, 1.0::DOUBLE AS w FROM ranked WHERE rank <= 20
        UNION ALL SELECT q.vec_id, f.vec_id, 'dtag', 1, f.rank, w FROM embeddings q JOIN first f USING (label) JOIN idf USING (label) WHERE q.vec_id % 50 = 0 AND f.rank <= 20),
      fused AS (SELECT query_id, vec_id, round(sum(w / (60 + rank)), 9) AS rrf, min(rank) AS best_rank, arg_min(arm, o) AS arm, count(*) AS n_arms FROM arms GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best_rank, vec_id) AS rank FROM fused) SELECT query_id, vec_id, round(rrf, 6) AS rrf, best_rank, arm, n_arms, rank FROM r WHERE rank <= 20""",
    "union_of_arms": f"""WITH {SCORED}, {CASCADE}, a AS (SELECT query_id, doc_id, paragraph_index, round(score, 6) AS score, 'or' AS arm, row_number() OVER (PARTITION BY query_id ORDER BY {_PLACE}) AS i FROM found),
      b AS (SELECT query_id, doc_id, paragraph_index, round(score, 6) + 0.1::DOUBLE AS score, 'cascade' AS arm, row_number() OVER (PARTITION BY query_id ORDER BY {_PLACE}) AS i FROM c),
      u AS (SELECT * FROM a WHERE i <= 10 UNION ALL SELECT * FROM b WHERE i <= 10), x AS (SELECT query_id, doc_id, paragraph_index, max(score) AS score, arg_max(arm, score) AS arm FROM u GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_PLACE}) AS position FROM x) SELECT query_id, doc_id, paragraph_index, round(score, 6) AS score, arm, position FROM r WHERE position <= 20""",
    "assembled_answer": f"""WITH {SCORED}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_PLACE}) AS r FROM found),
      l AS (SELECT query_id, doc_id * 1000000 + paragraph_index AS id, {AUTHORITY} AS authority_level, score AS sim, text, {_KEY.format("text", 200)} AS content_key, doc_id::VARCHAR || '/' || page_number::VARCHAR AS page_key
        FROM top JOIN lines USING (doc_id, paragraph_index) LEFT JOIN labels USING (doc_id) WHERE r <= 60),
      sd AS (SELECT *, round((0.25::DOUBLE * sim + 0.1::DOUBLE * {_AUTH} + 0.05::DOUBLE * {_LENGTH}) / 0.4::DOUBLE, 6) AS score FROM l),
      first3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS i3 FROM sd) WHERE i3 <= 15), {_BALANCED.format(tier=_TIER, a=9, b=6)},
      cand AS (SELECT * FROM ordered WHERE score >= 0.18 AND position <= 15) {_picked("cand", 5)}""",
    "code_lookup": """WITH p AS (SELECT page_id, replace(regexp_extract(url, '/([a-z]{2}/[0-9]+)', 1), '/', '-') AS c FROM pages), q AS (SELECT page_id AS query_id, upper(c) AS c FROM p WHERE page_id % 5 = 0 AND regexp_matches(upper(c), '^([A-Z]{1,4}[.\\-_]?[A-Z0-9]{1,5}([.\\-_][A-Z0-9]{1,5})+|[A-Z][0-9]{4,5})$')),
      n AS (SELECT page_id AS doc_id, upper('page ' || c || ' copy') AS name FROM p), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM q JOIN n ON contains(name, c)) SELECT * FROM r WHERE rank <= 20""",
    "substring_hits": f"""WITH {LINES}, q AS (SELECT item_id, substring({NORM.format("text")}, 4, (6 + item_id % 4 * 10)::INT) AS p FROM benchmark), t AS (SELECT doc_id, {NORM.format("text")} AS n FROM lines)
      SELECT item_id, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM q JOIN t ON contains(n, p) WHERE p <> '' GROUP BY 1""",
    "metadata_scope": f"""WITH {META}, q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'src' || (item_id % 3)::VARCHAR END AS p, CASE WHEN item_id % 5 = 0 THEN 'FR' END AS s, CASE WHEN item_id % 7 = 0 THEN 'Medicaid' END AS g,
        CASE WHEN item_id % 11 = 0 THEN 'payer_policy' END AS a FROM benchmark)
      SELECT query_id, count(doc_id) AS docs FROM q LEFT JOIN meta ON (p IS NULL OR payer = p OR (p = 'src1' AND payer IN ('src0', 'src2') AND state = 'FR')) AND (s IS NULL OR state = s) AND (g IS NULL OR program = g) AND (a IS NULL OR authority_level = a) GROUP BY 1""",
    **{name: _search_sql(o) for name, o in SEARCHES.items()},
    "search_scoped": _search_sql(SEARCHES["search"], scoped=True),
}
