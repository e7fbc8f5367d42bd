"""Registered queries of publishing, locating citations, and the text of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import documents, locate, publishing, registry, tagging
from tidemark.plans.corpus_queries import _CLASSES, _REGISTRY, _doc_tags, _line_tags, _lines, _meta, _registry, _told
from tidemark.plans.oracle import DOC_TAGS, LINES, META, NORM, STRIP, TAGS, T, TOK, WORDS, distinct
from tidemark.plans.understanding_queries import _PARTS, _PROFILES, _parts
from tidemark.sources.tables import read, telemetry


# -- publishing --
def _vectors(spark, d):
    """The embeddings as those of documents' first chunks (even) and facts (odd), by generator A, B or none."""
    i, label = F.col("vec_id"), F.col("label")
    generator = F.when(label % 3 == 0, "A").when(label % 3 == 1, "B")
    return read(spark, d, "embeddings").select((i % 120).alias("doc_id"), generator.alias("generator"), F.when(i % 2 == 0, "hierarchical").otherwise("fact").alias("source_type"), i.alias("source_id"))


def _paragraph_tags(spark, d):
    """The tags of lines as those of paragraphs, tagged twice; the later run is missing its p-tags."""
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("code")))).alias(f"{k}_tags")
    by = _line_tags(spark, d).groupBy("doc_id", "page_number", F.col("paragraph_index").alias("order_index")).agg(*map(of, "dpj"))
    later = by.where("order_index % 2 = 0").withColumns({"p_tags": F.array().cast("array<string>"), "created_at": F.lit(2)})
    return by.withColumn("created_at", F.lit(1)).unionByName(later)


def _published(spark, d):
    own = _vectors(spark, d)
    chunks = _lines(spark, d).where("paragraph_index < 4").select("doc_id", (F.col("doc_id") + 120 * F.col("paragraph_index")).alias("source_id"), "page_number", "paragraph_index", "text")
    facts = read(spark, d, "labels").select("doc_id", F.col("doc_id").alias("source_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
    asked = own.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "b").when(F.col("doc_id") % 12 == 0, "x").otherwise(" ").alias("generator")).distinct()
    docs = _meta(spark, d).select("doc_id", "payer", "state")
    return publishing.rows(own, publishing.generators(own, asked), chunks, facts, _paragraph_tags(spark, d), docs)


def publish_generators(spark, d):
    own = _vectors(spark, d)
    asked = own.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "b").when(F.col("doc_id") % 12 == 0, "x").otherwise(" ").alias("generator")).distinct()
    return publishing.generators(own, asked)


def served_rows(spark, d):
    tags = [F.array_join(F.coalesce(f"{k}_tags", F.array()), ",").alias(f"{k}_tags") for k in "dpj"]
    return _published(spark, d).select("doc_id", "source_type", "source_id", F.coalesce("page_number", F.lit(-1)).alias("page_number"), *tags, "payer", "state", "content_sha")


def publish_coverage(spark, d):
    return publishing.tag_coverage(_published(spark, d), _paragraph_tags(spark, d))


def replaced_rows(spark, d):
    stored = _lines(spark, d).select("doc_id", "paragraph_index", F.lit("old").alias("state"))
    new = _lines(spark, d).where("doc_id % 3 = 0 and paragraph_index < 2").select("doc_id", "paragraph_index", F.lit("new").alias("state"))
    return publishing.replace_rows(stored, new).groupBy("doc_id", "state").agg(F.count(F.lit(1)).alias("n"))


def embeddable_units(spark, d):
    i = F.col("doc_id")
    chunks = read(spark, d, "documents").select("doc_id", i.alias("source_id"), F.when(i % 3 == 0, F.concat(F.lit("about "), "source")).alias("summary"), "text")
    facts = read(spark, d, "labels").select("doc_id", i.alias("source_id"), F.concat(F.lit("fact "), i.cast("string")).alias("text"), F.when(i % 2 == 0, "all").alias("who_eligible"), F.when(i % 3 == 0, "").alias("how_verified"), F.when(i % 5 == 0, "none").alias("limitations"))
    found = publishing.embeddable(chunks, facts)
    return found.select("doc_id", "source_type", "source_id", F.sha2("text", 256).alias("text_sha"))


def resynced_payers(spark, d):
    rows = _lines(spark, d).select("doc_id", "paragraph_index", F.concat(F.lit("old "), (F.col("doc_id") % 3).cast("string")).alias("payer"))
    own = _meta(spark, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, None).otherwise(F.col("payer")).alias("payer"))
    return publishing.canonical_payers(rows, own).groupBy("doc_id", "payer").agg(F.count(F.lit(1)).alias("n"))


def reconciled_tags(spark, d):
    j = _doc_tags(spark, d).where("kind = 'j'").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "score")))).alias("j_tags"))
    own = read(spark, d, "documents").select("doc_id").join(j, "doc_id", "left")
    inherited = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "Alpha").otherwise("Gamma").alias("payor"))
    found = publishing.reconcile(own, inherited, F.when(F.col("payor") == "Alpha", "payor.alpha"))
    told = F.array_sort(F.transform(F.map_entries("j_tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))))
    return found.select("doc_id", F.array_join(told, ",").alias("j_tags"))


def embedding_backfill(spark, d):
    i = F.col("doc_id")
    results = read(spark, d, "documents").select("doc_id", F.when(i % 3 == 0, F.to_json(F.struct(F.lit("completed").alias("status")))).when(i % 3 == 1, '{"status": "failed"}').otherwise("{").alias("metadata"))
    jobs = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "done").otherwise("pending").alias("status"))
    return publishing.embedding_backfill(results, jobs)


def decided_phrases(spark, d):
    """Words of the questions as decisions on the tags that documents have."""
    entries = _doc_tags(spark, d).groupBy("kind", "code").agg(F.array(F.lit("alpha"), F.lit("beta")).alias("strong"), F.lit(7).cast("long").alias("revision"))
    phrase = F.element_at(F.array(*map(F.lit, ("alpha", "gamma", "delta"))), (F.col("item_id") % 3 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, ("claims.general", "state.fl", "new.code"))), (F.floor(F.col("item_id") / 3) % 3 + 1).cast("int"))
    decisions = read(spark, d, "benchmark").select(F.when(code == "state.fl", "j").otherwise("d").alias("kind"), code.alias("code"), phrase.alias("phrase"), F.when(phrase == "alpha", "rejected").otherwise("approved").alias("state"))
    return publishing.decide_phrases(entries, decisions).withColumn("strong", F.array_join("strong", ","))


# -- citations --
def _named(spark, d):
    """Documents by their first words."""
    return read(spark, d, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 70).alias("name"))


def title_locations(spark, d):
    asked = _named(spark, d).where("doc_id % 10 = 0").select(F.col("doc_id").alias("citation_id"), F.concat(F.lit("The "), F.substring("name", 1, 60)).alias("title"))
    return locate.by_title(asked, _named(spark, d), ["thereof", "onen", "einer", "que", "les"])


def url_locations(spark, d):
    pages = read(spark, d, "pages")
    asked = pages.select(F.col("page_id").alias("citation_id"), F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("?none"))).otherwise(F.col("url")).alias("url"))
    docs = pages.where("page_id % 3 = 0").select((F.col("page_id") + 5000).alias("doc_id"), "url")
    known = _registry(spark, d).select("url", "ingested_doc_id", F.when(F.col("first_seen") % 5 == 1, 403).otherwise(F.col("last_status")).alias("last_status"))
    return locate.by_url(asked, docs, known).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


def quote_locations(spark, d):
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("citation_id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.substring("text", 4, 75)).alias("quote"))
    return locate.by_quote(asked, _lines(spark, d))


def cited_passages(spark, d):
    i = F.col("doc_id")
    asked = read(spark, d, "documents").select(
        i.alias("citation_id"), "doc_id", F.when(i % 4 == 0, "ection 2").alias("section"), F.when(i % 3 == 0, F.substring("text", 30, 40)).alias("quote"), F.when(i % 2 == 0, i % 3 + 1).alias("page")
    )
    chunks = _lines(spark, d).withColumn("section", F.concat(F.lit("Section "), F.col("page_number").cast("string")))
    return locate.passages(asked, chunks).withColumn("excerpt", F.sha2("excerpt", 256))


def token_shares(spark, d):
    """How much of a question, and of a section's name, each document has."""
    items = read(spark, d, "benchmark")
    n = items.agg(F.max("item_id") + 1).scalar()
    docs = read(spark, d, "documents").withColumn("item_id", F.col("doc_id") % n)
    rows = docs.join(items.select("item_id", F.col("text").alias("asked")), "item_id")
    topic = locate.section_topic(F.concat(F.lit("10.2 "), F.substring("asked", 1, 60)))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.round(locate.meaningful_share(text, F.col("asked")), 6).alias("meaningful"), F.round(locate.section_share(text, topic), 6).alias("section"))


def sitemap_pages(spark, d):
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "Example").otherwise("Example Org").alias("payer"), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("pharmacy.formulary"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("eligibility.member"), F.lit("claims.timely_filing"))).otherwise(F.array().cast("array<string>")).alias("dcodes"))
    word = F.element_at(F.array(*map(F.lit, ("Pharmacy", "timely", "claims", "eligible"))), (F.col("first_seen") % 4 + 1).cast("int"))
    pages = _registry(spark, d).select("payer", F.concat("url", F.lit("/"), word).alias("url"), "last_status", "curation_status", "ingested", "last_seen")
    return locate.sitemap_candidates(asked, pages)


def web_queries(spark, d):
    terms = locate.web_terms(_parts(spark, d), F.col("query_id") % 2 == 0)
    domain = F.when(F.col("query_id") % 2 == 0, "example.org")
    return terms.select("query_id", locate.web_query(F.lit("asked"), F.col("terms"), domain).alias("web_query"))


def reranked_hits(spark, d):
    pages = read(spark, d, "pages")
    hits = pages.select((F.col("page_id") % 20).alias("query_id"), F.col("page_id").alias("place"), "url", F.col("url").alias("title"), F.substring("html", 1, 300).alias("snippet"), F.lit("Example.org").alias("domain"), F.array(F.lit("the and"), F.lit("/EN/")).alias("terms"))
    return locate.rerank_hits(hits).select("query_id", "place", "hit_score", "new_place")


# -- texts --
def _spread(spark, d):
    """Documents with empty lines between their lines."""
    return read(spark, d, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n \n")).alias("text"))


def header_paragraphs(spark, d):
    found = documents.split_paragraphs(_spread(spark, d))
    return found.select("doc_id", "paragraph_index", F.coalesce("section", F.lit("-")).alias("section"), F.sha2("text", 256).alias("text_sha"))


def page_markdowns(spark, d):
    return _spread(spark, d).select("doc_id", F.sha2(documents.page_markdown(F.col("text")), 256).alias("markdown_sha"))


def normal_spans(spark, d):
    raw = F.concat(F.lit("  "), F.regexp_replace(F.coalesce("text", F.lit("")), " ", "  "))
    rows = read(spark, d, "documents").select("doc_id", raw.alias("raw"), (F.col("doc_id") % 50).cast("int").alias("a"))
    span = documents.normal_span(F.col("raw"), F.col("a"), F.col("a") + 40)
    return rows.select("doc_id", F.sha2(documents.normal_page(F.col("raw")), 256).alias("normal_sha"), F.coalesce(span["start"], F.lit(-1)).cast("long").alias("start"), F.coalesce(span["end"], F.lit(-1)).cast("long").alias("end"))


def fact_spans(spark, d):
    """Facts are words of the text with one blank between them, in texts that have two."""
    page = F.regexp_replace(F.coalesce("text", F.lit("")), " ", "  ")
    i = F.col("doc_id")
    fact = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), (i % 5 + 3).cast("int"), 4), " ")
    span = documents.fact_span(fact, page, F.when(i % 3 == 0, 2), F.when(i % 3 == 0, 9))
    return read(spark, d, "documents").select("doc_id", F.coalesce(span["start"], F.lit(-1)).cast("long").alias("start"), F.coalesce(span["end"], F.lit(-1)).cast("long").alias("end"))


EXTRACTION = StructType().add("summary", "string").add("k", "long")


def parsed_responses(spark, d):
    k = F.col("k")
    body = F.concat(F.lit('{"summary": "s'), k.cast("string"), F.lit('", "k": '), k.cast("string"))
    response = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).when(k % 5 == 1, F.concat(F.lit("Sure: "), body, F.lit("} bye"))).when(k % 5 == 2, F.concat(body, F.lit("}")))
        .when(k % 5 == 3, "no braces").otherwise(F.concat(F.lit(" "), body, F.lit(', "facts": []} trailing {'))).alias("response")
    )
    got = documents.parsed(F.col("response"), EXTRACTION)
    return telemetry(read(spark, d, "events")).select("event_id", response).select("event_id", F.coalesce(got["summary"], F.lit("-")).alias("summary"), F.coalesce(got["k"], F.lit(-1)).alias("k"))


def critiques(spark, d):
    k = F.col("k")
    raw = F.when(k % 4 == 0, F.concat(F.lit('{"pass": true, "score": '), (k / 40.0).cast("string"), F.lit(', "category_assessment": {"tone": {"score": 2, "note": "n"}, "facts": {"score": "x"}}}'))).when(k % 4 == 1, '{"score": "bad", "confidence": 0.25}').when(k % 4 == 2, '{"score": -3}').otherwise("nothing")
    c = documents.critique(F.col("raw"), ["tone", "facts"])
    rows = telemetry(read(spark, d, "events")).select("event_id", raw.alias("raw")).select("event_id", c.alias("c"))
    told = F.array_join(F.transform(F.map_entries("c.categories"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.1f", e["value"]))), ",")
    return rows.select("event_id", "c.passed", F.round("c.score", 6).alias("score"), "c.confidence", told.alias("categories"))


def error_classes(spark, d):
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ("llm_failure", "json_parse_error", "database_error", "stream_error", "persistence_error", "other", "surprise"))), (k % 7 + 1).cast("int"))
    severity, stage = documents.error_class(kind, k % 2 == 0)
    due = documents.half_a_year_on(F.to_date("ts")).cast("string")
    return telemetry(read(spark, d, "events")).select("event_id", severity.alias("severity"), stage.alias("stage"), due.alias("due"))


def file_classes(spark, d):
    i = F.col("doc_id")
    name = F.concat("source", F.lit("_"), F.element_at(F.array(*map(F.lit, ("Provider-Manual", "fee_schedule", "notes", "Member_Handbook"))), (i % 4 + 1).cast("int")), F.lit("-"), "lang", F.lit(".PDF"))
    files = read(spark, d, "documents").select(i.alias("file_id"), name.alias("name"), F.lit("ctx").alias("context_payer"), F.when(i % 2 == 0, "FL").alias("context_state"), F.lit(None).cast("string").alias("context_program"))
    found = registry.classify_files(files, [("^src1[0-9]? ", "Source One"), ("^src2 ", "Source Two")], [("provider manual", "provider_manual", "contract_source_of_truth"), ("manual|handbook", "handbook", "payer_policy"), ("fee schedule", "fee_schedule", "payer_policy")], [(" fr$", "FR")], [("member", "Medicaid")])
    return found.select("file_id", *(F.coalesce(c, F.lit("-")).alias(c) for c in found.columns[1:]))


def inherited_pool(spark, d):
    """The pool of two payers' tags with the documents that another authority's tags add."""
    pool = tagging.cascade_pool(_doc_tags(spark, d), {"j": ["payor.beta", "payor.alpha"], "d": ["pharmacy.formulary", "claims.general"], "p": ["authorization.prior"]}, "state.fl")
    return tagging.with_inherited(pool, _doc_tags(spark, d).where("code = 'payor.alpha'"), cap=300)


QUERIES = {f.__name__: f for f in (
    publish_generators, served_rows, publish_coverage, replaced_rows, embeddable_units, resynced_payers, reconciled_tags, embedding_backfill, decided_phrases, title_locations, url_locations,
    quote_locations, cited_passages, token_shares, sitemap_pages, web_queries, reranked_hits, header_paragraphs, page_markdowns, normal_spans, fact_spans, parsed_responses, critiques,
    error_classes, file_classes, inherited_pool,
)}

_GENERATORS = """emb AS (SELECT vec_id % 120 AS doc_id, CASE WHEN label % 3 = 1 THEN 'B' ELSE 'A' END AS g, CASE WHEN vec_id % 2 = 0 THEN 'hierarchical' ELSE 'fact' END AS source_type, vec_id AS source_id FROM embeddings),
chosen AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'B' WHEN doc_id % 12 = 0 THEN 'A' ELSE min(g) END AS generator FROM emb GROUP BY doc_id)"""
_PTAGS = """pt0 AS (SELECT doc_id, page_number, paragraph_index, """ + ", ".join(f"coalesce(list_sort(list(code) FILTER (kind = '{k}')), []) AS {k}" for k in "dpj") + """ FROM line_tags GROUP BY 1, 2, 3),
ptags AS (SELECT doc_id, page_number, paragraph_index, d, CASE WHEN paragraph_index % 2 = 0 THEN [] ELSE p END AS p, j FROM pt0)"""
_SERVED = f"""WITH {TAGS}, {_PTAGS}, {_GENERATORS}, {META},
src AS (SELECT doc_id, 'hierarchical' AS source_type, doc_id + 120 * paragraph_index AS source_id, page_number, paragraph_index, text FROM lines WHERE paragraph_index < 4
  UNION ALL SELECT doc_id, 'fact', doc_id, NULL, NULL, 'quality ' || quality::VARCHAR FROM labels),
served AS (SELECT e.doc_id, e.source_type, e.source_id, s.page_number, coalesce(d, []) AS d, coalesce(p, []) AS p, coalesce(j, []) AS j, payer, state, sha256(e.doc_id::VARCHAR || '‖' || e.source_type || '‖' || e.source_id::VARCHAR || '‖' || text) AS content_sha
  FROM emb e JOIN chosen c ON e.doc_id = c.doc_id AND e.g = c.generator JOIN src s ON s.doc_id = e.doc_id AND s.source_type = e.source_type AND s.source_id = e.source_id JOIN meta m ON m.doc_id = e.doc_id
  LEFT JOIN ptags t ON t.doc_id = e.doc_id AND t.page_number = s.page_number AND t.paragraph_index = s.paragraph_index)"""
_TITLE_TOKENS = distinct("list_filter(" + TOK + ", lambda t: length(t) >= 3 AND t NOT IN ('the', 'a', 'an', 'of', 'for', 'and', 'or', 'in', 'on', 'to', 'with', 'from', 'by', 'at', 'is', 'are', 'this', 'that'))")
_tokens = lambda x: _TITLE_TOKENS.replace("{}", x)


def _share(asked: str, stops: str) -> str:
    wanted = f"list_distinct(list_filter({TOK.format(asked)}, lambda t: length(t) >= 4 AND t NOT IN ({stops})))"
    return f"coalesce(len(list_intersect({wanted}, {TOK.format('text')})) / nullif(len({wanted}), 0), 0)"


_quote = lambda ws: ", ".join(f"'{w}'" for w in ws.split())
_SPREAD = "docs AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || ' ' || chr(10)) AS text FROM documents)"
_BLOCKS = f"blocks AS (SELECT doc_id, i, {STRIP.format('b')} AS b FROM (SELECT doc_id, unnest(s) AS b, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, regexp_split_to_array({STRIP.format('text')}, '\\n\\s*\\n+') AS s FROM docs)))"
_REST = STRIP.format("array_to_string(list_slice(string_split(b, chr(10)), 2, NULL), chr(10))")
_FIRST = STRIP.format("string_split(b, chr(10))[1]")
_PAGE = "regexp_replace({}, ' ', '  ', 'g')"
_NORMAL = "regexp_replace(regexp_replace(array_to_string(list_transform(string_split({}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"

SQL = {
    "publish_generators": f"WITH {_GENERATORS} SELECT * FROM chosen",
    "served_rows": f"{_SERVED} SELECT doc_id, source_type, source_id, coalesce(page_number, -1) AS page_number, array_to_string(d, ',') AS d_tags, array_to_string(p, ',') AS p_tags, array_to_string(j, ',') AS j_tags, payer, state, content_sha FROM served",
    "publish_coverage": f"""{_SERVED}, s AS (SELECT doc_id, """ + ", ".join(f"count(*) FILTER (len({k}) > 0) AS {k}" for k in "dpj") + """ FROM pt0 GROUP BY 1), r AS (SELECT doc_id, count(*) AS rows, """ + ", ".join(f"count(*) FILTER (len({k}) > 0) AS j{k}" for k in "dpj") + """ FROM served GROUP BY 1),
      x AS (""" + " UNION ALL ".join(f"SELECT doc_id, rows, '{k}' AS kind, j{k} AS joined, coalesce({k}, 0) AS source FROM r LEFT JOIN s USING (doc_id)" for k in "dpj") + """) SELECT *, source > 0 AND joined = 0 AS missed FROM x""",
    "replaced_rows": f"WITH {LINES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state, count(*) AS n FROM lines WHERE doc_id % 3 <> 0 OR paragraph_index < 2 GROUP BY 1, 2",
    "embeddable_units": """SELECT doc_id, 'hierarchical' AS source_type, doc_id AS source_id, sha256(CASE WHEN doc_id % 3 = 0 AND coalesce(text, '') <> '' THEN 'about ' || source || chr(10) || text ELSE coalesce(text, '') END) AS text_sha FROM documents
      UNION ALL SELECT doc_id, 'fact', doc_id, sha256('fact ' || doc_id::VARCHAR || CASE WHEN doc_id % 2 = 0 OR doc_id % 5 = 0 THEN chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Who eligible: all' ELSE '' END || CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE '' END
        || CASE WHEN doc_id % 5 = 0 THEN 'Limitations: none' ELSE '' END ELSE '' END) FROM labels""",
    "resynced_payers": f"WITH {LINES}, {META} SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'old ' || (doc_id % 3)::VARCHAR ELSE payer END AS payer, count(*) AS n FROM lines JOIN meta USING (doc_id) GROUP BY 1, 2",
    "reconciled_tags": f"""WITH {DOC_TAGS}, st AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), j AS (SELECT doc_id, code, score::BIGINT AS v FROM doc_tags WHERE kind = 'j' AND NOT (code = 'payor.alpha' AND doc_id IN (SELECT doc_id FROM st)) UNION ALL SELECT doc_id, 'payor.alpha', 1 FROM st WHERE doc_id IN (SELECT doc_id FROM documents))
      SELECT d.doc_id, coalesce(string_agg(code || '=' || v::VARCHAR, ',' ORDER BY code || '=' || v::VARCHAR), '') AS j_tags FROM documents d LEFT JOIN j USING (doc_id) GROUP BY 1""",
    "embedding_backfill": "SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)",
    "decided_phrases": f"""WITH {DOC_TAGS}, e AS (SELECT DISTINCT kind, code FROM doc_tags), d AS (SELECT DISTINCT CASE item_id // 3 % 3 WHEN 1 THEN 'j' ELSE 'd' END AS kind, CASE item_id // 3 % 3 WHEN 0 THEN 'claims.general' WHEN 1 THEN 'state.fl' ELSE 'new.code' END AS code, item_id % 3 AS p FROM benchmark),
      g AS (SELECT kind, code, list(CASE p WHEN 1 THEN 'gamma' WHEN 2 THEN 'delta' END) FILTER (p > 0) AS a, bool_or(p = 0) AS r FROM d GROUP BY 1, 2),
      n AS (SELECT kind, code, e.code IS NULL AS new, list_sort(list_filter(list_distinct(list_concat(CASE WHEN e.code IS NULL THEN [] ELSE ['alpha', 'beta'] END, coalesce(a, []))), lambda x: NOT (coalesce(r, false) AND x = 'alpha'))) AS s FROM e FULL JOIN g USING (kind, code))
      SELECT kind, code, array_to_string(s, ',') AS strong, CASE WHEN new OR s <> ['alpha', 'beta'] THEN 8 ELSE 7 END::BIGINT AS revision FROM n""",
    "title_locations": f"""WITH n AS (SELECT doc_id, substring(coalesce(text, ''), 1, 70) AS name FROM documents), a AS (SELECT doc_id AS citation_id, {_tokens("'The ' || substring(name, 1, 60)")} AS a FROM n WHERE doc_id % 10 = 0),
      b AS (SELECT doc_id, length(name) AS size, {_tokens("name")} AS b FROM n), p AS (SELECT *, len(list_intersect(a, b)) AS common FROM a, b WHERE list_has_any(a, b)),
      s AS (SELECT *, round(common / least(len(a), len(b)), 6) AS overlap, list_intersect(a, ['thereof', 'onen', 'einer', 'que', 'les']) AS pa, list_intersect(b, ['thereof', 'onen', 'einer', 'que', 'les']) AS pb FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY common = len(a) DESC, overlap DESC, size, doc_id) AS i FROM s)
      SELECT citation_id, doc_id, overlap, CASE WHEN overlap >= 0.9::DOUBLE THEN 'title_strict' ELSE 'title_relaxed' END AS method FROM r WHERE i = 1 AND overlap >= 0.65::DOUBLE AND common >= 2 AND NOT (len(pa) > 0 AND len(pb) > 0 AND NOT list_has_any(pa, pb))""",
    "url_locations": f"""WITH {_REGISTRY}, o AS (SELECT url, min(page_id) + 5000 AS own FROM pages WHERE page_id % 3 = 0 GROUP BY 1), c AS (SELECT page_id AS citation_id, CASE WHEN page_id % 4 = 0 THEN url || '?none' ELSE url END AS url FROM pages)
      SELECT citation_id, coalesce(own, CASE WHEN ingested THEN id END, -1) AS doc_id, CASE WHEN own IS NOT NULL OR ingested THEN 'doc_ingested' WHEN (CASE WHEN id % 5 = 1 THEN 403 ELSE last_status END) IN (401, 403, 451) THEN 'sitemap_robots_blocked' ELSE 'sitemap_needs_scrape' END AS kind,
        CASE WHEN own IS NOT NULL THEN 'url_exact_doc' ELSE 'url_exact_sitemap' END AS method FROM c LEFT JOIN o USING (url) LEFT JOIN reg USING (url) WHERE own IS NOT NULL OR id IS NOT NULL""",
    "quote_locations": f"""WITH {LINES}, q AS (SELECT item_id AS citation_id, {NORM.format("CASE WHEN item_id % 2 = 0 THEN text ELSE substring(text, 4, 75) END")} AS q FROM benchmark), p AS (SELECT citation_id, CASE WHEN length(q) <= 80 THEN q ELSE substring(q, 1, 60) END AS p FROM q),
      h AS (SELECT citation_id, doc_id, paragraph_index, row_number() OVER (PARTITION BY citation_id ORDER BY doc_id, paragraph_index) AS i FROM p JOIN (SELECT *, {NORM.format("text")} AS n FROM lines) ON contains(n, p) WHERE p <> '') SELECT citation_id, doc_id, paragraph_index FROM h WHERE i = 1""",
    "cited_passages": f"""WITH {LINES}, c AS (SELECT doc_id AS citation_id, doc_id, doc_id % 4 = 0 AS sec, CASE WHEN doc_id % 3 = 0 THEN substring(text, 30, 40) END AS quote, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 + 1 END AS page FROM documents),
      s AS (SELECT citation_id, page_number, paragraph_index, substring(l.text, 1, 600) AS excerpt, CASE WHEN sec AND contains('section ' || page_number::VARCHAR, 'ection 2') THEN 1 WHEN length(quote) >= 12 AND list_has_all({TOK.format("l.text")}, {TOK.format("quote")}) THEN 2 WHEN page_number = page THEN 3 WHEN page_number > 1 THEN 4 END AS step
        FROM c JOIN lines l USING (doc_id) WHERE length(l.text) >= 200), r AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY step, page_number, paragraph_index) AS i FROM s WHERE step IS NOT NULL)
      SELECT citation_id, page_number, paragraph_index, sha256(excerpt) AS excerpt, CASE step WHEN 1 THEN 'by_section' WHEN 2 THEN 'by_quote_tokens' WHEN 3 THEN 'by_page' ELSE 'doc_first_chunk' END AS method FROM r WHERE i = 1""",
    "token_shares": f"""WITH r AS (SELECT d.doc_id, coalesce(d.text, '') AS text, b.text AS asked FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = item_id)
      SELECT doc_id, round({_share("asked", _quote("what is the how does a an of for and or to in on with from by at do can will be are was were that"))}, 6) AS meaningful, round({_share("substring(asked, 1, 60)", _quote("the a an of for and or to in on with from by at is are be general overview information"))}, 6) AS section FROM r""",
    "sitemap_pages": f"""WITH {_REGISTRY}, p AS (SELECT c.payer, reg.url || '/' || CASE id % 4 WHEN 0 THEN 'Pharmacy' WHEN 1 THEN 'timely' WHEN 2 THEN 'claims' ELSE 'eligible' END AS url, reg.last_status, reg.curation_status, reg.ingested, id FROM reg JOIN classes c ON c.page_id = id),
      t AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'Example' ELSE 'Example Org' END AS payer, CASE item_id % 3 WHEN 0 THEN ['pharmacy'] ELSE ['timely', 'filing'] END AS ws FROM benchmark WHERE item_id % 3 < 2),
      r AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY ingested DESC, id DESC, url) AS rank FROM t JOIN p ON t.payer = p.payer AND len(list_filter(ws, lambda w: contains(lower(url), w))) > 0 WHERE last_status = 200 AND curation_status NOT IN ('noise', 'stale')) SELECT * FROM r WHERE rank <= 3""",
    "web_queries": f"""WITH {DOC_TAGS}, {_PROFILES}, {_PARTS}, k AS (SELECT DISTINCT query_id, CASE WHEN term_kind = 'tag' THEN trim(lower(replace(string_split(term, '.')[-1], '_', ' '))) ELSE term END AS t FROM parts WHERE part = 'REQUIRED' AND (term_kind <> 'tag' OR query_id % 2 = 0 OR selectivity >= 0.95::DOUBLE))
      SELECT query_id, 'asked' || string_agg(' "' || t || '"', '' ORDER BY t) || CASE WHEN query_id % 2 = 0 THEN ' site:example.org' ELSE '' END AS web_query FROM k GROUP BY 1""",
    "reranked_hits": """WITH h AS (SELECT page_id % 20 AS query_id, page_id AS place, CASE WHEN contains(lower(url), 'example.org') THEN 2 ELSE 0 END + contains(lower(url || ' ' || substring(html, 1, 300)), 'the and')::INT + contains(lower(url || ' ' || substring(html, 1, 300)), '/en/')::INT AS hit_score FROM pages)
      SELECT query_id, place, hit_score::BIGINT AS hit_score, row_number() OVER (PARTITION BY query_id ORDER BY hit_score DESC, place) AS new_place FROM h""",
    "header_paragraphs": f"""WITH {_SPREAD}, {_BLOCKS}, f AS (SELECT *, {_FIRST} AS h FROM blocks WHERE b <> ''), p AS (SELECT doc_id, i, CASE WHEN head THEN h END AS section, CASE WHEN head THEN {_REST} ELSE b END AS t FROM (SELECT *, length(h) < 100 AND regexp_matches(h, ':$|^[A-Z][A-Z\\s]+:|^[0-9]+\\.\\s+[A-Z]') AS head FROM f)),
      k AS (SELECT * FROM p WHERE t <> '' AND NOT (length(t) < 80 AND NOT contains(t, chr(10)) AND NOT regexp_matches(t, '[.:]$') AND (regexp_matches(t, '^[0-9.]*\\s*[A-Z][a-z]*(\\s+[a-z]+)*\\s*$') OR len({WORDS.format("t")}) <= 6)))
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS paragraph_index, coalesce(section, '-') AS section, sha256(t) AS text_sha FROM k""",
    "page_markdowns": f"""WITH {_SPREAD}, {_BLOCKS}, f AS (SELECT *, {_FIRST} AS h FROM blocks WHERE b <> ''), m AS (SELECT doc_id, i, CASE WHEN length(h) <= 120 AND h <> '' AND (regexp_matches(h, ':$|^[A-Z][A-Z\\s]+:|^[0-9]+\\.\\s+[A-Z]|^[0-9]+\\.[0-9]+\\s+') OR (length(h) <= 60 AND NOT h LIKE '%.' AND regexp_matches(h, '^\\p{{Lu}}') AND len({WORDS.format("h")}) BETWEEN 1 AND 8))
        THEN '## ' || regexp_replace(h, ':+$', '') || CASE WHEN {_REST} <> '' THEN chr(10) || chr(10) || {_REST} ELSE '' END ELSE b END AS t FROM f)
      SELECT d.doc_id, sha256(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i), '')) AS markdown_sha FROM docs d LEFT JOIN m USING (doc_id) GROUP BY 1""",
    "normal_spans": f"""WITH r AS (SELECT doc_id, '  ' || {_PAGE.format("coalesce(text, '')")} AS raw, doc_id % 50 AS a FROM documents), n AS (SELECT doc_id, a, raw, {_NORMAL.format("raw")} AS n, {_NORMAL.format("substring(raw, (a + 1)::INT, 40)")} AS own FROM r),
      p AS (SELECT *, CASE WHEN a + 40 <= length(raw) AND own <> '' THEN instr(n, own) ELSE 0 END AS i FROM n) SELECT doc_id, sha256(n) AS normal_sha, CASE WHEN i > 0 THEN i - 1 ELSE -1 END AS start, CASE WHEN i > 0 THEN i - 1 + length(own) ELSE -1 END AS "end" FROM p""",
    "fact_spans": f"""WITH r AS (SELECT doc_id, {_PAGE.format("coalesce(text, '')")} AS page, array_to_string(list_slice(string_split(coalesce(text, ''), ' '), doc_id % 5 + 3, doc_id % 5 + 6), ' ') AS fact FROM documents), f AS (SELECT *, {_PAGE.format("fact")} AS w FROM r),
      g AS (SELECT *, fact = '' OR page = '' AS blank, doc_id % 3 = 0 AND 9 <= length(page) AND {NORM.format("substring(page, 3, 7)").replace("lower(", "(")} = {NORM.format("fact").replace("lower(", "(")} AS same, instr(page, w) AS i FROM f)
      SELECT doc_id, CASE WHEN blank OR same OR i = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 2 ELSE -1 END ELSE i - 1 END AS start, CASE WHEN blank OR same OR i = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 9 ELSE -1 END ELSE i - 1 + length(w) END AS "end" FROM g""",
    "parsed_responses": f"WITH {T} SELECT event_id, CASE WHEN k % 5 = 3 THEN '-' ELSE 's' || k::VARCHAR END AS summary, CASE WHEN k % 5 = 3 THEN -1 ELSE k END AS k FROM t",
    "critiques": f"""WITH {T} SELECT event_id, k % 4 = 0 AS passed, round(CASE k % 4 WHEN 0 THEN least(1, k / 40.0::DOUBLE) WHEN 2 THEN 0 ELSE 0.5::DOUBLE END, 6) AS score, CASE WHEN k % 4 = 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN k % 4 = 0 THEN 'tone=1.0' ELSE '' END AS categories FROM t""",
    "error_classes": f"""WITH {T} SELECT event_id, CASE WHEN k % 7 = 1 AND k % 2 = 0 THEN 'warning' WHEN k % 7 < 5 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN k % 7 IN (0, 1, 3) THEN 'extraction' WHEN k % 7 IN (2, 4) THEN 'persistence' ELSE 'other' END AS stage, (ts::DATE + 182)::DATE::VARCHAR AS due FROM t""",
    "file_classes": """SELECT doc_id AS file_id, CASE WHEN regexp_matches(source, '^src1[0-9]?$') THEN 'Source One' WHEN source = 'src2' THEN 'Source Two' ELSE 'ctx' END AS payer, CASE doc_id % 4 WHEN 0 THEN 'provider_manual' WHEN 1 THEN 'fee_schedule' WHEN 3 THEN 'handbook' ELSE '-' END AS asset_type,
      CASE doc_id % 4 WHEN 0 THEN 'contract_source_of_truth' WHEN 2 THEN '-' ELSE 'payer_policy' END AS authority_level, CASE WHEN lang = 'fr' THEN 'FR' WHEN doc_id % 2 = 0 THEN 'FL' ELSE '-' END AS state, CASE WHEN doc_id % 4 = 3 THEN 'Medicaid' ELSE '-' END AS program,
      CASE WHEN doc_id % 4 = 2 THEN 'none' ELSE 'high' END AS confidence FROM documents""",
    "inherited_pool": f"""WITH {DOC_TAGS}, f AS (SELECT doc_id, max((kind = 'd' AND code IN ('pharmacy.formulary', 'claims.general'))::INT) AS d, max((kind = 'j' AND code IN ('payor.beta', 'payor.alpha'))::INT) AS j, max((kind = 'p' AND code = 'authorization.prior')::INT) AS p, max((kind = 'j' AND code = 'state.fl')::INT) AS s FROM doc_tags GROUP BY 1),
      l AS (SELECT doc_id, CASE WHEN j + d + p = 3 THEN 1 WHEN j + d = 2 THEN 2 WHEN s + d = 2 THEN 3 WHEN s = 1 THEN 4 END AS level FROM f), q AS (SELECT doc_id, level FROM l WHERE level = (SELECT min(level) FROM l)),
      e AS (SELECT doc_id, level::BIGINT AS level, false AS inherited FROM q UNION ALL SELECT DISTINCT doc_id, (SELECT min(level) FROM q)::BIGINT, true FROM doc_tags WHERE code = 'payor.alpha' AND doc_id NOT IN (SELECT doc_id FROM q) AND (SELECT min(level) FROM q) IN (1, 2))
      SELECT * FROM e ORDER BY inherited, doc_id LIMIT 300""",
}
