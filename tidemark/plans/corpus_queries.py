"""Registered queries over documents, tags and pages, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import content_key
from tidemark.operators import corpus, lexical, ranking, registry, snapshots, tagging
from tidemark.plans.oracle import DOC_TAGS, HEAD, HOST, LEXICON, LINES, NORM, PATH, STRIP, TAGS, TOK, hits
from tidemark.sources.store import shared_folder, stored
from tidemark.sources.tables import metadata, read

LINE = ["doc_id", "paragraph_index"]
PARAGRAPH = ["doc_id", "page_number"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "lines", lambda s, d: corpus.lines(read(s, d, "documents")))


def _line_tags(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "line_tags", lambda s, d: tagging.tag_lines(_lines(s, d)))


def _doc_tags(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "document_tags", lambda s, d: tagging.propagate(_line_tags(s, d), PARAGRAPH, ["doc_id"]))


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return metadata(read(spark, d, "documents"), read(spark, d, "labels"))


def line_chunks(spark, d):
    return corpus.headings(_lines(spark, d)).select(*LINE, "page_number", F.sha2("text", 256).alias("text_sha"), "n_words", "is_heading")


def simple_paragraphs(spark, d):
    return corpus.simple_paragraphs(read(spark, d, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max("paragraph_index").alias("last_index"))


def glued_fragments(spark, d):
    return corpus.glue_fragments(_lines(spark, d)).select(*LINE, "n_parts", F.length("text").cast("long").alias("chars"))


def tag_lines(spark, d):
    return _line_tags(spark, d)


def tag_paragraphs(spark, d):
    return tagging.propagate(_line_tags(spark, d), LINE, PARAGRAPH)


def tag_documents(spark, d):
    return _doc_tags(spark, d)


def effective_tags(spark, d):
    return tagging.effective_tags(_line_tags(spark, d), LINE + ["page_number"], PARAGRAPH, ["doc_id"])


def inherited_overlay(spark, d):
    alpha = read(spark, d, "documents").where("source = 'src0'").select("doc_id", F.lit("j").alias("kind"), F.lit("payor.alpha").alias("code"))
    return tagging.overlay(_doc_tags(spark, d), alpha)


def tag_statistics(spark, d):
    found = tagging.tag_statistics(_doc_tags(spark, d), read(spark, d, "documents"))
    return found.select("kind", "code", "n_docs", F.round("idf", 6).alias("idf"), F.round("selectivity", 6).alias("selectivity"))


def gate_probe(spark, d):
    return tagging.gate_probe(_doc_tags(spark, d), {"d": ["claims.general"], "j": ["state.fl"], "p": ["authorization.prior"]})


def cascade_pool(spark, d):
    return tagging.cascade_pool(_doc_tags(spark, d), {"j": ["payor.beta"], "d": ["pharmacy.formulary"], "p": ["appeals.filing"]}, "state.fl")


def theme_buckets(spark, d):
    found = tagging.theme_buckets(_lines(spark, d), _doc_tags(spark, d))
    return found.withColumn("share", F.round("share", 6))


def most_specific_tag(spark, d):
    return tagging.most_specific(_doc_tags(spark, d))


def phrase_precision(spark, d):
    found = tagging.phrase_precision(read(spark, d, "documents"), _doc_tags(spark, d))
    return found.withColumn("precision", F.round("precision", 6))


def candidates(spark, d):
    found = tagging.candidates(corpus.document_lines(read(spark, d, "documents")))
    return found.withColumn("confidence", F.round("confidence", 6))


def generic_words(spark, d):
    lines = _lines(spark, d).select(F.col("text").alias("phrase"))
    known = read(spark, d, "benchmark").select(F.col("text").alias("phrase"))
    return tagging.generic_words(lines, known)


def content_dedup(spark, d):
    kept = corpus.first_of_copies(read(spark, d, "documents").select("doc_id", "text"), 400, ["doc_id"])
    return kept.select("doc_id", F.sha2("content_key", 256).alias("key_sha"))


def neighbour_band_join(spark, d):
    lines = _lines(spark, d)
    seeds = _line_tags(spark, d).where("code = 'payor.beta'").select(*LINE, "page_number").distinct()
    return ranking.neighbours(seeds, lines.select(*LINE, "page_number"), 3, 1).select("doc_id", "seed_paragraph", "paragraph_index")


def neighbour_context(spark, d):
    seeds = _line_tags(spark, d).where("code = 'payor.beta'").select(*LINE, "page_number").distinct()
    found = ranking.neighbour_text(seeds, _lines(spark, d))
    return found.select("doc_id", "seed_paragraph", F.sha2("context", 256).alias("context_sha"))


def published_rows(spark, d):
    return registry.published_rows(_lines(spark, d), _line_tags(spark, d)).select(*LINE, "tags", "content_sha")


def published_snapshot(spark, d):
    """The version that is current after four moves: all rows; every fifth document replaced and every eleventh taken out; every seventh replaced; and back to the second."""
    rows = registry.published_rows(_lines(spark, d), _line_tags(spark, d)).select("doc_id", "paragraph_index", "tags", "content_sha")
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    again = lambda n, mark: rows.where((F.col("doc_id") % n == 0) & (F.col("doc_id") % 11 != 0)).withColumn("content_sha", F.sha2(F.concat(F.lit(mark), F.col("content_sha")), 256))
    snapshots.publish(rows, path)
    second = snapshots.publish(again(5, "second "), path, gone=rows.where("doc_id % 11 = 0").select("doc_id").distinct())
    snapshots.publish(again(7, "third "), path)
    snapshots.go_back(spark, path, second)
    return snapshots.read(spark, path, rows.schema)


def verify_published(spark, d):
    rows = registry.published_rows(_lines(spark, d), _line_tags(spark, d))
    stored = rows.where("page_number <> 2")
    return registry.verify_published(rows, stored)


#: The test pages' hosts, as an example of a table of payers by host.
HOSTS = {"example.com": ("Example", "FL"), "example.org": ("Example Org", None)}


def url_classes(spark, d):
    return registry.classify_urls(read(spark, d, "pages"), HOSTS)


def corpus_hosts(spark, d):
    pages = read(spark, d, "pages")
    even = F.col("page_id") % 2 == 0
    docs = pages.select(F.col("page_id").alias("doc_id"), F.when(even, F.col("url")).otherwise("uploads/x").alias("file_path"), F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("source_url"))
    known = pages.where("page_id % 5 = 0").select(F.col("page_id").alias("ingested_doc_id"), registry.host(F.col("url")).alias("host"))
    return registry.corpus_hosts(docs, known, read(spark, d, "documents").where("lang = 'en'"))


def _registry(spark, d):
    """The pages as a registry: those of a host, each seen at its id."""
    pages = read(spark, d, "pages").select("page_id", "url", F.sha2("html", 256).alias("content_hash"))
    c = registry.url_class(F.col("url"), HOSTS)
    return pages.select("page_id", "url", "content_hash", c.alias("c")).groupBy("url").agg(F.min(F.struct("page_id", "content_hash", "c")).alias("p")).select(
        "url", "p.c.*", F.col("p.page_id").alias("first_seen"), F.col("p.page_id").alias("last_seen"), (200 + F.col("p.page_id") % 3 * 150).alias("last_status"),
        F.lit(1).cast("long").alias("attempts"), "p.content_hash", F.lit(None).cast("long").alias("content_changed_at"),
        F.when(F.col("p.page_id") % 7 == 0, "canonical").when(F.col("p.page_id") % 11 == 0, "noise").otherwise("auto").alias("curation_status"),
        F.when(F.col("p.page_id") % 4 == 0, "payer_policy").alias("curated_authority"), F.when(F.col("p.page_id") % 6 == 0, F.array(F.lit("claims"))).alias("topic_tags"),
        (F.col("p.page_id") % 2 == 0).alias("ingested"), F.when(F.col("p.page_id") % 2 == 0, F.col("p.page_id")).alias("ingested_doc_id"),
    )


def registry_upsert(spark, d):
    """All pages sighted by host over an empty registry, then the later half again with other bodies."""
    pages = read(spark, d, "pages")
    seen = pages.select(
        F.concat(F.lit("https://"), registry.host(F.col("url")), F.lit("/start")).alias("url"), F.col("page_id").alias("at"), F.when(F.col("page_id") % 5 != 0, 200).cast("long").alias("status"),
        F.sha2((F.col("page_id") % 3).cast("string"), 256).alias("content_hash"), F.when(F.col("page_id") % 9 == 0, "Hinted").alias("payer_hint"), F.lit(None).cast("string").alias("state_hint"), F.lit(None).cast("string").alias("authority_hint"),
    )
    none = _registry(spark, d).limit(0)
    once = registry.upsert(none, seen.where("at % 2 = 0"), HOSTS)
    twice = registry.upsert(once, seen.where("at % 2 = 1"), HOSTS)
    return twice.select("url", "host", "payer", "state", "first_seen", "last_seen", F.coalesce("last_status", F.lit(-1)).alias("status"), "attempts", "content_hash", F.coalesce("content_changed_at", F.lit(-1)).alias("changed_at"), "curation_status")


def registry_stats(spark, d):
    return registry.registry_stats(_registry(spark, d))


def curated_sources(spark, d):
    rows = _registry(spark, d)
    edits = rows.where("first_seen % 10 = 3").select("url", F.when(F.col("first_seen") % 20 == 3, "stale").alias("curation_status"), F.when(F.col("first_seen") % 40 == 3, "").alias("curated_authority"), F.when(F.col("first_seen") % 30 == 3, F.array(F.lit("appeals"))).alias("topic_tags"))
    done = registry.mark_ingested(registry.curate(rows, edits), rows.where("first_seen % 13 = 0").select("url", (F.col("first_seen") + 1000).alias("doc_id")))
    return done.select("url", "curation_status", F.coalesce("curated_authority", F.lit("-")).alias("curated_authority"), F.array_join(F.coalesce("topic_tags", F.array()), ",").alias("topics"), "ingested", F.coalesce("ingested_doc_id", F.lit(-1)).alias("ingested_doc_id"))


def source_search(spark, d):
    where = registry.reachable(F.col("last_status")) & (registry.has_authority("payer_policy") | registry.has_topic("claims"))
    return registry.find_sources(_registry(spark, d), where, most=40).select("url", "position")


def source_text_search(spark, d):
    return registry.find_sources(_registry(spark, d), text="example com en", most=40).select("url", "position")


def registry_latest(spark, d):
    pages = read(spark, d, "pages").select("page_id", registry.host(F.col("url")).alias("host"), F.length("html").cast("long").alias("size"))
    return registry.latest(pages, ["host"], [F.desc("size"), F.col("page_id")])


def page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", corpus.page_title(F.col("html"), F.col("url")).alias("title"))


def payer_scope(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("source").alias("payer"), F.col("lang").alias("state"))
    return registry.payer_scope(rows, "src1", ["src0", "src2"], "fr")


def orphan_embeddings(spark, d):
    stored, current = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), read(spark, d, "labels").select("doc_id")
    return registry.orphans(stored, current, "doc_id")


def authority_rerank(spark, d):
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    level = F.when(F.col("quality") == 1, "contract_source_of_truth").when(F.col("quality") == 0, "payer_policy").otherwise("unknown")
    sim = F.col("doc_id") % 100 / 100.0
    score = ranking.rerank_score(ranking.arm_similarity(F.lit("vector"), sim), ranking.authority_score(level), ranking.length_score(F.col("text")), boosted=F.col("lang") == "de")
    rounded = F.round(score, 6)
    return docs.select("doc_id", rounded.alias("score"), ranking.confidence_label(rounded).alias("label"), ranking.authority_tier(level).alias("tier"))


def decay_and_cap(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source", "lang", (F.col("n_chars") % 1000 / 1000.0).alias("score"))
    kept = ranking.decay_filter(rows, ["source", "lang"], "score")
    return ranking.per_document_cap(kept, ["lang"], "source", [F.desc("score"), F.col("doc_id")], 20, 50).select("doc_id", "lang", "source", "position")


def quote_hits(spark, d):
    found = lexical.quotes(read(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), "text"), read(spark, d, "documents").select("doc_id", "text"))
    return found.select(F.col("quote_id").alias("item_id"), "doc_id", "shared", F.round("part", 6).alias("part"))


QUERIES = {f.__name__: f for f in (
    line_chunks, simple_paragraphs, glued_fragments, tag_lines, tag_paragraphs, tag_documents, effective_tags, inherited_overlay, tag_statistics, gate_probe,
    cascade_pool, theme_buckets, most_specific_tag, phrase_precision, candidates, generic_words, content_dedup, neighbour_band_join,
    neighbour_context, published_rows, published_snapshot, verify_published, url_classes, corpus_hosts, registry_upsert, registry_stats, curated_sources, source_search,
    source_text_search, registry_latest, page_titles, payer_scope, orphan_embeddings, authority_rerank, decay_and_cap, quote_hits,
)}


def _grams() -> str:
    one = """SELECT doc_id, is_heading, list_slice(w, i, i + {n} - 1) AS own, array_to_string(list_slice(w, i, i + {n} - 1), ' ') AS gram FROM
      (SELECT doc_id, is_heading, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM words WHERE len(w) >= {n})"""
    return " UNION ALL ".join(one.format(n=n) for n in (2, 3, 4))


_list = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_ALONE = _list("""is are was were be been being have has had do does did will would could should may might must shall can the a an and or but if then else when what which who whom whose
  where why how that this these those it its as at by for with to from of in on into through during before after above below between under again further each both few more most other some such no not
  only own same so than too very just also please thank you we they our your their""".split())
_COMMON = _list(("thank you", "please contact", "as follows", "for more information", "in order to", "prior to", "in accordance with", "with respect to", "due to", "as well as", "such as", "as of",
  "in addition to", "in the event", "as required", "as applicable", "if applicable", "as needed", "at least", "at the time", "a copy of", "a member", "a provider", "a copy", "and provider", "and providers",
  "and services", "are required", "are required to", "in order", "of the", "to the", "for the", "with the", "access to", "accordance with", "along with", "and appeals", "and behavioral", "and behavioral health"))
_PLAIN = _list("i ii iii iv v vi vii viii ix x id pdf url faq usa etc inc llc ltd tel fax www http https org com gov edu".split())


def _told(tag: str) -> str:
    inner = f"regexp_replace(regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1), '<[^>]*>', '', 'g')"
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&")):
        inner = f"replace({inner}, '{name}', '{mark}')"
    return f"trim(regexp_replace({inner}, '\\s+', ' ', 'g'))"


def _key(host: str) -> str:
    bare = f"regexp_replace({host}, '^(www|www-es)\\.', '')"
    parts = f"string_split({bare}, '.')"
    return f"CASE WHEN {bare} IN ('example.com', 'example.org') OR len({parts}) <= 2 THEN {bare} ELSE {parts}[-2] || '.' || {parts}[-1] END"


_payer = lambda host: f"CASE {_key(host)} WHEN 'example.com' THEN 'Example' WHEN 'example.org' THEN 'Example Org' END"
_state = lambda host: f"CASE {_key(host)} WHEN 'example.com' THEN 'FL' END"
_CLASSES = f"""parts AS (SELECT page_id, url, html, {HOST} AS host, CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END AS path FROM pages),
classes AS (SELECT page_id, url, html, host, path, {_payer("host")} AS payer,
  coalesce({_state("host")}, CASE lower(regexp_extract(path, '^/([^/]+)', 1)) WHEN 'florida' THEN 'FL' WHEN 'fl' THEN 'FL' WHEN 'texas' THEN 'TX' WHEN 'tx' THEN 'TX' WHEN 'california' THEN 'CA' WHEN 'ca' THEN 'CA' WHEN 'georgia' THEN 'GA' WHEN 'ga' THEN 'GA' END) AS state,
  CASE WHEN regexp_matches(path, '(?i)/(billing|provider)[-_ ]manual|/pro[-_ ]?pe[-_ ]?manual') THEN 'payer_manual'
    WHEN regexp_matches(path, '(?i)/utilization[-_ ]management|/payment[-_ ]polic|/clinical[-_ ](polic|payment)|/criteria/|/preauth|/coverage[-_ ]polic') THEN 'payer_policy'
    WHEN regexp_matches(path, '(?i)fee[-_ ]?schedule') THEN 'fee_schedule' WHEN regexp_matches(path, '(?i)/member[-_ ]handbook|/members/') THEN 'member_handbook'
    WHEN regexp_matches(path, '(?i)/medicaid/recent_presentations') THEN 'training' END AS authority,
  nullif(lower(regexp_extract(path, '\\.([A-Za-z0-9]{{1,8}})$', 1)), '') AS extension,
  CASE WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]{{1,8}})$', 1)) IN ('pdf', 'doc', 'docx', 'xls', 'xlsx', 'ppt', 'pptx', 'rtf', 'txt') THEN 'doc' ELSE 'page' END AS content_kind FROM parts)"""
_REGISTRY = f"""{_CLASSES}, ids AS (SELECT url, min(page_id) AS id FROM pages GROUP BY 1),
reg AS (SELECT c.url, host, content_kind, authority, id, 200 + id % 3 * 150 AS last_status, CASE WHEN id % 7 = 0 THEN 'canonical' WHEN id % 11 = 0 THEN 'noise' ELSE 'auto' END AS curation_status,
  CASE WHEN id % 4 = 0 THEN 'payer_policy' END AS curated_authority, CASE WHEN id % 6 = 0 THEN 'claims' END AS topics, id % 2 = 0 AS ingested FROM classes c JOIN ids ON id = page_id)"""

SQL = {
    "glued_fragments": f"""WITH {LINES}, marked AS (SELECT *, {STRIP.format("text")} AS b FROM lines),
      flags AS (SELECT *, b <> '' AND length(b) < 40 AND regexp_matches(b, '\\b([A-Z][0-9]{{4}}|[0-9]{{5}})\\b') AND (
        regexp_matches(b, '(?i)\\b(add(ed)?|remov(ed)?|updat(ed)?|revis(ed)?|delet(ed)?|replac(ed)?|correct(ed)?)\\b[^.\n]*\\b(hcpcs|cpt|code)\\b') OR regexp_matches(b, '^([a-z(\\[]|(and|or|to|through|thru)\\b)')) AS fragment FROM marked),
      islands AS (SELECT *, sum((NOT fragment)::INT) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS island FROM flags)
      SELECT doc_id, min(paragraph_index) AS paragraph_index, count(*) AS n_parts, length(string_agg(text, chr(10) ORDER BY paragraph_index)) AS chars FROM islands GROUP BY doc_id, island""",
    "tag_statistics": f"""WITH {DOC_TAGS}, n AS (SELECT count(*) AS total FROM documents), s AS (SELECT kind, code, count(DISTINCT doc_id) AS n_docs FROM doc_tags GROUP BY ALL)
      SELECT kind, code, n_docs, round(ln(total / greatest(n_docs, 1)), 6) AS idf, round(1 - n_docs / total, 6) AS selectivity FROM s, n""",
    "gate_probe": f"""WITH {DOC_TAGS}, f AS (SELECT doc_id, max((kind = 'd' AND code = 'claims.general')::INT) AS d, max((kind = 'j' AND code = 'state.fl')::INT) AS j,
        max((kind = 'p' AND code = 'authorization.prior')::INT) AS p FROM doc_tags GROUP BY 1)
      SELECT count(*) FILTER (d = 1) AS d_docs, count(*) FILTER (j = 1) AS j_docs, count(*) FILTER (p = 1) AS p_docs,
        count(*) FILTER (d + j + p > 0) AS union_docs, count(*) FILTER (d + j + p = 3) AS intersection_docs FROM f""",
    "theme_buckets": f"""WITH {DOC_TAGS}, n AS (SELECT doc_id, count(*) AS c FROM lines GROUP BY 1), b AS (SELECT code, count(*) AS docs, sum(c)::BIGINT AS chunks FROM doc_tags JOIN n USING (doc_id) WHERE kind = 'd' GROUP BY 1),
      t AS (SELECT *, sum(chunks) OVER () AS total, max(chunks) OVER () AS first, count(*) OVER () AS themes, row_number() OVER (ORDER BY chunks DESC, code) AS i FROM b)
      SELECT code, docs, chunks, round(chunks / total, 6) AS share, least(themes, 5) <= 2 OR first / total >= 0.65::DOUBLE AS narrow FROM t WHERE i <= 5""",
    "most_specific_tag": f"""WITH {DOC_TAGS} SELECT doc_id, code FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY length(code) - length(replace(code, '.', '')) DESC, length(code) DESC, code DESC) AS n
      FROM doc_tags WHERE kind = 'd' AND string_split(code, '.')[-1] NOT IN ('general', 'info', 'information', 'misc', 'other')) WHERE n = 1""",
    "phrase_precision": f"""WITH {DOC_TAGS.replace("norm AS", "line_norm AS").replace("FROM norm ", "FROM line_norm ")}, norm AS MATERIALIZED (SELECT doc_id, {NORM.format("coalesce(text, '')")} AS n FROM documents),
      h AS (SELECT DISTINCT doc_id, phrase, kind, code FROM ({hits("doc_id", False)})),
      c AS (SELECT phrase, kind, code, count(*) AS df, count(t.doc_id) AS df_tagged FROM h LEFT JOIN doc_tags t USING (doc_id, kind, code) GROUP BY ALL),
      g AS (SELECT *, first_value(phrase) OVER (PARTITION BY kind, code ORDER BY df DESC, phrase) AS top FROM c WHERE df >= 100 AND df_tagged / df >= 0.85::DOUBLE)
      SELECT c.phrase, c.kind, c.code, c.df, c.df_tagged, round(c.df_tagged / c.df, 6) AS precision, CASE WHEN g.top = c.phrase THEN 'KEEP_CANONICAL'
        WHEN EXISTS (SELECT 1 FROM c o WHERE o.kind = c.kind AND o.code = c.code AND o.phrase <> c.phrase AND contains(o.phrase, c.phrase) AND o.df = c.df AND o.df_tagged = c.df_tagged) THEN 'DROP_DUPE'
        WHEN c.df <= 5 THEN 'DROP_RARE' WHEN c.df >= 100 AND c.df_tagged / c.df < 0.6::DOUBLE THEN 'DROP_NOISY' ELSE 'KEEP' END AS verdict
      FROM c LEFT JOIN g ON c.kind = g.kind AND c.code = g.code AND c.phrase = g.phrase""",
    "candidates": f"""WITH {LINES}, {HEAD}, {LEXICON}, words AS (SELECT doc_id, is_heading, text, string_split(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ') AS w FROM headed), grams AS ({_grams()}),
      kept AS (SELECT doc_id, gram, is_heading FROM grams WHERE length(gram) >= 4 AND gram NOT IN (SELECT phrase FROM lexicon) AND gram NOT IN {_COMMON}
        AND len(list_filter(own, lambda x: x NOT IN {_ALONE})) > 0 AND len(list_filter(own, lambda x: length(x) = 1)) = 0
        AND NOT regexp_matches(gram, '^(?:©.*|[0-9]+\\s*(?:a\\.m\\.|p\\.m\\.)|[0-9]+\\s+days?|(?:and|or|the|of|to|for|with|from|by|in|on|at|as|if|but|an?)\\s|.*[0-9]{{4,}}|[0-9]+\\s*$)')),
      c AS (SELECT doc_id, gram AS phrase, count(*) AS occurrences, sum(CASE WHEN is_heading THEN 2 ELSE 1 END)::BIGINT AS weight, bool_or(is_heading) AS h FROM kept GROUP BY ALL),
      d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, phrase) AS i FROM c WHERE weight >= 3 AND NOT EXISTS (SELECT 1 FROM lexicon l WHERE contains(l.phrase, c.phrase) OR contains(c.phrase, l.phrase))),
      f AS (SELECT * FROM d WHERE i <= 100), n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1),
      caps AS (SELECT doc_id, is_heading, unnest(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]{{1,14}}'))) AS a FROM headed),
      a AS (SELECT doc_id, lower(a) AS phrase, count(*) AS occurrences, sum(CASE WHEN is_heading THEN 2 ELSE 1 END)::BIGINT AS weight, bool_or(is_heading) AS h FROM caps WHERE lower(a) NOT IN {_PLAIN} AND lower(a) NOT IN (SELECT phrase FROM lexicon) GROUP BY 1, 2),
      b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, phrase) AS i FROM a WHERE weight >= 3),
      every AS (SELECT doc_id, 'd' AS candidate_type, phrase, occurrences, weight, h FROM f UNION ALL SELECT b.doc_id, 'alias', phrase, occurrences, weight, h FROM b LEFT JOIN n USING (doc_id) WHERE i <= 130 - coalesce(n, 0))
      SELECT doc_id, candidate_type, phrase, occurrences, weight, round(least(0.9::DOUBLE, least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * weight) + CASE WHEN h THEN 0.1::DOUBLE ELSE 0 END), 6) AS confidence FROM every""",
    "page_titles": f"""WITH p AS (SELECT page_id, url, {_told("h1")} AS h1, {_told("title")} AS t FROM pages) SELECT page_id, substring(CASE WHEN h1 <> '' THEN h1 WHEN t <> '' THEN t ELSE url END, 1, 240) AS title FROM p""",
    "url_classes": f"WITH {_CLASSES} SELECT page_id, host, path, payer, state, authority, content_kind, extension FROM classes",
    "corpus_hosts": f"""WITH e AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'), k AS (SELECT page_id, {HOST} AS h FROM pages WHERE page_id % 5 = 0),
      d AS (SELECT page_id, CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') ELSE h END AS host FROM pages LEFT JOIN k USING (page_id))
      SELECT coalesce(host, '(no_host)') AS host, count(*) AS docs, count(doc_id) AS published FROM d LEFT JOIN e ON page_id = doc_id GROUP BY 1""",
    "registry_upsert": f"""WITH s AS (SELECT {HOST} AS host, page_id AS pos, page_id % 5 <> 0 AS fetched, sha256((page_id % 3)::VARCHAR) AS hash, page_id % 9 = 0 AS hinted FROM pages),
      o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY pos % 2, pos) AS i FROM s), b AS (SELECT *, lag(hash) OVER (PARTITION BY host ORDER BY i) AS before FROM o WHERE fetched),
      g AS (SELECT host, arg_max(hash, i) AS content_hash, coalesce(max(pos) FILTER (before IS NULL OR before <> hash), -1) AS any_change, count(*) AS attempts FROM b GROUP BY 1),
      ch AS (SELECT host, arg_max(pos, i) AS changed_at FROM b WHERE before IS NULL OR before <> hash GROUP BY 1),
      f AS (SELECT host, min(pos % 2) AS half FROM s GROUP BY 1), h AS (SELECT DISTINCT host FROM s JOIN f USING (host) WHERE hinted AND pos % 2 = half)
      SELECT 'https://' || s.host || '/start' AS url, s.host, CASE WHEN h.host IS NOT NULL THEN 'Hinted' ELSE max({_payer("s.host")}) END AS payer, max({_state("s.host")}) AS state, arg_min(s.pos, s.pos % 2 * 1000000 + s.pos) AS first_seen, max(s.pos) AS last_seen,
        CASE WHEN max(g.attempts) > 0 THEN 200 ELSE -1 END::BIGINT AS status, coalesce(max(g.attempts), 0) AS attempts, max(g.content_hash) AS content_hash, coalesce(max(ch.changed_at), -1) AS changed_at, 'auto' AS curation_status
      FROM s LEFT JOIN g USING (host) LEFT JOIN ch USING (host) LEFT JOIN h ON h.host = s.host GROUP BY s.host, h.host""",
    "registry_stats": f"""WITH {_REGISTRY} SELECT 'curation_status' AS dimension, curation_status AS value, count(*) AS n FROM reg GROUP BY 2
      UNION ALL SELECT 'content_kind', content_kind, count(*) FROM reg GROUP BY 2 UNION ALL SELECT 'ingested', ingested::VARCHAR, count(*) FROM reg GROUP BY 2
      UNION ALL SELECT * FROM (SELECT 'host', host, count(*) FROM reg GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)""",
    "curated_sources": f"""WITH {_REGISTRY}, e AS (SELECT *, id % 10 = 3 AS edit FROM reg)
      SELECT url, CASE WHEN edit AND id % 20 = 3 THEN 'stale' ELSE curation_status END AS curation_status, coalesce(CASE WHEN edit AND id % 40 = 3 THEN NULL ELSE curated_authority END, '-') AS curated_authority,
        CASE WHEN edit AND id % 30 = 3 THEN 'appeals' ELSE coalesce(topics, '') END AS topics, ingested OR id % 13 = 0 AS ingested, CASE WHEN id % 13 = 0 THEN id + 1000 ELSE coalesce(CASE WHEN ingested THEN id END, -1) END AS ingested_doc_id FROM e""",
    "source_search": f"""WITH {_REGISTRY}, r AS (SELECT url, row_number() OVER (ORDER BY curation_status = 'canonical' DESC, ingested DESC, id DESC, url) AS position FROM reg
        WHERE last_status BETWEEN 200 AND 399 AND (coalesce(curated_authority, authority) = 'payer_policy' OR coalesce(topics, '') = 'claims')) SELECT * FROM r WHERE position <= 40""",
    "source_text_search": f"""WITH {_REGISTRY}, w AS (SELECT *, {TOK.format("url")} AS t FROM reg), m AS (SELECT *, len(list_filter(t, lambda x: x IN ('example', 'com', 'en'))) AS f FROM w WHERE list_has_all(t, ['example', 'com', 'en'])),
      r AS (SELECT url, row_number() OVER (ORDER BY f DESC, ingested DESC, id DESC, url) AS position FROM m) SELECT * FROM r WHERE position <= 40""",
    "line_chunks": f"WITH {LINES}, {HEAD} SELECT doc_id, paragraph_index, page_number, sha256(text) AS text_sha, n_words, is_heading FROM headed",
    "simple_paragraphs": f"WITH {LINES} SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars, max(paragraph_index) AS last_index FROM lines WHERE length(trim(text, ' ')) >= 20 GROUP BY 1",
    "tag_lines": f"WITH {TAGS} SELECT * FROM line_tags",
    "tag_paragraphs": f"WITH {TAGS} SELECT doc_id, page_number, kind, code, count(DISTINCT paragraph_index)::DOUBLE AS score FROM line_tags GROUP BY ALL",
    "tag_documents": f"WITH {DOC_TAGS} SELECT * FROM doc_tags",
    "effective_tags": f"""WITH {TAGS}, places AS (SELECT DISTINCT doc_id, paragraph_index, page_number FROM line_tags),
      every AS (SELECT doc_id, paragraph_index, page_number, kind, code, 1.0::DOUBLE AS w FROM (SELECT DISTINCT * EXCLUDE (score) FROM line_tags)
        UNION ALL SELECT doc_id, paragraph_index, page_number, kind, code, 0.3::DOUBLE FROM places JOIN (SELECT DISTINCT doc_id, page_number, kind, code FROM line_tags) USING (doc_id, page_number)
        UNION ALL SELECT doc_id, paragraph_index, page_number, kind, code, 0.1::DOUBLE FROM places JOIN (SELECT DISTINCT doc_id, kind, code FROM line_tags) USING (doc_id))
      SELECT doc_id, paragraph_index, page_number, kind, code, round(sum(w), 4) AS weight FROM every GROUP BY ALL""",
    "inherited_overlay": f"""WITH {DOC_TAGS}, alpha AS (SELECT doc_id, 'j' AS kind, 'payor.alpha' AS code FROM documents WHERE source = 'src0')
      SELECT doc_id, kind, code, 1.0::DOUBLE AS score FROM alpha UNION ALL SELECT * FROM doc_tags t WHERE NOT EXISTS (SELECT 1 FROM alpha a WHERE a.doc_id = t.doc_id AND a.kind = t.kind AND a.code = t.code)""",
    "cascade_pool": f"""WITH {DOC_TAGS}, f AS (SELECT doc_id, max((kind = 'd' AND code = 'pharmacy.formulary')::INT) AS d, max((kind = 'j' AND code = 'payor.beta')::INT) AS j,
        max((kind = 'p' AND code = 'appeals.filing')::INT) AS p, max((kind = 'j' AND code = 'state.fl')::INT) AS s FROM doc_tags GROUP BY 1),
      l AS (SELECT doc_id, CASE WHEN j + d + p = 3 THEN 1 WHEN j + d = 2 THEN 2 WHEN s + d = 2 THEN 3 WHEN s = 1 THEN 4 END AS level FROM f)
      SELECT doc_id, level::BIGINT AS level FROM l WHERE level = (SELECT min(level) FROM l)""",
    "generic_words": f"""WITH {LINES}, r AS (SELECT unnest(list_distinct({TOK.format("text")})) AS word FROM lines), l AS (SELECT unnest(list_distinct({TOK.format("text")})) AS word FROM benchmark),
      b AS (SELECT word, 1 AS r, 0 AS l FROM r UNION ALL SELECT word, 0, 1 FROM l)
      SELECT word, sum(r)::BIGINT AS n_rejected, sum(l)::BIGINT AS n_lexicon FROM b WHERE length(word) >= 3 GROUP BY 1 HAVING sum(r) >= 30 AND sum(l) <= 1""",
    "content_dedup": f"""WITH k AS (SELECT doc_id, substring({NORM.format("text")}, 1, 400) AS key FROM documents)
      SELECT doc_id, sha256(key) AS key_sha FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM k) WHERE n = 1 OR key = ''""",
    "neighbour_band_join": f"""WITH {TAGS}, seeds AS (SELECT DISTINCT doc_id, paragraph_index, page_number FROM line_tags WHERE code = 'payor.beta')
      SELECT s.doc_id, s.paragraph_index AS seed_paragraph, l.paragraph_index FROM seeds s JOIN lines l ON s.doc_id = l.doc_id AND l.paragraph_index BETWEEN s.paragraph_index - 3 AND s.paragraph_index + 3
      AND l.page_number BETWEEN s.page_number - 1 AND s.page_number + 1 AND l.paragraph_index <> s.paragraph_index""",
    "neighbour_context": f"""WITH {TAGS}, seeds AS (SELECT DISTINCT doc_id, paragraph_index FROM line_tags WHERE code = 'payor.beta')
      SELECT s.doc_id, s.paragraph_index AS seed_paragraph, sha256(substring(string_agg(l.text, chr(10) ORDER BY l.paragraph_index), 1, 1500)) AS context_sha FROM seeds s JOIN lines l
      ON s.doc_id = l.doc_id AND abs(l.paragraph_index - s.paragraph_index) = 1 GROUP BY 1, 2""",
    "published_rows": f"""WITH {TAGS}, t AS (SELECT doc_id, paragraph_index, string_agg(DISTINCT kind || ':' || code, ',' ORDER BY kind || ':' || code) AS tags FROM line_tags GROUP BY ALL)
      SELECT doc_id, paragraph_index, coalesce(tags, '') AS tags, sha256(doc_id::VARCHAR || '|' || paragraph_index::VARCHAR || '|' || text) AS content_sha FROM lines LEFT JOIN t USING (doc_id, paragraph_index)""",
    "published_snapshot": f"""WITH {TAGS}, t AS (SELECT doc_id, paragraph_index, string_agg(DISTINCT kind || ':' || code, ',' ORDER BY kind || ':' || code) AS tags FROM line_tags GROUP BY ALL), p AS (SELECT doc_id, paragraph_index, coalesce(tags, '') AS tags, sha256(doc_id::VARCHAR || '|' || paragraph_index::VARCHAR || '|' || text) AS content_sha FROM lines LEFT JOIN t USING (doc_id, paragraph_index))
      SELECT doc_id, paragraph_index, tags, CASE WHEN doc_id % 5 = 0 THEN sha256('second ' || content_sha) ELSE content_sha END AS content_sha FROM p WHERE doc_id % 11 <> 0""",
    "verify_published": f"""WITH {TAGS}, t AS (SELECT DISTINCT doc_id, paragraph_index, 1 AS t FROM line_tags)
      SELECT count(*) AS expected, count(*) FILTER (page_number <> 2) AS stored, count(*) FILTER (page_number = 2) AS missing, 0::BIGINT AS unexpected, count(*) FILTER (page_number <> 2 AND t IS NULL) AS untagged
      FROM lines LEFT JOIN t USING (doc_id, paragraph_index)""",
    "registry_latest": f"SELECT page_id, host, size FROM (SELECT page_id, {HOST} AS host, length(html) AS size, row_number() OVER (PARTITION BY {HOST} ORDER BY length(html) DESC, page_id) AS n FROM pages) WHERE n = 1",
    "payer_scope": "SELECT doc_id, source AS payer, lang AS state FROM documents WHERE source = 'src1' OR (source IN ('src0', 'src2') AND lang = 'fr')",
    "orphan_embeddings": """SELECT vec_id AS doc_id, 'orphan' AS state FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "authority_rerank": """WITH l AS (SELECT d.doc_id, text, lang, quality FROM documents d LEFT JOIN labels USING (doc_id)),
      s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 3 END::BIGINT AS tier, round((0.25::DOUBLE * greatest(0.0::DOUBLE, (doc_id % 100 / 100.0::DOUBLE - 0.5::DOUBLE) * 2)
        + 0.1::DOUBLE * CASE WHEN quality = 1 THEN 1.0::DOUBLE WHEN quality = 0 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END
        + 0.05::DOUBLE * CASE WHEN length(text) < 50 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (length(text) - 50) / 450.0::DOUBLE) END) / 0.4::DOUBLE * CASE WHEN lang = 'de' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM l)
      SELECT doc_id, score, CASE WHEN score >= 0.55 THEN 'high' WHEN score >= 0.35 THEN 'medium' WHEN score >= 0.18 THEN 'low' ELSE 'abstain' END AS label, tier FROM s""",
    "decay_and_cap": """WITH r AS (SELECT doc_id, source, lang, n_chars % 1000 / 1000.0::DOUBLE AS score FROM documents),
      b AS (SELECT *, max(score) OVER (PARTITION BY source, lang) AS best FROM r), k AS (SELECT * FROM b WHERE best <= 0 OR score >= 0.6::DOUBLE * best),
      p AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, doc_id) AS n FROM k),
      t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS position FROM p WHERE n <= 20)
      SELECT doc_id, lang, source, position FROM t WHERE position <= 50""",
    "quote_hits": f"""WITH t AS (SELECT item_id, {TOK.format("text")} AS w FROM benchmark), u AS (SELECT doc_id, {TOK.format("text")} AS w FROM documents),
      q AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
      g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM u WHERE len(w) >= 8)),
      n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1)
      SELECT item_id, doc_id, count(*) AS shared, round(count(*) / max(n), 6) AS part FROM q JOIN g USING (g) JOIN n USING (item_id) GROUP BY ALL""",
}


def page_sections(spark, d):
    from tidemark.operators import sections

    found = sections.page_sections(read(spark, d, "pages"))
    return found.select("page_id", "page_number", "section_title", F.sha2("text", 256).alias("text_sha"), "text_length", "extraction_status")


def page_plain_text(spark, d):
    from tidemark.operators import sections

    text = sections.plain_text(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.sha2(text, 256).alias("text_sha"), F.length(text).cast("long").alias("n_chars"))


def markdown_paragraphs(spark, d):
    from tidemark.operators import sections

    found = sections.paragraphs(read(spark, d, "documents"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max("end_offset").alias("last_end"))


QUERIES |= {f.__name__: f for f in (page_sections, page_plain_text, markdown_paragraphs)}
_BARE = "html"
for _pattern in (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>",):
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', ' ', 'g')"
for _name, _mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
    _BARE = f"replace({_BARE}, '&{_name};', '{_mark}')"
SQL["page_plain_text"] = f"WITH t AS (SELECT page_id, trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'), ' ') AS text FROM pages) SELECT page_id, sha256(text) AS text_sha, length(text) AS n_chars FROM t"
