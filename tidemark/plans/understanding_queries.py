"""Registered queries of query understanding, the gate, routing, grading and job control, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import normalise_query
from tidemark.operators import documents, gate, lexicon, ranking, routing, tagging, understanding
from tidemark.plans.corpus_queries import _doc_tags, _lines
from tidemark.plans.evaluation_queries import _round
from tidemark.plans.oracle import BARE, ASKED, DOC_TAGS, HOST, LINES, PATH, T, TOK, WORDS, expand, first_tokens
from tidemark.plans.retrieval_queries import _KEY, _LITERALS, _postings, _signal, _SIGNALS, cut  # noqa: F401
from tidemark.sources.store import stored
from tidemark.sources.tables import read, telemetry


def _said(spark, d):
    rows = read(spark, d, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "role", "text")


def _asked(spark, d):
    """What users said, and the benchmark's items, as queries."""
    users = _said(spark, d).where("role = 'user'").select("query_id", "text")
    return users.unionByName(read(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("query_id"), "text"))


def _profiles(spark, d):
    return stored(spark, d, "profiles", lambda s, d: understanding.profiles(_asked(s, d)))


def _parts(spark, d):
    return understanding.term_parts(_profiles(spark, d), tagging.tag_statistics(_doc_tags(spark, d), read(spark, d, "documents")))


def query_expansion(spark, d):
    return lexicon.expand(_said(spark, d)).drop("phrase")


def query_profiles(spark, d):
    p = _profiles(spark, d)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return p.select("query_id", joined("codes"), joined("literals"), F.size("untagged").cast("long").alias("n_untagged"), F.sha2("core", 256).alias("core_sha"), F.round("coverage", 6).alias("coverage"), "query_type")


def query_rewrites(spark, d):
    r = understanding.rewrites(_profiles(spark, d), _parts(spark, d))
    return r.select("query_id", *(F.sha2(c, 256).alias(c) for c in ("hybrid", "phrase_strict", "vector_broad")))


def term_parts(spark, d):
    found = _parts(spark, d).groupBy("term_kind", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("selectivity"), 4).alias("selectivity"))
    return found


def required_phrases(spark, d):
    told = F.transform("phrases", lambda p: F.concat_ws("/", p["phrase"], F.format_string("%.4f", p["weight"]), F.coalesce(p["code"], F.lit("-"))))
    return understanding.required_phrases(_parts(spark, d)).select("query_id", F.array_join(told, ";").alias("phrases"))


def query_gate(spark, d):
    p = _profiles(spark, d)
    has = lambda k: F.exists("codes", lambda c: c.startswith(k))
    reason = gate.fail_fast(F.col("text"), has("d:"), F.size("literals") > 0, has("j:"))
    return p.select(
        "query_id",
        gate.malformed(F.col("text")).alias("malformed"),
        F.coalesce(reason, F.lit("none")).alias("reason"),
        F.coalesce(gate.response_mode(reason), F.lit("none")).alias("mode"),
        gate.says(F.col("text"), gate.EXPLORATORY).alias("exploratory"),
        gate.says(F.col("text"), gate.SPECIFICS).alias("specifics"),
        gate.says(F.col("text"), gate.CONTACT_QUERY).alias("contact"),
        gate.service_specific(F.col("codes")).alias("service"),
        F.sha2(normalise_query(F.col("text")), 256).alias("normal_sha"),
    )


def gate_menu(spark, d):
    return gate.menu(lexicon.table(spark)).select(F.array_join("options", ",").alias("options"))


def _gated(spark, d):
    return gate.run_gate(_profiles(spark, d).select("query_id", "text", "codes"), _doc_tags(spark, d), lexicon.table(spark))


def gate_contours(spark, d):
    return _gated(spark, d).select("query_id", "union_docs", "intersection_docs", "process_intent", "contour", F.array_join("fanout", ",").alias("fanout"))


def gate_stories(spark, d):
    return gate.narrate(_gated(spark, d))


def query_classes(spark, d):
    """Classes and canonicality, with the probe's documents as the pool."""
    p = _profiles(spark, d).join(_gated(spark, d).select("query_id", F.col("intersection_docs").alias("pool")), "query_id")
    has = lambda k: F.exists("codes", lambda c: c.startswith(k))
    literal = F.size("literals") > 0
    return p.select(
        "query_id",
        routing.query_class(F.col("query_type"), literal, gate.says(F.col("text"), gate.EXPLORATORY), has("d:"), F.col("pool")).alias("query_class"),
        F.round(routing.canonicality(F.col("query_type"), has("j:"), has("d:"), F.col("pool")), 6).alias("canonicality"),
        F.array_join(routing.strategy_order(F.col("query_type"), F.col("pool")), ",").alias("steps"),
        F.round(routing.crawlability(F.coalesce(F.get(F.filter("codes", lambda c: c.startswith("j:payor.")), 0), F.lit(""))), 2).alias("crawlability"),
    )


def _callers(spark, d):
    k = F.col("k")
    return telemetry(read(spark, d, "events")).select(
        F.col("event_id").alias("query_id"), F.when(k % 7 == 0, None).when(k % 7 == 1, "chat.thinking").when(k % 7 == 2, "auth_agent").when(k % 7 == 3, "research").when(k % 7 == 4, "batch").when(k % 7 == 5, "chat.copilot").otherwise("unknown").alias("caller_mode"),
        F.when(k % 3 == 0, "structured").when(k % 3 == 1, "").alias("answer_shape"), F.when(k % 4 == 0, k / 100.0).alias("accuracy_need"), F.lit(None).cast("double").alias("recall_demand"), F.when(k % 5 == 0, "background").alias("speed_budget"), "k",
    )


def caller_preferences(spark, d):
    found = routing.resolve_preferences(_callers(spark, d))
    budget = routing.escalation_budget(F.col("caller_mode"), F.col("speed_budget"))
    return found.select("query_id", "caller_mode", "answer_shape", F.round("accuracy_need", 6).alias("accuracy_need"), F.round("recall_demand", 6).alias("recall_demand"), "speed_budget", budget.cast("long").alias("budget"))


#: Priors of a class of queries, as an example.
BASE_PRIORS = (("a", ["structured"], 0.6, 0.1, 0.9, 0.05, 0.95), ("b", ["structured", "essay"], 0.5, 0.3, 0.8, 0.1, 0.7), ("c", ["essay"], 0.2, 0.2, 0.4, 0.0, 0.2), ("d", ["essay", "structured"], 0.55, 0.35, 1.0, 0.2, 0.5))


def prior_scores(spark, d):
    base = spark.createDataFrame(list(BASE_PRIORS), "strategy string, shapes array<string>, accuracy double, accuracy_std double, recall_capacity double, recall_std double, speed double")
    asked = routing.resolve_preferences(_callers(spark, d))
    priors = routing.blended_priors(base, asked.select("query_id", (F.col("k") % 5 / 4.0).alias("w")))
    rows = priors.join(asked.drop("k"), "query_id")
    score = routing.prior_score(F.col("accuracy_need"), F.col("recall_demand"), F.col("speed_budget"), F.col("answer_shape"))
    return rows.select("query_id", "strategy", F.round(score, 6).alias("score"))


def step_successes(spark, d):
    k = F.col("k")
    t = telemetry(read(spark, d, "events")).withColumn("step", F.element_at(F.array(*map(F.lit, ("phrase_strict", "bm25_in_pool", "hybrid", "vector_broad", "vector_in_pool"))), (k % 5 + 1).cast("int")))
    grade = routing.step_success(F.col("step"), k % 9, k / 100.0, k % 4, k / 150.0, k % 3, F.least(k % 2, k % 3), k % 3 - F.least(k % 7, k % 3), F.greatest(F.least(k % 2, k % 3), k % 3 - F.least(k % 11, k % 3)))
    return t.select("event_id", F.coalesce(grade, F.lit("failed")).alias("grade"))


def _attempts(spark, d):
    """The calls of a user in a day as attempts at one query."""
    k = F.col("k")
    t = telemetry(read(spark, d, "events"))
    return t.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("query_id"), F.col("event_id").alias("attempt"), "strategy", F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").otherwise("low").alias("confidence"),
        (k % 5 != 0).alias("abstained"), (k % 9).alias("signature"), (k % 3).alias("b"), F.when(k % 6 == 0, "high").when(k % 6 == 1, "medium").alias("grade"), (k % 8).alias("n_chunks"),
    )


def escalations(spark, d):
    rows = _attempts(spark, d)
    budget = rows.groupBy("query_id").agg(F.min("b").alias("budget"))
    return routing.escalate(rows.join(budget, "query_id"))


def answer_confidence(spark, d):
    found = routing.confidence(_attempts(spark, d))
    told = routing.hint(F.col("confidence"), F.when(F.col("most_chunks") < 3, "VAGUE").when(F.col("most_chunks") < 6, "CONCEPTUAL").otherwise("MIXED"), F.col("most_chunks") % 2, F.col("most_chunks"))
    return found.select("query_id", "confidence", F.coalesce(told, F.lit("-")).alias("hint"))


def inherited_scores(spark, d):
    k = F.col("k")
    rows = telemetry(read(spark, d, "events")).select("event_id", F.col("user_id").alias("query_id"), F.when(k % 3 != 0, k / 100.0).alias("score"), F.when(k % 4 != 0, k % 50 / 50.0).alias("own_top"))
    return routing.inherited_scores(rows, escalated=True).select("event_id", F.round("score", 6).alias("score"))


def term_statistics(spark, d):
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = understanding.term_statistics(asked, read(spark, d, "documents"))
    return found.withColumn("selectivity", F.round("selectivity", 6))


def item_presence(spark, d):
    return understanding.presence(understanding.significant(_profiles(spark, d)), _postings(spark, d)).select("query_id", "n_items", "place", F.coalesce("missing", F.lit("-")).alias("missing"))


def recall_estimates(spark, d):
    """The presence of each query's terms and the documents with its tags, as an estimate of what a search will find."""
    p = _profiles(spark, d)
    items = understanding.significant(p)
    place = understanding.presence(items, _postings(spark, d))
    lost = items.join(p.select("query_id", F.explode("literals").alias("literal")), "query_id").where(F.lower("literal") == F.col("item")).join(place.where("missing is not null").select("query_id", "missing"), "query_id").where("missing = item")
    rows = p.select("query_id").join(_gated(spark, d).select("query_id", "intersection_docs"), "query_id").join(place, "query_id", "left").join(lost.select("query_id", F.lit(True).alias("lost")).distinct(), "query_id", "left")
    several = F.when(F.col("n_items") >= 2, F.col("place"))
    return rows.select("query_id", understanding.recall_estimate(F.col("intersection_docs"), several, F.coalesce("lost", F.lit(False))).alias("est_recall"))


def category_signals(spark, d):
    docs = understanding.signals(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    asked = understanding.signals(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    return understanding.signal_match(asked, docs)


def signal_families(spark, d):
    """What each document has most in common with a question that says everything."""
    asked = F.struct(F.lit(1.0).alias("P"), F.lit(0.9).alias("D"), F.lit(0.8).alias("J"))
    found = understanding.signal_families(asked, understanding.signal_struct(F.coalesce("text", F.lit(""))))
    return read(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("families"))


def query_literals(spark, d):
    """The literals of every line."""
    found = _lines(spark, d).select("doc_id", "paragraph_index", understanding.cut_query(F.col("text"))[0].alias("l")).where("size(l) > 0")
    return found.select("doc_id", "paragraph_index", F.size("l").cast("long").alias("n"), F.array_join("l", ",").alias("literals"))


def best_attempts(spark, d):
    t = telemetry(read(spark, d, "events"))
    rows = t.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("attempt"), (F.col("k") == 97).alias("success"), (F.col("k") / 100.0).alias("rerank"), (F.col("k") % 13).alias("n_docs"))
    return understanding.best_attempt(rows)


def fact_grades(spark, d):
    t = telemetry(read(spark, d, "events"))
    facts = t.select(F.col("user_id").alias("query_id"), (F.col("k") / 100.0).alias("support"), (F.col("k") % 4 != 0).alias("grounded"), (F.col("k") % 19 == 0).alias("contradicted"))
    found = understanding.fact_grade(facts)
    return found.select("query_id", "n", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"), "validated", "contradicted")


def speed_priors(spark, d):
    return understanding.speed_prior(telemetry(read(spark, d, "events"))).withColumn("speed", F.round("speed", 6))


KNOWN = {"src0": "Source Zero", "src1": "Source One"}


def canonical_names(spark, d):
    raw = F.concat(F.lit("  "), F.col("source"), F.lit(" . "))
    state = F.when(F.col("lang") == "fr", " Florida ").when(F.col("lang") == "de", "somewhere").otherwise(F.col("lang"))
    return read(spark, d, "documents").select("doc_id", understanding.canonical(F.col("source"), KNOWN).alias("payer"), documents.canonical_state(state).alias("state"), documents.canonical_level(F.concat(F.lit("Payer-Policy "), "source")).alias("level"), documents.name_key(raw).alias("name_key"))


def job_progress(spark, d):
    return understanding.progress(read(spark, d, "events")).withColumn("percent", F.round("percent", 6))


def pruned_log(spark, d):
    kept = understanding.prune(read(spark, d, "events"), 3)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def enqueued_jobs(spark, d):
    wanted = read(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "A").otherwise("B").alias("generator"))
    queue = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "A").otherwise("B").alias("generator"), F.when(F.col("toxic") == 0, "pending").otherwise("done").alias("status"))
    return understanding.enqueue(wanted, queue, ["doc_id", "generator"])


def tag_objects(spark, d):
    return understanding.tag_objects(_doc_tags(spark, d), "doc_id")


def fact_matches(spark, d):
    asked = _said(spark, d).where("role = 'user'").select("query_id", F.lit("en").alias("payer"), "text")
    pages = read(spark, d, "benchmark").select(F.col("item_id").alias("fact_id"), F.lit("en").alias("payer"), F.when(F.col("item_id") % 2 == 0, 1.0).otherwise(0.65).alias("authority"), "text")
    found = understanding.fact_match(asked, pages, tau=0.1)
    return found.withColumn("score", F.round("score", 6))


def dominant_hosts(spark, d):
    from tidemark.operators.evaluation import host_majority
    from tidemark.operators.registry import host, parent_host, path

    rows = read(spark, d, "pages").select(F.regexp_extract(path(F.col("url")), "^/([a-z]{2})(/|$)", 1).alias("region"), parent_host(host(F.col("url"))).alias("parent_host"))
    return host_majority(rows, "region", "parent_host")


def _ordered(spark, d):
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    level = F.when(F.col("quality") == 1, "contract_source_of_truth").when(F.col("quality") == 0, "payer_policy").otherwise("unknown")
    return docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), level.alias("authority_level"), (F.col("n_chars") % 100 / 100.0).alias("score"))


def canonical_order(spark, d):
    return ranking.canonical_order(_ordered(spark, d), 10).select("query_id", "id", "position")


def balanced_order(spark, d):
    return ranking.balanced_order(_ordered(spark, d), 5, 0.4).select("query_id", "id", "position")


QUERIES = {f.__name__: f for f in (
    query_expansion, query_profiles, query_rewrites, term_parts, required_phrases, query_gate, gate_menu, gate_contours, gate_stories, query_classes, caller_preferences, prior_scores,
    step_successes, escalations, answer_confidence, inherited_scores, term_statistics, item_presence, recall_estimates, category_signals, signal_families, query_literals, best_attempts, fact_grades,
    speed_priors, canonical_names, job_progress, pruned_log, enqueued_jobs, tag_objects, fact_matches, dominant_hosts, canonical_order, balanced_order,
)}

_ASKED = "asked AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - item_id, text FROM benchmark)"
_NOISE = "(" + ", ".join(f"'{w}'" for w in """a an the is are was were be been being of for to in on at by from with without and or but if then than as so such what which who whom whose where when why how
  do does did can could would should will shall tell show give find explain describe summarize say says said saying cover covers covered across applies apply applying me us you i we they them my our your this that
  these those about regarding policy policies rule rules requirement requirements information info details guideline guidelines general specific applicable current process new old recent now today""".split()) + ")"  # fmt: skip
_KNOWN_WORDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{c}' AS code, {[w for p in phrases for w in p.split()]!r} AS ws" for k, c, phrases in ASKED)
_GENERIC = "(" + ", ".join(f"'{w}'" for w in """provider providers policy policies rule rules requirement requirements information info details general specific covered coverage applies apply process guideline guidelines
  service services plan plans member members patient patients client clients""".split()) + ")"  # fmt: skip
# Profiles: prof (query_id, text, codes, literals, others, untagged, coverage, query_type).
_PROFILES = f"""{_ASKED}, {expand("asked")}, {cut("asked")}, words_of AS ({_KNOWN_WORDS}),
known AS (SELECT query_id, list_distinct(flatten(list(ws))) AS known, list_sort(list(kind || ':' || code)) AS codes FROM expanded JOIN words_of USING (kind, code) WHERE place < 12 GROUP BY 1),
pr0 AS (SELECT query_id, text, literals, list_filter(regexp_split_to_array(rest, '[\\s,.;:!?()"''/\\\\]+'), lambda t: t <> '' AND lower(t) NOT IN {_NOISE}) AS others FROM asked0),
pr1 AS (SELECT p.*, coalesce(codes, []) AS codes, list_filter(others, lambda t: NOT list_contains(coalesce(known, []), lower(t))) AS untagged FROM pr0 p LEFT JOIN known USING (query_id)),
prof AS MATERIALIZED (SELECT *, (len(literals) + len(others) - len(untagged)) / greatest(len(literals) + len(others), 1) AS coverage, array_to_string(list_concat(literals, others), ' ') AS core,
  CASE WHEN len(literals) > 0 THEN 'PRECISION_DOMINANT' WHEN (len(others) - len(untagged)) / greatest(len(others), 1) >= 0.5 AND len(codes) > 0 THEN 'CONCEPTUAL'
  WHEN (len(others) - len(untagged)) / greatest(len(others), 1) >= 0.2::DOUBLE AND len(codes) > 0 THEN 'MIXED' ELSE 'VAGUE' END AS query_type FROM pr1)"""
_LEAF = "trim(lower(replace(string_split({}, '.')[-1], '_', ' ')))"
_PARTS = f"""sel AS (SELECT kind || ':' || code AS term, 1 - count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS s FROM doc_tags GROUP BY 1),
terms AS (SELECT query_id, unnest(literals) AS term, 'literal' AS term_kind, 1.0::DOUBLE AS selectivity FROM prof UNION ALL SELECT query_id, term, 'tag', coalesce(s, 0) FROM (SELECT query_id, unnest(codes) AS term FROM prof) LEFT JOIN sel USING (term)
  UNION ALL SELECT query_id, term, 'untagged', CASE WHEN lower(term) IN {_GENERIC} THEN 0.05::DOUBLE WHEN length(term) >= 5 THEN 0.5::DOUBLE WHEN length(term) >= 3 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END FROM (SELECT query_id, unnest(untagged) AS term FROM prof)),
parts AS (SELECT *, CASE WHEN selectivity >= 0.65::DOUBLE AND term_kind <> 'untagged' THEN 'REQUIRED' WHEN selectivity >= 0.4::DOUBLE THEN 'BOOSTED' ELSE 'DROP' END AS part FROM terms)"""
_MALFORMED = f"coalesce(len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{L}}+$'))) < 2 OR len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{L}}+$'))) < len(w) / 2, true)"
_PROCESS = r"\b(how do i|how can i|how does one|how to|what(''?s| is) the process (for|to)|what are the steps (for|to)|steps to|procedure for)\b"
_GATE = f"""probe AS (SELECT query_id, count(*) AS union_docs, count(*) FILTER (kinds = needed) AS intersection_docs FROM (SELECT query_id, doc_id, count(DISTINCT kind) AS kinds, max(needed) AS needed
    FROM (SELECT query_id, unnest(codes) AS tag, len(list_distinct(list_transform(codes, lambda c: c[1]))) AS needed FROM prof) JOIN (SELECT doc_id, kind, kind || ':' || code AS tag FROM doc_tags) USING (tag) GROUP BY 1, 2) GROUP BY 1),
g0 AS (SELECT query_id, text, codes, coalesce(union_docs, 0) AS u, coalesce(intersection_docs, 0) AS x, list_filter(codes, lambda c: c LIKE 'd:%') AS d, len(list_filter(codes, lambda c: c LIKE 'j:%')) AS j, len(list_filter(codes, lambda c: c LIKE 'p:%')) AS p,
  {WORDS.format("lower(text)")} AS w, regexp_matches(array_to_string({WORDS.format("lower(text)")}, ' '), '(?i){_PROCESS}') AS process FROM prof LEFT JOIN probe USING (query_id)),
g1 AS (SELECT *, d = ['d:claims.general'] AS general, {_MALFORMED} AS bad, CASE WHEN (len(d) > 0)::INT + (j > 0)::INT + (p > 0)::INT > 1 THEN x ELSE u END AS anchor FROM g0),
gated AS MATERIALIZED (SELECT *, CASE WHEN len(codes) = 0 AND bad THEN 'unclear' WHEN len(codes) = 0 THEN 'out_of_scope' WHEN u = 0 THEN 'corpus_gap' WHEN len(d) > 0 AND j > 0 AND general AND p = 0 AND NOT process THEN 'underspecified/explore_siblings'
  WHEN len(d) > 0 AND j > 0 AND general AND p = 0 THEN 'exact' WHEN len(d) > 0 AND j > 0 AND x > 0 THEN 'exact' WHEN len(d) > 0 AND j > 0 THEN 'vicinity' WHEN anchor BETWEEN 1 AND 25 THEN 'exact'
  WHEN len(d) = 0 THEN 'underspecified/missing_domain' ELSE 'underspecified/missing_jurisdiction' END AS contour FROM g1)"""
_GATED = f"WITH {DOC_TAGS}, {_PROFILES}, {_GATE}"
_says = lambda p: f"regexp_matches(text, '(?i){p}')"
_PRESETS = (("chat.copilot", "structured", 0.70, 0.70, "real_time"), ("chat.default", "essay", 0.85, 0.95, "real_time"), ("chat.thinking", "essay", 0.95, 0.95, "interactive"), ("auth_agent", "binary", 1.0, 0.95, "interactive"),
  ("research", "essay", 0.95, 1.0, "none"), ("batch", "structured", 0.90, 0.80, "background"))
_PREFERENCES = f"""{T}, preset(mode, shape, accuracy, recall, speed) AS (VALUES {", ".join(f"('{m}', '{s}', {a}::DOUBLE, {r}::DOUBLE, '{v}')" for m, s, a, r, v in _PRESETS)}),
cal AS (SELECT event_id AS query_id, k, coalesce(CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'chat.thinking' WHEN 2 THEN 'auth_agent' WHEN 3 THEN 'research' WHEN 4 THEN 'batch' WHEN 5 THEN 'chat.copilot' ELSE 'unknown' END, 'chat.default') AS caller_mode FROM t),
pref AS (SELECT query_id, k, caller_mode, CASE WHEN k % 3 = 0 THEN 'structured' ELSE coalesce(shape, 'essay') END AS answer_shape, CASE WHEN k % 4 = 0 THEN k / 100.0::DOUBLE ELSE coalesce(accuracy, 0.85) END AS accuracy_need, coalesce(recall, 0.95::DOUBLE) AS recall_demand,
  CASE WHEN k % 5 = 0 THEN 'background' ELSE coalesce(speed, 'real_time') END AS speed_budget FROM cal LEFT JOIN preset ON mode = caller_mode)"""
_ATTEMPTS = f"""{T}, att AS (SELECT user_id::VARCHAR || '/' || ts::DATE::VARCHAR AS query_id, event_id AS attempt, strategy, CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, k % 5 <> 0 AS abstained, k % 9 AS signature, k % 3 AS b,
  CASE k % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS grade, k % 8 AS n_chunks FROM t)"""
_ITEMS = f"""i0 AS (SELECT query_id, literals, list_transform(list_concat(list_concat(literals, untagged), list_filter(list_transform(list_filter(codes, lambda c: c NOT LIKE 'p:%'), lambda c: {_LEAF.format("substring(c, 3)")}), lambda x: x <> 'general' AND length(x) >= 3)), lambda x: lower(x)) AS e FROM prof),
i1 AS (SELECT query_id, literals, list_filter(e, lambda t, i: list_position(e, t) = i) AS e FROM i0),
i2 AS (SELECT query_id, literals, list_slice(list_filter(list_filter(e, lambda x: len(list_filter(e, lambda y: y <> x AND contains(y, x))) = 0), lambda x: len({TOK.format("x")}) > 0), 1, 5) AS e FROM i1),
items AS (SELECT query_id, len(e) AS n_items, unnest(e) AS item FROM i2), iw AS (SELECT item, list_distinct({TOK.format("item")}) AS ws FROM (SELECT DISTINCT item FROM items)), iu AS (SELECT item, len(ws) AS n, unnest(ws) AS token FROM iw),
pt AS (SELECT DISTINCT doc_id, paragraph_index, unnest({TOK.format("text")}) AS token FROM lines), fi AS MATERIALIZED (SELECT item, doc_id, paragraph_index FROM iu JOIN pt USING (token) GROUP BY 1, 2, 3 HAVING count(*) = max(n)),
pp AS (SELECT query_id, doc_id, paragraph_index, count(DISTINCT item) AS c FROM items JOIN fi USING (item) GROUP BY 1, 2, 3), pd AS (SELECT query_id, doc_id, count(DISTINCT item) AS c FROM items JOIN fi USING (item) GROUP BY 1, 2),
bp AS (SELECT query_id, max(c) AS p FROM pp GROUP BY 1), bd AS (SELECT query_id, max(c) AS d FROM pd GROUP BY 1), lost AS (SELECT query_id, min(item) AS missing FROM items WHERE item NOT IN (SELECT item FROM fi) GROUP BY 1),
pres AS (SELECT DISTINCT i.query_id, n_items, missing, CASE WHEN missing IS NOT NULL THEN 'missing' WHEN p >= n_items THEN 'paragraph' WHEN d >= n_items THEN 'document' ELSE 'scattered' END AS place FROM items i LEFT JOIN bp USING (query_id) LEFT JOIN bd USING (query_id) LEFT JOIN lost USING (query_id))"""
_TITLE_CASE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: CASE WHEN length(w) <= 4 AND upper(w) = w AND regexp_matches(w, '[A-Z]') THEN w ELSE upper(substring(w, 1, 1)) || lower(substring(w, 2)) END), ' ')"
_LEVELS = """r0 AS (SELECT source AS query_id, d.doc_id AS id, CASE WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 3 END AS tier, n_chars % 100 / 100.0::DOUBLE AS score FROM documents d LEFT JOIN labels USING (doc_id)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS i FROM r0)"""


def _signals_of(source: str, key: str) -> str:
    one = " UNION ALL ".join(f"SELECT {key}, '{n}' AS category, {_signal('text', n)} AS score FROM {source}" for n in _SIGNALS)
    return f"SELECT * FROM ({one}) WHERE score > 0"


_BASE = "base(strategy, shapes, accuracy, accuracy_std, recall, recall_std, speed) AS (VALUES ('a', ['structured'], 0.6, 0.1, 0.9, 0.05, 0.95), ('b', ['structured', 'essay'], 0.5, 0.3, 0.8, 0.1, 0.7), ('c', ['essay'], 0.2, 0.2, 0.4, 0.0, 0.2), ('d', ['essay', 'structured'], 0.55, 0.35, 1.0, 0.2, 0.5))"
_CANON = "canon(strategy, ca, cas, cr, crs, cs) AS (VALUES ('a', 0.467, 0.125, 1.00, 0.0, 0.98), ('b', 0.508, 0.377, 0.70, 0.0, 0.75), ('c', 0.033, 0.100, 0.40, 0.0, 0.12), ('d', 0.600, 0.367, 1.00, 0.0, 0.48))"
_mix = lambda a, b: f"((1 - w) * {a}::DOUBLE + w * {b}::DOUBLE)"
_risk = "greatest(0, (accuracy_need - 0.5::DOUBLE) * 2)"

SQL = {
    "query_expansion": f"WITH said AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations), {expand('said')} SELECT query_id, place, kind, code FROM expanded WHERE place < 12",
    "query_profiles": f"WITH {_PROFILES} SELECT query_id, array_to_string(codes, ',') AS codes, array_to_string(literals, ',') AS literals, len(untagged) AS n_untagged, sha256(core) AS core_sha, round(coverage, 6) AS coverage, query_type FROM prof",
    "query_rewrites": f"""WITH {DOC_TAGS}, {_PROFILES}, {_PARTS}, gone AS (SELECT query_id, list(DISTINCT lower(term)) AS gone FROM parts WHERE part = 'DROP' AND term_kind = 'untagged' GROUP BY 1),
      a AS (SELECT p.*, coalesce(gone, []) AS gone FROM prof p LEFT JOIN gone USING (query_id)),
      b AS (SELECT *, coalesce(nullif(array_to_string(list_filter({WORDS.format("CASE WHEN core = '' THEN text ELSE core END")}, lambda t: NOT list_contains(gone, lower(t))), ' '), ''), text) AS hybrid,
        list_transform(list_filter(codes, lambda c: c LIKE 'j:%'), lambda c: replace(regexp_replace(c, '^j:([^.]*\\.)?', ''), '_', ' ')) AS pay FROM a)
      SELECT query_id, sha256(hybrid) AS hybrid, sha256(CASE WHEN len(literals) > 0 THEN array_to_string(literals, ' ') ELSE coalesce(nullif(array_to_string(list_filter(untagged, lambda t: NOT list_contains(gone, lower(t))), ' '), ''), hybrid) END) AS phrase_strict,
        sha256(CASE WHEN len(pay) > 0 THEN coalesce(nullif(array_to_string(list_filter({WORDS.format("hybrid")}, lambda t: len(list_filter(pay, lambda p: contains(lower(t), p) OR contains(p, lower(t)))) = 0), ' '), ''), hybrid) ELSE hybrid END) AS vector_broad FROM b""",
    "term_parts": f"WITH {DOC_TAGS}, {_PROFILES}, {_PARTS} SELECT term_kind, part, count(*) AS n, round(sum(selectivity), 4) AS selectivity FROM parts GROUP BY 1, 2",
    "required_phrases": f"""WITH {DOC_TAGS}, {_PROFILES}, {_PARTS}, r AS (SELECT query_id, CASE WHEN term_kind = 'tag' THEN {_LEAF.format("substring(term, 3)")} ELSE lower(term) END AS phrase, greatest(0.1::DOUBLE, selectivity) AS weight, CASE WHEN term_kind = 'tag' THEN term END AS code FROM parts WHERE part = 'REQUIRED'),
      f AS (SELECT *, row_number() OVER (PARTITION BY query_id, phrase ORDER BY code IS NOT NULL, code, weight) AS i FROM r WHERE phrase <> '' AND NOT (code IS NOT NULL AND phrase = 'general'))
      SELECT query_id, string_agg(phrase || '/' || printf('%.4f', weight) || '/' || coalesce(code, '-'), ';' ORDER BY phrase) AS phrases FROM f WHERE i = 1 GROUP BY 1""",
    "query_gate": f"""WITH {_PROFILES}, g AS (SELECT *, {WORDS.format("text")} AS w, {BARE} AS bare FROM prof), r AS (SELECT *, CASE
        WHEN {_says(r"\bSSN[:#]?\s*[0-9]{3}-?[0-9]{2}-?[0-9]{4}\b|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b|\b(?:DOB|date of birth)\b[:\s]*[0-9]|\bMRN[:#]?\s*\w+\b|\bmember\s*(?:id|number|#)[:\s]*\w+\b|\bpatient\s+(?:name|named)\b")} THEN 'phi_detected'
        WHEN {_says(r"\bignore\s+(?:previous|prior|all)\s+(?:instruction|prompt|rule)|\byou\s+are\s+now\b|^\s*system\s*:|\bact\s+as\s+(?:a\s+)?(?:different|new)\b|\bdisregard\s+(?:your|the)\s+(?:instruction|rule|prompt)")} THEN 'jailbreak'
        WHEN {_says(r"\bhow\s+(?:do|does)\s+(?:you|this\s+system)\s+work\b|\bwhat\s+(?:tools|capabilities|model|system\s+prompt)\s+(?:do|does|are)\b|\bwhat(?:''s|\s+is)\s+your\s+(?:prompt|instructions|model|system)\b")} THEN 'self_referential'
        WHEN len(list_filter(codes, lambda c: c LIKE 'd:%' OR c LIKE 'j:%')) = 0 AND len(literals) = 0 THEN 'no_domain_match' END AS reason FROM g)
      SELECT query_id, {_MALFORMED} AS malformed, coalesce(reason, 'none') AS reason, CASE reason WHEN 'phi_detected' THEN 'strict' WHEN 'jailbreak' THEN 'silent' WHEN 'self_referential' THEN 'redirect' WHEN 'no_domain_match' THEN 'reframe' ELSE 'none' END AS mode,
        {_says(r"\btell me\b|\bshow me\b|\boverview\b|\bsummari[sz]e\b|\bacross\s+\w+|\bcompare\b|\bdifferenc(?:e|es)\b|\bwhat\s+does\s+\w+\s+say\b|\bwhat''?s\s+covered\b|\boverview\s+of\b")} AS exploratory,
        {_says(r"\b([0-9]+\s*(?:days?|hours?|weeks?|months?|years?|business\s*days?|calendar\s*days?)|\$[0-9][0-9,.]*|[0-9]{1,3}\.[0-9]+\s*%|[A-Z]{2,5}\.[A-Z]{2,5}\.[0-9]+|[A-Z][0-9]{4}\b)")} AS specifics,
        {_says(r"\b(phone|fax|telephone|hotline|toll[\s.\-]?free|edi\s+payer[\s\-]?id|payer[\s\-]?id|edi[\s\-]?id|contact\s+number|provider\s+(services|phone|contact)|member\s+(services|phone|contact))\b")} AS contact,
        false AS service, sha256(CASE WHEN bare = '' THEN text ELSE bare END) AS normal_sha FROM r""",
    "gate_menu": "SELECT 'claims,eligibility,pharmacy' AS options",
    "gate_contours": f"{_GATED} SELECT query_id, u AS union_docs, x AS intersection_docs, process AS process_intent, contour, CASE WHEN contour = 'underspecified/explore_siblings' THEN 'claims.timely_filing' ELSE '' END AS fanout FROM gated",
    "gate_stories": f"""{_GATED} SELECT query_id, CASE WHEN len(codes) > 0 THEN 'Matched ' || array_to_string(codes, ', ') || '. ' ELSE '' END || CASE contour WHEN 'exact' THEN x::VARCHAR || ' documents cover this; answering directly.'
      WHEN 'vicinity' THEN u::VARCHAR || ' documents are near this, none covers it; piecing an answer together.' WHEN 'underspecified/explore_siblings' THEN '1 more specific topics are known; exploring them.'
      WHEN 'underspecified/missing_domain' THEN 'The topic is missing, and too many documents fit; asking back.' WHEN 'underspecified/missing_jurisdiction' THEN 'Whom this is about is missing, and too many documents fit; asking back.'
      WHEN 'corpus_gap' THEN 'The topic is known, but no document covers it.' WHEN 'out_of_scope' THEN 'The question is clear, but nothing in scope matches it.' ELSE 'The question isn''t clear; asking to put it in other words.' END AS story FROM gated""",
    "query_classes": f"""{_GATED}, c AS (SELECT p.*, x AS pool, {_says(r"\btell me\b|\bshow me\b|\boverview\b|\bsummari[sz]e\b|\bacross\s+\w+|\bcompare\b|\bdifferenc(?:e|es)\b|\bwhat\s+does\s+\w+\s+say\b|\bwhat''?s\s+covered\b").replace("text", "p.text")} AS explores, len(d) > 0 AS hd, j > 0 AS hj FROM prof p JOIN gated USING (query_id))
      SELECT query_id, CASE WHEN len(literals) > 0 THEN 'literal_anchor' WHEN explores THEN 'exploratory' WHEN query_type = 'VAGUE' THEN 'vague' WHEN query_type = 'CONCEPTUAL' THEN 'conceptual' WHEN pool BETWEEN 1 AND 500 THEN 'tight_pool' WHEN pool > 500 THEN 'wide_pool' WHEN hd THEN 'tight_pool' ELSE 'vague' END AS query_class,
        round(CASE WHEN hj AND hd AND query_type <> 'VAGUE' AND pool > 0 THEN CASE WHEN pool BETWEEN 100 AND 500 THEN 1 WHEN pool < 100 THEN greatest(0, (pool - 50) / 50.0::DOUBLE) ELSE greatest(0, (900 - pool) / 400.0::DOUBLE) END ELSE 0 END, 6) AS canonicality,
        CASE WHEN query_type = 'PRECISION_DOMINANT' THEN 'phrase_strict,bm25_in_pool' WHEN query_type = 'VAGUE' THEN 'vector_broad' WHEN pool BETWEEN 1 AND 2000 AND query_type = 'MIXED' THEN 'bm25_in_pool,vector_in_pool,phrase_strict' WHEN pool BETWEEN 1 AND 2000 THEN 'bm25_in_pool,vector_in_pool'
          WHEN query_type = 'MIXED' THEN 'vector_broad,bm25_in_pool,phrase_strict' ELSE 'vector_broad,bm25_in_pool' END AS steps, 0.3::DOUBLE AS crawlability FROM c""",
    "caller_preferences": f"""WITH {_PREFERENCES} SELECT query_id, caller_mode, answer_shape, round(accuracy_need, 6) AS accuracy_need, round(recall_demand, 6) AS recall_demand, speed_budget,
      CASE WHEN caller_mode IN ('fast', 'copilot') OR speed_budget = 'real_time' THEN 0 WHEN caller_mode IN ('thinking', 'research') THEN 2 ELSE 1 END::BIGINT AS budget FROM pref""",
    "prior_scores": f"""WITH {_PREFERENCES}, {_BASE}, {_CANON}, x AS (SELECT p.*, b.*, c.* EXCLUDE (strategy), k % 5 / 4.0::DOUBLE AS w FROM pref p, base b JOIN canon c USING (strategy))
      SELECT query_id, strategy, round(greatest(0, {_mix("accuracy", "ca")} - {_risk} * {_mix("accuracy_std", "cas")}) * accuracy_need + greatest(0, {_mix("recall", "cr")} - {_risk} * {_mix("recall_std", "crs")}) * recall_demand
        + {_mix("speed", "cs")} * CASE speed_budget WHEN 'real_time' THEN 1.0::DOUBLE WHEN 'interactive' THEN 0.4::DOUBLE WHEN 'background' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN list_contains(shapes, answer_shape) THEN 0.3::DOUBLE ELSE 0.12::DOUBLE END, 6) AS score FROM x""",
    "step_successes": f"""WITH {T}, x AS (SELECT event_id, k % 5 AS s, k % 9 AS n, k / 100.0::DOUBLE AS r, k % 4 AS nd, k / 150.0::DOUBLE AS ns, k % 3 AS a, least(k % 2, k % 3) AS an, k % 3 - least(k % 7, k % 3) AS att, greatest(least(k % 2, k % 3), k % 3 - least(k % 11, k % 3)) AS ae FROM t)
      SELECT event_id, coalesce(CASE WHEN n = 0 THEN NULL WHEN s = 0 THEN CASE WHEN a > 0 AND ((an >= 1 AND ae = a) OR att / nullif(a, 0) >= 0.8::DOUBLE) THEN 'high' END WHEN s IN (1, 4) THEN CASE WHEN r >= 0.5 THEN 'high' WHEN r >= 0.3::DOUBLE THEN 'medium' END
        WHEN s = 2 THEN CASE WHEN r >= 0.4::DOUBLE THEN 'high' WHEN r >= 0.25 THEN 'medium' END WHEN s = 3 AND nd >= 2 AND ns >= 0.4::DOUBLE THEN 'high' END, 'failed') AS grade FROM x""",
    "escalations": f"""WITH {_ATTEMPTS}, bu AS (SELECT query_id, min(b) AS budget FROM att GROUP BY 1), n AS (SELECT att.*, budget, row_number() OVER (PARTITION BY query_id ORDER BY attempt) AS n FROM att JOIN bu USING (query_id)),
      f AS (SELECT *, EXISTS (SELECT 1 FROM n o WHERE o.query_id = n.query_id AND o.n < n.n AND NOT o.abstained) AS done, EXISTS (SELECT 1 FROM n o WHERE o.query_id = n.query_id AND o.n < n.n AND o.signature = n.signature) AS seen FROM n WHERE n <= least(budget + 1, 4)),
      m AS (SELECT *, min(CASE WHEN seen THEN n END) OVER (PARTITION BY query_id) AS stop FROM f WHERE NOT done), k AS (SELECT *, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r FROM m WHERE stop IS NULL OR n < stop)
      SELECT query_id, tries, attempt, strategy, confidence FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS tries, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, n) AS i FROM k) WHERE i = 1""",
    "answer_confidence": f"""WITH {_ATTEMPTS}, c AS (SELECT query_id, arg_min_null(grade, attempt) AS first, count(grade) AS s, max(n_chunks) AS m FROM att GROUP BY 1), l AS (SELECT *, CASE WHEN first = 'high' THEN 'high' WHEN s > 0 THEN 'medium' ELSE 'low' END AS confidence FROM c)
      SELECT query_id, confidence, coalesce(CASE WHEN confidence = 'high' THEN NULL WHEN m < 3 AND confidence = 'low' THEN 'add_specifics' WHEN m BETWEEN 3 AND 5 AND m % 2 = 0 THEN 'add_data_point' WHEN confidence = 'low' AND m > 0 THEN 'widen' END, '-') AS hint FROM l""",
    "inherited_scores": f"WITH {T}, x AS (SELECT event_id, CASE WHEN k % 3 <> 0 THEN k / 100.0::DOUBLE ELSE 0.99::DOUBLE END AS r, CASE WHEN k % 4 <> 0 THEN k % 50 / 50.0::DOUBLE ELSE 0 END AS o FROM t) SELECT event_id, round(greatest(o + 0.15::DOUBLE, least(1, r + 0.45::DOUBLE)), 6) AS score FROM x",
    "term_statistics": f"""WITH q AS (SELECT item_id AS query_id, unnest({first_tokens("text", 7)}) AS token FROM benchmark), t AS (SELECT unnest(list_distinct({TOK.format("text")})) AS token FROM documents),
      f AS (SELECT token, count(*) AS df FROM t GROUP BY 1), s AS (SELECT query_id, token, coalesce(df, 0) AS df, CASE WHEN df IS NULL THEN 0 ELSE 1 - df / (SELECT count(*) FROM documents) END AS s FROM q LEFT JOIN f USING (token))
      SELECT query_id, token, df, round(s, 6) AS selectivity, CASE WHEN s >= 0.4 THEN 'BOOSTED' ELSE 'DROP' END AS part FROM s""",
    "item_presence": f"WITH {LINES}, {_PROFILES}, {_ITEMS} SELECT query_id, n_items, place, coalesce(missing, '-') AS missing FROM pres",
    "recall_estimates": f"""{_GATED}, {_ITEMS}, z AS (SELECT query_id, bool_or(list_contains(list_transform(literals, lambda x: lower(x)), missing)) AS z FROM pres JOIN i2 USING (query_id) WHERE missing IS NOT NULL GROUP BY 1)
      SELECT query_id, round(CASE WHEN coalesce(z, false) OR x = 0 THEN 0 ELSE pow(0.7::DOUBLE * CASE WHEN x <= 5 THEN 0.4::DOUBLE WHEN x <= 50 THEN 0.7::DOUBLE WHEN x <= 500 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END
        * CASE WHEN coalesce(n_items, 0) < 2 THEN 1.0::DOUBLE ELSE CASE place WHEN 'paragraph' THEN 1.0::DOUBLE WHEN 'document' THEN 0.7::DOUBLE WHEN 'scattered' THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END END, 1 / 3.0::DOUBLE) END, 3) AS est_recall
      FROM gated LEFT JOIN pres USING (query_id) LEFT JOIN z USING (query_id)""",
    "category_signals": f"""WITH d AS ({_signals_of("documents", "doc_id")}), q AS ({_signals_of("benchmark", "item_id")}), w AS (SELECT item_id, sum(score) AS total FROM q GROUP BY 1),
      p AS (SELECT item_id, doc_id, round(least(1, sum(q.score * d.score) / max(total)), 6) AS signal FROM q JOIN d USING (category) JOIN w USING (item_id) GROUP BY 1, 2)
      SELECT item_id AS query_id, signal, count(*) AS chunks FROM p GROUP BY ALL""",
    "signal_families": f"""WITH s AS ({_signals_of("(SELECT doc_id, coalesce(text, '') AS text FROM documents)", "doc_id")}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score * CASE category WHEN 'P' THEN 1.0::DOUBLE WHEN 'D' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END DESC, category) AS i FROM s)
      SELECT d.doc_id, coalesce(string_agg(category, ',' ORDER BY i), '') AS families FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND i <= 2 GROUP BY 1""",
    "query_literals": f"WITH {LINES}, src AS (SELECT doc_id * 100000 + paragraph_index AS query_id, text FROM lines), {cut('src')} SELECT query_id // 100000 AS doc_id, query_id % 100000 AS paragraph_index, len(literals) AS n, array_to_string(literals, ',') AS literals FROM asked0 WHERE len(literals) > 0",
    "best_attempts": f"""WITH {T}, a AS (SELECT user_id AS query_id, event_id AS attempt, k = 97 AS success, k / 100.0::DOUBLE AS rerank, k % 13 AS n_docs FROM t),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY success DESC, CASE WHEN success THEN attempt END, CASE WHEN NOT success THEN round(rerank + 0.05::DOUBLE * least(n_docs, 10), 6) END DESC, attempt) AS n FROM a)
      SELECT query_id, attempt, success, rerank, n_docs FROM r WHERE n = 1""",
    "fact_grades": f"""WITH {T}, f AS (SELECT user_id AS query_id, CASE WHEN k % 4 <> 0 THEN k / 100.0::DOUBLE ELSE 0 END AS s, k % 19 = 0 AS c FROM t),
      b AS (SELECT query_id, count(*) AS n, sum(s) AS s, count(*) FILTER (c) AS contradicted, count(*) FILTER (s >= 0.5) AS validated FROM f GROUP BY 1)
      SELECT query_id, n, round(greatest(0, least(1, (s - contradicted) / n)), 6) AS score, round(s / n, 6) AS coverage, validated, contradicted FROM b""",
    "speed_priors": f"WITH {T}, b AS (SELECT strategy, ln(avg(total_ms)) AS m FROM t GROUP BY 1), e AS (SELECT min(m) AS low, max(m) AS high FROM b) SELECT strategy, round(1 - (m - low) / nullif(high - low, 0), 6) AS speed FROM b, e",
    "canonical_names": f"""SELECT doc_id, CASE source WHEN 'src0' THEN 'Source Zero' WHEN 'src1' THEN 'Source One' ELSE {_TITLE_CASE.format('source')} END AS payer, CASE lang WHEN 'fr' THEN 'FL' WHEN 'de' THEN NULL ELSE upper(lang) END AS state,
      'payer_policy_' || source AS level, source || ' ' AS name_key FROM documents""",
    "job_progress": """SELECT event_id, row_number() OVER w AS done, round(row_number() OVER w / count(*) OVER (PARTITION BY user_id) * 100, 6) AS percent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "pruned_log": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1",
    "enqueued_jobs": """WITH w AS (SELECT DISTINCT doc_id, CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS generator FROM documents)
      SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND CASE WHEN quality = 1 THEN 'A' ELSE 'B' END = w.generator AND toxic = 0)""",
    "tag_objects": f"WITH {DOC_TAGS} SELECT doc_id, string_agg(code || '=' || score::BIGINT::VARCHAR, ';' ORDER BY code) AS tags FROM doc_tags GROUP BY 1",
    "fact_matches": f"""WITH a AS (SELECT conv_id * 1000 + turn AS query_id, {first_tokens("text", None)} AS t FROM conversations WHERE role = 'user'),
      b AS (SELECT item_id AS fact_id, CASE WHEN item_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END AS authority, {first_tokens("text", None)} AS t FROM benchmark),
      x AS (SELECT query_id, len(t) AS na, unnest(t) AS k FROM a), y AS (SELECT fact_id, authority, len(t) AS nb, unnest(t) AS k FROM b),
      p AS (SELECT query_id, fact_id, na, nb, authority, count(*) AS c FROM x JOIN y USING (k) GROUP BY ALL)
      SELECT query_id, fact_id, round(c / (na + nb - c) * authority, 6) AS score FROM p WHERE c / (na + nb - c) * authority >= 0.1::DOUBLE""",
    "dominant_hosts": f"""WITH h AS (SELECT regexp_extract(CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END, '^/([a-z]{{2}})(/|$)', 1) AS region, {HOST} AS h FROM pages),
      p AS (SELECT region, CASE WHEN len(string_split(h, '.')) > 2 THEN string_split(h, '.')[-2] || '.' || string_split(h, '.')[-1] ELSE h END AS parent_host FROM h),
      c AS (SELECT region, parent_host, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY region)::BIGINT AS total, row_number() OVER (PARTITION BY region ORDER BY n DESC, parent_host DESC) AS i FROM c)
      SELECT region, parent_host, n, total FROM r WHERE i = 1 AND total >= 3 AND n >= 3""",
    "canonical_order": f"""WITH {_LEVELS}, r AS (SELECT * FROM r1 WHERE i <= 30) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score >= 0.55 THEN 3 WHEN score >= 0.35 THEN 2 WHEN score >= 0.18 THEN 1 ELSE 0 END DESC, tier, score DESC, id) AS position FROM r""",
    "balanced_order": f"""WITH {_LEVELS}, n AS (SELECT *, (tier > 1)::INT AS half, row_number() OVER (PARTITION BY query_id, tier > 1 ORDER BY score DESC, id) AS n FROM r1 WHERE i <= 15)
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY half, n) AS position FROM n WHERE n <= CASE WHEN half = 0 THEN 6 ELSE 9 END""",
}
