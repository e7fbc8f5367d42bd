"""Search end to end for a table of requests: arms, filters, fusion, enrichment, rerank, floor, assembly, neighbours.

    corpus mode     lexical, vector and tag arm, fused by reciprocal ranks
    precision mode  lexical and tag arm
    recall mode     vector arm alone, with its raw similarity

Each arm gives a bounded number of rows per request, so that everything behind it works on candidates only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import NEIGHBOUR_FLOOR, NEIGHBOUR_SHARE
from tidemark.functions.text import content_key, normalise
from tidemark.operators import covers, fusion, gate, lexical, ranking, substrings, understanding, vector
from tidemark.operators.tagging import leaf
from tidemark.sources.store import cut, laid_down, sent

CHUNK = ["doc_id", "paragraph_index"]
# Authority levels in the order of the tag arm, and what a query that is a code looks like.
AUTHORITY_ORDER = ("contract_source_of_truth", "operational", "payer_policy", "fyi_not_citable")
CODE = r"^([A-Z]{1,4}[.\-_]?[A-Z0-9]{1,5}([.\-_][A-Z0-9]{1,5})+|[A-Z][0-9]{4,5})$"


@dataclass(frozen=True)
class Corpus:
    """The tables that are searched.

    chunks: doc_id, paragraph_index, page_number, text; documents: doc_id, name, payer, state, program,
    authority_level; line_tags: doc_id,
    paragraph_index, kind, code; document_tags: doc_id, kind, code; vectors: chunk, doc_id,
    paragraph_index, embedding; places: the index of `covers.positions` (not read in recall mode); bags: kind, code, phrase, what a
    request's tags may be asked by; scope: query_id and doc_id of the only documents that a request may get
    (null: all of them, for each request); dealt: whether places are stored by document.
    """

    chunks: DataFrame
    documents: DataFrame
    line_tags: DataFrame
    document_tags: DataFrame
    vectors: DataFrame
    places: DataFrame | None
    bags: DataFrame
    scope: DataFrame | None = None
    dealt: bool = False


@dataclass(frozen=True)
class Options:
    mode: str = "corpus"  # corpus, precision or recall
    k: int = 10
    tag_mode: str = "auto"  # auto, strict, relaxed or none
    order: str = "score"  # score, canonical_first or balanced
    canonical_floor: float = 0.5
    min_similarity: float | None = None
    paragraphs: int = 2  # of neighbours around a hit; 0 for none
    pages: int = 1
    merge_from: float = 0.7  # lexical score from which a hit takes in its topic block
    per_document: int = 20
    total: int = 50


def in_scope(payer: Column, state: Column, program: Column, authority: Column, plans: tuple[str, ...], authorities: tuple[str, ...], home: str) -> Column:
    """Whether a document row (payer, state, program, authority_level) is in a request's scope, given as columns that may be null.

    A request for one of the `plans` also admits the state's `authorities` in the state `home`.
    """
    same = lambda asked, own: F.coalesce(asked == F.col(own), F.lit(True))
    shared = payer.isin(*plans) & F.col("payer").isin(*authorities) & (F.col("state") == home)
    return (same(payer, "payer") | F.coalesce(shared, F.lit(False))) & same(state, "state") & same(program, "program") & same(authority, "authority_level")


def _held(sets: DataFrame, documents: DataFrame) -> DataFrame:
    """codes, _state, _program, _payer: what a document may say of itself to be named by a j-tag of a set (codes)."""
    each = sets.select("codes", F.explode("codes").alias("tag"))
    parts = each.where(F.col("tag").rlike(r"^j:[^.]+\..")).select("codes", "tag", F.regexp_extract("tag", r"^j:([^.]+)", 1).alias("category"), F.regexp_extract("tag", r"^j:[^.]+\.(.*)$", 1).alias("value"))
    said = F.replace("value", F.lit("_"), F.lit(" "))
    # What a document says of itself is one of few values, so tags are held against values, not documents.
    values = documents.select("state", "program", "payer").distinct()
    names = lambda c: F.contains(F.lower(c), F.lower(said))
    meets = F.when(F.col("category") == "state", F.col("state") == F.upper(F.substring("value", 1, 2))).when(F.col("category") == "program", names("program")).when(F.col("category").isin("payor", "regulatory_authority"), names("payer"))
    return parts.join(values, meets).select("codes", "state", "program", "payer").distinct().toDF("codes", "_state", "_program", "_payer")


_SAYS = ("state", "program", "payer")
_BY_PAYER = r"^j:(payor|regulatory_authority)\."


def tag_filters(requests: DataFrame, documents: DataFrame, document_tags: DataFrame) -> DataFrame:
    """query_id, doc_id, strict and relaxed of documents that a request's tags (array `codes` of kind:code) admit.

    Strict: a j-tag names the document's state, program or payer, or the document has that payer tag.
    Relaxed: the document has one of the d- or p-tags. Requests with the same tags are worked out once.
    """
    sets = requests.select("codes").distinct()
    each = sets.select("codes", F.explode("codes").alias("tag"))
    held = _held(sets, documents)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SAYS]  # a document may lack some
    by_value = documents.select("doc_id", *_SAYS).join(F.broadcast(held), same).select("codes", "doc_id", F.lit(True).alias("strict"), F.lit(False).alias("relaxed"))
    tags = document_tags.select("doc_id", "kind", F.concat_ws(":", "kind", "code").alias("tag"))
    has = each.join(tags, "tag")
    by_payer = has.where(F.col("tag").rlike(_BY_PAYER)).select("codes", "doc_id", F.lit(True).alias("strict"), F.lit(False).alias("relaxed"))
    by_topic = has.where("kind <> 'j'").select("codes", "doc_id", F.lit(False).alias("strict"), F.lit(True).alias("relaxed"))
    every = by_value.unionByName(by_payer).unionByName(by_topic).groupBy("codes", "doc_id").agg(F.max("strict").alias("strict"), F.max("relaxed").alias("relaxed"))
    return requests.select("query_id", "codes").join(every, "codes").select("query_id", "doc_id", "strict", "relaxed")


def tag_filters_of(pairs: DataFrame, requests: DataFrame, documents: DataFrame, document_tags: DataFrame) -> DataFrame:
    """The rows of `tag_filters` for pairs (query_id, doc_id) only: no request meets all documents that its tags admit."""
    pairs = cut(pairs.select("query_id", "doc_id").distinct())
    own = pairs.join(requests.select("query_id", "codes"), "query_id").join(documents.select("doc_id", *_SAYS), "doc_id")
    same = [F.col("_codes").eqNullSafe(F.col("codes")), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SAYS)]
    held = _held(requests.select("codes").distinct(), documents).withColumnRenamed("codes", "_codes")
    by_value = own.join(held, same).select("query_id", "doc_id", F.lit(True).alias("strict"), F.lit(False).alias("relaxed"))
    has = own.select("query_id", "doc_id", "codes").join(document_tags.select("doc_id", "kind", F.concat_ws(":", "kind", "code").alias("tag")), "doc_id").where(F.array_contains("codes", F.col("tag")))
    by_tag = has.select("query_id", "doc_id", F.col("tag").rlike(_BY_PAYER).alias("strict"), (F.col("kind") != "j").alias("relaxed")).where("strict or relaxed")
    return by_value.unionByName(by_tag).groupBy("query_id", "doc_id").agg(F.max("strict").alias("strict"), F.max("relaxed").alias("relaxed"))


def tag_moded(found: DataFrame, requests: DataFrame, admitted: DataFrame, mode: str, relaxes: bool = True) -> DataFrame:
    """found (query_id, doc_id, ...) under a tag mode: strict, relaxed, none, or auto, which is relaxed only where strict leaves a request nothing.

    Without j-tags auto and strict filter nothing. relaxes: whether relaxed filters at all (in the lexical arm it doesn't).
    """
    if mode == "none" or mode == "relaxed" and not relaxes:
        return found
    some = lambda pattern: F.exists("codes", lambda c: c.rlike(pattern))
    about = sent(requests.select("query_id", some(r"^j:(state|program|payor|regulatory_authority)\..").alias("_j"), some("^[dp]:").alias("_dp")))
    # Documents with the queries that they are admitted to, so that what is found meets them where it lies by document.
    of = lambda test: F.collect_set(F.when(F.col(test), F.col("query_id"))).alias(test)
    rows = covers.of_document(found.join(about, "query_id"), admitted.groupBy("doc_id").agg(of("strict"), of("relaxed")), "left")
    is_in = lambda c: F.coalesce(F.array_contains(c, F.col("query_id")), F.lit(False))
    strict = ~F.col("_j") | is_in("strict")
    relaxed = ~F.col("_dp") | is_in("relaxed")
    if mode == "strict":
        rows = rows.where(strict)
    elif mode == "relaxed":
        rows = rows.where(relaxed)
    else:
        rows = laid_down(rows.withColumns({"strict": strict, "relaxed": relaxed}))
        strict, relaxed = F.col("strict"), F.col("relaxed")
        any_strict = cut(rows.groupBy("query_id").agg(F.max(strict).alias("_any")))
        rows = rows.join(sent(any_strict), "query_id").where(F.when(F.col("_any"), strict).otherwise(F.col("_dp") & relaxed)).drop("_any")
    return rows.drop("_j", "_dp", "strict", "relaxed")


def code_lookup(requests: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id and rank of documents whose name holds a query that is a code, anywhere; a request without one falls through."""
    asked = requests.select("query_id", F.upper(F.trim("text")).alias("pattern")).where(F.col("pattern").rlike(CODE))
    found = substrings.holding(asked, documents.select("doc_id", F.upper("name").alias("text")), ["doc_id"]).select("query_id", "doc_id").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).cast("long")).where(F.col("rank") <= k)


def lexical_arm(requests: DataFrame, corpus: Corpus, options: Options, admitted: DataFrame) -> DataFrame:
    """query_id, doc_id, paragraph_index, similarity and rank by cover density, its levels chosen within what scope and tags leave."""
    tags = requests.select("query_id", F.explode("codes").alias("tag"))
    phrases = tags.join(corpus.bags.select(F.concat_ws(":", "kind", "code").alias("tag"), "phrase"), "tag").select("query_id", "phrase")
    narrow = lambda rows: tag_moded(rows, requests, admitted, options.tag_mode, relaxes=False)
    kept = covers.ranked(requests.select("query_id", "text"), phrases, corpus.places, corpus.chunks, corpus.scope, narrow, corpus.dealt)
    return lexical.top_k(kept, 2 * options.k, "score", CHUNK).select("query_id", *CHUNK, F.col("score").alias("similarity"), "rank")


def vector_arm(requests: DataFrame, corpus: Corpus, options: Options) -> DataFrame:
    """The nearest chunks; where tags or a least similarity will take rows away, more are fetched first."""
    wanted = 2 * options.k
    fetched = wanted * (8 if options.mode == "recall" or options.tag_mode != "none" else 1)
    asked = requests.select(F.col("query_id").alias("chunk"), "embedding")
    least = options.min_similarity if options.mode == "recall" else None
    if corpus.scope is None:
        near = vector.nearest(asked, corpus.vectors, fetched, "chunk", least)
    else:
        pools = corpus.scope.join(corpus.vectors.select("doc_id", "chunk"), "doc_id")
        near = vector.nearest_within(pools, asked, corpus.vectors, fetched, "chunk", least)
    rows = near.drop("rank").join(corpus.vectors.select("chunk", *CHUNK), "chunk")
    admitted = None
    if options.tag_mode != "none":
        rows = cut(rows)
        admitted = tag_filters_of(rows, requests, corpus.documents, corpus.document_tags)
    return lexical.top_k(tag_moded(rows, requests, admitted, options.tag_mode), wanted, "similarity", CHUNK).select("query_id", *CHUNK, "similarity", "rank")


def tag_arm(requests: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """The first k chunks with one of the request's d-tags, by authority: each tag's first k are found once, then those of a request's tags merged.

    requests: dtags, the codes asked for. Similarity is .5.
    """
    place = reduce(lambda acc, x: acc.when(F.col("authority_level") == x[1], x[0]), list(enumerate(AUTHORITY_ORDER))[1:], F.when(F.col("authority_level") == AUTHORITY_ORDER[0], 0)).otherwise(len(AUTHORITY_ORDER))
    each = requests.select("query_id", F.explode("dtags").alias("code"))
    tagged = corpus.line_tags.where("kind = 'd'").select(*CHUNK, "code").join(F.broadcast(each.select("code").distinct()), "code")
    tagged = tagged.join(corpus.documents.select("doc_id", "authority_level"), "doc_id").select(*CHUNK, "code", place.alias("place"))
    if corpus.scope is None:
        first = tagged.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("place", *CHUNK))).where(F.col("n") <= k)
    else:  # a tag's first chunks differ from request to request
        each = each.join(corpus.scope.select("query_id", "doc_id").distinct(), "query_id")
        first = tagged
    rows = each.join(first, "code" if corpus.scope is None else ["code", "doc_id"]).select("query_id", *CHUNK, "place").distinct()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", *CHUNK)).cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", *CHUNK, F.lit(0.5).alias("similarity"), "rank")


def candidates(requests: DataFrame, corpus: Corpus, options: Options) -> DataFrame:
    """query_id, doc_id, paragraph_index, place (by fusion) and the similarity in each arm, null where an arm lacks the row."""
    arms = {}
    if options.mode != "recall":
        admitted = cut(tag_filters(requests, corpus.documents, corpus.document_tags))
        arms["bm25"] = lexical_arm(requests, corpus, options, admitted)
    if options.mode != "precision":
        arms["vector"] = vector_arm(requests, corpus, options)
    if options.mode != "recall":
        arms["dtag"] = tag_arm(requests, corpus, options.k)
    every = reduce(DataFrame.unionByName, (df.withColumns({"arm": F.lit(n), "arm_order": F.lit(i)}) for i, (n, df) in enumerate(arms.items())))
    sim = lambda n: F.max(F.when(F.col("arm") == n, F.col("similarity"))).alias(n)
    fused = every.groupBy("query_id", *CHUNK).agg(F.sum(1.0 / (fusion.RRF_K + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), F.min_by("arm", "arm_order").alias("arm"), *(sim(n) for n in ("bm25", "vector", "dtag")))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 9).desc(), "best_rank", *CHUNK)
    return fused.withColumn("place", F.row_number().over(order).cast("long"))


def first_contents(rows: DataFrame, chars: int = 400) -> DataFrame:
    """rows (query_id, text, place) with one row per query and content, the first by place; those without content stay."""
    key = content_key(F.col("text"), chars)
    keyed = rows.withColumn("_key", F.when(key == "", F.concat(F.lit("#"), F.col("place").cast("string"))).otherwise(F.concat(F.lit("="), key)))
    first = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("place"))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_key", "_n")


HEADER_CHARS, HEADER_MARKS = 80, ("Provider Manual", "SH_")


def topic_blocks(rows: DataFrame, chunks: DataFrame, least: float, paragraphs: int = 3, most: int = 5) -> DataFrame:
    """rows (query_id, doc_id, paragraph_index, page_number, text, lexical) with the texts of their block round those of good hits.

    A hit of `least` or more takes in, in document order, the first `most` texts of its page within so many
    paragraphs, without page headers.
    """
    good = rows.where(F.coalesce("lexical", F.lit(0.0)) >= least)
    header = (F.length(F.trim("text")) < HEADER_CHARS) & reduce(lambda a, b: a | b, (F.col("text").contains(m) for m in HEADER_MARKS))
    around = ranking.neighbours(good.select(*CHUNK, "page_number").distinct(), chunks.where((F.trim("text") != "") & ~header), paragraphs, 0)
    order = Window.partitionBy("doc_id", "seed_paragraph").orderBy("paragraph_index")
    first = around.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("paragraph_index", F.trim("text").alias("text"))))
    blocks = first.groupBy("doc_id", F.col("seed_paragraph").alias("paragraph_index")).agg(parts.alias("_parts"))
    own = F.struct(F.col("paragraph_index"), F.trim("text").alias("text"))
    merged = F.array_join(F.filter(F.transform(F.array_sort(F.array_append("_parts", own)), lambda p: p["text"]), lambda t: t != ""), "\n\n")
    joined = rows.join(blocks, CHUNK, "left")
    taken = F.col("_parts").isNotNull() & (F.coalesce("lexical", F.lit(0.0)) >= least)
    return joined.withColumns({"text": F.when(taken, merged).otherwise(F.col("text")), "n_merged": F.when(taken, F.size("_parts")).otherwise(0).cast("long")}).drop("_parts")


def meta_haystack(name: Column, payer: Column, state: Column, codes: Column) -> Column:
    """What a document says of itself, for phrases that its texts don't repeat: name as it is and cut, payer, state, and tags by leaf and in full."""
    cut = F.regexp_replace(name, r"[_\-/.]", " ")
    bare = F.transform(codes, lambda c: F.substring(c, 3, 1000))
    full = F.transform(bare, lambda c: F.lower(F.regexp_replace(c, r"[._]", " ")))
    own = F.array(*(normalise(F.coalesce(c, F.lit(""))) for c in (name, cut, payer, state)))
    return F.array_join(F.filter(F.concat(own, F.transform(bare, leaf), full), lambda x: x != ""), " | ")


def rerank(rows: DataFrame, single_arm: bool) -> DataFrame:
    """rows with coverage, boosted and score.

    rows: bm25, vector, dtag, authority_level, text, context, meta, codes (the document's tags), dcodes (the chunk's d-codes), query, and
    phrases, an array of (phrase, weight, code) or null. A phrase is there if the document has its j-tag, or if it
    stands in the text, the texts beside it, or what the document says of itself. All weights' signals are
    averaged over those that the query has; chunks with one of its d-tags count half as much again.
    """
    body = F.concat_ws(" | ", normalise(F.col("text")), F.nullif(normalise(F.coalesce("context", F.lit(""))), F.lit("")))
    tag = lambda p: F.coalesce(p["code"].startswith("j:") & F.array_contains(F.col("codes"), p["code"]), F.lit(False))
    there = lambda p: tag(p) | F.contains(F.col("_body"), p["phrase"]) | F.contains(F.col("meta"), p["phrase"])
    some = F.coalesce(F.size("phrases") > 0, F.lit(False))
    total = lambda test: F.aggregate("phrases", F.lit(0.0), lambda acc, p: acc + F.when(test(p), p["weight"]).otherwise(0.0))
    coverage = F.when(some, total(there) / total(lambda p: F.lit(True)))
    boosted = some & F.exists("phrases", lambda p: F.coalesce(p["code"].startswith("d:") & F.array_contains("dcodes", F.substring(p["code"], 3, 1000)), F.lit(False)))
    arms = [F.col(n) if single_arm else ranking.arm_similarity(F.lit(n), F.col(n)) for n in ("bm25", "vector", "dtag")]
    asked, own = understanding.signal_struct(F.col("query")), understanding.signal_struct(F.col("_body"))
    weight = understanding.signal_weight(F.col("_asked"))
    rows = rows.withColumn("_body", body).withColumns({"_asked": asked, "_own": own})
    signal = F.when(weight > 0, F.least(F.lit(1.0), understanding.signal_dot(F.col("_asked"), F.col("_own")) / weight))
    rows = rows.withColumns({"coverage": coverage, "boosted": F.coalesce(boosted, F.lit(False)), "signal": signal, "_sim": F.coalesce(F.greatest(*arms), F.lit(0.0))})
    parts = [(0.25, F.col("_sim")), (0.10, ranking.authority_score(F.col("authority_level"))), (0.05, ranking.length_score(F.col("text"))), (0.20, F.col("signal")), (0.55, F.col("coverage"))]
    raw = reduce(lambda a, b: a + b, (F.coalesce(w * c, F.lit(0.0)) for w, c in parts))
    active = 0.40 + F.when(F.col("signal").isNotNull(), 0.20).otherwise(0.0) + F.when(some, 0.55).otherwise(0.0)
    score = F.round(raw / active * F.when(F.col("boosted"), ranking.TAG_BOOST).otherwise(1.0), 6)
    return rows.withColumn("score", score).drop("_body", "_asked", "_own", "_sim")


def coverage_floor(rows: DataFrame) -> DataFrame:
    """Drops rows without all phrases, but for the values of contacts that were asked for, and rows with the query's d-tag."""
    contact = gate.says(F.col("query"), gate.CONTACT_QUERY) & gate.says(F.col("text"), gate.CONTACT_VALUE)
    return rows.where(F.col("coverage").isNull() | (F.col("coverage") >= 1.0 - 1e-9) | contact | F.col("boosted"))


def expand_hits(picked: DataFrame, chunks: DataFrame, options: Options) -> DataFrame:
    """picked (query_id, doc_id, paragraph_index, page_number, text, score) and their neighbours, marked by `origin`.

    A neighbour whose content is among the hits, or the same as an earlier one's, is left out. It gets half of the
    best score of its document's hits. Hits come first, then neighbours by score, as many per document and in
    all as the options say.
    """
    key = content_key(F.col("text"), 200)
    seeds = picked.select("query_id", *CHUNK, "page_number", "text", "score")
    around = seeds.select("query_id", *CHUNK, "page_number").join(
        ranking.neighbours(seeds.select(*CHUNK, "page_number").distinct(), chunks, options.paragraphs, options.pages).select(
            "doc_id", F.col("seed_paragraph").alias("paragraph_index"), F.col("paragraph_index").alias("_at"), F.col("page_number").alias("_page"), F.col("text").alias("_text")
        ),
        CHUNK,
    )
    around = around.select("query_id", "doc_id", F.col("_at").alias("paragraph_index"), F.col("_page").alias("page_number"), F.col("_text").alias("text")).distinct()
    around = around.withColumn("_key", key).where("_key <> ''").join(seeds.select("query_id", *CHUNK), ["query_id", *CHUNK], "left_anti")
    around = around.join(seeds.select("query_id", key.alias("_key")), ["query_id", "_key"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(*CHUNK))
    fresh = around.withColumn("_n", first).where("_n = 1")
    best = seeds.groupBy("query_id", "doc_id").agg(F.max("score").alias("_best"))
    score = F.when(F.col("_best") > 0, NEIGHBOUR_SHARE * F.col("_best")).otherwise(NEIGHBOUR_FLOOR)
    new = fresh.join(best, ["query_id", "doc_id"]).select("query_id", *CHUNK, "page_number", "text", F.round(score, 7).alias("score"), F.lit("neighbour").alias("origin"))
    both = seeds.withColumn("origin", F.lit("hit")).unionByName(new)
    order = [(F.col("origin") != "hit").cast("int"), F.desc("score"), *map(F.col, CHUNK)]
    return ranking.per_document_cap(both, ["query_id"], "doc_id", order, options.per_document, options.total)


def search(requests: DataFrame, corpus: Corpus, options: Options = Options()) -> DataFrame:
    """query_id, doc_id, paragraph_index, origin (hit or neighbour), score, label and position of all requests' answers.

    requests: query_id, text, embedding, codes (kind:code tags), dtags (d-codes for the tag arm), phrases (array of
    phrase, weight, code, or null).
    """
    requests = cut(requests)
    found = cut(candidates(requests, corpus, options))
    docs = corpus.documents.select("doc_id", "name", "payer", "state", "authority_level")
    # The candidates go to the chunks and documents: neither all texts nor all documents are shuffled for them.
    rows = corpus.chunks.select(*CHUNK, "page_number", "text").join(sent(cut(docs.join(sent(found), "doc_id"))), CHUNK)
    rows = cut(first_contents(rows).join(requests.select("query_id", F.col("text").alias("query"), "phrases"), "query_id"))
    seeds = cut(rows.select(*CHUNK, "page_number").distinct())
    context = ranking.neighbours(seeds, corpus.chunks.select(*CHUNK, "page_number", "text"), 1, 1)
    parts = F.array_sort(F.collect_list(F.struct("paragraph_index", "text")))
    context = context.groupBy("doc_id", F.col("seed_paragraph").alias("paragraph_index")).agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 1, 1500).alias("context"))
    own = corpus.document_tags.join(sent(seeds.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "code"))).alias("codes"))
    dcodes = corpus.line_tags.where("kind = 'd'").join(sent(seeds.select(*CHUNK)), CHUNK, "left_semi").groupBy(*CHUNK).agg(F.collect_set("code").alias("dcodes"))
    none = F.array().cast("array<string>")
    rows = rows.join(context, CHUNK, "left").join(own, "doc_id", "left").join(dcodes, CHUNK, "left")
    rows = rows.withColumns({"codes": F.coalesce("codes", none), "dcodes": F.coalesce("dcodes", none)})
    asked = F.coalesce(F.size("phrases") > 0, F.lit(False))
    rows = rows.withColumn("context", F.when(asked, F.col("context"))).withColumn("codes", F.when(asked, F.col("codes")).otherwise(none))
    rows = rows.withColumn("lexical", F.when(asked, F.coalesce(F.col("bm25"), F.col("vector"), F.col("dtag"))))
    rows = topic_blocks(cut(rows), corpus.chunks.select(*CHUNK, "page_number", "text"), options.merge_from)
    rows = rows.withColumn("meta", F.when(asked, meta_haystack(F.col("name"), F.col("payer"), F.col("state"), F.col("codes"))).otherwise(""))
    ranked = cut(coverage_floor(rerank(cut(rows), single_arm=options.mode == "recall")))
    ranked = ranking.decay_filter(ranked, ["query_id", "arm"], "score")
    ranked = ranked.withColumns({
        "id": F.struct(*CHUNK),
        "content_key": content_key(F.col("text"), 200),
        "page_key": F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page_number").cast("string")),
    })
    least = {"high": 0.55, "medium": 0.35, "low": 0.18}
    floor = 0.0 if options.mode == "recall" else least["low"]
    if options.min_similarity is not None:
        floor = max((v for v in least.values() if options.min_similarity >= v), default=0.0)
    if options.order == "canonical_first":
        ordered = ranking.canonical_order(ranked, options.k)
    elif options.order == "balanced":
        ordered = ranking.balanced_order(ranked, options.k, options.canonical_floor)
    else:
        ordered = ranking.score_order(ranked, options.k)
    slots = ranking.assemble(ordered.select("query_id", "id", "position", "score", "content_key", "page_key"), options.k, floor)
    picked = cut(ranked.join(slots, ["query_id", "id"]).select("query_id", *CHUNK, "page_number", "text", "score", "slot"))
    label = ranking.confidence_label(F.col("score"))
    if not options.paragraphs:
        return picked.select("query_id", *CHUNK, F.lit("hit").alias("origin"), "score", label.alias("label"), F.col("slot").alias("position"))
    out = expand_hits(picked, corpus.chunks.select(*CHUNK, "page_number", "text"), options)
    return out.select("query_id", *CHUNK, "origin", "score", F.when(F.col("origin") == "hit", label).otherwise("low").alias("label"), "position")
