"""Finding the document and the passage that a citation (title, URL, section, quote) means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import TITLE_STOPS
from tidemark.functions.text import normalise, tokens
from tidemark.operators import substrings
from tidemark.sources.store import cut

# payers' names in titles, least overlap and common tokens, overlap of a strict match, statuses that mean blocked, lengths.
PAYER_TOKENS = "aetna humana cigna sunshine wellcare molina unitedhealthcare uhc centene anthem amerigroup blue bcbs kaiser magellan optum".split()
LEAST_OVERLAP, LEAST_COMMON, STRICT_OVERLAP = 0.65, 2, 0.90
MOST_LACKED = 1 - LEAST_OVERLAP + 1e-6  # the part of the smaller set that may lack, before the overlap is rounded to six places
BLOCKED = (401, 403, 451)
LEAST_QUOTE, LONG_QUOTE, PROBE = 12, 80, 60
LEAST_BODY, EXCERPT = 200, 600
MEANT_STOPS = "what is the how does a an of for and or to in on with from by at do can will be are was were that".split()
SECTION_STOPS = "the a an of for and or to in on with from by at is are be general overview information".split()
# Words in URLs for d-codes, the first that fits.
URL_KEYWORDS = (
    ("claims.timely_filing", ("timely", "filing")),
    ("utilization_management.prior_authorization", ("preauth", "prior-auth", "authorization")),
    ("utilization_management", ("preauth", "prior-auth", "authorization")),
    ("pharmacy", ("pharmacy",)),
    ("eligibility", ("eligib",)),
    ("disputes", ("appeal", "grievance")),
    ("claims", ("claims",)),
)


def title_tokens(text: Column) -> Column:
    """The distinct tokens of three letters or more that are no stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(TITLE_STOPS)))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Jaccard index and overlap coefficient of two arrays of distinct tokens, 0 where one is empty."""
    both, zero = F.size(F.array_intersect(a, b)), F.lit(0)
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), zero), F.lit(0.0)), F.coalesce(both / F.nullif(F.least(F.size(a), F.size(b)), zero), F.lit(0.0))


def _rarest_first(sets: DataFrame, key: list[str], counts: DataFrame) -> DataFrame:
    """key and the tokens of sets (key, tokens), those first that the fewest names have; counts: t, names."""
    each = sets.select(*key, F.explode("tokens").alias("t")).join(counts, "t", "left")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "t")))
    return each.groupBy(*key).agg(ordered.alias("tokens")).select(*key, F.transform("tokens", lambda x: x["t"]).alias("tokens"))


def by_title(citations: DataFrame, documents: DataFrame, payers: list[str] = PAYER_TOKENS) -> DataFrame:
    """citation_id, doc_id, overlap and method of citations (citation_id, title) whose title names a document (doc_id, name).

    Names that hold all of a title's tokens go before others; then the greatest overlap coefficient, the shortest name,
    the smallest id. A match needs an overlap of .65 and two common tokens, and another payer's name rules it out.

    Titles of the same tokens are looked for once, and of names with the same tokens the first by size and id takes part. First
    names are looked for that hold all of a title's tokens or all but one, each such set once for all titles that have it: what many
    titles and names begin with makes no pairs of them. Behind these only names can go that a title holds wholly. Pairs are made for
    titles that found none: where the best overlap is less than .65 nothing is found, so the smaller set has two of its rarest
    tokens, as many as it may lack and two, in common with the other. A title of one token has no two in common with any name; a name of
    one token can't be meant, but goes before those that fit less.
    """
    own = lambda c: F.array_intersect(F.col(c), F.array(*map(F.lit, payers)))
    asked = citations.select("citation_id", F.array_sort(title_tokens(F.col("title"))).alias("tokens")).where(F.size("tokens") >= LEAST_COMMON)
    titles = asked.groupBy("tokens").agg(F.min("citation_id").alias("id"))
    named = documents.select("doc_id", F.length("name").alias("size"), F.array_sort(title_tokens(F.col("name"))).alias("tokens")).where("size(tokens) > 0")
    names = cut(named.groupBy("tokens").agg(F.min(F.struct("size", "doc_id")).alias("r")).select("tokens", "r.size", "r.doc_id"))
    counts = cut(names.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("names")))
    a = cut(_rarest_first(titles, ["id"], counts).select("id", F.col("tokens").alias("a"), F.size("tokens").alias("n_a"), own("tokens").alias("own_a")))
    b = cut(_rarest_first(names, ["doc_id", "size"], counts).select("doc_id", "size", F.col("tokens").alias("b"), F.size("tokens").alias("n_b"), own("tokens").alias("own_b")))
    # Two tokens together are rare where each is frequent.
    twos = lambda c: F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y, j: F.struct(i.alias("i"), (i + j + 1).alias("j"), F.xxhash64(x, y).alias("two")))))
    by_two = lambda df, key, n, c: df.where(F.col(n) > 1).select(key, n, F.explode(twos(c)).alias("p")).select(key, n, "p.*")
    of_a, of_b = by_two(a, "id", "n_a", F.col("a")), by_two(b, "doc_id", "n_b", F.col("b")).select("doc_id", "n_b", "two")
    foreign = (F.size("own_a") > 0) & (F.size("own_b") > 0) & ~F.arrays_overlap("own_a", "own_b")
    row = lambda common, overlap: ("id", "doc_id", "size", common.alias("common"), (common < F.col("n_a")).alias("partly"), F.round(overlap, 6).alias("overlap"), foreign.alias("foreign"))

    # Titles' tokens without the one of number `lacks` (-1: all), and the two of them that the fewest names have.
    known = of_a.join(of_b.groupBy("two").agg(F.count(F.lit(1)).alias("names")), "two").groupBy("id").agg(F.collect_list(F.struct("names", "two", "i", "j")).alias("twos"))
    lacks = F.sequence(F.lit(-1), F.when(F.col("n_a") * MOST_LACKED >= 1, F.col("n_a") - 1).otherwise(-1))
    parts = a.join(known, "id").withColumn("lacks", F.explode(lacks))
    among = F.filter("twos", lambda p: (p["i"] != F.col("lacks")) & (p["j"] != F.col("lacks")))
    left = F.col("n_a") - (F.col("lacks") >= 0).cast("int")
    # All of them stand in some name.
    parts = parts.where(F.size(among) == left * (left - 1) / 2).select("id", "n_a", "own_a", "lacks", F.array_sort(F.filter("a", lambda x, i: i != F.col("lacks"))).alias("part"), F.array_min(among)["two"].alias("two"))
    parts = cut(parts)
    met = parts.groupBy("part").agg(F.min("two").alias("two")).join(of_b, "two").where("n_b >= size(part)").select("part", "doc_id").join(b, "doc_id").where(F.size(F.array_except("part", "b")) == 0)
    first = F.min(F.struct("size", "doc_id", "own_b"))
    holders = met.groupBy("part", (F.col("n_b") == F.size("part")).alias("equal")).agg(first.alias("r")).select("part", "equal", "r.*")
    overlap_of = F.when(F.col("equal") | (F.col("lacks") < 0), F.lit(1.0)).otherwise(left / F.col("n_a"))
    early = cut(parts.join(holders, "part").select(*row(left, overlap_of)))

    rest = cut(a.join(early.where("not partly").select("id").distinct(), "id", "left_anti"))
    held = by_two(rest, "id", "n_a", F.col("a")).join(by_two(b, "doc_id", "n_b", F.slice("b", 1, 2)), "two").where("n_b < n_a").select("id", "doc_id")
    held = held.unionByName(rest.select("id", F.explode("a").alias("t")).join(b.where("n_b = 1").select("doc_id", F.get("b", 0).alias("t")), "t").select("id", "doc_id"))
    held = held.join(rest, "id").join(b, "doc_id").where(F.size(F.array_except("b", "a")) == 0).select(*row(F.col("n_b"), F.lit(1.0)))

    rest = cut(rest.join(early.select("id").distinct(), "id", "left_anti"))
    most = lambda c: F.slice(c, 1, (F.floor(F.size(c) * MOST_LACKED) + 2).cast("int"))
    short = by_two(rest, "id", "n_a", most("a")).join(of_b, "two").where("n_a <= n_b")
    longer = by_two(rest, "id", "n_a", F.col("a")).join(by_two(b, "doc_id", "n_b", most("b")), "two").where("n_b < n_a")
    pairs = short.select("id", "doc_id").unionByName(longer.select("id", "doc_id")).distinct().join(rest, "id").join(b, "doc_id")
    common = F.size(F.array_intersect("a", "b"))
    rows = early.unionByName(held).unionByName(pairs.select(*row(common, common / F.least("n_a", "n_b")))).where(F.col("overlap") >= LEAST_OVERLAP)
    best = F.min(F.struct("partly", (-F.col("overlap")).alias("apart"), "size", "doc_id", "common", "overlap", "foreign")).alias("r")
    good = rows.groupBy("id").agg(best).select("id", "r.*").where((F.col("common") >= LEAST_COMMON) & ~F.col("foreign"))
    found = asked.join(titles, "tokens").select("citation_id", "id").join(good, "id")
    return found.select("citation_id", "doc_id", "overlap", F.when(F.col("overlap") >= STRICT_OVERLAP, "title_strict").otherwise("title_relaxed").alias("method"))


def by_url(citations: DataFrame, documents: DataFrame, registry: DataFrame) -> DataFrame:
    """citation_id, doc_id, kind and method of citations (citation_id, url): a document (doc_id, url) with it, else the registry's row (url, ingested_doc_id, last_status)."""
    owned = documents.where("url is not null").groupBy("url").agg(F.min("doc_id").alias("own"))
    known = registry.groupBy("url").agg(F.min(F.struct("ingested_doc_id", "last_status")).alias("r")).select("url", "r.*", F.lit(True).alias("known"))
    rows = citations.select("citation_id", "url").join(owned, "url", "left").join(known, "url", "left").where("own is not null or known")
    kind = F.when(F.col("own").isNotNull() | F.col("ingested_doc_id").isNotNull(), "doc_ingested").when(F.col("last_status").isin(*BLOCKED), "sitemap_robots_blocked").otherwise("sitemap_needs_scrape")
    return rows.select("citation_id", F.coalesce("own", "ingested_doc_id").alias("doc_id"), kind.alias("kind"), F.when(F.col("own").isNotNull(), "url_exact_doc").otherwise("url_exact_sitemap").alias("method"))


def by_quote(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citation_id, doc_id and paragraph_index of the first chunk (doc_id, paragraph_index, text) in which a citation's quote stands.

    What is looked for is the quote, or the start of a long one, as a part of the normalised text, whatever its words are.
    """
    quote = normalise(F.col("quote"))
    probe = F.when(F.length(quote) <= LONG_QUOTE, quote).otherwise(F.substring(quote, 1, PROBE))
    asked = citations.where(F.length("quote") >= LEAST_QUOTE).select("citation_id", probe.alias("pattern"))
    found = substrings.holding(asked, chunks.select("doc_id", "paragraph_index", normalise(F.col("text")).alias("text")), ["doc_id", "paragraph_index"])
    return found.groupBy("citation_id").agg(F.min(F.struct("doc_id", "paragraph_index")).alias("p")).select("citation_id", "p.doc_id", "p.paragraph_index")


def section_topic(section: Column) -> Column:
    """A section's name without its number."""
    return F.trim(F.regexp_replace(section, r"^\s*([0-9]+\.?)+\s*", ""))


def token_share(text: Column, asked: Column, stops: list[str]) -> Column:
    """Which part of the tokens of four letters or more of `asked`, without stops, the text has."""
    wanted = F.array_distinct(F.filter(tokens(asked), lambda t: (F.length(t) >= 4) & ~t.isin(stops)))
    return F.coalesce(F.size(F.array_intersect(wanted, tokens(text))) / F.nullif(F.size(wanted), F.lit(0)), F.lit(0.0))


def meaningful_share(text: Column, query: Column) -> Column:
    return token_share(text, query, MEANT_STOPS)


def section_share(text: Column, section: Column) -> Column:
    return token_share(text, section, SECTION_STOPS)


def passages(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citation_id, page_number, paragraph_index, excerpt and method of the passage that a citation means in its document.

    citations: citation_id, doc_id, section, quote, page (each may be null); chunks: doc_id, paragraph_index,
    page_number, section, text. In order: a chunk whose section holds the cited one; one with all of the quote's tokens;
    one of the cited page; the first behind the first page. Only chunks of some length count.
    """
    body = chunks.where(F.length("text") >= LEAST_BODY).select("doc_id", "paragraph_index", "page_number", F.lower("section").alias("_section"), "text")
    rows = citations.join(body, "doc_id")
    wanted = F.array_distinct(tokens(F.col("quote")))
    step = (
        F.when(F.contains("_section", F.lower("section")), 1)
        .when((F.length("quote") >= LEAST_QUOTE) & (F.size(F.array_except(wanted, tokens(F.col("text")))) == 0), 2)
        .when(F.col("page_number") == F.col("page"), 3)
        .when(F.col("page_number") > 1, 4)
    )
    first = rows.withColumn("step", step).where("step is not null").groupBy("citation_id").agg(F.min(F.struct("step", "page_number", "paragraph_index", F.substring("text", 1, EXCERPT).alias("excerpt"))).alias("p"))
    method = F.element_at(F.array(*map(F.lit, ("by_section", "by_quote_tokens", "by_page", "doc_first_chunk"))), F.col("p.step"))
    return first.select("citation_id", "p.page_number", "p.paragraph_index", "p.excerpt", method.alias("method"))


def sitemap_candidates(requests: DataFrame, registry: DataFrame, most: int = 3) -> DataFrame:
    """query_id, url and rank of reachable pages of a request's payer whose URL has a word of its first fitting d-code.

    requests: query_id, payer, dcodes; registry: payer, url, last_status, curation_status, ingested, last_seen.
    """
    fits = lambda p: F.exists("dcodes", lambda c: (c == p) | c.startswith(f"{p}."))
    words = reduce(lambda acc, x: acc.when(fits(x[0]), F.array(*map(F.lit, x[1]))), URL_KEYWORDS[1:], F.when(fits(URL_KEYWORDS[0][0]), F.array(*map(F.lit, URL_KEYWORDS[0][1]))))
    asked = requests.select("query_id", "payer", words.alias("words")).where("words is not null")
    # Requests for one payer and topic have the same pages: these are ranked once.
    topics = asked.select("payer", "words").distinct()
    pages = registry.where((F.col("last_status") == 200) & ~F.col("curation_status").isin("noise", "stale")).select("payer", "url", "ingested", "last_seen")
    found = topics.join(pages, "payer").where(F.exists("words", lambda w: F.contains(F.lower("url"), w)))
    order = Window.partitionBy("payer", "words").orderBy(F.desc("ingested"), F.desc("last_seen"), "url")
    first = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return asked.join(first.select("payer", "words", "url", "rank"), ["payer", "words"]).select("query_id", "url", "rank")


def web_query(text: Column, terms: Column, domain: Column) -> Column:
    """The text with each term in quotes and the domain behind it."""
    quoted = F.array_join(F.transform(terms, lambda t: F.concat(F.lit(' "'), t, F.lit('"'))), "")
    return F.concat(text, quoted, F.when(domain.isNotNull(), F.concat(F.lit(" site:"), domain)).otherwise(""))


def web_terms(parts: DataFrame, with_domain: Column, rare: float = 0.95) -> DataFrame:
    """query_id and terms that a web query must hold: required literals, and required tags where a domain anchors them or they are rare."""
    tag = F.col("term_kind") == "tag"
    kept = parts.where((F.col("part") == "REQUIRED") & (~tag | with_domain | (F.col("selectivity") >= rare)))
    bare = F.trim(F.lower(F.replace(F.element_at(F.split("term", r"\."), -1), F.lit("_"), F.lit(" "))))
    return kept.groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(tag, bare).otherwise(F.col("term")))).alias("terms"))


def rerank_hits(hits: DataFrame) -> DataFrame:
    """hits (query_id, place, url, title, snippet, domain, terms) with their new place: 2 for the known domain, 1 for each term said; equal ones stay in order."""
    said = F.lower(F.concat_ws(" ", "title", "snippet"))
    known = F.when(F.contains(F.lower("url"), F.lower("domain")), 2).otherwise(0)
    score = known + F.size(F.filter("terms", lambda t: F.contains(said, F.lower(t))))
    order = Window.partitionBy("query_id").orderBy(F.desc("hit_score"), "place")
    return hits.withColumn("hit_score", score.cast("long")).withColumn("new_place", F.row_number().over(order).cast("long"))
