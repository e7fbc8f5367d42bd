"""Query profiles, rewrites, term statistics, recall estimates, signals, attempts and grading."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import QUERY_NOISE
from tidemark.functions.text import filter_tokens, tokens, words
from tidemark.operators.lexical import query_tokens
from tidemark.operators.lexicon import SAMPLE, Entry, expand
from tidemark.operators.routing import partition_term, query_type, untagged_selectivity
from tidemark.operators.tagging import leaf
from tidemark.sources.store import cut

# Weights of the formulas below, and the steps of a pool's factor (documents up to, factor).
POOL_STEPS, POOL_WIDE = ((0, 0.0), (5, 0.4), (50, 0.7), (500, 1.0)), 0.85
PRESENT = {"paragraph": 1.0, "document": 0.7, "scattered": 0.2, "missing": 0.05}
MOST_ITEMS = 5
#: Postings that a task is meant to take, documents or paragraphs that are looked at at once, and words of a query set that are sent to all tasks.
BLOCK, UNITS, MOST_SENT = 2_000_000, 2_048, 200_000
HALLUCINATION_PENALTY = 1.0
SUPPORTED = 0.5
# What stands for itself in a query, each pattern and the class of what may not follow it.
LITERALS = (
    (r"\b[A-Z]{2,5}\.[A-Z]{2,5}\.[0-9]+(?:\.[0-9]+)*", "[A-Za-z0-9.]"),
    (r"\b[A-Z][0-9]{4}\b", None),
    (r"\b[A-Z][0-9]{2}(?:\.[0-9]{1,4})?", "[A-Za-z0-9.]"),
    (r"\b[0-9]{5}\b", None),
    (r"\b[A-Z]{2,5}-[A-Z0-9]{2,8}(?:-[A-Z0-9]+)*\b", None),
)

#: Signal categories and their patterns, in the words of the test tables.
CATEGORIES = {"P": ("that the", "this is", "are the"), "D": ("with", "from", "pour", "avec"), "J": ("of the", "und", "en la")}


def cut_query(text: Column) -> tuple[Column, Column]:
    """The query's literals, and its other tokens: what is left between white space and punctuation once the literals are out."""
    found, rest = F.array().cast("array<string>"), F.trim(text)
    for pattern, stop in LITERALS:
        own = f"(?i){pattern}" + (f"(?!{stop})" if stop else "")
        found = F.concat(found, F.regexp_extract_all(rest, F.lit(f"({own})"), F.lit(1)))
        rest = F.regexp_replace(rest, own, " ")
    return found, F.filter(F.split(rest, r"""[\s,.;:!?()"'/\\]+"""), lambda t: t != "")


def profiles(queries: DataFrame, entries: tuple[Entry, ...] = SAMPLE) -> DataFrame:
    """query_id, text, codes (sorted kind:code), literals, untagged, core, coverage and query_type of queries (query_id, text).

    coverage: the part of the tokens that say something which are literals or words of a matched entry's phrases.
    """
    asked = {(e.kind, e.code): e.asked for e in entries}
    said = [(k, c, [w for p in phrases for w in p.split()]) for (k, c), phrases in asked.items()]
    of_entry = queries.sparkSession.createDataFrame(said, "kind string, code string, known array<string>")
    hits = expand(queries, entries).join(F.broadcast(of_entry), ["kind", "code"])
    by = hits.groupBy("query_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "code"))).alias("codes"), F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))
    found, others = cut_query(F.col("text"))
    none = F.array().cast("array<string>")
    rows = queries.select("query_id", "text", found.alias("literals"), others.alias("others")).join(by, "query_id", "left")
    rows = rows.withColumns({"codes": F.coalesce("codes", none), "known": F.coalesce("known", none)})
    rows = rows.withColumn("others", F.filter("others", lambda t: ~F.lower(t).isin(QUERY_NOISE)))
    rows = rows.withColumn("untagged", F.filter("others", lambda t: ~F.array_contains(F.col("known"), F.lower(t))))
    every = F.size("literals") + F.size("others")
    coverage = (every - F.size("untagged")) / F.greatest(every, F.lit(1))
    kind = query_type(F.size("literals") > 0, F.col("coverage"), F.size("codes") > 0)
    rows = rows.withColumn("coverage", coverage).withColumn("core", F.array_join(F.concat("literals", "others"), " "))
    return rows.select("query_id", "text", "codes", "literals", "untagged", "core", "coverage", kind.alias("query_type"))


def term_parts(profiles: DataFrame, selectivity: DataFrame) -> DataFrame:
    """query_id, term, term_kind (literal, tag, untagged), selectivity and part of all terms of profiles; selectivity: kind, code, selectivity of tags."""
    literal = profiles.select("query_id", F.explode("literals").alias("term"), F.lit("literal").alias("term_kind"), F.lit(1.0).alias("selectivity"))
    tags = profiles.select("query_id", F.explode("codes").alias("term"), F.lit("tag").alias("term_kind"))
    of_tag = selectivity.select(F.concat_ws(":", "kind", "code").alias("term"), "selectivity")
    tags = tags.join(of_tag, "term", "left").select("query_id", "term", "term_kind", F.coalesce("selectivity", F.lit(0.0)).alias("selectivity"))
    other = profiles.select("query_id", F.explode("untagged").alias("term"), F.lit("untagged").alias("term_kind")).withColumn("selectivity", untagged_selectivity(F.col("term")))
    every = literal.unionByName(tags).unionByName(other)
    return every.withColumn("part", partition_term(F.col("selectivity"), F.col("term_kind") != "untagged"))


def required_phrases(parts: DataFrame) -> DataFrame:
    """query_id and phrases, an array of (phrase, weight, code): required literals, then required tags by their leaf (not "general"), each phrase once."""
    tag = F.col("term_kind") == "tag"
    code = F.when(tag, F.col("term"))
    phrase = F.when(tag, leaf(F.substring("term", 3, 1000))).otherwise(F.lower("term"))
    rows = parts.where("part = 'REQUIRED'").select("query_id", phrase.alias("phrase"), F.greatest(F.lit(0.1), F.col("selectivity")).alias("weight"), code.alias("code"))
    rows = rows.where((F.col("phrase") != "") & ~(F.col("code").isNotNull() & (F.col("phrase") == "general")))
    first = rows.groupBy("query_id", "phrase").agg(F.min(F.struct(F.col("code").isNotNull().alias("tag"), "code", "weight")).alias("f"))
    entry = F.struct("phrase", F.col("f.weight").alias("weight"), F.col("f.code").alias("code"))
    return first.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("phrases"))


def rewrites(profiles: DataFrame, parts: DataFrame) -> DataFrame:
    """query_id and its text for each way of searching: hybrid, phrase_strict and vector_broad."""
    gone = parts.where("part = 'DROP' and term_kind = 'untagged'").groupBy("query_id").agg(F.collect_set(F.lower("term")).alias("gone"))
    rows = profiles.join(gone, "query_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    kept = lambda ws: F.filter(ws, lambda t: ~F.array_contains("gone", F.lower(t)))
    joined = lambda ws, other: F.coalesce(F.nullif(F.array_join(ws, " "), F.lit("")), other)
    core = joined(kept(words(F.coalesce(F.nullif("core", F.lit("")), F.col("text")))), F.col("text"))
    rows = rows.withColumn("hybrid", core)
    payors = F.transform(F.filter("codes", lambda c: c.startswith("j:")), lambda c: F.replace(F.regexp_replace(c, r"^j:([^.]*\.)?", ""), F.lit("_"), F.lit(" ")))
    apart = lambda t: ~F.exists("payors", lambda p: F.contains(F.lower(t), p) | F.contains(p, F.lower(t)))
    rows = rows.withColumn("payors", payors)
    strict = F.when(F.size("literals") > 0, F.array_join("literals", " ")).otherwise(joined(kept(F.col("untagged")), F.col("hybrid")))
    broad = F.when(F.size("payors") > 0, joined(F.filter(words(F.col("hybrid")), apart), F.col("hybrid"))).otherwise(F.col("hybrid"))
    return rows.select("query_id", "hybrid", strict.alias("phrase_strict"), broad.alias("vector_broad"))


def term_statistics(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, token, df, selectivity and part of each query token: one pass over the documents' distinct tokens."""
    wanted = query_tokens(queries).select("query_id", "token")
    seen = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    df = seen.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1))).scalar()
    found = wanted.join(df, "token", "left")
    n = F.coalesce("df", F.lit(0))
    selectivity = F.when(n == 0, 0.0).otherwise(1 - n / total)
    return found.select("query_id", "token", n.alias("df"), selectivity.alias("selectivity"), partition_term(selectivity, F.lit(False)).alias("part"))


def significant(profiles: DataFrame) -> DataFrame:
    """query_id, item and n_items: what has to meet in a text: literals, untagged terms, leaves of d- and j-tags; five at most, none a part of another."""
    leaves = F.filter(F.transform(F.filter("codes", lambda c: ~c.startswith("p:")), lambda c: leaf(F.substring(c, 3, 1000))), lambda x: (x != "general") & (F.length(x) >= 3))
    every = F.array_distinct(F.transform(F.concat("literals", "untagged", leaves), lambda x: F.lower(x)))
    rows = profiles.select("query_id", every.alias("every"))
    alone = F.filter("every", lambda x: ~F.exists("every", lambda y: (y != x) & F.contains(y, x)))
    items = F.slice(F.filter(alone, lambda x: F.size(tokens(x)) > 0), 1, MOST_ITEMS)
    return rows.select("query_id", items.alias("items")).select("query_id", F.size("items").cast("long").alias("n_items"), F.explode("items").alias("item"))


def _met(queries: np.ndarray, items: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Which queries (rows of items' numbers, shorter ones with repeats) have all of their items in one unit; items and units: what stands where.

    UNITS at a time are a bit each, so that a query costs an AND of a few words per item.
    """
    out = np.zeros(len(queries), bool)
    starts = np.unique(units)
    order = np.argsort(units, kind="stable")
    items, units = items[order], np.searchsorted(starts, units[order])
    for first in range(0, len(starts), UNITS):
        low, high = np.searchsorted(units, [first, first + UNITS])
        own, row = np.unique(items[low:high], return_inverse=True)
        bit = units[low:high] - first
        cell = row * (UNITS // 64) + (bit >> 6)
        order = np.argsort(cell, kind="stable")
        begins = np.flatnonzero(np.diff(cell[order], prepend=-1))
        bits = np.zeros(len(own) * (UNITS // 64), np.uint64)
        bits[cell[order][begins]] = np.bitwise_or.reduceat(np.uint64(1) << (bit[order] & 63).astype(np.uint64), begins)
        bits = bits.reshape(len(own), -1)
        left = np.flatnonzero(~out)
        for column in queries.T:  # most queries have an item that no unit has
            at = np.minimum(np.searchsorted(own, column[left]), len(own) - 1)
            left = left[own[at] == column[left]]
        for i in range(0, len(left), UNITS):
            some = left[i : i + UNITS]
            both = np.bitwise_and.reduce([bits[np.searchsorted(own, column[some])] for column in queries.T])
            out[some] = both.any(axis=1)
    return out


def _put_together(names: np.ndarray, words: list[np.ndarray], tokens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of items of several words, and the places that have all of them; each item is looked for where its rarest word stands."""
    order = np.lexsort((places, tokens))
    tokens, places = tokens[order], places[order]
    own, begins, sizes = np.unique(tokens, return_index=True, return_counts=True)
    width = int(places.max(initial=0)) + 1
    keys = np.searchsorted(own, tokens) * width + places
    made = []
    for name, each in zip(names, words):
        at = np.searchsorted(own, each)
        if len(own) and at.max() < len(own) and (own[at] == each).all():
            at = at[np.argsort(sizes[at], kind="stable")]
            near = places[begins[at[0]] : begins[at[0]] + sizes[at[0]]]
            for other in at[1:]:
                wanted = other * width + near
                near = near[keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted]
            made.append((np.full(len(near), name), near))
    return tuple(np.concatenate([x[i] for x in made] or [np.zeros(0, np.int64)]) for i in (0, 1))


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (block, doc_id, paragraph_index, number) with those of a document in one row: its paragraphs and numbers as bytes, by paragraph."""
    for batch in batches:
        block, doc, paragraph, number = (batch.column(c).to_numpy() for c in ("block", "doc_id", "paragraph_index", "number"))
        order = np.lexsort((number, paragraph, doc))
        begins = np.flatnonzero(np.diff(doc[order], prepend=doc[order][:1] - 1))
        packed = (pa.array([x.tobytes() for x in np.split(c[order].astype(np.int64), begins[1:])], pa.binary()) for c in (paragraph, number))
        if len(begins):
            yield pa.RecordBatch.from_arrays([pa.array(block[order][begins]), pa.array(doc[order][begins]), *packed], ["block", "doc_id", "paragraphs", "numbers"])


def _postings_of(own: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, paragraphs and numbers of rows of `_by_document`, one of each per posting."""
    said = [[np.frombuffer(x, np.int64) for x in own[c].to_pylist()] for c in ("paragraphs", "numbers")]
    paragraphs, numbers = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in said)
    return np.repeat(own["doc_id"].to_numpy(), [len(x) for x in said[0]]), paragraphs, numbers


def presence(items: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, place and missing: whether all items (query_id, item, n_items) meet in a paragraph, a document, or only the corpus, or which is missing.

    index: postings (doc_id, paragraph_index, token). An item stands in a paragraph that has all its words. Documents
    are dealt into blocks, queries are packed and meet each block; a task sends on the queries that it can answer, not the places.
    """
    said = items.select("item").distinct().select("item", F.array_sort(F.array_distinct(tokens(F.col("item")))).alias("words"))
    words_of = said.select(F.explode("words").alias("token")).distinct()
    numbers = cut(words_of.withColumn("number", F.monotonically_increasing_id()))
    of_words = said.select("item", F.size("words").alias("n"), F.explode("words").alias("token")).join(numbers, "token").groupBy("item", "n").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    # An item of one word has its number; those of several words have numbers below 0.
    several = cut(of_words.where("n > 1").select("numbers").distinct().withColumn("name", -1 - F.monotonically_increasing_id()))
    named = cut(of_words.join(several, "numbers", "left").select("item", F.coalesce("name", F.get("numbers", 0)).alias("name")))
    # Queries with the same items are looked for once; shorter ones repeat an item.
    sets = items.join(named, "item").groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    sets = cut(sets.groupBy("names").agg(F.collect_list("query_id").alias("queries")).withColumn("set", F.monotonically_increasing_id()))
    full = F.transform(F.sequence(F.lit(0), F.lit(MOST_ITEMS - 1)), lambda i: F.get("names", i % F.size("names")))

    def packed(rows: DataFrame, ids: str, values: str, kind: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                values_of = batch.column(values)
                sides = batch.column(ids).to_numpy().astype(np.int64), values_of.value_lengths().to_numpy().astype(np.int64), values_of.flatten().to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([kind]), *(pa.array([x.tobytes()], pa.binary()) for x in sides)], ["kind", "ids", "sizes", "values"])

        return rows.select(ids, values).coalesce(16).mapInArrow(run, "kind bigint, ids binary, sizes binary, values binary")

    asked = cut(packed(several, "name", "numbers", 0).union(packed(sets.select("set", full.alias("names")), "set", "names", 1)))
    n = index.count()
    blocks = max(n // BLOCK, min(n // (BLOCK // 20), items.sparkSession.sparkContext.defaultParallelism)) + 1
    sent = F.broadcast(numbers) if numbers.count() <= MOST_SENT else numbers
    found = index.select("doc_id", "paragraph_index", "token").join(sent, "token").select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "paragraph_index", "number")
    # A document's postings are packed before they are shuffled: a fraction of as many rows.
    found = found.mapInArrow(_by_document, "block int, doc_id bigint, paragraphs binary, numbers binary")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "kind", "ids", "sizes", "values")

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        docs, paragraphs, numbers = _postings_of(own)
        doc = np.unique(docs, return_inverse=True)[1]
        order = np.lexsort((paragraphs, doc))
        fresh = (np.diff(doc[order], prepend=-1) != 0) | (np.diff(paragraphs[order], prepend=-1) != 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        doc_of = doc[order][fresh]
        every = [(row["kind"], *(np.frombuffer(row[c], np.int64) for c in ("ids", "sizes", "values"))) for row in asked.to_pylist()]
        more = [_put_together(ids, np.split(values, np.cumsum(sizes)[:-1]), numbers, place) for kind, ids, sizes, values in every if kind == 0]
        name, at = (np.concatenate([x, *(m[i] for m in more)]) for i, x in enumerate((numbers, place)))
        # Each document's items once.
        seen, local = np.unique(name, return_inverse=True)
        once = np.unique(local * (len(doc_of) + 1) + doc_of[at]) if len(at) else at
        items_of, docs_of = seen[once // (len(doc_of) + 1)] if len(at) else at, once % (len(doc_of) + 1)
        rows = [pa.table({"name": seen, "set": pa.nulls(len(seen), pa.int64()), "whole": pa.nulls(len(seen), pa.bool_())})]
        for kind, sets, _, queries in every:
            if kind == 1 and len(seen):
                queries = queries.reshape(-1, MOST_ITEMS)
                near = np.flatnonzero(np.isin(queries, seen).all(axis=1))
                near = near[_met(queries[near], items_of, docs_of)]
                used = np.isin(name, queries[near])
                rows.append(pa.table({"name": pa.nulls(len(near), pa.int64()), "set": sets[near], "whole": _met(queries[near], name[used], at[used])}))
        return pa.concat_tables(rows)

    met = found.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, "name bigint, set bigint, whole boolean")
    met = cut(met.groupBy("name", "set").agg(F.max("whole").alias("whole")))
    best = met.where("set is not null").join(sets, "set").select(F.explode("queries").alias("query_id"), "whole")
    lost = items.join(named.join(met.where("name is not null"), "name", "left_anti").select("item"), "item").groupBy("query_id").agg(F.min("item").alias("missing"))
    rows = items.select("query_id", "n_items").distinct().join(best, "query_id", "left").join(lost, "query_id", "left")
    place = F.when(F.col("missing").isNotNull(), "missing").when(F.col("whole"), "paragraph").when(F.col("whole").isNotNull(), "document").otherwise("scattered")
    return rows.select("query_id", "n_items", place.alias("place"), "missing")


def recall_estimate(pool: Column, place: Column, missing_literal: Column) -> Column:
    """(0.7 pool factor presence)^(1/3); 0 for an empty pool or where a literal is missing. A null place (fewer than two items) counts fully."""
    factor = reduce(lambda acc, x: acc.when(pool <= x[0], x[1]), POOL_STEPS[1:], F.when(pool <= POOL_STEPS[0][0], POOL_STEPS[0][1])).otherwise(POOL_WIDE)
    present = reduce(lambda acc, kv: F.when(place == kv[0], kv[1]).otherwise(acc), PRESENT.items(), F.lit(1.0))
    return F.when(missing_literal | (pool == 0), 0.0).otherwise(F.round(F.pow(0.7 * factor * present, F.lit(1 / 3)), 3))


def signal_struct(text: Column, categories=CATEGORIES, short_words: int = 20) -> Column:
    """A struct of each category's score: hits / sqrt(patterns) in short texts, hits / patterns in long ones, 1 at most."""
    short = F.size(words(text)) <= short_words
    low = F.lower(text)

    def score(patterns: tuple[str, ...]) -> Column:
        hits = sum((low.contains(p).cast("int") for p in patterns), F.lit(0))
        return F.least(F.lit(1.0), hits / F.when(short, F.lit(len(patterns) ** 0.5)).otherwise(F.lit(float(len(patterns)))))

    return F.struct(*(score(p).alias(n) for n, p in categories.items()))


def signal_weight(asked: Column, categories=CATEGORIES) -> Column:
    return reduce(lambda a, b: a + b, (asked[n] for n in categories))


def signal_dot(asked: Column, own: Column, categories=CATEGORIES) -> Column:
    return reduce(lambda a, b: a + b, (asked[n] * own[n] for n in categories))


def signal_families(asked: Column, own: Column, most: int = 2, categories=CATEGORIES) -> Column:
    """The names of the categories that a query and a text have most in common, best first."""
    each = F.array(*(F.struct((-asked[n] * own[n]).alias("v"), F.lit(n).alias("n")) for n in categories))
    return F.slice(F.transform(F.filter(F.array_sort(each), lambda x: x["v"] < 0), lambda x: x["n"]), 1, most)


def signals(rows: DataFrame, key: str, categories=CATEGORIES, short_words: int = 20) -> DataFrame:
    """key, category and score of each category that a text has."""
    scored = rows.select(key, signal_struct(F.col("text"), categories, short_words).alias("s"))
    one = F.array(*(F.struct(F.lit(n).alias("category"), F.col("s")[n].alias("score")) for n in categories))
    return scored.select(key, F.explode(one).alias("x")).select(key, "x.category", "x.score").where("score > 0")


def signal_match(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, doc_id and signal: the product of the category vectors over the query's weight, 1 at most.

    Chunks are counted by their vector first: categories are few, so the vectors are, and the pairs to
    score are queries and distinct vectors, not queries and chunks.
    """
    weight = queries.groupBy("query_id").agg(F.sum("score").alias("total"))
    vectors = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("category", "score"))).alias("v"))
    distinct = vectors.select("v").distinct().select("v", F.explode("v").alias("x")).select("v", "x.category", F.col("x.score").alias("s"))
    scored = queries.join(distinct, "category").groupBy("query_id", "v").agg(F.sum(F.col("score") * F.col("s")).alias("dot"))
    scored = scored.join(weight, "query_id").select("query_id", "v", F.least(F.lit(1.0), F.col("dot") / F.col("total")).alias("signal"))
    return scored.join(vectors.groupBy("v").agg(F.count(F.lit(1)).alias("chunks")), "v").groupBy("query_id", F.round("signal", 6).alias("signal")).agg(F.sum("chunks").alias("chunks"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Per query the first successful attempt, else the one with the best rerank plus .05 per document (ten at most)."""
    value = F.col("rerank") + 0.05 * F.least(F.col("n_docs"), F.lit(10))
    order = Window.partitionBy("query_id").orderBy(F.desc("success"), F.when(F.col("success"), F.col("attempt")), F.when(~F.col("success"), F.round(value, 6)).desc(), "attempt")
    return attempts.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def fact_grade(facts: DataFrame) -> DataFrame:
    """Per query from facts (query_id, support, grounded, contradicted): score, coverage, validated and contradicted."""
    support = F.when(F.col("grounded"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("support")))).otherwise(0.0)
    by = facts.withColumn("s", support).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("sum"), F.count_if("contradicted").alias("contradicted"), F.count_if(F.col("s") >= SUPPORTED).alias("validated")
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sum") - HALLUCINATION_PENALTY * F.col("contradicted")) / F.col("n")))
    return by.select("query_id", "n", score.alias("score"), (F.col("sum") / F.col("n")).alias("coverage"), "validated", "contradicted")


def speed_prior(log: DataFrame) -> DataFrame:
    """Per strategy 1 for the fastest and 0 for the slowest mean latency, on a log scale."""
    by = log.groupBy("strategy").agg(F.avg("total_ms").alias("mean"))
    low, high = (by.agg(f(F.log("mean"))).scalar() for f in (F.min, F.max))
    return by.select("strategy", (1 - (F.log("mean") - low) / F.nullif(high - low, F.lit(0.0))).alias("speed"))


def title_case(text: Column) -> Column:
    """Words with a capital, short all-capital ones as they are."""
    word = lambda w: F.when((F.length(w) <= 4) & (F.upper(w) == w) & w.rlike("[A-Z]"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
    return F.array_join(F.transform(F.split(text, " "), word), " ")


def canonical(raw: Column, known: dict[str, str]) -> Column:
    """The canonical form of a name: null for blank, the known one, else title case."""
    key = F.lower(F.regexp_replace(F.regexp_replace(F.trim(raw), r"[.,;:]+$", ""), r"\s+", " "))
    named = reduce(lambda acc, kv: F.when(key == kv[0], kv[1]).otherwise(acc), known.items(), title_case(key))
    return F.when(key == "", F.lit(None)).otherwise(named)


def progress(events: DataFrame) -> DataFrame:
    """event_id, done and percent: how far each user's events have come with every one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", F.row_number().over(w).cast("long").alias("done"), (F.row_number().over(w) / F.count(F.lit(1)).over(Window.partitionBy("user_id")) * 100).alias("percent"))


def prune(events: DataFrame, days: int, floor: int = 7) -> DataFrame:
    """Events no older than so many days before the newest, seven at least."""
    newest = events.agg(F.max("ts")).scalar()
    return events.where(F.col("ts") >= newest - F.make_dt_interval(F.lit(max(days, floor))))


def enqueue(wanted: DataFrame, queue: DataFrame, key: list[str]) -> DataFrame:
    """The wanted jobs that aren't pending yet, each once."""
    return wanted.dropDuplicates(key).join(queue.where("status = 'pending'").select(*key), key, "left_anti")


def tag_objects(tags: DataFrame, key: str) -> DataFrame:
    """key and its tags as one JSON-like map in the order of codes."""
    entries = F.array_sort(F.collect_list(F.struct("code", F.col("score").cast("long").alias("score"))))
    return tags.groupBy(key).agg(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["code"], e["score"].cast("string"))), ";").alias("tags"))


def fact_match(asked: DataFrame, facts: DataFrame, alpha: float = 0.5, tau: float = 0.3) -> DataFrame:
    """Pairs of a question and a fact of the same payer with at least tau of weighted token overlap times authority.

    Both have payer and text. Overlap is Jaccard over filter tokens; the pairs come from shared tokens.
    """
    a = asked.select("query_id", "payer", filter_tokens(F.col("text"), None).alias("a"))
    b = facts.select("fact_id", F.col("payer").alias("own"), "authority", filter_tokens(F.col("text"), None).alias("b"))
    a = a.select("query_id", F.col("payer").alias("own"), F.size("a").alias("na"), F.explode("a").alias("t"))
    b = b.select("fact_id", "own", "authority", F.size("b").alias("nb"), F.explode("b").alias("t"))
    pairs = a.join(b, ["own", "t"])
    by = pairs.groupBy("query_id", "fact_id", "na", "nb", "authority").agg(F.count(F.lit(1)).alias("both"))
    score = F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) * F.col("authority")
    return by.select("query_id", "fact_id", score.alias("score")).where(F.col("score") >= tau)
