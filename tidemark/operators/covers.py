"""Cover density over a positional index, with the levels by which a query's chunks are found.

The index has a row for each token of a chunk and field, with the places where it stands; a chunk's fields follow
each other, the name (A) of its document before the text (D), so that their places do too.

A query asks for its tokens, each by itself, and for the phrases of its expansion, of which all tokens
have to be there. Of a chunk's places at which any of them stands, a cover is a shortest stretch that satisfies one
of these demands: no cover lies in another. A cover counts n / (the sum of its places' inverse weights), divided by one more than the
words between its n places; the score is S / (S + 1), S the sum over covers. With single tokens only, S is the sum of weights.

Which chunks are scored: those with all of the query's code-like tokens and one of the others, if there are
any; else those of the k-of-n cascade over the first seven tokens; else all that satisfy a demand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.constants import FIELD_WEIGHT, STOP_WORDS
from tidemark.functions.text import filter_tokens, normalise_query, placed, tokens
from tidemark.sources.store import cut, laid_down

CHUNK = ["doc_id", "paragraph_index"]
# Tokens that look like codes of procedures.
ANCHOR = "^([a-z][0-9]{3,5}|[a-z]{2}[0-9]{3,4})$"
#: Rows of a query set that are sent to all tasks; beyond that both sides are shuffled.
MOST_SENT = 200_000
ENTRY = "array<struct<place:int,term:int,inverse:double>>"


def entries(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, paragraph_index and entries, an array of (field, token, places), of each chunk. A name (documents: doc_id, name) stands in all chunks of its document; a text's places begin behind it.

    A chunk's entries are put together in its row. Only names meet chunks, and don't move them if both are dealt by document.
    """
    said = lambda c: tokens(F.coalesce(c, F.lit("")))
    rows = chunks.select(*CHUNK, said("text").alias("own")).join(documents.select("doc_id", said("name").alias("named")), "doc_id", "left")
    rows = rows.withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    of = lambda field, c, shift: F.transform(placed(F.col(c)), lambda e: F.struct(F.lit(field).alias("field"), e["token"].alias("token"), F.transform(e["places"], lambda p: p + shift).alias("places")))
    return rows.select(*CHUNK, F.concat(of("A", "named", F.lit(0)), of("D", "own", F.size("named"))).alias("entries"))


def positions(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, field, token and places: the entries of chunks, a row each."""
    return entries(chunks, documents).select(*CHUNK, F.inline("entries"))


def demands(queries: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What queries (query_id, text) and their expansion (query_id, phrase) ask for.

    First query_id, token, term (its number in the query) and bit (of the tokens that the cascade looks at each has one, others 0); second query_id,
    groups (arrays of terms, one of which must be there as a whole), n_first, n_anchors, n_rest and anchor_bits.
    """
    content = lambda c: F.array_distinct(F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS)))
    bags = phrases.select("query_id", F.array_sort(content(F.col("phrase"))).alias("bag")).where("size(bag) > 0").groupBy("query_id").agg(F.array_sort(F.collect_set("bag")).alias("bags"))
    text = normalise_query(F.col("text"))
    none = F.array().cast("array<array<string>>")
    rows = queries.select("query_id", content(text).alias("own"), filter_tokens(text).alias("first")).join(bags, "query_id", "left").withColumn("bags", F.coalesce("bags", none))
    rows = rows.withColumn("terms", F.array_distinct(F.concat("own", F.flatten("bags"))))
    wanted = F.array_distinct(F.concat(F.transform("own", lambda t: F.array(t)), F.col("bags")))
    groups = F.transform(wanted, lambda g: F.transform(g, lambda t: (F.array_position(F.col("terms"), t) - 1).cast("int")))
    anchors = F.filter("first", lambda t: t.rlike(ANCHOR))
    rows = rows.select("query_id", "terms", "first", groups.alias("groups"), F.size("first").cast("long").alias("n_first"), F.size(anchors).cast("long").alias("n_anchors"))
    each = rows.select("query_id", "first", F.posexplode("terms").alias("term", "token"))
    bit = F.coalesce(F.get(F.transform("first", lambda _, i: F.call_function("shiftleft", F.lit(1), i)), F.array_position("first", F.col("token")).cast("int") - 1), F.lit(0))
    each = each.select("query_id", "token", "term", bit.alias("bit"))
    anchor_bits = F.aggregate(F.transform("first", lambda t, i: F.when(t.rlike(ANCHOR), F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda x, y: x.bitwiseOR(y))
    return each, rows.select("query_id", "groups", F.size("terms").alias("n_terms"), "n_first", "n_anchors", (F.col("n_first") - F.col("n_anchors")).alias("n_rest"), anchor_bits.alias("anchor_bits"))


def _sent(rows: DataFrame) -> DataFrame:
    """rows of the queries, sent to all tasks up to a proven bound only."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def of_document(rows: DataFrame, by_document: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of their document's one row; neither moves nor sorts rows that lie by document."""
    return rows.join(by_document.hint("shuffle_hash"), "doc_id", how)


def found(queries: DataFrame, phrases: DataFrame, index: DataFrame, chunks: DataFrame, within: DataFrame | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None, dealt: bool = False) -> DataFrame:
    """query_id, doc_id, paragraph_index, level, matched, entries, groups and n_terms of the chunks of each query's first level that has any.

    level: -1 for the code-like tokens, k for the cascade, 0 for any demand. within: query_id and doc_id, the only documents of each query.
    narrow: leaves out matching documents (query_id, doc_id) before levels are chosen. dealt: whether the index is stored by document.
    """
    each, asked = (cut(x) for x in demands(queries, phrases))
    few = each.count() <= MOST_SENT
    sent_each, sent = (F.broadcast(each) if few else each), _sent(asked)
    own = index.join(_sent(each.select("token").distinct()), "token", "left_semi")
    # A document's rows lie in one task, so that what the queries find in its chunks is put together there: the hits are never shuffled, nor an index that lies so.
    if not (dealt and few):
        own = own.repartition("doc_id")
    bits = F.bit_or("bit").alias("bits")
    by_bits = {
        "matched": F.bit_count("bits").cast("long"),
        "_anchored": (F.col("n_anchors") > 0) & (F.bit_count(F.col("bits").bitwiseAND(F.col("anchor_bits"))) == F.col("n_anchors")) & ((F.col("n_rest") == 0) | (F.col("bits").bitwiseAND(F.bitwise_not("anchor_bits")) != 0)),
    }
    found_bits = own.join(sent_each, "token").groupBy("query_id", *CHUNK).agg(bits).join(sent, "query_id").withColumns(by_bits)
    docs = found_bits.groupBy("query_id", "doc_id").agg(F.max("matched").alias("matched"), F.max("_anchored").alias("_anchored"))
    if within is not None:
        docs = of_document(docs, within.groupBy("doc_id").agg(F.collect_set("query_id").alias("_own"))).where(F.array_contains("_own", F.col("query_id"))).drop("_own")
    # Scope and tags go by documents.
    docs = laid_down(docs if narrow is None else narrow(docs))
    most = docs.groupBy("query_id").agg(F.max("_anchored").alias("_some"), F.max("matched").alias("_most")).join(sent.select("query_id", "n_first"), "query_id")
    strict = F.col("_most") >= F.greatest(F.lit(3), F.floor((F.col("n_first") + 1) / 2))
    levels = cut(most.select("query_id", F.when(F.col("_some"), -1).when(strict, F.col("_most")).otherwise(0).cast("long").alias("level")))
    of_level = F.when(F.col("level") == -1, F.col("_anchored")).when(F.col("level") > 0, F.col("matched") == F.col("level")).otherwise(True)
    chosen = docs.join(_sent(levels), "query_id").where(of_level).groupBy("doc_id").agg(F.collect_set("query_id").alias("_queries"))

    weight = F.create_map(*(F.lit(x) for k, v in FIELD_WEIGHT.items() for x in (k, 1 / v)))[F.col("field")]
    entry = F.transform("places", lambda p: F.struct(p.alias("place"), F.col("term"), weight.alias("inverse"))).cast(ENTRY)
    hits = of_document(own, chosen).join(sent_each, "token").where(F.array_contains("_queries", F.col("query_id")))
    met = hits.select("query_id", *CHUNK, "bit", entry.alias("entries")).groupBy("query_id", *CHUNK).agg(bits, F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries"))
    met = met.join(sent, "query_id").join(_sent(levels), "query_id").withColumns(by_bits)
    seen = F.array_distinct(F.transform("entries", lambda e: e["term"]))
    satisfied = F.exists("groups", lambda g: F.size(F.array_except(g, seen)) == 0)
    rows = met.where(of_level & ((F.col("level") != 0) | satisfied))
    return rows.select("query_id", *CHUNK, "level", "matched", "entries", "groups", "n_terms")


def density(entries: Column, groups: Column, n_terms: Column) -> Column:
    """S, the sum over covers. entries: by place; groups: arrays of terms; n_terms: how many terms there are."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    start = F.struct(F.array_repeat(F.lit(0), n_terms).alias("last"), F.lit(0).alias("reach"), F.lit(0.0).alias("sum"))

    def step(state: Column, e: Column) -> Column:
        last = F.transform(state["last"], lambda v, t: F.when(t == e["term"], e["number"]).otherwise(v))

        def counted(s: Column) -> Column:
            # Where the latest stretch that satisfies a demand begins; 0 where none does.
            begin = F.array_max(F.transform(groups, lambda g: F.array_min(F.transform(g, lambda t: F.get(s, t)))))

            def added(b: Column) -> Column:
                n = e["number"] - b + 1
                inverse = F.aggregate(F.slice(entries, b, n), F.lit(0.0), lambda x, y: x + y["inverse"])
                between = e["place"] - F.get(entries, b - 1)["place"] - (n - 1)
                more = F.when(b > state["reach"], n / inverse / (1 + between)).otherwise(F.lit(0.0))
                return F.struct(s.alias("last"), F.greatest(b, state["reach"]).alias("reach"), (state["sum"] + more).alias("sum"))

            return let(begin, added)

        return let(last, counted)

    numbered = F.transform(entries, lambda e, i: F.struct(e["place"].alias("place"), e["term"].alias("term"), (i + 1).alias("number")))
    covers = F.aggregate(numbered, start, step, lambda s: s["sum"])
    # Where each group is one term, each place of one is a cover of its own.
    single = F.forall(groups, lambda g: F.size(g) == 1)
    alone = lambda e: F.array_contains(F.flatten(groups), e["term"])
    return F.when(single, F.aggregate(F.filter(entries, alone), F.lit(0.0), lambda x, e: x + 1 / e["inverse"])).otherwise(covers)


def ranked(queries: DataFrame, phrases: DataFrame, index: DataFrame, chunks: DataFrame, within: DataFrame | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None, dealt: bool = False) -> DataFrame:
    """query_id, doc_id, paragraph_index, level, matched and score of each query's chunks."""
    s = F.round(density(F.col("entries"), F.col("groups"), F.col("n_terms")), 9)
    rows = found(queries, phrases, index, chunks, within, narrow, dealt).withColumn("s", s)
    return rows.select("query_id", *CHUNK, "level", "matched", (F.col("s") / (F.col("s") + 1)).alias("score"))
