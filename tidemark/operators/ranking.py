"""Rerank signals, confidence labels, decay, dedup, caps, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import AUTHORITY, AUTHORITY_DEFAULT, CONFIDENCE, DECAY, RERANK, TAG_BOOST, TIER, TIER_DEFAULT
from tidemark.sources.store import sent


def _mapped(c: Column, values: dict, default) -> Column:
    return reduce(lambda acc, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(acc), values.items(), F.lit(default))


def authority_score(level: Column) -> Column:
    return _mapped(level, AUTHORITY, AUTHORITY_DEFAULT)


def authority_tier(level: Column) -> Column:
    return _mapped(level, TIER, TIER_DEFAULT).cast("long")


def length_score(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 50, 0.0).otherwise(F.least(F.lit(1.0), (n - 50) / 450.0))


def arm_similarity(arm: Column, similarity: Column) -> Column:
    """Vector scores from .5 on spread over 0 to 1; those of other arms as they are."""
    return F.when(arm == "vector", F.greatest(F.lit(0.0), (similarity - 0.5) * 2)).otherwise(similarity)


def coverage(present: Column, weights: Column) -> Column:
    """The present phrases' share of the weight; arrays of booleans and doubles."""
    hit = F.aggregate(F.zip_with(present, weights, lambda p, w: F.when(p, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return hit / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)


def rerank_score(sim: Column, auth: Column, length: Column, jpd: Column | None = None, cov: Column | None = None, boosted: Column | None = None) -> Column:
    """The weighted mean of the signals there are; times 1.5 for chunks with the query's d-tag."""
    parts = [("sim", sim), ("auth", auth), ("len", length), ("jpd", jpd), ("cov", cov)]
    total = sum(RERANK[n] for n, c in parts if c is not None)
    score = reduce(lambda a, b: a + b, (RERANK[n] * c for n, c in parts if c is not None)) / total
    return score if boosted is None else F.when(boosted, score * TAG_BOOST).otherwise(score)


def confidence_label(score: Column) -> Column:
    return reduce(lambda acc, x: F.when(score >= x[1], F.lit(x[0])).otherwise(acc), reversed(CONFIDENCE), F.lit("abstain"))


def decay_filter(rows: DataFrame, category: list[str], score: str) -> DataFrame:
    """Drops rows below 0.6 of their category's best score, which is aggregated and joined."""
    best = rows.groupBy(*category).agg(F.max(score).alias("best"))
    return rows.join(best, category).where((F.col("best") <= 0) | (F.col(score) >= DECAY * F.col("best")))


def per_document_cap(rows: DataFrame, by: list[str], document: str, order: list[Column], per_document: int, total: int) -> DataFrame:
    """At most so many rows per document, then in all, for each query (by)."""
    inner = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by, document).orderBy(*order))).where(F.col("n") <= per_document).drop("n")
    return inner.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("position") <= total)


def neighbours(seeds: DataFrame, chunks: DataFrame, paragraphs: int, pages: int, most: int | None = None) -> DataFrame:
    """seed_paragraph and the chunks within so many paragraphs and pages of each seed in its document, without the seed.

    A seed becomes the places around it, which meet the chunks by equality, so that a long document is no hot key. Those of
    a query set's hits go to the chunks, whose texts are not shuffled.
    """
    around = F.explode(F.sequence(F.col("paragraph_index") - paragraphs, F.col("paragraph_index") + paragraphs)).alias("_at")
    s = seeds.select("doc_id", F.col("paragraph_index").alias("seed_paragraph"), F.col("page_number").alias("seed_page"), around).distinct()
    s = s.where("_at <> seed_paragraph").withColumnRenamed("_at", "paragraph_index")
    page = F.col("seed_page").isNull() | F.col("page_number").between(F.col("seed_page") - pages, F.col("seed_page") + pages)
    found = chunks.join(sent(s), ["doc_id", "paragraph_index"]).where(page)
    if most is None:
        return found
    order = Window.partitionBy("doc_id", "seed_paragraph").orderBy(F.abs(F.col("paragraph_index") - F.col("seed_paragraph")), "paragraph_index")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def neighbour_text(seeds: DataFrame, chunks: DataFrame, reach: int = 1, most_chars: int = 1500) -> DataFrame:
    """doc_id, seed_paragraph and the text around each seed in document order, cut at most_chars."""
    found = neighbours(seeds, chunks, reach, 1_000_000)
    parts = F.array_sort(F.collect_list(F.struct("paragraph_index", "text")))
    text = F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 1, most_chars)
    return found.groupBy("doc_id", "seed_paragraph").agg(text.alias("context"))


def best_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each query by score; what orders below take part in."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def score_order(rows: DataFrame, k: int) -> DataFrame:
    """The best 3 k rows (query_id, id, score) with their place by score as `position`."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= 3 * k)


def balanced_order(rows: DataFrame, k: int, floor: float) -> DataFrame:
    """The best 3 k rows (query_id, id, authority_level, score) in assembly order `position`: three times the reserved slots of tiers 0 and 1, then of the rest."""
    slots = -int(-k * max(0.0, min(1.0, floor)) // 1)
    half = (authority_tier(F.col("authority_level")) > 1).cast("long")
    n = F.row_number().over(Window.partitionBy("query_id", "half").orderBy(F.desc("score"), "id"))
    kept = best_rows(rows, 3 * k).withColumn("half", half).withColumn("n", n)
    kept = kept.where(F.when(F.col("half") == 0, F.col("n") <= 3 * slots).otherwise(F.col("n") <= 3 * max(0, k - slots)))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("half", "n")).cast("long")
    return kept.withColumn("position", position).drop("n", "half")


def canonical_order(rows: DataFrame, k: int) -> DataFrame:
    """The best 3 k rows in assembly order `position`: confidence band, then authority tier, then score."""
    band = F.when(F.col("score") >= 0.55, 3).when(F.col("score") >= 0.35, 2).when(F.col("score") >= 0.18, 1).otherwise(0)
    order = Window.partitionBy("query_id").orderBy(band.desc(), authority_tier(F.col("authority_level")), F.desc("score"), "id")
    return best_rows(rows, 3 * k).withColumn("position", F.row_number().over(order).cast("long"))


def assemble(rows: DataFrame, k: int, least: float) -> DataFrame:
    """query_id, id and slot (from 1) of the rows picked in order of `position`.

    rows: query_id, id, position, score, content_key, page_key. A row under the threshold is passed
    over; one with a known content or page is too, and leaves neither its content nor its page behind.
    That makes picking sequential within a query: a fold over its rows in one array. Only the 3 k first
    positions take part, so the array is small whatever the corpus.
    """
    entry = F.struct("position", "id", "content_key", "page_key")
    ordered = rows.where((F.col("position") <= 3 * k) & (F.col("score") >= least)).groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    fresh = lambda acc, r: (F.size(acc) < k) & ~F.exists(acc, lambda x: (x["content_key"] == r["content_key"]) | (x["page_key"] == r["page_key"]))
    kind = rows.select(F.array(entry).alias("rows")).schema["rows"].dataType.simpleString()
    picked = F.aggregate("rows", F.array().cast(kind), lambda acc, r: F.when(fresh(acc, r), F.array_append(acc, r)).otherwise(acc))
    return ordered.select("query_id", F.posexplode(picked).alias("slot", "r")).select("query_id", F.col("r.id").alias("id"), (F.col("slot") + 1).cast("long").alias("slot"))


def assembly_ratios(picked: DataFrame) -> DataFrame:
    """Per query of picked rows (query_id, authority_level): how many of each tier, and the shares of authoritative and of contract ones."""
    t = authority_tier(F.col("authority_level"))
    by = picked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(t == 0).alias("contract"), F.count_if(t == 1).alias("policy"), F.count_if(t == 2).alias("fyi"), F.count_if(t == 3).alias("untagged"))
    share = lambda c: F.round(c / F.col("n"), 3)
    return by.withColumns({"canonical_ratio": share(F.col("contract") + F.col("policy")), "strict_ratio": share(F.col("contract"))})
