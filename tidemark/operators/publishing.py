"""Publishing: which vectors, their rows, what was joined; write-side tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = "dpj"


def generators(embeddings: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """doc_id and generator to publish: the one asked for (doc_id, generator), any but A and B meaning A, else the first that the document has; null counts as A."""
    own = embeddings.groupBy("doc_id").agg(F.min(F.coalesce("generator", F.lit("A"))).alias("first"))
    if asked is None:
        return own.select("doc_id", F.col("first").alias("generator"))
    said = F.nullif(F.upper(F.trim("generator")), F.lit(""))
    wanted = asked.select("doc_id", F.when(said.isin("A", "B"), said).when(said.isNotNull(), "A").alias("wanted"))
    return own.join(wanted, "doc_id", "left").select("doc_id", F.coalesce("wanted", "first").alias("generator"))


def rows(embeddings: DataFrame, chosen: DataFrame, chunks: DataFrame, facts: DataFrame, paragraph_tags: DataFrame, documents: DataFrame) -> DataFrame:
    """Serving rows of the chosen generators' embeddings: source, place, text, tags, document, content_sha; blanks for what is missing.

    embeddings: doc_id, generator, source_type, source_id; a source that isn't in chunks or facts (source_id, doc_id,
    text; chunks also page_number and paragraph_index) is dropped. paragraph_tags: doc_id, page_number, order_index,
    d_tags, p_tags, j_tags, created_at; the latest of a place counts, of equally late ones that with the greatest tags.
    """
    generator = F.coalesce("generator", F.lit("A"))
    own = embeddings.withColumn("generator", generator).join(chosen, ["doc_id", "generator"])
    hier = own.where("source_type = 'hierarchical'").join(chunks.select("doc_id", "source_id", "page_number", "paragraph_index", "text"), ["doc_id", "source_id"])
    fact = own.where("source_type = 'fact'").join(facts.select("doc_id", "source_id", "text"), ["doc_id", "source_id"])
    both = hier.unionByName(fact, allowMissingColumns=True)
    tags = [f"{k}_tags" for k in KINDS]
    at = F.when(F.col("created_at").isNotNull(), F.struct("created_at", *tags))
    latest = paragraph_tags.groupBy("doc_id", "page_number", F.col("order_index").alias("paragraph_index")).agg(F.max_by(F.struct(*tags), at).alias("t")).select("doc_id", "page_number", "paragraph_index", "t.*")
    joined = both.join(latest, ["doc_id", "page_number", "paragraph_index"], "left").join(documents, "doc_id")
    sha = F.sha2(F.concat_ws("‖", F.col("doc_id").cast("string"), "source_type", F.col("source_id").cast("string"), "text"), 256)
    blank = {c: F.coalesce(c, F.lit("")) for c in ("text", "payer", "state", "program", "authority_level") if c in joined.columns}
    return joined.withColumns({**blank, "content_sha": sha})


def tag_coverage(published: DataFrame, paragraph_tags: DataFrame) -> DataFrame:
    """Per document and kind: rows, rows that got a tag, places that have one, and whether all of these were missed."""
    place = paragraph_tags.groupBy("doc_id", "page_number", "order_index").agg(*(F.max(F.size(f"{k}_tags") > 0).alias(k) for k in KINDS))
    source = place.groupBy("doc_id").agg(*(F.count_if(k).alias(f"source_{k}") for k in KINDS))
    joined = published.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.size(f"{k}_tags") > 0).alias(f"joined_{k}") for k in KINDS))
    both = joined.join(source, "doc_id", "left").fillna(0)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"joined_{k}").alias("joined"), F.col(f"source_{k}").alias("source")) for k in KINDS))).alias("e")
    return both.select("doc_id", "rows", each).select("doc_id", "rows", "e.*", ((F.col("e.source") > 0) & (F.col("e.joined") == 0)).alias("missed"))


def replace_rows(stored: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """stored with all rows of the keys in `new` replaced by these."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def embeddable(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, source_type, source_id and the text to embed: summary and text of chunks; fact, then who, how and limits, of facts."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    chunk = F.when(some("summary").isNotNull() & some("text").isNotNull(), F.concat_ws("\n", "summary", "text")).otherwise(F.coalesce("text", F.lit("")))
    extra = F.concat_ws(" ", F.concat(F.lit("Who eligible: "), some("who_eligible")), F.concat(F.lit("How verified: "), some("how_verified")), F.concat(F.lit("Limitations: "), some("limitations")))
    fact = F.trim(F.concat_ws("\n", F.coalesce("text", F.lit("")), F.nullif(extra, F.lit(""))))
    a = chunks.select("doc_id", F.lit("hierarchical").alias("source_type"), "source_id", chunk.alias("text"))
    return a.unionByName(facts.select("doc_id", F.lit("fact").alias("source_type"), "source_id", fact.alias("text")))


def canonical_payers(published: DataFrame, documents: DataFrame) -> DataFrame:
    """published with the payer of its document where that has one and differs."""
    own = documents.select("doc_id", F.nullif("payer", F.lit("")).alias("_own"))
    return published.join(own, "doc_id", "left").withColumn("payer", F.coalesce("_own", "payer")).drop("_own")


def reconcile(document_tags: DataFrame, inherited: DataFrame, codes: Column) -> DataFrame:
    """doc_id and j_tags (map) of document_tags (doc_id, j_tags) with the code 1.0 of each payor whose authority a document (doc_id, payor) is."""
    stamps = inherited.select("doc_id", codes.alias("code")).where("code is not null").groupBy("doc_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_set("code")), lambda c: F.struct(c, F.lit(1.0)))).alias("_new"))
    none = F.create_map().cast("map<string,double>")
    rows = document_tags.join(stamps, "doc_id", "left").withColumns({"j_tags": F.coalesce("j_tags", none), "_new": F.coalesce("_new", none)})
    kept = F.map_filter("j_tags", lambda k, v: ~F.map_contains_key("_new", k))
    return rows.withColumn("j_tags", F.map_concat(kept, "_new")).drop("_new")


def embedding_backfill(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """doc_id of documents whose chunking result (doc_id, metadata as JSON) is complete and that have no embedding job (doc_id, status) pending or at work."""
    done = results.where(F.get_json_object("metadata", "$.status") == "completed").select("doc_id").distinct()
    return done.join(jobs.where(F.col("status").isin("pending", "processing")), "doc_id", "left_anti")


def decide_phrases(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lexicon entries (kind, code, strong, revision) after decisions (kind, code, phrase, state): approved phrases are added, rejected ones taken out; what changes gets the next revision."""
    by = decisions.groupBy("kind", "code").agg(F.collect_set(F.when(F.col("state") == "approved", F.col("phrase"))).alias("_add"), F.collect_set(F.when(F.col("state") == "rejected", F.col("phrase"))).alias("_drop"))
    both = entries.join(by, ["kind", "code"], "full")
    none = F.array().cast("array<string>")
    old = F.coalesce("strong", none)
    new = F.array_sort(F.array_except(F.array_union(old, F.coalesce("_add", none)), F.coalesce("_drop", none)))
    changed = ~F.coalesce(F.array_sort(old) == new, F.lit(False)) | F.col("revision").isNull()
    following = entries.agg(F.coalesce(F.max("revision"), F.lit(0)) + 1).scalar()
    return both.select("kind", "code", new.alias("strong"), F.when(changed, following).otherwise(F.col("revision")).alias("revision"))
