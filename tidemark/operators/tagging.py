"""Phrase tagging, propagation of tags, statistics of tags and phrases, candidates for new phrases."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.constants import (
    CANDIDATE_STOPS,
    CANONICAL_P,
    COMMON_ABBREVIATIONS,
    COMMON_PHRASES,
    DOCUMENT_WEIGHT,
    GENERIC_LEXICON,
    GENERIC_REJECTED,
    HEADING_WEIGHT,
    LINE_WEIGHT,
    NOISY_DF,
    NOISY_P,
    PARAGRAPH_WEIGHT,
    RARE_DF,
)
from tidemark.functions.text import tokens
from tidemark.operators.lexicon import SAMPLE, Entry, best_tags, phrase_hits, phrase_map


def tag_lines(rows: DataFrame, entries: tuple[Entry, ...] = SAMPLE) -> DataFrame:
    """Each line's tags with their best score; a tag goes where one of its refuted words stands in the line."""
    return best_tags(rows, entries)


def propagate(tags: DataFrame, child: list[str], parent: list[str]) -> DataFrame:
    """Each parent's tags with the number of its children that have them; scores of children don't count."""
    return tags.select(*child, *parent, "kind", "code").distinct().groupBy(*parent, "kind", "code").agg(F.count(F.lit(1)).cast("double").alias("score"))


def effective_tags(line_tags: DataFrame, line: list[str], paragraph: list[str], document: list[str]) -> DataFrame:
    """For each line: code and 1.0 / 0.3 / 0.1 for its presence in the line, its paragraph and its document."""
    places = line_tags.select(*line).distinct()
    level = lambda keys, w: line_tags.select(*keys, "kind", "code").distinct().withColumn("w", F.lit(w))
    own = level(line, LINE_WEIGHT)
    near = places.join(level(paragraph, PARAGRAPH_WEIGHT), paragraph).select(*line, "kind", "code", "w")
    far = places.join(level(document, DOCUMENT_WEIGHT), document).select(*line, "kind", "code", "w")
    every = own.select(*line, "kind", "code", "w").unionByName(near).unionByName(far)
    return every.groupBy(*line, "kind", "code").agg(F.round(F.sum("w"), 4).alias("weight"))


def overlay(document_tags: DataFrame, inherited: DataFrame) -> DataFrame:
    """Document tags with the inherited ones (doc_id, kind, code) set to 1.0."""
    both = document_tags.select("doc_id", "kind", "code", "score", F.lit(0).alias("over")).unionByName(inherited.select("doc_id", "kind", "code", F.lit(1.0).alias("score"), F.lit(1).alias("over")))
    return both.groupBy("doc_id", "kind", "code").agg(F.max_by("score", "over").alias("score"))


def tag_statistics(document_tags: DataFrame, docs: DataFrame) -> DataFrame:
    """kind, code, n_docs, idf = ln(N / n) and selectivity = 1 - n / N."""
    size = docs.agg(F.count(F.lit(1))).scalar()
    counted = document_tags.groupBy("kind", "code").agg(F.countDistinct("doc_id").alias("n_docs"))
    n = F.col("n_docs")
    return counted.select("kind", "code", "n_docs", F.log(size / F.greatest(n, F.lit(1))).alias("idf"), (1 - n / size).alias("selectivity"))


def gate_probe(document_tags: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """d_docs, j_docs, p_docs, union_docs and intersection_docs of documents with the wanted codes, in one aggregate."""
    flags = {k: F.max(((F.col("kind") == k) & F.col("code").isin(wanted.get(k, []))).cast("int")) for k in "djp"}
    by = document_tags.groupBy("doc_id").agg(*(c.alias(k) for k, c in flags.items()))
    every = F.lit(True)
    for k in "djp":
        if wanted.get(k):
            every = every & (F.col(k) == 1)
    return by.agg(*(F.count_if(F.col(k) == 1).alias(f"{k}_docs") for k in "djp"), F.count_if(F.greatest("d", "j", "p") == 1).alias("union_docs"), F.count_if(every).alias("intersection_docs"))


def cascade_pool(document_tags: DataFrame, wanted: dict[str, list[str]], fallback: str, cap: int | None = None) -> DataFrame:
    """doc_id and level of the first level that isn't empty: J and D and P, J and D, fallback and D, fallback."""
    has = lambda k, codes: F.max(((F.col("kind") == k) & F.col("code").isin(codes)).cast("int")) == 1
    by = document_tags.groupBy("doc_id").agg(*(has(k, wanted[k]).alias(k) for k in "jdp"), has("j", [fallback]).alias("f"))
    levels = F.when(F.col("j") & F.col("d") & F.col("p"), 1).when(F.col("j") & F.col("d"), 2).when(F.col("f") & F.col("d"), 3).when(F.col("f"), 4)
    marked = by.select("doc_id", levels.cast("long").alias("level")).where("level is not null")
    pool = marked.where(F.col("level") == marked.agg(F.min("level")).scalar())
    return pool if cap is None else pool.orderBy("doc_id").limit(cap)


def with_inherited(pool: DataFrame, inherited: DataFrame, levels: tuple[int, ...] = (1, 2), cap: int = 5000) -> DataFrame:
    """pool (doc_id, level) and the inherited documents (doc_id) it lacks, marked, where the pool's level is a plan's; its own come first."""
    level = pool.agg(F.min("level")).scalar()
    new = inherited.select("doc_id").distinct().join(pool, "doc_id", "left_anti").where(level.isin(*levels))
    new = new.select("doc_id", level.alias("level"), F.lit(True).alias("inherited"))
    both = pool.select("doc_id", "level", F.lit(False).alias("inherited")).unionByName(new)
    return both.orderBy("inherited", "doc_id").limit(cap)


def theme_buckets(chunks: DataFrame, document_tags: DataFrame, most: int = 5, dominance: float = 0.65) -> DataFrame:
    """The d-tags of the documents of found chunks (doc_id), by chunks: code, docs, chunks, share of all assignments, and whether the set is narrow.

    Narrow: two themes or fewer, or the first has the share `dominance` of the assignments.
    """
    by_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    d = document_tags.where("kind = 'd'").select("doc_id", "code").distinct().join(by_doc, "doc_id")
    by = d.groupBy("code").agg(F.count(F.lit(1)).alias("docs"), F.sum("chunks").alias("chunks"))
    total = by.agg(F.sum("chunks")).scalar()
    top = by.orderBy(F.desc("chunks"), "code").limit(most)
    n, first = (top.agg(c).scalar() for c in (F.count(F.lit(1)), F.max("chunks")))
    narrow = (n <= 2) | (first / total >= dominance)
    return top.select("code", "docs", "chunks", (F.col("chunks") / total).alias("share"), narrow.alias("narrow"))


def phrase_precision(docs: DataFrame, document_tags: DataFrame, entries: tuple[Entry, ...] = SAMPLE) -> DataFrame:
    """For each phrase: documents with it (df), those of them that have its tag (df_tagged), precision and verdict.

    docs: doc_id and text. Per entry a phrase is dropped as a copy of a longer one that contains it and has
    the same counts, then as rare or noisy; of those precise and frequent enough the most frequent is canonical.
    """
    said = phrase_hits(docs.select("doc_id", "text"), entries).select("doc_id", "phrase", "kind", "code")
    tagged = said.join(document_tags.select("doc_id", "kind", "code", F.lit(1).alias("tagged")).distinct(), ["doc_id", "kind", "code"], "left")
    by = tagged.groupBy("kind", "code", "phrase").agg(F.count(F.lit(1)).alias("df"), F.count("tagged").alias("df_tagged"))
    # An entry's phrases are few, and in one row.
    own = by.groupBy("kind", "code").agg(F.collect_list(F.struct("phrase", "df", "df_tagged")).alias("own")).select("kind", "code", "own", F.explode("own").alias("p"))
    p = F.col("p")
    longer = lambda o: (o["phrase"] != p["phrase"]) & F.contains(o["phrase"], p["phrase"]) & (o["df"] == p["df"]) & (o["df_tagged"] == p["df_tagged"])
    good = F.filter("own", lambda o: (o["df_tagged"] / o["df"] >= CANONICAL_P) & (o["df"] >= NOISY_DF))
    canonical = F.element_at(F.array_sort(F.transform(good, lambda o: F.struct((-o["df"]).alias("df"), o["phrase"].alias("phrase")))), 1)["phrase"]
    precision = p["df_tagged"] / p["df"]
    verdict = (
        F.when((F.size(good) > 0) & (p["phrase"] == F.when(F.size(good) > 0, canonical)), "KEEP_CANONICAL")
        .when(F.exists("own", longer), "DROP_DUPE")
        .when(p["df"] <= RARE_DF, "DROP_RARE")
        .when((p["df"] >= NOISY_DF) & (precision < NOISY_P), "DROP_NOISY")
        .otherwise("KEEP")
    )
    return own.select("kind", "code", "p.phrase", "p.df", "p.df_tagged", precision.alias("precision"), verdict.alias("verdict"))


# What a candidate phrase must not begin with or be.
JUNK = re.compile(
    r"^(?:©.*|[0-9]+\s*(?:a\.m\.|p\.m\.)|[0-9]+\s+days?|(?:and|or|the|of|to|for|with|from|by|in|on|at|as|if|but|an?)\s|.*[0-9]{4,}|[0-9]+\s*$)", re.IGNORECASE
)
BLANKS = re.compile(r"[ \t\n\r\f\v]+")
CAPITALS = re.compile("[A-Z][A-Z0-9]{1,14}")


def _weighted(count: Counter, heads: Counter, least: int) -> list[tuple]:
    """(item, occurrences, weight, in a heading) of items of some weight, the heaviest first, then by item."""
    found = [(x, n, n + (HEADING_WEIGHT - 1) * heads[x], x in heads) for x, n in count.items() if HEADING_WEIGHT * n >= least]
    return sorted((x for x in found if x[2] >= least), key=lambda x: (-x[2], x[0]))


def candidates(
    documents: DataFrame, entries: tuple[Entry, ...] = SAMPLE, decided: frozenset[str] = frozenset(), least: int = 3, most_grams: int = 100, most_abbreviations: int = 30, common_words: frozenset[str] = frozenset()
) -> DataFrame:
    """doc_id, candidate_type, phrase, occurrences, weight and confidence of what a document says often and the lexicon lacks.

    documents: doc_id and lines, an array of (text, is_heading). Candidates are word n-grams of 2 to 4 (type d)
    and words of capitals (alias), counted in a document, headings twice. Left out are decided and common
    phrases, those of stop words alone or with single letters, junk, and parts or wholes of known phrases; then those
    lighter than `least` and all beyond the caps. A document is one row, so nothing is shuffled.
    """
    known = set(phrase_map(entries))
    never = known | set(COMMON_PHRASES) | set(decided)
    codes = {e.code.replace("_", " ").lower() for e in entries}
    stops, plain = set(CANDIDATE_STOPS), set(COMMON_ABBREVIATIONS) | set(common_words)

    def is_candidate(words: tuple[str, ...]) -> bool:
        gram = " ".join(words)
        if len(gram) < 4 or len(gram) > 500 or gram in never or all(w in stops for w in words) or any(len(w) == 1 for w in words) or JUNK.match(gram):
            return False
        return not any(gram in p or p in gram for p in known) and gram.replace(" ", "_") not in codes

    def of_document(lines: list) -> list[tuple]:
        count, heads, names, named = Counter(), Counter(), Counter(), Counter()
        for line in lines:
            text = line["text"] or ""
            words = BLANKS.sub(" ", text).strip().lower().split(" ")
            capitals = [w.lower() for w in re.split(r"\W+", text) if CAPITALS.fullmatch(w)]
            for n in (2, 3, 4):
                grams = list(zip(*(words[i:] for i in range(n))))
                count.update(grams)
                if line["is_heading"]:
                    heads.update(grams)
            names.update(capitals)
            if line["is_heading"]:
                named.update(capitals)
        # What a gram is only matters for the few that are said often enough.
        kept = [(" ".join(x), *rest) for x, *rest in _weighted(count, heads, least) if is_candidate(x)]
        kept = sorted(kept, key=lambda x: (-x[2], x[0]))[:most_grams]
        aliases = [x for x in _weighted(names, named, least) if x[0] not in never and x[0] not in plain]
        aliases = aliases[: most_grams + most_abbreviations - len(kept)]
        confidence = lambda w, h: min(0.9, min(0.9, 0.5 + 0.1 * w) + (0.1 if h else 0))
        return [(t, x, n, w, confidence(w, h)) for t, rows in (("d", kept), ("alias", aliases)) for x, n, w, h in rows]

    def run(batches):
        names = ["candidate_type", "phrase", "occurrences", "weight", "confidence"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            for i in range(batch.num_rows):
                out = of_document(batch.column("lines")[i].as_py() or [])
                if out:
                    own = batch.column("doc_id").take(pa.array([i] * len(out), pa.int32()))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))], ["doc_id", *names])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "lines").mapInArrow(run, f"doc_id {kind}, candidate_type string, phrase string, occurrences bigint, weight bigint, confidence double")


def generic_words(rejected: DataFrame, lexicon_phrases: DataFrame) -> DataFrame:
    """Words of three letters or more in at least 30 rejected phrases and at most one of the lexicon's; both have `phrase`."""
    words = lambda df, a, b: df.select(F.explode(F.array_distinct(tokens(F.col("phrase")))).alias("word"), F.lit(a).alias("r"), F.lit(b).alias("l"))
    both = words(rejected, 1, 0).unionByName(words(lexicon_phrases, 0, 1)).where(F.length("word") >= 3)
    by = both.groupBy("word").agg(F.sum("r").alias("n_rejected"), F.sum("l").alias("n_lexicon"))
    return by.where((F.col("n_rejected") >= GENERIC_REJECTED) & (F.col("n_lexicon") <= GENERIC_LEXICON))


# Leaves of codes that say nothing by themselves.
GENERIC_LEAVES = ("general", "info", "information", "misc", "other")


def leaf(code: Column) -> Column:
    """The last part of a code, with blanks."""
    return F.trim(F.lower(F.replace(F.element_at(F.split(code, r"\."), -1), F.lit("_"), F.lit(" "))))


def most_specific(tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each key's deepest d-code with a leaf that says something: most dots, then the longest, then the last by name."""
    dots = F.length("code") - F.length(F.replace("code", F.lit(".")))
    named = tags.where((F.col("kind") == "d") & ~leaf(F.col("code")).isin(*GENERIC_LEAVES))
    return named.groupBy(key).agg(F.max_by("code", F.struct(dots, F.length("code"), "code")).alias("code"))
