"""Documents to pages, chunks and lines; page text; embeddable units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import content_key, tokens

PAGE_LINES = 8


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, page_number and text: a row per line of a document."""
    cut = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "text")
    rows = docs.select("doc_id", cut)
    return rows.select("doc_id", F.col("i").cast("long").alias("paragraph_index"), (F.floor(F.col("i") / PAGE_LINES) + 1).cast("long").alias("page_number"), "text")


def heading(text: Column, most_words: int = 15) -> Column:
    """Whether a line is a heading: some words, not many, that don't end a sentence."""
    n = F.size(tokens(text))
    return (n >= 1) & (n <= most_words) & ~F.rtrim(text).rlike(r"[.,;:]$")


def headings(rows: DataFrame) -> DataFrame:
    """lines with n_words and is_heading."""
    return rows.withColumns({"n_words": F.size(tokens(F.col("text"))).cast("long"), "is_heading": heading(F.col("text"))})


def simple_paragraphs(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """Paragraphs of at least so many characters; their index counts the short ones too."""
    return lines(docs).where(F.length(F.trim("text")) >= least_chars)


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id and lines, an array of (text, is_heading), for what works on a document as one row."""
    cut = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda t: F.struct(t.alias("text"), heading(t).alias("is_heading")))
    return docs.select("doc_id", cut.alias("lines"))


# A billing code, a change of one, and how text begins that goes on from before.
CODE = r"\b([A-Z][0-9]{4}|[0-9]{5})\b"
CHANGE = r"(?i)\b(add(ed)?|remov(ed)?|updat(ed)?|revis(ed)?|delet(ed)?|replac(ed)?|correct(ed)?)\b[^.\n]*\b(hcpcs|cpt|code)\b"
GOES_ON = r"^([a-z(\[]|(and|or|to|through|thru)\b)"
FRAGMENT_CHARS = 40


def is_code_fragment(text: Column) -> Column:
    """A short piece with a billing code that begins in the middle of something or logs a change of codes."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return (bare != "") & (F.length(bare) < FRAGMENT_CHARS) & bare.rlike(CODE) & (bare.rlike(CHANGE) | bare.rlike(GOES_ON))


def glue_fragments(rows: DataFrame) -> DataFrame:
    """Joins code fragments onto the paragraph before them in the same section: islands by a running count of other paragraphs.

    rows: doc_id, paragraph_index, text, and maybe section.
    """
    order = Window.partitionBy("doc_id").orderBy("paragraph_index")
    starts = ~is_code_fragment(F.col("text"))
    if "section" in rows.columns:
        starts = starts | ~F.col("section").eqNullSafe(F.lag("section").over(order))
    marked = rows.withColumn("island", F.sum(starts.cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("paragraph_index", "text")))
    glued = marked.groupBy("doc_id", "island").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return glued.select("doc_id", F.get("parts", 0)["paragraph_index"].alias("paragraph_index"), F.size("parts").cast("long").alias("n_parts"), text.alias("text"))


def first_of_copies(rows: DataFrame, chars: int, order: list[str]) -> DataFrame:
    """The first row of each content key; rows without content all stay."""
    keyed = rows.withColumn("content_key", content_key(F.col("text"), chars))
    first = Window.partitionBy("content_key").orderBy(*order)
    full = keyed.where("content_key <> ''").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return full.unionByName(keyed.where("content_key = ''"))


def page_title(html: Column, url: Column) -> Column:
    """A page's first heading, else its title, else the URL: without tags, references decoded, 240 characters."""
    inner = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    told = lambda tag: F.trim(F.regexp_replace(decode_references(F.regexp_replace(inner(tag), "<[^>]*>", "")), r"\s+", " "))
    return F.substring(F.when(told("h1") != "", told("h1")).when(told("title") != "", told("title")).otherwise(url), 1, 240)


# The named references of markup.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&"))


def decode_references(text: Column) -> Column:
    for name, mark in NAMED:
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def content_sha(*parts: Column) -> Column:
    """An identifier of a published row; equal bodies have different ones."""
    return F.sha2(F.concat_ws("‖", *(p.cast("string") for p in parts)), 256)
