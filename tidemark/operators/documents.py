"""Text of pages and extractions: paragraphs with headers, markdown, normal form and spans, repaired JSON, checks of free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import words

# What makes a first line a header of a paragraph, and a page's line a heading.
PARAGRAPH_HEADER = (r":$", r"^[A-Z][A-Z\s]+:", r"^[0-9]+\.\s+[A-Z]")
PAGE_HEADER = (*PARAGRAPH_HEADER, r"^[0-9]+\.[0-9]+\s+")
TITLE_LIKE = r"^[0-9.]*\s*[A-Z][a-z]*(\s+[a-z]+)*\s*$"
GAP = r"\n\s*\n+"


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _blocks(text: Column) -> Column:
    """The pieces between empty lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(strip(text), GAP, -1), strip), lambda b: b != "")


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, section and text of documents (doc_id, text): the pieces between empty lines, a header taken off their first line, short titles left out."""
    lines = lambda b: F.split(b, "\n", -1)
    head = lambda b: strip(F.get(lines(b), 0))
    headed = lambda b: (F.length(head(b)) < 100) & _any(head(b), PARAGRAPH_HEADER)
    rest = lambda b: strip(F.array_join(F.slice(lines(b), 2, 1_000_000_000), "\n"))
    made = F.transform(_blocks(F.coalesce("text", F.lit(""))), lambda b: F.struct(F.when(headed(b), head(b)).alias("section"), F.when(headed(b), rest(b)).otherwise(b).alias("text")))
    bare = lambda p: p["text"]
    title = lambda p: (F.length(bare(p)) < 80) & ~bare(p).contains("\n") & ~bare(p).rlike(r"[.:]$") & (bare(p).rlike(TITLE_LIKE) | (F.size(words(bare(p))) <= 6))
    kept = F.filter(made, lambda p: (bare(p) != "") & ~title(p))
    return docs.select("doc_id", F.posexplode(kept).alias("i", "p")).select("doc_id", F.col("i").cast("long").alias("paragraph_index"), "p.section", "p.text")


def page_markdown(text: Column) -> Column:
    """A page's raw text as markdown: paragraphs whose first line looks like a header get it as one."""
    first = lambda b: strip(F.get(F.split(b, "\n", -1), 0))
    short = lambda h: (F.length(h) <= 60) & ~h.endswith(".") & h.rlike(r"^\p{Lu}") & (F.size(words(h)).between(1, 8))
    header = lambda b: (F.length(first(b)) <= 120) & (first(b) != "") & (_any(first(b), PAGE_HEADER) | short(first(b)))
    body = lambda b: strip(F.array_join(F.slice(F.split(b, "\n", -1), 2, 1_000_000_000), "\n"))
    named = lambda b: F.concat(F.lit("## "), F.regexp_replace(first(b), ":+$", ""), F.when(body(b) != "", F.concat(F.lit("\n\n"), body(b))).otherwise(""))
    parts = F.transform(_blocks(F.coalesce(text, F.lit(""))), lambda b: F.when(header(b), named(b)).otherwise(b))
    return F.array_join(parts, "\n\n")


def normal_page(text: Column) -> Column:
    """Single blanks in each line, lines stripped, no more than one empty line between others."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: strip(F.regexp_replace(x, r"\s+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def normal_span(raw: Column, start: Column, end: Column) -> Column:
    """A struct of start and end in the normal page of a span of the raw one; null where it can't be found."""
    own = normal_page(F.substring(raw, start + 1, end - start))
    at = F.call_function("locate", own, normal_page(raw))
    good = (start < end) & (start >= 0) & (end <= F.length(raw)) & (own != "") & (at > 0)
    return F.when(good, F.struct((at - 1).alias("start"), (at - 1 + F.length(own)).alias("end")))


def fact_span(fact: Column, page: Column, start: Column, end: Column) -> Column:
    """A struct of where a fact stands in a page: at the place given if that says it, else where it is found with any white space between its words, else the place given."""
    given = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    one = lambda x: strip(F.regexp_replace(x, r"\s+", " "))
    valid = start.isNotNull() & end.isNotNull() & (start >= 0) & (start < end) & (end <= F.length(page))
    same = valid & (one(F.substring(page, start + 1, end - start)) == one(fact))
    quoted = F.array_join(F.transform(F.split(fact, " ", -1), lambda w: F.when(w == "", "").otherwise(F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))), "\\s+")
    said = F.regexp_substr(page, quoted)
    at = F.call_function("locate", said, page)
    found = F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(said)).cast("int").alias("end"))
    blank = (F.coalesce(fact, F.lit("")) == "") | (F.coalesce(page, F.lit("")) == "")
    return F.when(blank | same, given).when(said.isNotNull(), found).otherwise(given)


def json_text(response: Column) -> Column:
    """The JSON in a model's response: without fences and what stands before the first brace."""
    bare = strip(response)
    bare = F.regexp_replace(F.regexp_replace(bare, r"^```json", ""), r"^```", "")
    bare = strip(F.regexp_replace(bare, r"```$", ""))
    at = F.instr(bare, "{")
    return F.when(at > 0, F.substring(bare, at, F.length(bare))).otherwise(bare)


def closed(text: Column) -> Column:
    """Text that was cut off in a list of facts, closed: behind a quote, a comma or a colon with null."""
    bare = F.regexp_replace(text, r"\s+$", "")
    return F.when(bare.endswith("}") | (bare == ""), bare).when(bare.endswith('"'), F.concat(bare, F.lit('": null}]}'))).when(bare.rlike("[,:]$"), F.concat(bare, F.lit(" null}]}"))).otherwise(bare)


def parsed(response: Column, schema: StructType) -> Column:
    """A struct of schema from a response: as it is, else up to its last brace where braces are even, else closed; null if none can be read."""
    text = json_text(response)
    upto = F.regexp_substr(text, F.lit(r"(?s)^.*\}"))
    even = F.length(F.regexp_replace(upto, r"[^{]", "")) == F.length(F.regexp_replace(upto, r"[^}]", ""))
    fields = [f.name for f in schema.fields]
    read = lambda x: F.from_json(x, schema)
    usable = lambda s: reduce(lambda a, b: a | b, (s[f].isNotNull() for f in fields))
    tries = [read(text), read(F.when(even, upto)), read(closed(text))]
    return F.coalesce(*(F.when(usable(t), t) for t in tries))


def critique(raw: Column, categories: list[str]) -> Column:
    """A struct of passed, score (within 0 and 1, .5 if missing), confidence and categories (map of those with a number) from a critique's JSON."""
    get = lambda name: F.get_json_object(raw, f"$.{name}")
    bound = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = bound(F.coalesce(get("score").try_cast("double"), F.lit(0.5)))
    own = F.array_compact(F.array(*(F.when(get(f"category_assessment.{c}.score").try_cast("double").isNotNull(), F.struct(F.lit(c).alias("key"), bound(get(f"category_assessment.{c}.score").try_cast("double")).alias("value"))) for c in categories)))
    return F.struct(F.coalesce(get("pass").try_cast("boolean"), F.lit(False)).alias("passed"), score.alias("score"), F.coalesce(get("confidence").try_cast("double"), F.lit(0.5)).alias("confidence"), F.map_from_entries(own).alias("categories"))


# Severity and stage of errors.
ERRORS = {
    "llm_failure": ("critical", "extraction"),
    "json_parse_error": ("critical", "extraction"),
    "database_error": ("critical", "persistence"),
    "stream_error": ("critical", "extraction"),
    "persistence_error": ("critical", "persistence"),
    "other": ("warning", "other"),
}


def error_class(kind: Column, recovered: Column) -> tuple[Column, Column]:
    """Severity and stage of an error; one in JSON that was recovered is a warning, an unknown one too."""
    pick = lambda i: reduce(lambda acc, kv: F.when(kind == kv[0], kv[1][i]).otherwise(acc), ERRORS.items(), F.lit(("warning", "other")[i]))
    return F.when((kind == "json_parse_error") & recovered, "warning").otherwise(pick(0)), pick(1)


def half_a_year_on(day: Column) -> Column:
    return F.date_add(day, 182)


# States by code and by name, canonical programs.
STATES = """AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY
DC PR""".split()
STATE_NAMES = {"florida": "FL", "georgia": "GA", "texas": "TX", "california": "CA", "new york": "NY", "puerto rico": "PR", "district of columbia": "DC"}


def name_key(raw: Column) -> Column:
    """Trimmed, in lower case, with single blanks and no marks at the end."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"[.,;:]+$", ""), r"\s+", " "))


def canonical_state(raw: Column) -> Column:
    """A state's two letters; null for anything else of another length."""
    key = name_key(raw)
    named = reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), list(STATE_NAMES.items())[1:], F.when(key == list(STATE_NAMES)[0], list(STATE_NAMES.values())[0]))
    return F.when(F.length(key) == 2, F.upper(key)).otherwise(named)


def canonical_level(raw: Column) -> Column:
    """An enumerated value in lower case with underscores; null for blank."""
    return F.nullif(F.regexp_replace(name_key(raw), "[ -]", "_"), F.lit(""))
