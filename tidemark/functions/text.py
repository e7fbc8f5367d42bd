"""Text expressions: analyzer, normalisation, phrase tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.constants import NOISE_WORDS, STOP_WORDS

# What questions begin with, wherever it stands.
LEADS = (
    r"(?i)(?<![\p{L}\p{Mn}\p{Nd}_])(how\s+many|how\s+much|how\s+long|how\s+often|how\s+do\s+i|how\s+can\s+i|how\s+do\s+you|how\s+is|how\s+are|how\s+does|what\s+is\s+the|"
    r"what\s+are\s+the|what\s+does|what\s+do\s+i|when\s+do\s+i|when\s+can\s+i|when\s+is|where\s+do\s+i|where\s+can\s+i|who\s+can\s+i|who\s+do\s+i|"
    r"can\s+i|do\s+i|have\s+to|need\s+to|is\s+there\s+a|are\s+there\s+any)"
)


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def placed(own: Column) -> Column:
    """Each of the tokens (an array) once, with the places from 1 where it stands, as an array of (token, places) by token.

    One sort and one run through it within the row, so that no occurrence is exploded, grouped or shuffled.
    """
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["token"] != F.get(s, i - 1)["token"]))
        run = lambda b, i, j: F.slice(s, i + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - i)
        return let(begins, lambda b: F.transform(b, lambda i, j: F.struct(F.get(s, i)["token"].alias("token"), F.transform(run(b, i, j), lambda x: x["at"]).alias("places"))))

    by_token = F.sort_array(F.transform(own, lambda t, i: F.struct(t.alias("token"), (i + 1).alias("at"))))
    return F.when(F.size(own) > 0, let(by_token, runs)).otherwise(F.array().cast("array<struct<token:string,places:array<int>>>"))


def filter_tokens(text: Column, most: int | None = 7) -> Column:
    """The first distinct tokens (all if None) that are no stop words and longer than one letter."""
    kept = F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)))
    return kept if most is None else F.slice(kept, 1, most)


def normalise(text: Column) -> Column:
    """Lower case, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def padded(text: Column) -> Column:
    """Letters and digits with single blanks, also at both ends."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def words(text: Column) -> Column:
    """The text's words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def normalise_query(text: Column) -> Column:
    """Without question leads and quantifiers; the plain query where nothing would be left."""
    kept = F.array_join(F.filter(words(F.regexp_replace(text, LEADS, " ")), lambda w: ~F.lower(w).isin(NOISE_WORDS)), " ")
    return F.when(kept == "", text).otherwise(kept)


def content_key(text: Column, chars: int) -> Column:
    """The start of the normalised text, by which copies are known."""
    return F.substring(normalise(text), 1, chars)


def word_grams(text: Column, sizes: tuple[int, ...], bare_ends: bool = False) -> Column:
    """The text's word n-grams as an array of (gram, n); with bare_ends those that begin and end with no stop word.

    The words are worked out once and don't leave the expression, so exploding the result copies no array.
    """

    def of(w: Column, n: int) -> Column:
        kept = F.sequence(F.lit(1), F.size(w) - (n - 1))
        if bare_ends:
            kept = F.filter(kept, lambda i: ~F.get(w, i - 1).isin(STOP_WORDS) & ~F.get(w, i + (n - 2)).isin(STOP_WORDS))
        made = F.transform(kept, lambda i: F.struct(F.array_join(F.slice(w, i, n), " ").alias("gram"), F.lit(n).cast("long").alias("n")))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<struct<gram:string,n:bigint>>"))

    return F.get(F.transform(F.array(tokens(text)), lambda w: F.concat(*(of(w, n) for n in sizes))), 0)
