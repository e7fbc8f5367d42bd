"""Operator 4: Order MinHash fingerprints.

A text's tokens (runs of non-space characters; a run of more than TOKEN_CHARS, as in texts without blanks, gives
single characters and its last TOKEN_CHARS as one token, so that an edit shifts no other tokens) give k-mers of
K tokens. Each k-mer gets its occurrence number, so that repetitions count, and is hashed with it.
Each of SKETCHES orderings goes round the circle of hashes from a fixed point of its own, the points
lying evenly; an ordering's first two k-mers are selected and give a tuple: they are hashed in the order
in which they stand in the text. Likeness is the share of equal tuples: it falls with edits and with
moved passages (Marcais et al., 2019, with tuples of two; the orderings are those of one-permutation
hashing with rotation, Shrivastava and Li, 2014).

All DataFrame functions on arrays of one text: its hashes are sorted once, which gives the occurrence
numbers (places in runs of equal hashes) and the two hashes behind each point.

Each document is compared with its successor by ascending doc_id. Ids are dealt into ranges: by their
quantiles, and between two quantiles by equal steps, so that there are as many ranges as the shuffle
needs. In a range the successor is the next row, and a range's last row gets the first of the next
non-empty range, from a table with one row per range. Whole texts are shuffled once.

Cases: a null text is the empty one. A text with fewer than K tokens has one k-mer of all of them,
also the empty text. Rows with the same doc_id follow each other by text; null ids come first. The
last row's successor is the first, also when there is only one row. An empty table gives no rows. Ids
must be numbers: others stop the job. All rows of one id are ordered in one task (it sorts and spills).
Other columns are left out, whatever their names. A very long text needs a few longs per token in
memory; one with more than 2^PLACE_BITS tokens stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.llm.arrays import let
from tidemark.llm.tables import read, whole_texts, written

K = 3
SKETCHES = 32
#: Bits that number the SKETCHES points.
ARC_BITS = 5
TOKEN_CHARS = 24
#: A run of up to TOKEN_CHARS, or what is left of a longer one, is a token; before that, each character is one.
TOKEN = rf"\S{{1,{TOKEN_CHARS}}}+(?!\S)|\S"
#: Quantiles of the ids; ranges are steps between two of them.
QUANTILES = 64
#: Low bits of a packed long that hold a k-mer's place in its text; the rest is its hash.
PLACE_BITS = 26
PLACE = (1 << PLACE_BITS) - 1
HALF = SKETCHES // 2


def occurrences(text: Column) -> Column:
    """A text's k-mers as longs: hash with occurrence number in the high bits, place in the text in the low ones."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    many = lambda w: F.transform(F.slice(w, K, F.size(w)), lambda _, i: F.xxhash64(*(F.get(w, i + j) for j in range(K))))
    over = F.raise_error("a text has too many tokens for its places").cast("array<bigint>")
    hashes = let(words, lambda w: F.when(F.size(w) > PLACE, over).when(F.size(w) >= K, many(w)).otherwise(F.array(F.xxhash64(w))))
    return let(F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))), numbered)


def numbered(s: Column) -> Column:
    """The sorted longs with the number that each has in its run of equal hashes counted into its hash."""
    high = lambda x: F.shiftright(x, PLACE_BITS)
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (high(F.get(s, i)) != high(F.get(s, i - 1))))
    again = lambda x, n: F.xxhash64(high(x), n).bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))
    own = lambda r: F.transform(F.slice(s, r["a"] + 1, r["b"] - r["a"]), lambda x, n: F.when(n == 0, x).otherwise(again(x, n)))
    bounds = lambda a: F.arrays_zip(a.alias("a"), F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(s))).alias("b"))
    return let(starts, lambda a: F.when(F.size(a) == F.size(s), s).otherwise(F.sort_array(F.flatten(F.transform(bounds(a), own)))))


def fingerprint(text: Column) -> Column:
    """A text's fingerprint: an array of SKETCHES longs."""
    arc = lambda x: F.shiftright(x, 64 - ARC_BITS).cast("int")  # noqa: E731  # from -HALF to HALF - 1

    def firsts(s: Column) -> Column:
        # For each point the index of the first hash behind it: there is one leader in each arc that has any hash.
        leaders = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (arc(F.get(s, i)) != arc(F.get(s, i - 1))))
        before = lambda f, j: F.when(j == 0, F.lit(-HALF - 1)).otherwise(arc(F.get(s, F.get(f, j - 1))))
        copies = lambda f: F.flatten(F.transform(f, lambda i, j: F.array_repeat(i, arc(F.get(s, i)) - before(f, j))))
        return let(leaders, lambda f: F.concat(copies(f), F.array_repeat(F.lit(0), HALF - 1 - arc(F.element_at(s, -1)))))

    def tuples(s: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(PLACE))
        h = lambda x: F.shiftright(x, PLACE_BITS)
        two = lambda a, b: F.when(place(a) <= place(b), F.xxhash64(h(a), h(b))).otherwise(F.xxhash64(h(b), h(a)))
        return F.transform(firsts(s), lambda i: two(F.get(s, i), F.get(s, (i + 1) % F.size(s))))

    return let(occurrences(text), tuples)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples of two fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / float(SKETCHES)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text and range, a number that ascends with doc_id and splits the rows about evenly."""
    if not isinstance(docs.schema["doc_id"].dataType, NumericType):
        raise ValueError("ids must be numbers")
    n = min(ranges, QUANTILES)
    edges = docs.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(n + 1)], 0.25 / n)
    edges, own = sorted(set(edges)), F.col("doc_id").cast("double")
    if len(edges) < 2:
        return docs.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    steps = -(-ranges // n)

    def between(low: int, high: int) -> Column:
        if high - low == 1:
            step = F.floor((own - edges[low]) / (edges[high] - edges[low]) * steps)
            return low * steps + F.greatest(F.lit(0), F.least(F.lit(steps - 1), step.cast("int")))
        middle = (low + high) // 2
        return F.when(own < edges[middle], between(low, middle)).otherwise(between(middle, high))

    return docs.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(between(0, len(edges) - 1)))


def with_successor(docs: DataFrame, ranges: int) -> DataFrame:
    """range, n (from 1 in the range), doc_id, text, and of the next row by doc_id: next_text, next_range, next_n."""
    dealt = in_ranges(docs, ranges)
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = dealt.select("range", F.row_number().over(order).alias("n"), "doc_id", "text", F.lead("text").over(order).alias("next_text"))
    # One narrow row per range; behind the last comes the first. Then only the ranges' first texts move.
    lowest = dealt.groupBy("range").agg(F.min("doc_id").alias("low"))
    cycle = Window.orderBy("range")
    everywhere = cycle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(cycle), F.first(c).over(everywhere))
    links = written(lowest.select("range", "low", after("range").alias("then_range")))
    lows = links.select(F.col("range").alias("then_range"), "low")
    first = (F.col("range") == F.col("then_range")) & F.col("doc_id").eqNullSafe(F.col("low"))
    # Three numbers per range, of which there are a few per shuffle partition: small enough to send everywhere.
    firsts = dealt.join(F.broadcast(lows), first).groupBy("then_range").agg(F.min("text").alias("then_text"))
    joined = rows.join(links.select("range", "then_range").join(firsts, "then_range"), "range")
    last = F.col("next_text").isNull()
    return joined.select(
        "range",
        "n",
        "doc_id",
        "text",
        F.coalesce("next_text", "then_text").alias("next_text"),
        F.when(last, F.col("then_range")).otherwise(F.col("range")).alias("next_range"),
        F.when(last, F.lit(1)).otherwise(F.col("n") + 1).alias("next_n"),
    )


def edited(text: Column, after: Column) -> Column:
    """The text with its last quarter replaced by as much of the other's start."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(after, F.lit(1), quarter))


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """range, n, doc_id, n_chars, edited_sha256, fp, edited_fp, next_range and next_n of all rows of docs (doc_id, text)."""
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_successor(docs, ranges).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return rows.select(
        "range",
        "n",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fp"),
        fingerprint(F.col("edited")).alias("edited_fp"),
        "next_range",
        "next_n",
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(fingerprints(whole_texts(read(spark, sf_dir, "documents"))))
    after = found.select(F.col("range").alias("next_range"), F.col("n").alias("next_n"), F.col("fp").alias("next_fp"))
    return found.join(after, ["next_range", "next_n"]).select(
        "doc_id", "n_chars", "edited_sha256",
        hex_digits(F.col("fp")).alias("fingerprint"),
        hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
