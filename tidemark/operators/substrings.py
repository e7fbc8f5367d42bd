"""Texts that hold a pattern anywhere, for a table of patterns: an index of grams.

A pattern is known by its rarest gram. Texts with that gram are its candidates, and each of them is checked, so
the result is that of LIKE '%pattern%' on all texts, without a pair of them being made. A gram is a few bytes of UTF-8,
packed into a long. A pattern takes the longest grams that fit into it, so a long one meets few texts and
one of a single letter is still exact.

The texts are read twice: once to count the patterns' grams, once for those that the chosen ones stand in, which are checked where
they lie. Patterns and their grams go to all tasks up to a proven bound, and what is shuffled are counts and results; beyond it, postings
are joined, and so they are with a stored index.

Cases: a null or empty pattern is in no text, a null text holds none. Equal patterns are looked for once. Ids
may repeat; each gets its own rows. A text whose key has a null is left out. Long texts are cut into portions that overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.sources.store import cut

#: Bytes in a gram; the first must be 1, the last 8 at most.
LENGTHS = (1, 3, 8)
#: Grams that are sent to all tasks; beyond that both sides are shuffled.
MOST_SENT = 1_000_000
#: Patterns, and bytes of them, that are.
MOST_PATTERNS, MOST_BYTES = 200_000, 4_000_000
#: Bytes of a text whose grams are worked out at once.
PORTION = 1 << 20


def _packed(raw: np.ndarray, n: int) -> np.ndarray:
    """The grams of n bytes, in their order."""
    count = max(0, len(raw) - n + 1)
    said = raw.astype(np.uint64)
    packed = said[:count].copy()
    for i in range(1, n):
        packed |= said[i : i + count] << np.uint64(8 * i)
    return packed.view(np.int64)


def grams(raw: bytes, n: int) -> np.ndarray:
    """The distinct grams of n bytes."""
    return np.unique(_packed(np.frombuffer(raw, np.uint8), n))


def postings(texts: DataFrame, key: list[str], lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """key and gram: the index of texts (key, text), to be stored where many tables of patterns will be asked. A portion of a text has each gram once."""
    rows = texts.where("text is not null").select(*key, F.col("text").alias("_text"))

    def run(batches):
        for batch in batches:
            made, owners, size = [], [], 0

            def out(made=made, owners=owners):
                taken = pa.array(np.repeat(np.array(owners, np.int64), [len(x) for x in made]))
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in key), pa.array(np.concatenate(made))], [*key, "gram"])

            for i, text in enumerate(batch.column("_text").to_pylist()):
                raw = text.encode()
                for start in range(0, len(raw), PORTION):
                    for n in lengths:
                        made.append(grams(raw[start : start + PORTION + n - 1], n))
                        owners.append(i)
                        size += len(made[-1])
                    if size > PORTION:
                        yield out()
                        made.clear(), owners.clear()
                        size = 0
            if made:
                yield out()

    return rows.mapInArrow(run, StructType([*rows.drop("_text").schema.fields, StructField("gram", LongType())]))


class _Sought:
    """Grams, known by their length and value, that whole batches of texts are searched for."""

    def __init__(self, by_length: dict[int, np.ndarray]):
        self.by_length = {n: np.unique(x) for n, x in by_length.items()}
        self.marked = {}
        for n, x in self.by_length.items():  # most grams are told apart by a few bits of theirs
            self.marked[n] = np.zeros(1 << 20, bool)
            self.marked[n][self._cell(x)] = True

    @staticmethod
    def _cell(x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def found(self, raw: np.ndarray, ends: np.ndarray):
        """By length and portion: n, the distinct (text's number, gram) in two columns. ends: where each text ends in raw."""
        for start in range(0, len(raw), PORTION):
            for n, wanted in self.by_length.items():
                packed = _packed(raw[start : start + PORTION + n - 1], n)
                at = np.flatnonzero(self.marked[n][self._cell(packed)])
                at = at[np.isin(packed[at], wanted)]
                owner = np.searchsorted(ends, at + start, "right")
                inside = at + start + n <= ends[owner]
                owner, gram = owner[inside], packed[at[inside]]
                order = np.lexsort((gram, owner))
                owner, gram = owner[order], gram[order]
                fresh = np.append(True, (np.diff(owner) != 0) | (np.diff(gram) != 0))[: len(owner)]
                yield n, owner[fresh], gram[fresh]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All of a column's texts as one array, and where each ends."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets[1:] - offsets[0]


def _counted(texts: DataFrame, sought: _Sought) -> DataFrame:
    """n, gram and texts: how many texts (column text; each of its portions counts) have a sought gram."""
    sent = texts.sparkSession.sparkContext.broadcast(sought)

    def run(batches):
        for batch in batches:
            for n, _, gram in sent.value.found(*_bytes(batch.column(0))) if batch.num_rows else ():
                own, counts = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n)), pa.array(own), pa.array(counts)], ["n", "gram", "texts"])

    every = texts.where("text is not null").select("text").mapInArrow(run, "n bigint, gram bigint, texts bigint")
    return every.groupBy("n", "gram").agg(F.sum("texts").alias("texts"))


def _standing(texts: DataFrame, key: list[str], patterns: list[tuple[str, int, int]]) -> DataFrame:
    """key and pattern: the texts in which the patterns (pattern, n, gram) stand."""
    by_gram = {}
    for pattern, n, gram in patterns:
        by_gram.setdefault((n, gram), []).append((pattern, pattern.encode()))
    lengths = {n for n, _ in by_gram}
    sought = _Sought({n: np.array([g for m, g in by_gram if m == n], np.int64) for n in sorted(lengths)})
    sent = texts.sparkSession.sparkContext.broadcast((sought, by_gram))
    rows = texts.where(" and ".join(["text is not null", *(f"`{c}` is not null" for c in key)])).select(*key, F.col("text").alias("_text"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sought, by_gram = sent.value
            raw, ends = _bytes(batch.column("_text"))
            found, text, last = set(), b"", -1
            for n, owners, near in sought.found(raw, ends):
                for i, gram in zip(owners.tolist(), near.tolist()):
                    if i != last:
                        text, last = raw[ends[i - 1] if i else 0 : ends[i]].tobytes(), i
                    found.update((i, pattern) for pattern, said in by_gram[n, gram] if said in text)
            own = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in key), pa.array([p for _, p in found], pa.string())], [*key, "pattern"])

    return rows.mapInArrow(run, StructType([*rows.drop("_text").schema.fields, StructField("pattern", StringType())]))


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows joined with wanted (gram, ...), which goes to all tasks only up to its proven bound."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted, "gram")


def holding(patterns: DataFrame, texts: DataFrame, key: list[str], index: DataFrame | None = None) -> DataFrame:
    """patterns' columns and key, for each text (key, text) that a pattern (column pattern) stands in; a text's key is its own.

    index: the stored `postings` of all lengths; without it only those of the patterns' lengths are made.
    """
    fitting = F.greatest(*(F.when(F.octet_length("pattern") >= n, n) for n in LENGTHS), F.lit(0))
    asked = cut(patterns.where("pattern <> ''").select("pattern").distinct().withColumn("n", fitting))
    lengths = tuple(sorted(r.n for r in asked.select("n").distinct().collect()))  # three at most
    own = [postings(asked.where(F.col("n") == n).select("pattern", F.col("pattern").alias("text")), ["pattern"], (n,)) for n in lengths]
    if not own:
        own = [postings(asked.select("pattern", F.col("pattern").alias("text")), ["pattern"])]
    wanted = own[0]
    for more in own[1:]:
        wanted = wanted.union(more)
    wanted = cut(wanted)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("pattern")).alias("bytes")).first()
    if index is None and size["n"] <= MOST_PATTERNS and (size["bytes"] or 0) <= MOST_BYTES:
        with_length = wanted.join(asked, "pattern")
        every = with_length.select(F.col("n").cast("long").alias("n"), "gram").distinct().toArrow()
        counts = _counted(texts, _Sought({n: every["gram"].to_numpy()[every["n"].to_numpy() == n] for n in lengths}))
        known = with_length.join(counts, ["n", "gram"], "left").groupBy("pattern").agg(F.min(F.struct("texts", "n", "gram")).alias("r"), F.min(F.col("texts").isNotNull()).alias("all"))
        chosen = [(r.pattern, r.n, r.gram) for r in known.where("all").select("pattern", "r.n", "r.gram").collect()]
        return patterns.join(_standing(texts, key, chosen), "pattern")
    made = lambda by: postings(texts, by, lengths) if index is None else index.select(*by, "gram")
    counts = _among(made([]), cut(wanted.select("gram").distinct())).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    known = wanted.join(counts, "gram", "left").groupBy("pattern").agg(F.min(F.struct("texts", "gram")).alias("r"), F.min(F.col("texts").isNotNull()).alias("all"))
    # A pattern with a gram that no text has is in none.
    rarest = cut(known.where("all").select("pattern", F.col("r.gram").alias("gram")))
    near = cut(_among(made(key), rarest).select(*key, "pattern").distinct())
    found = near.join(texts.select(*key, "text"), key).where(F.contains("text", "pattern")).select(*key, "pattern")
    return patterns.join(found, "pattern")
