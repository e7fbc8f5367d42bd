"""The phrase lexicon: its entries as a table, and matching of many phrases in one pass over a text.

A lexicon is a configuration table (kind, code, strong and weak phrases, refuted words) of bounded size
(MOST_ENTRIES, checked when it is loaded). Each task builds one automaton of its phrases, so that a
text is read once whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.constants import LEXICON, SINGLE_WORD_STOPS
from tidemark.functions.text import normalise, padded

MOST_ENTRIES = 50_000
#: Phrases up to so many characters have to stand as words, longer ones anywhere in a text.
SHORT = 4
#: Entries that one query is expanded with.
MOST_MATCHES = 12


@dataclass(frozen=True)
class Entry:
    kind: str
    code: str
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    refuted: tuple[str, ...] = ()

    @property
    def leaf(self) -> str:
        return self.code.split(".")[-1].replace("_", " ").strip().lower()

    @property
    def asked(self) -> list[str]:
        """What a query may say: the strong phrases, then the code's leaf."""
        return list(dict.fromkeys([*(p.strip().lower() for p in self.strong if p.strip()), self.leaf]))


SAMPLE = tuple(Entry(*x) for x in LEXICON)
ENTRY = "kind string, code string, strong array<string>, weak array<string>, refuted array<string>"


def table(spark: SparkSession, entries: tuple[Entry, ...] = SAMPLE) -> DataFrame:
    return spark.createDataFrame([(e.kind, e.code, list(e.strong), list(e.weak), list(e.refuted)) for e in entries], ENTRY)


def load(rows: DataFrame) -> tuple[Entry, ...]:
    """The entries of a lexicon table."""
    found = rows.orderBy("kind", "code").limit(MOST_ENTRIES + 1).collect()
    if len(found) > MOST_ENTRIES:
        raise ValueError(f"a lexicon has {MOST_ENTRIES} entries at most")
    return tuple(Entry(r.kind, r.code, tuple(r.strong or ()), tuple(r.weak or ()), tuple(r.refuted or ())) for r in found)


def phrase_map(entries: Iterable[Entry] = SAMPLE) -> dict[str, tuple[str, str, float]]:
    """phrase: (kind, code, score): kinds p, d, j; codes count as phrases; a later strong phrase replaces an earlier one, a weak one never does."""
    out: dict[str, tuple[str, str, float]] = {}
    for kind in "pdj":
        for e in entries:
            if e.kind == kind:
                for phrase in (e.code.replace("_", " "), *e.strong):
                    out[phrase] = (kind, e.code, 1.0)
                for phrase in e.weak:
                    out.setdefault(phrase, (kind, e.code, 0.6))
    return out


def _word_character(c: str) -> bool:
    return c.isalnum() or c == "_"


class Matcher:
    """Finds which of many phrases stand in a text; those of up to `short` characters as words."""

    def __init__(self, phrases: dict[str, object], short: int = SHORT):
        self.short = short
        self.automaton = ahocorasick.Automaton()
        for phrase, value in phrases.items():
            if phrase:
                self.automaton.add_word(phrase, (phrase, value))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[str, object]:
        found: dict[str, object] = {}
        if self.empty or not text:
            return found
        for end, (phrase, value) in self.automaton.iter(text):
            if phrase in found:
                continue
            start = end - len(phrase)
            if len(phrase) <= self.short and (start >= 0 and _word_character(text[start]) or end + 1 < len(text) and _word_character(text[end + 1])):
                continue
            found[phrase] = value
        return found


def _hits(rows: DataFrame, entries: tuple[Entry, ...], best: bool) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept]
    added = [("kind", "string"), ("code", "string"), ("score", "double")] + ([] if best else [("phrase", "string"), ("refuted", "boolean")])

    def run(batches):
        hits, against = Matcher(phrase_map(entries)), Matcher({w: None for e in entries for w in e.refuted})
        refuted = {(e.kind, e.code): set(e.refuted) for e in entries if e.refuted}
        for batch in batches:
            row: list[int] = []
            out: list[tuple] = []
            for i, text in enumerate(batch.column("normal").to_pylist()):
                found = hits.find(text)
                if not found:
                    continue
                bad = against.find(text).keys()
                rejected = lambda k, c: (k, c) in refuted and not refuted[k, c].isdisjoint(bad)
                if best:
                    top: dict[tuple[str, str], float] = {}
                    for k, c, s in found.values():
                        if s > top.get((k, c), 0.0) and not rejected(k, c):
                            top[k, c] = s
                    new = [(k, c, s) for (k, c), s in top.items()]
                else:
                    new = [(k, c, s, p, rejected(k, c)) for p, (k, c, s) in found.items()]
                row += [i] * len(new)
                out += new
            taken = pa.array(row, pa.int32())
            columns = list(zip(*out)) or [()] * len(added)
            kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
            values = [pa.array(list(v), kinds[t]) for v, (_, t) in zip(columns, added)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(taken) for n in names), *values], [*names, *(n for n, _ in added)])

    schema = StructType(kept)
    for name, kind in added:
        schema = schema.add(name, kind)
    normal = rows.select(*names, normalise(F.coalesce("text", F.lit(""))).alias("normal"))
    return normal.mapInArrow(run, schema)


def phrase_hits(rows: DataFrame, entries: tuple[Entry, ...] = SAMPLE) -> DataFrame:
    """The rows' columns but the text, and kind, code, score, phrase, refuted: a row per phrase of the lexicon in a text."""
    return _hits(rows, entries, best=False)


def best_tags(rows: DataFrame, entries: tuple[Entry, ...] = SAMPLE) -> DataFrame:
    """The rows' columns but the text, and kind, code, score: each text's tags with their best score, without those that one of their refuted words refutes."""
    return _hits(rows, entries, best=True)


def expand(queries: DataFrame, entries: tuple[Entry, ...] = SAMPLE, most: int = MOST_MATCHES) -> DataFrame:
    """query_id, place, kind, code and phrase of the first matching entries in (kind, code) order.

    A phrase matches as whole words; a general single word longer than four letters doesn't.
    """
    plain = lambda p: re.sub("[^a-z0-9]+", " ", p.lower()).strip()
    order = sorted(entries, key=lambda e: (e.kind, e.code))

    def run(batches):
        asked = [[(p, f" {plain(p)} ") for p in e.asked if plain(p) and not (len(plain(p)) > 4 and plain(p) in SINGLE_WORD_STOPS)] for e in order]
        matcher = Matcher({w: None for own in asked for _, w in own}, short=0)  # blanks stand for the bounds
        for batch in batches:
            ids, out = [], []
            for i, text in enumerate(batch.column("n").to_pylist()):
                found = matcher.find(text)
                hits = [(e.kind, e.code, next(p for p, w in own if w in found)) for e, own in zip(order, asked) if any(w in found for _, w in own)] if found else []
                ids += [i] * len(hits[:most])
                out += [(n, *h) for n, h in enumerate(hits[:most])]
            place, kind, code, phrase = list(zip(*out)) or [()] * 4
            columns = [pa.array(list(place), pa.int64()), *(pa.array(list(c), pa.string()) for c in (kind, code, phrase))]
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(ids, pa.int32())), *columns], ["query_id", "place", "kind", "code", "phrase"])

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", padded(F.col("text")).alias("n")).mapInArrow(run, f"query_id {kind}, place bigint, kind string, code string, phrase string")


def bags(spark: SparkSession, entries: tuple[Entry, ...] = SAMPLE) -> DataFrame:
    """kind, code and phrase: all that an entry may be asked by."""
    return spark.createDataFrame([(e.kind, e.code, p) for e in entries for p in e.asked], "kind string, code string, phrase string")


def phrase_bags(queries: DataFrame, entries: tuple[Entry, ...] = SAMPLE) -> DataFrame:
    """query_id and phrase: all that the entries which a query (query_id, text) matches may be asked by."""
    matched = expand(queries, entries).select("query_id", "kind", "code")
    return matched.join(bags(queries.sparkSession, entries), ["kind", "code"]).select("query_id", "phrase")
