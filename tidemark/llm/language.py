"""Operator 9: language ID by compression.

For each language a zstandard raw-content dictionary is made of excerpts of labelled texts. A text is
compressed once with each of them; the language whose dictionary gives the fewest bytes is the
answer, and the relative distance to the next one is the margin. A text whose margin is narrow is
marked as rejected. Texts are compressed in pieces of PIECE_BYTES, each by itself: what a text has said
before would else take the dictionary's place, and the margin would go down with the length.

Learning uses a bounded sample: of each language the SAMPLE_ROWS rows with the smallest hash of their
id and text, and of each of these an excerpt of EXCERPT_CHARS that begins at a place in the whole text
given by the hash. Repeated rows count once. Rows are picked by a hash threshold that follows from the
language's number of different rows, so that no language meets in one task; only the sample, of a
fixed most rows, reaches the driver. Prediction maps whole texts, without a shuffle.

Cases: `und` for a null text, one without a letter, and where nothing could be learned. Equal sizes:
the language with more labelled rows, then the first by name, with margin 0. One language: margin 1.
Repeated rows get equal answers. Empty tables give no rows. Null labels are not learned from. A null id
stays, and rows with one id and different texts are different rows. Columns named like the results are
replaced, others stay. A very long text is compressed piece by piece.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.tables import by_size, read

SAMPLE_ROWS = 256
EXCERPT_CHARS = 2048
#: Labels that a model has at most; more of them stop the job.
MOST_LANGUAGES = 200
#: Below this relative distance between the smallest and the next size an answer is rejected.
LEAST_MARGIN = 0.004
LEVEL = 6
PIECE_BYTES = 1 << 15
#: Behind each text, so that also the shortest are compressible and sizes differ by their content.
PAD = b"\0" * 256
UNKNOWN = "und"

NOT_LETTERS = re.compile(r"[\W\d_]+")
MAYBE_LETTER = re.compile(r"[^\W\d_]")


def normalise(text: str) -> bytes:
    """Lower-case letters with single blanks between runs of them, as UTF-8."""
    return NOT_LETTERS.sub(" ", text.lower()).encode()


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, the language with most rows first."""

    dictionaries: tuple[tuple[str, bytes], ...]


def held_out(doc_id: Column) -> Column:
    """Rows that a model for op9 must not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, learn_from: Column | None = None, sample_rows: int = SAMPLE_ROWS, excerpt_chars: int = EXCERPT_CHARS) -> Model:
    """A model from doc_id, text and lang of the rows for which learn_from holds (all if None)."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    if learn_from is not None:
        rows = rows.where(learn_from)
    place = F.xxhash64("doc_id", "text", F.lit("language"))
    rows = rows.select("lang", "text", place.alias("place"))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.05).alias("n"), F.count(F.lit(1)).alias("rows"))
    counted = counted.limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counted:
        return Model(())
    # Twice the wanted share of each language passes, from which the driver takes the first by hash.
    unit = F.pmod(F.col("place"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for r in counted for x in (r["lang"], min(1.0, 2 * sample_rows / max(r["n"], 1)))))
    start = F.pmod(F.shiftright("place", 30), F.greatest(F.length("text") - excerpt_chars, F.lit(0)) + 1).cast("int") + 1
    excerpt = F.substring("text", start, F.lit(excerpt_chars))
    picked = rows.where(unit < share[F.col("lang")]).select("lang", unit.alias("unit"), "place", excerpt.alias("text"))
    sizes = {r["lang"]: r["rows"] for r in counted}
    # Of different rows there are about twice sample_rows per language; the limit holds whatever the hashes are.
    most = picked.dropDuplicates(["lang", "place"]).orderBy("unit", "lang").limit(8 * sample_rows * len(sizes))
    by: dict[str, list] = {}
    for r in most.collect():
        by.setdefault(r["lang"], []).append((r["unit"], r["text"]))
    order = sorted(by, key=lambda k: (-sizes[k], k))
    return Model(tuple((k, b" ".join(normalise(t) for _, t in sorted(by[k])[:sample_rows])) for k in order))


_COMPRESSORS: dict[int, list] = {}


def compressors(model: Model) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """This worker's compressors for a model."""
    key = zlib.crc32(repr(model).encode())
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        set_up = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        made = []
        for lang, content in model.dictionaries:
            words = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=set_up)
            made.append((lang, zstandard.ZstdCompressor(dict_data=words, compression_params=set_up)))
        _COMPRESSORS[key] = made
    return _COMPRESSORS[key]


def classify(text: str | None, by: list) -> tuple[str, float]:
    """The language and the margin."""
    if text is None or not by or not has_letter(text):
        return UNKNOWN, 0.0
    raw = normalise(text) + PAD
    pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
    sizes = [sum(len(c.compress(x)) for x in pieces) for _, c in by]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = sizes[:best] + sizes[best + 1 :]
    return by[best][0], 1 - sizes[best] / min(rest) if rest else 1.0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (the margin) and rejected, in place of columns of these names; only `text` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")]
    docs = docs.drop(*(n for n, _ in added))

    def answer(batches):
        by = compressors(shared.value)
        for part, texts in by_size(batches):
            found = [classify(x, by) for x in texts]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            columns.append(pa.array([f[0] == UNKNOWN or f[1] < LEAST_MARGIN for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *(n for n, _ in added)])

    schema = StructType(list(docs.schema.fields))
    for name, kind in added:
        schema = schema.add(name, kind)
    return docs.mapInArrow(answer, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(F.col("doc_id")))
    predicted = predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
