"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again.

1. language ID: documents whose language is rejected go.
2. SimHash near-dedup: of each class of near copies (five-word shingles, likeness 0.8) the document with
   the smallest doc_id stays.
3. secret scans: every secret that is found is replaced by a mask; all documents stay.
4. mixing: the corpus is put into the order of a mix of its sources with tempered target weights; all
   documents stay. The files, by name, and the rows in them follow that order.
5. packing: the documents become sequences of power-of-two length, with their token ids. Each file has
   them sorted by length; `run` writes a folder for each length, the buckets that batches are drawn from.

Cases, in every stage: an empty table gives no rows; columns beyond those of `documents` are left out,
whatever their names; very long texts are taken whole. Each stage says what it does with nulls and ties.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, mixing, packing, secrets, simhash
from tidemark.llm.tables import read, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. Null texts, those without a letter, and narrow margins go; repeated rows and null ids stay."""
    model = language.fit(docs)
    return language.predict(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the smallest doc_id, of equal ids the text with the smallest hash, a null id only if it is alone.

    Rows are told apart by id and text, so an id with several texts loses none that has no near copy;
    repeated rows are copies. A null text counts as the empty one; null and blank texts are one class.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"), 256)
    rows = docs.select(*COLUMNS, key.alias("_key"))
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_key").alias("doc_id"), "text")
    kept = simhash.representatives(named, simhash.WIDE).select("doc_id._key")
    return rows.dropDuplicates(["_key"]).join(kept, "_key", "left_semi").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret masked and n_chars brought up to date. A null text becomes the empty one; repeated rows and null ids stay."""
    versions = docs.select(*COLUMNS).withColumn("text", F.coalesce("text", F.lit("")))
    ledger = secrets.scan(versions, secrets.new_ledger(spark))
    found = secrets.findings_by_path(versions.withColumn("whole", F.col("text")), ledger)
    masked = F.when(F.size("spans") > 0, secrets.redact(F.col("whole"), F.col("spans"))).otherwise(F.col("whole"))
    return found.withColumn("text", masked).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mix's order. A null source is one of its own; equal ids follow by text; repeated rows have places of their own."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents. A null text gives the end id alone; repeated rows give sequences of their own; null ids stay."""
    pieces = packing.default_pack(docs)
    return packing.digest(pieces, "ids").sortWithinPartitions("length", "sequence_id")


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_documents),
]
#: SQL can't express compression, SimHash and BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    return packing.write_buckets(stage(spark, docs, sf_dir), f"{folder}/{name}")
