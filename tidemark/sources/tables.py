"""Reading the engine's tables, with the roles that the test tables have in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(events: DataFrame) -> DataFrame:
    """events as the decision log: caller, strategy, total_ms and, from props, k."""
    s = F.col("event_type")
    strategy = F.when(s == "view", "a").when(s == "click", "b").when(s == "signup", "c").when(s == "purchase", "d").otherwise("natural")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        strategy.alias("strategy"),
        F.round(F.col("value") * 100, 0).alias("total_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def cells(events: DataFrame) -> DataFrame:
    """The log as evaluation cells, one per call."""
    t = telemetry(events)
    k = F.col("k")
    return t.select(
        "event_id",
        F.col("user_id").alias("query_id"),
        "strategy",
        (k % 100 / 100.0).alias("recall"),
        ((k * 7) % 100 / 100.0).alias("precision"),
        (k % 5 != 0).alias("answered"),
        F.when(k % 7 == 0, 1).otherwise(0).cast("long").alias("contradicted"),
        F.col("total_ms").alias("latency_ms"),
        F.when(k % 4 == 0, "correct").when(k % 4 == 1, "partial").when(k % 4 == 2, "wrong").otherwise("unable_to_verify").alias("verdict"),
        F.when(k % 11 == 0, "correct").when(k % 13 == 0, "wrong").alias("human_verdict"),
        ((k * 3) % 100 / 100.0).alias("confidence"),
        F.when(k % 3 == 0, "factual").when(k % 3 == 1, "conceptual").otherwise("vague").alias("query_class"),
        F.to_date("ts").alias("day"),
        k.alias("k"),
    )


def metadata(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, name, payer, state, program and authority_level of documents."""
    level = F.when(F.col("quality") == 1, "contract_source_of_truth").when(F.col("quality") == 0, "payer_policy").otherwise("unknown")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat("source", F.lit("_"), "lang", F.lit("-"), F.col("doc_id").cast("string")).alias("name"),
        F.col("source").alias("payer"),
        F.upper("lang").alias("state"),
        F.when(F.col("toxic") == 1, "Medicaid").otherwise("Commercial").alias("program"),
        level.alias("authority_level"),
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_pages_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_phrase_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """tag and phrases of a precision report in CSV, kept verdicts only."""
    rows = spark.read.csv(path, header=True, schema="tag string, phrase string, precision double, verdict string")
    return rows.where(F.col("verdict").isin("KEEP", "KEEP_CANONICAL")).groupBy("tag").agg(F.array_sort(F.collect_set("phrase")).alias("phrases"))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows of a log: telemetry, decisions, errors."""
    rows.write.mode("append").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
