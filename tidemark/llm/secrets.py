"""Operator 1: secret scans over an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its content. The ledger is a stored table with a
row for each (blob, rule_version) that was ever scanned, also for those without findings. `scan` takes
one row of each content, leaves out what the ledger has under the same rule version, looks for
secrets in the rest only, and appends what it found; `findings_by_path` joins the ledger's findings back
to all paths and versions. All of it is DataFrame functions.

The ledger keeps the text of a blob with secrets, so that its redacted form can be made without reading
the versions again. op1 scans two versions of each path, the document and, where that has secrets, the
redacted document: of the second only blobs that the ledger doesn't know are scanned.

A match's place comes from splitting the text at the rule's matches: the pieces between them and the
matches themselves alternate, so running sums of their lengths are the offsets (code points).

Copies: one content may have a third of all rows. Copies are reduced to one per map task before the
shuffle, and the ledger is a written table, so that the join back is one that Spark splits where a
blob is frequent. Only blobs with findings take part in it.

Cases: a null text is the empty blob. Repeated rows each get the findings. Empty tables give empty
results. A null id stays. Other columns don't matter, whatever their names. Very long texts take time
near linear in their length and matches.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import let, maxima_before, sums_before
from tidemark.llm.tables import read, shared_folder, whole_texts, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` of which group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


# The rules to apply, in the order of their kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a maximal run, so the bound can stand in the pattern
)
#: Goes up with each change of RULES; blobs are scanned again under a new version.
RULE_VERSION = 1

SPAN = "struct<start:int,rank:int,end:int,kind:string>"
LEDGER = f"blob string, rule_version int, spans array<{SPAN}>, text string"


def blob_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in a text, by start."""
    sizes = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), lambda m: F.length(m).cast("long"))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("long"))
    zipped = lambda g, m: F.arrays_zip(g.alias("gap"), sums_before(g).alias("gaps"), m.alias("size"), sums_before(m).alias("sizes"), sizes(rule.group).alias("counted"))
    places = let(gaps, lambda g: let(sizes(0), lambda m: zipped(g, m)))
    span = lambda p: F.struct(
        (p["gaps"] + p["gap"] + p["sizes"]).cast("int").alias("start"),
        F.lit(rank).alias("rank"),
        (p["gaps"] + p["gap"] + p["sizes"] + p["size"]).cast("int").alias("end"),
        F.lit(rule.kind).alias("kind"),
    )
    # The last piece has no match behind it: its sizes are null.
    found = F.transform(F.filter(places, lambda p: p["counted"] >= rule.least), span)
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules' spans in a text: array of (start, rank, end, kind) by start, then in the rules' order."""
    return F.array_sort(F.concat(*(_spans(text, r, i) for i, r in enumerate(rules))))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger (blob, rule_version, spans, text where there are spans) once the versions (column `text`) are in it.

    ledger: its folder, made if it isn't there; only blobs that it doesn't have under rule_version are scanned and appended.
    """
    spark = versions.sparkSession
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"])
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(ledger)
    known = spark.read.parquet(ledger).where(F.col("rule_version") == rule_version)
    blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    found = blobs.select("blob", F.lit(rule_version).alias("rule_version"), secret_spans(F.col("text"), rules).alias("spans"), "text")
    found = found.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))
    found.write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger)


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"


def findings_by_path(versions: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION, more: DataFrame | None = None) -> DataFrame:
    """The versions' columns, without the text, and `blob` and `spans` (empty where nothing was found), in place of columns of these names.

    more: further columns by blob with findings.
    """
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    if more is not None:
        found = found.join(more, "blob", "left")
    paths = versions.drop("spans").withColumn("blob", blob_id(F.col("text"))).drop("text")
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each span replaced by the mask; spans that overlap share one."""
    ends = F.transform(spans, lambda s: s["end"].cast("long"))
    tail = F.substring(text, F.coalesce(F.array_max(ends), F.lit(0)).cast("int") + 1, F.length(text))

    def joined(reach: Column) -> Column:  # where the spans before each one end
        at = lambda i: F.get(reach, i).cast("int")
        kept = F.transform(spans, lambda s, i: F.when(s["start"] >= at(i), F.concat(F.substring(text, at(i) + 1, s["start"] - at(i)), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(kept, ""), tail)

    return let(maxima_before(ends), joined)


def redacted_versions(ledger: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """was (a blob with secrets) and text, its redacted form."""
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    return found.select(F.col("blob").alias("was"), redact(F.col("text"), F.col("spans")).alias("text"))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: blob, and n_left, the spans still found in the path's next, redacted version."""
    versions, ledger = whole_texts(read(spark, sf_dir, "documents")), new_ledger(spark)
    first = scan(versions, ledger)
    changed = written(redacted_versions(first))
    left = findings_by_path(changed, scan(changed, ledger)).select(F.col("was").alias("blob"), F.size("spans").cast("long").alias("n_left"))
    found = findings_by_path(versions, first, more=left)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(r.kind) for r in RULES), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"), "blob", F.coalesce("n_left", F.lit(0).cast("long")).alias("n_left"))
