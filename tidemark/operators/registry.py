"""Web source registry: URL classes, hosts, upserts, curation, search; states of jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Path patterns and the authority level that the first match gives.
AUTHORITY_PATHS = (
    (r"(?i)/billing[-_ ]manual", "payer_manual"),
    (r"(?i)/provider[-_ ]manual", "payer_manual"),
    (r"(?i)/pro[-_ ]?pe[-_ ]?manual", "payer_manual"),
    (r"(?i)/utilization[-_ ]management", "payer_policy"),
    (r"(?i)/payment[-_ ]polic", "payer_policy"),
    (r"(?i)/clinical[-_ ]polic", "payer_policy"),
    (r"(?i)/clinical[-_ ]payment", "payer_policy"),
    (r"(?i)/criteria/", "payer_policy"),
    (r"(?i)/preauth", "payer_policy"),
    (r"(?i)/coverage[-_ ]polic", "payer_policy"),
    (r"(?i)fee[-_ ]?schedule", "fee_schedule"),
    (r"(?i)/member[-_ ]handbook", "member_handbook"),
    (r"(?i)/members/", "member_handbook"),
    (r"(?i)/medicaid/recent_presentations", "training"),
)
# Payer and state of known hosts, first path segments that name a state, extensions of documents.
HOST_PAYERS = {
    "sunshinehealth.com": ("Sunshine Health", "FL"),
    "ahca.myflorida.com": ("AHCA", "FL"),
    "myflorida.com": ("AHCA", "FL"),
    "cms.gov": ("CMS", None),
    "medicare.gov": ("CMS", None),
    "medicaid.gov": ("CMS", None),
    "ambetterhealth.com": ("Ambetter", None),
    "cenpatico.com": ("Cenpatico", None),
    "wellcare.com": ("WellCare", None),
    "humana.com": ("Humana", None),
    "molinahealthcare.com": ("Molina Healthcare", None),
    "aetna.com": ("Aetna", None),
    "aetnabetterhealth.com": ("Aetna", "FL"),
    "simplyhealthcare.com": ("Simply Healthcare", "FL"),
    "clearhealthalliance.com": ("Clear Health Alliance", "FL"),
    "humanahealthyhorizons.com": ("Humana", "FL"),
    "uhc.com": ("United Healthcare", None),
    "uhccommunityplan.com": ("United Healthcare", None),
}
STATE_SEGMENTS = {"florida": "FL", "fl": "FL", "texas": "TX", "tx": "TX", "california": "CA", "ca": "CA", "georgia": "GA", "ga": "GA"}
DOCUMENT_EXTENSIONS = "pdf doc docx xls xlsx ppt pptx rtf txt".split()


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def parent_host(name: Column) -> Column:
    """The last two labels of a host with more than two."""
    labels = F.split(name, r"\.")
    return F.when(F.size(labels) > 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(name)


def url_class(url: Column, payers: dict[str, tuple[str | None, str | None]] = HOST_PAYERS) -> Column:
    """A struct of host, path, payer, state, authority, content_kind and extension of a URL."""
    h, p = host(url), path(url)
    bare = F.regexp_replace(h, r"^www\.|^www-es\.", "")
    known = F.create_map(*(F.lit(x) for k, v in payers.items() for x in (k, v[0])))
    home = {k: v[1] for k, v in payers.items() if v[1]}
    homes = F.create_map(*(F.lit(x) for kv in home.items() for x in kv)) if home else F.create_map().cast("map<string,string>")
    key = F.when(F.map_contains_key(known, bare), bare).otherwise(parent_host(bare))
    segment = F.lower(F.regexp_extract(p, "^/([^/]+)", 1))
    states = F.create_map(*(F.lit(x) for kv in STATE_SEGMENTS.items() for x in kv))
    authority = reduce(lambda acc, x: acc.when(p.rlike(x[0]), x[1]), AUTHORITY_PATHS[1:], F.when(p.rlike(AUTHORITY_PATHS[0][0]), AUTHORITY_PATHS[0][1]))
    extension = F.nullif(F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]{1,8})$", 1)), F.lit(""))
    kind = F.when(extension.isin(DOCUMENT_EXTENSIONS), "doc").otherwise("page")
    return F.struct(
        h.alias("host"), p.alias("path"), known[key].alias("payer"), F.coalesce(homes[key], states[segment]).alias("state"),
        authority.alias("authority"), kind.alias("content_kind"), extension.alias("extension"),
    )


def classify_urls(pages: DataFrame, payers: dict[str, tuple[str | None, str | None]] = HOST_PAYERS) -> DataFrame:
    """page_id and the URL's class."""
    return pages.select("page_id", url_class(F.coalesce("url", F.lit("")), payers).alias("c")).select("page_id", "c.*")


# What an asset is called in a file's name, with its authority level; the first match counts.
FILE_EXTENSION = r"(?i)\.(pdf|docx?|xlsx?)$"


def classify_files(files: DataFrame, payers: list[tuple[str, str]], assets: list[tuple[str, str, str]], states: list[tuple[str, str]], programs: list[tuple[str, str]]) -> DataFrame:
    """file_id, payer, asset_type, authority_level, state, program and confidence by the first pattern of each kind in a file's name.

    files: file_id, name, and context_payer, context_state, context_program, which stand where no pattern does.
    """
    bare = F.regexp_replace(F.regexp_replace("name", FILE_EXTENSION, ""), "[_-]", " ")
    first = lambda rules, at: reduce(lambda acc, x: acc.when(bare.rlike("(?i)" + x[0]), x[at]), rules[1:], F.when(bare.rlike("(?i)" + rules[0][0]), rules[0][at]))
    asset = first(assets, 1)
    return files.select(
        "file_id",
        F.coalesce(first(payers, 1), "context_payer").alias("payer"),
        asset.alias("asset_type"),
        first(assets, 2).alias("authority_level"),
        F.coalesce(first(states, 1), "context_state").alias("state"),
        F.coalesce(first(programs, 1), "context_program").alias("program"),
        F.when(asset.isNotNull(), "high").otherwise("none").alias("confidence"),
    )


def corpus_hosts(documents: DataFrame, registry: DataFrame, published: DataFrame) -> DataFrame:
    """host, docs and published of documents (doc_id, file_path, source_url): the host of the path if that is a URL, else of the source's URL, else of the registry's row that it was ingested from; most documents first."""
    web = lambda c: F.nullif(F.regexp_extract(c, "^https?://([^/]+)", 1), F.lit(""))
    own = registry.where("ingested_doc_id is not null").groupBy(F.col("ingested_doc_id").alias("doc_id")).agg(F.min("host").alias("_host"))
    named = documents.join(own, "doc_id", "left").select("doc_id", F.coalesce(web("file_path"), web("source_url"), "_host").alias("host"))
    flagged = named.join(published.select("doc_id", F.lit(1).alias("p")).distinct(), "doc_id", "left")
    by = flagged.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.count("p").alias("published"))
    return by.select(F.coalesce("host", F.lit("(no_host)")).alias("host"), "docs", "published")


def registry_stats(registry: DataFrame, most_hosts: int = 20) -> DataFrame:
    """dimension, value and n: rows by curation_status, content_kind, ingested, and the hosts with most."""
    of = lambda c: registry.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("dimension"), "value", "n")
    hosts = of("host").orderBy(F.desc("n"), "value").limit(most_hosts)
    return reduce(DataFrame.unionByName, (of("curation_status"), hosts, of("content_kind"), of("ingested")))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """For each key the first row in the order; DISTINCT ON."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n = 1").drop("n")


def upsert(registry: DataFrame, sightings: DataFrame, payers: dict[str, tuple[str | None, str | None]] = HOST_PAYERS) -> DataFrame:
    """The registry after sightings (url, at, status, content_hash, payer_hint, state_hint, authority_hint), merged by url.

    A URL seen first is classified, hints going before the class. Later sightings bring last_seen, last_status,
    attempts and content_hash up to date, and content_changed_at where a fetched body's hash is another than the last
    known. Columns of curation are never touched. registry: url, host, path, payer, state, authority, content_kind, extension,
    first_seen, last_seen, last_status, attempts, content_hash, content_changed_at, curation_status, curated_authority,
    topic_tags, ingested, ingested_doc_id.
    """
    hashed = F.struct("at", F.col("content_hash").alias("hash"))
    fetched = F.col("status").isNotNull()
    by = sightings.groupBy("url").agg(
        F.min("at").alias("_first"),
        F.max("at").alias("_last"),
        F.max_by("status", F.when(fetched, F.col("at"))).alias("_status"),
        F.count("status").alias("_fetches"),
        F.array_sort(F.collect_list(F.when(fetched & F.col("content_hash").isNotNull(), hashed))).alias("_bodies"),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}") for c in ("payer_hint", "state_hint", "authority_hint")),
    )
    both = registry.join(by, "url", "full").withColumn("_c", url_class(F.col("url"), payers))
    new = F.col("first_seen").isNull()
    # The body before each one: the registry's for the first.
    before = F.concat(F.array("content_hash"), F.transform("_bodies", lambda b: b["hash"]))
    moved = F.array_max(F.transform("_bodies", lambda b, i: F.when(~F.get(before, i).eqNullSafe(b["hash"]), b["at"])))
    both = both.withColumn("_moved", moved)
    said = lambda c, hint: F.when(new, F.coalesce(f"_{hint}", F.col("_c")[c])).otherwise(F.col(c)).alias(c)
    own = lambda c: F.when(new, F.col("_c")[c]).otherwise(F.col(c)).alias(c)
    last_body = F.when(F.size("_bodies") > 0, F.element_at("_bodies", -1)["hash"])
    return both.select(
        "url", own("host"), own("path"), said("payer", "payer_hint"), said("state", "state_hint"), said("authority", "authority_hint"), own("content_kind"), own("extension"),
        F.coalesce("first_seen", "_first").alias("first_seen"),
        F.greatest("last_seen", "_last").alias("last_seen"),
        F.coalesce("_status", "last_status").alias("last_status"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("_fetches", F.lit(0))).alias("attempts"),
        F.coalesce(last_body, "content_hash").alias("content_hash"),
        F.coalesce("_moved", "content_changed_at").alias("content_changed_at"),
        F.coalesce("curation_status", F.lit("auto")).alias("curation_status"), "curated_authority", "topic_tags", F.coalesce("ingested", F.lit(False)).alias("ingested"), "ingested_doc_id",
    )


CURATION = ("auto", "canonical", "noise", "stale", "needs_auth")


def curate(registry: DataFrame, edits: DataFrame) -> DataFrame:
    """registry after edits (url, curation_status, curated_authority, topic_tags), of which null leaves a field as it is; a blank authority takes the override away. One edit per url."""
    e = edits.select("url", *(F.col(c).alias(f"_{c}") for c in ("curation_status", "curated_authority", "topic_tags")))
    status = F.when(F.col("_curation_status").isNull() | F.col("_curation_status").isin(*CURATION), F.coalesce("_curation_status", "curation_status")).otherwise(F.raise_error("not a curation status").cast("string"))
    level = F.when(F.col("_curated_authority").isNull(), F.col("curated_authority")).otherwise(F.nullif("_curated_authority", F.lit("")))
    merged = registry.join(e, "url", "left")
    return merged.withColumns({"curation_status": status, "curated_authority": level, "topic_tags": F.coalesce("_topic_tags", "topic_tags")}).select(*registry.columns)


def mark_ingested(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """registry with ingested and ingested_doc_id set for the urls of documents (url, doc_id)."""
    own = documents.groupBy("url").agg(F.max("doc_id").alias("_doc"))
    return registry.join(own, "url", "left").withColumns({"ingested": F.col("ingested") | F.col("_doc").isNotNull(), "ingested_doc_id": F.coalesce("_doc", "ingested_doc_id")}).select(*registry.columns)


def reachable(status: Column) -> Column:
    return status.isNull() | status.between(200, 399)


def has_authority(level: str) -> Column:
    """Whether a row's authority is that level: the curated one before the inferred one."""
    return F.coalesce(F.col("curated_authority"), F.col("authority")) == level


def has_topic(topic: str) -> Column:
    return F.array_contains(F.coalesce("topic_tags", F.array().cast("array<string>")), topic)


def find_sources(registry: DataFrame, where: Column | None = None, text: str | None = None, most: int = 100) -> DataFrame:
    """The first rows in the registry's order, as `position`: with a text those whose URL has all its words, by how often; without one canonical ones; then ingested, last seen, url."""
    from tidemark.functions.text import tokens

    rows = registry if where is None else registry.where(where)
    if text and text.strip():
        asked = tokens(F.lit(text))
        own = tokens(F.col("url"))
        rows = rows.where(F.size(F.array_except(asked, own)) == 0).withColumn("_first", F.size(F.filter(own, lambda t: F.array_contains(asked, t))))
    else:
        rows = rows.withColumn("_first", (F.col("curation_status") == "canonical").cast("int"))
    order = [F.desc("_first"), F.desc("ingested"), F.desc("last_seen"), F.col("url")]
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("_first")


def payer_scope(rows: DataFrame, payer: str, also: list[str], state: str) -> DataFrame:
    """Rows of a payer, and of state authorities in the given state."""
    return rows.where((F.col("payer") == payer) | (F.col("payer").isin(also) & (F.col("state") == state)))


def published_rows(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Serving rows: chunk, metadata and its tags as an array of kind:code; blanks for what is missing."""
    own = tags.groupBy("doc_id", "paragraph_index").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "code"))), ",").alias("tags"))
    joined = chunks.join(own, ["doc_id", "paragraph_index"], "left")
    return joined.withColumns({"tags": F.coalesce("tags", F.lit("")), "content_sha": F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("paragraph_index").cast("string"), "text"), 256)})


def verify_published(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: rows expected, stored, missing and unexpected by content_sha, and rows without tags."""
    a = expected.groupBy("content_sha").agg(F.count(F.lit(1)).alias("a"))
    b = stored.groupBy("content_sha").agg(F.count(F.lit(1)).alias("b"), F.count_if(F.col("tags") == "").alias("untagged"))
    both = a.join(b, "content_sha", "full").fillna(0)
    return both.agg(
        F.sum("a").alias("expected"),
        F.sum("b").alias("stored"),
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("unexpected"),
        F.sum("untagged").alias("untagged"),
    )


def orphans(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Stored keys that are no longer current, and current ones not yet stored."""
    gone = stored.join(current, key, "left_anti").select(key, F.lit("orphan").alias("state"))
    new = current.join(stored, key, "left_anti").select(key, F.lit("missing").alias("state"))
    return gone.unionByName(new)


def _quiet(jobs: DataFrame, events: DataFrame, now: Column, started: int, silent: int) -> DataFrame:
    """Jobs at work (status processing) that started more than `started` minutes before now, and whose document has had no event for `silent` minutes."""
    ago = lambda m: now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m))
    alive = events.where(F.col("ts") > ago(silent)).select("doc_id").distinct()
    return jobs.where((F.col("status") == "processing") & (F.col("started_at") < ago(started))).join(alive, "doc_id", "left_anti")


def recover_stale(jobs: DataFrame, events: DataFrame, now: Column, minutes: int = 10, most_failures: int = 2) -> DataFrame:
    """The stuck jobs (job_id, doc_id, status, started_at, failure_count) as they become: pending again, or blocked from their third failure on."""
    silent = max(5, minutes // 2)
    count = F.coalesce("failure_count", F.lit(0))
    stuck = _quiet(jobs, events, now, minutes, silent)
    return stuck.select("job_id", "doc_id", F.when(count >= most_failures, "blocked").otherwise("pending").alias("status"), (count + 1).alias("failure_count"))


def finalise_zombies(jobs: DataFrame, events: DataFrame, work: DataFrame, now: Column, started: int = 30, silent: int = 10) -> DataFrame:
    """job_id, doc_id, and whether to embed, of jobs whose work (doc_id of lines or chunks) was written although they seem at work: these are complete."""
    stuck = _quiet(jobs, events, now, started, silent)
    return stuck.join(work.select("doc_id").distinct(), "doc_id", "left_semi").select("job_id", "doc_id", F.lit("completed").alias("status"), (~F.coalesce("skip_embedding", F.lit(False))).alias("embed"))


def fail_stale(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """jobs with those at work for longer failed."""
    old = (F.col("status") == "processing") & (F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return jobs.withColumns({"error": F.when(old, "stuck").otherwise(F.lit(None).cast("string")), "status": F.when(old, "failed").otherwise(F.col("status"))})
