"""Registered queries of the evaluation algebra, routing and job state, and their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tidemark.operators import evaluation, ranking, registry, routing
from tidemark.plans.oracle import C, T
from tidemark.sources.store import shared_folder
from tidemark.sources.tables import cells, read, telemetry
from tidemark.streaming import heartbeats, jobs


def _round(df, *but):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes))


def _cells(spark, d):
    return cells(read(spark, d, "events"))


def calibration_summary(spark, d):
    return _round(evaluation.calibration_summary(_cells(spark, d)))


def oracle_summary(spark, d):
    return _round(evaluation.oracle_summary(_cells(spark, d)))


def verdict_rollup(spark, d):
    return _round(evaluation.verdict_rollup(_cells(spark, d), "strategy"))


def score_statistics(spark, d):
    return _round(evaluation.score_statistics(_cells(spark, d)))


def routing_stats(spark, d):
    return _round(evaluation.routing_stats(telemetry(read(spark, d, "events"))))


def class_pivot(spark, d):
    return evaluation.class_pivot(_cells(spark, d))


def prior_cells(spark, d):
    return _round(evaluation.prior_cells(_cells(spark, d)))


def _scored(spark, d):
    return _cells(spark, d).withColumn("score", F.col("recall"))


def confusion(spark, d):
    return _round(evaluation.confusion(_scored(spark, d)))


def pr_curve(spark, d):
    k = F.col("k")
    expected = F.when(k % 5 == 0, "a").when(k % 5 == 1, "b").when(k % 5 == 2, "d").when(k % 5 == 3, "e")
    rows = _cells(spark, d).select("query_id", "strategy", F.coalesce("human_verdict", "verdict").alias("v"), F.when(k % 10 != 9, F.col("confidence")).alias("confidence"), (k % 6).alias("n_chunks"), expected.alias("expected"))
    return _round(evaluation.pr_curve(rows))


def drift_band(spark, d):
    runs = _cells(spark, d).groupBy("day").agg(F.avg("recall").alias("metric"), F.count(F.lit(1)).alias("n"))
    runs = runs.select(F.concat(F.lit("f"), (F.dayofmonth("day") % 3).cast("string")).alias("fingerprint"), F.round("metric", 6).alias("metric"), F.col("day").alias("at"))
    return _round(evaluation.drift_band(runs))


def _run(spark, d, parity):
    return _cells(spark, d).where(F.dayofmonth("day") % 2 == parity).groupBy("query_id").agg(F.avg("recall").alias("recall"))


def ab_movers(spark, d):
    return _round(evaluation.movers(_run(spark, d, 0), _run(spark, d, 1), "query_id", "recall", changed_only=True))


def compared_runs(spark, d):
    """The even and the odd days as two runs, with fingerprints made of what their cells hold."""
    k = F.col("k")

    def run(parity):
        one = _cells(spark, d).where(F.dayofmonth("day") % 2 == parity)
        none = [F.lit("same").alias(c) for c in evaluation.FINGERPRINT[2:]]
        return one.agg(F.concat(F.min("strategy"), F.max(k % 3).cast("string")).alias("priors_version"), F.max("k").cast("string").alias("lexicon_revision"), (F.count_distinct(k % 2) == 1).alias("stable")).select("*", *none)

    return evaluation.compare_runs(run(0), run(1))


def metric_lift(spark, d):
    means = [_cells(spark, d).where(F.dayofmonth("day") % 2 == p).groupBy(F.col("strategy").alias("metric")).agg(F.avg("recall").alias("value")) for p in (0, 1)]
    return _round(evaluation.lift(*means))


def confusion_slices(spark, d):
    return _round(evaluation.confusion(_scored(spark, d), ("strategy", "query_class")))


def disagreements(spark, d):
    return evaluation.disagreements(_scored(spark, d))


def prod_rollup(spark, d):
    k = F.col("k")
    at = read(spark, d, "events").select("event_id", "ts")
    claim = lambda bad: F.struct(F.when(bad, "contradicted").otherwise("supported").alias("status"))
    rows = _cells(spark, d).join(at, "event_id").select("strategy", "ts", (k % 3 != 0).alias("is_prod"), F.when(k % 8 != 7, F.col("recall")).alias("grade"), F.array(claim(k % 7 == 0), claim(k % 9 == 0)).alias("ledger"))
    return evaluation.prod_rollup(rows, 200)


def build_stability(spark, d):
    version = F.when(F.dayofmonth("day") % 3 == 0, F.concat(F.lit("v"), (F.col("k") % 3).cast("string"))).otherwise("v0")
    found = evaluation.build_stability(_cells(spark, d).select(F.col("day").cast("string").alias("run_id"), version.alias("version")))
    return found.withColumn("versions", F.array_join("versions", ","))


def pooled_priors(spark, d):
    return _round(evaluation.pooled_priors(_scored(spark, d))[1])


def cell_priors(spark, d):
    return _round(evaluation.pooled_priors(_scored(spark, d))[0])


def finalised_runs(spark, d):
    k = F.col("k")
    rows = _cells(spark, d).select(
        F.col("day").cast("string").alias("run_id"), F.when(F.col("verdict") == "unable_to_verify", "unable").otherwise(F.col("verdict")).alias("verdict"), F.when(k % 3 < 2, k % 3 == 0).alias("routing_correct"),
        F.when(k % 5 < 4, k % 5 < 2).alias("citation_hit"), F.when(k % 20 != 0, F.col("latency_ms")).alias("total_ms"),
    )
    return _round(evaluation.finalise(rows))


def deterministic_checks(spark, d):
    i = F.col("doc_id")
    rows = read(spark, d, "documents").select(
        i.alias("result_id"), F.when(i % 4 == 0, "a").when(i % 4 == 1, "B").when(i % 4 == 2, "e").alias("expected_strategy"), F.when(i % 3 == 0, "a").when(i % 3 == 1, "e").otherwise("b").alias("strategy_used"),
        F.when(i % 8 == 2, "phi").alias("expected_refusal"), F.when(i % 5 == 0, "phi").when(i % 5 == 1, "other").alias("refusal"), F.when(i % 2 == 0, F.array(F.lit("SRC1"))).alias("must_cite"),
        F.when(i % 6 == 0, F.array(F.lit("/FR/"))).alias("must_cite_url"), F.array("source").alias("names"), F.array(F.concat(F.lit("http://x/"), "lang", F.lit("/1"))).alias("urls"),
    )
    found = evaluation.deterministic_checks(rows)
    return found.select("result_id", *(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in found.columns[1:]))


def assembly_ratios(spark, d):
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    level = F.when(F.col("quality") == 1, "contract_source_of_truth").when(F.col("quality") == 0, "payer_policy").otherwise("unknown")
    return ranking.assembly_ratios(docs.select(F.col("source").alias("query_id"), level.alias("authority_level")))


def latency_quantiles(spark, d):
    return evaluation.exact_rank(_cells(spark, d), ["strategy", "query_class"], "latency_ms", 0.9, "p90_ms")


def rubric_scores(spark, d):
    k = telemetry(read(spark, d, "events")).select("event_id", "k")
    score, band = evaluation.rubric(F.col("k") % 6, F.col("k") % 4, F.col("k") % 3, (F.col("k") % 17 == 0).cast("int"))
    return k.select("event_id", F.round(score, 6).alias("score"), band.alias("band"))


def _jobs(spark, d):
    """A job for each document, started so many minutes ago as its id says; two of three are at work."""
    now = read(spark, d, "events").agg(F.max("ts")).scalar()
    i = F.col("doc_id")
    started = now - F.make_dt_interval(F.lit(0), F.lit(0), (i % 60).cast("int"))
    return now, read(spark, d, "documents").select(i.alias("job_id"), "doc_id", F.when(i % 3 != 0, "processing").otherwise("pending").alias("status"), started.alias("started_at"), (i % 4).alias("failure_count"), (i % 5 == 0).alias("skip_embedding"))


def _heartbeats(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("doc_id"), "ts")


def stale_jobs(spark, d):
    now, jobs = _jobs(spark, d)
    return registry.recover_stale(jobs, _heartbeats(spark, d), now)


def finalised_zombies(spark, d):
    now, jobs = _jobs(spark, d)
    return registry.finalise_zombies(jobs, _heartbeats(spark, d), read(spark, d, "labels").select("doc_id"), now)


def failed_jobs(spark, d):
    now, jobs = _jobs(spark, d)
    return registry.fail_stale(jobs, now).select("job_id", "status", F.coalesce("error", F.lit("-")).alias("error"))


def _profiles(spark, d):
    k = F.col("k")
    return telemetry(read(spark, d, "events")).select(
        F.col("event_id").alias("query_id"),
        (k * 13 % 1200).alias("pool_size"),
        (k % 3 == 0).alias("has_literal"),
        (k % 2 == 0).alias("has_payor"),
        (k % 5 == 0).alias("inherited"),
        (k % 7 == 0).alias("thematic"),
        (k % 10 / 10.0).alias("crawlability"),
        (k % 4).alias("n_domain_tags"),
        "k",
    )


def _linear_scores(spark, d, second=False):
    return routing.linear_scores(routing.linear_features(_profiles(spark, d)), second).withColumn("score", F.round("score", 6))


def linear_router(spark, d):
    return _round(routing.decide(_linear_scores(spark, d))).withColumn("invoke_all", F.col("invoke_all").cast("string"))


def second_router(spark, d):
    """The second router where some strategies were tried, some expect nothing, and some queries are refused."""
    k, every = F.col("k"), F.array(*map(F.lit, "abcd"))
    asked = _profiles(spark, d)
    tried = asked.where("k % 6 in (0, 3)").select("query_id", F.explode(F.when(k % 6 == 0, F.array(F.lit("a"))).otherwise(every)).alias("strategy"))
    hopeless = asked.where("k % 4 = 1").select("query_id", F.lit("d").alias("strategy"), F.lit(0.04).alias("est_recall"))
    found = routing.decide(_linear_scores(spark, d, second=True), tried, hopeless, asked.where("k % 25 = 0"))
    return _round(found).withColumn("invoke_all", F.col("invoke_all").cast("string"))


def forced_strategies(spark, d):
    forced = _profiles(spark, d).select("query_id", F.when(F.col("k") % 2 == 0, "b").otherwise("d").alias("strategy"))
    found = routing.override(_linear_scores(spark, d), forced)
    told = F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return found.withColumn("scores", F.array_join(told, ","))


def registry_stream(spark, d):
    """Last event and errors of each user, kept up by a stream over the event files."""
    return jobs.latest_by_user(spark, d)


def _job_events(events: DataFrame) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "signup", "claim").when(t == "purchase", "done").when(t == "error", "error").otherwise("beat")
    return events.select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("kind"))


#: Minutes after which a claimed job is taken from a worker that has been silent.
JOB_TIMEOUT, JOB_SILENT = 1440, 720


def job_transitions(spark, d):
    """Changes of all jobs' statuses as known at the last event."""
    events = read(spark, d, "events")
    return heartbeats.transitions(_job_events(events), events.agg(F.max("ts")).scalar(), JOB_TIMEOUT, JOB_SILENT)


def job_transitions_stream(spark, d):
    """The same by a stream with timers, as known at its watermark, a day before the last event."""
    return heartbeats.follow(_job_events(jobs.events(spark, d)), f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}", JOB_TIMEOUT, JOB_SILENT, "1 day")


def windowed_stream(spark, d):
    """Events and values by six-hour window and type, by a stream with a watermark."""
    return _round(jobs.windowed_counts(spark, d))


QUERIES = {f.__name__: f for f in (
    calibration_summary, oracle_summary, verdict_rollup, score_statistics, routing_stats, class_pivot, prior_cells, confusion, confusion_slices, disagreements, pr_curve,
    drift_band, ab_movers, compared_runs, metric_lift, prod_rollup, build_stability, pooled_priors, cell_priors, finalised_runs, deterministic_checks, assembly_ratios,
    latency_quantiles, rubric_scores, stale_jobs, finalised_zombies, failed_jobs, linear_router, second_router, forced_strategies, registry_stream, windowed_stream, job_transitions, job_transitions_stream,
)}

def _p(p: float, by: str, name: str) -> str:
    order = f"row_number() OVER (PARTITION BY {by} ORDER BY latency_ms)"
    return f"(SELECT {by}, latency_ms AS {name} FROM (SELECT {by}, latency_ms, {order} AS i, count(*) OVER (PARTITION BY {by}) AS n FROM cells) WHERE i = least(n - 1, floor({p} * n)::BIGINT) + 1)"


# The routers' weights: base, then a term for each feature; d's penalties for depth and inheritance shrink with crawlability in the first.
_LINEAR = {
    "a": "0.40 + 0.30 * exclusivity + 0.25 * literal + 0.20 * corpus_depth - 0.10 * thematic_policy - 0.15 * wide_pool + 0.05 * inheritance",
    "b": "0.20 + 0.40 * thematic_policy + 0.20 * corpus_depth - 0.20 * literal + 0.05 * exclusivity",
    "c": "0.05",
    "d": "0.20 + 0.40 * crawlability + 0.25 * wide_pool - 0.25 * (1 - crawlability) * inheritance - 0.20 * thematic_policy - 0.15 * (1 - crawlability) * corpus_depth - 0.05 * literal",
}
_LINEAR_2 = {
    "a": "0.40 + 0.30 * exclusivity + 0.25 * literal + 0.05 * corpus_depth * exclusivity + 0.15 * tag_coverage - 0.10 * thematic_policy - 0.15 * wide_pool",
    "b": _LINEAR["b"],
    "c": "0.05",
    "d": "0.20 + 0.40 * crawlability + 0.25 * wide_pool - 0.25 * inheritance - 0.20 * thematic_policy - 0.15 * corpus_depth - 0.05 * literal",
}


def _linear(weights: dict[str, str]) -> str:
    double = lambda x: re.sub(r"\b[0-9]\.[0-9]+\b", lambda m: m[0] + "::DOUBLE", x)
    return " UNION ALL ".join(f"SELECT query_id, '{s}' AS strategy, round({double(x)}, 6) AS score FROM f" for s, x in weights.items())


_FEATURES = """p AS (SELECT event_id AS query_id, k, greatest(1, k * 13 % 1200) AS size FROM t),
f AS (SELECT query_id, least(1, 50.0::DOUBLE / size) AS exclusivity, (k % 3 = 0)::INT AS literal, (k % 2 = 0 AND (size >= 20 OR k % 5 = 0))::INT AS corpus_depth, (k % 7 = 0)::INT AS thematic_policy,
  (size > 500)::INT AS wide_pool, (k % 5 = 0)::INT AS inheritance, k % 10 / 10.0::DOUBLE AS crawlability, CASE WHEN least(1, 50.0::DOUBLE / size) >= 0.2::DOUBLE THEN least(1, (k % 4) / 3.0::DOUBLE) ELSE 0 END AS tag_coverage FROM p)"""
_V = "coalesce(human_verdict, verdict)"
_STATES = f"""sc AS (SELECT *, recall AS score FROM cells), an AS (SELECT query_id, max(score) >= 0.7::DOUBLE AS answerable FROM sc GROUP BY 1),
st AS (SELECT sc.*, answerable, CASE verdict WHEN 'correct' THEN 'TP' WHEN 'partial' THEN CASE WHEN score >= 0.7::DOUBLE THEN 'TP' ELSE 'WP' END WHEN 'wrong' THEN 'FP' ELSE CASE WHEN score = 0 THEN 'MISS' WHEN answerable THEN 'FN' ELSE 'TN' END END AS state FROM sc JOIN an USING (query_id))"""


def _confusion(by: str) -> str:
    return f"""WITH {C}, {_STATES}, c AS (SELECT {by}, count(*) AS n, coalesce(sum(score) FILTER (state IN ('TP', 'WP')), 0) AS credit, {", ".join(f"count(*) FILTER (state = '{x.upper()}') AS {x}" for x in ("tp", "wp", "fp", "tn", "fn", "miss"))},
      count(*) FILTER (answerable) AS n_answerable FROM st GROUP BY ALL), r AS (SELECT *, credit / nullif(credit + fp, 0) AS precision, credit / nullif(credit + fn + miss, 0) AS recall FROM c)
      SELECT {by}, n, round(credit, 6) AS credit, tp, wp, fp, tn, fn, miss, n_answerable, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1,
        round(credit - 2 * fp + 0.5::DOUBLE * tn - fn, 6) AS utility, round(tn / nullif(n - n_answerable, 0), 6) AS honest_abstain, round(fn / nullif(n_answerable, 0), 6) AS over_abstain FROM r"""


_TRANSITIONS = """WITH lim AS (SELECT {} AS until FROM events),
e AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'beat' END AS kind, until FROM events, lim WHERE ts <= until AND user_id IS NOT NULL),
r AS (SELECT *, count(*) FILTER (kind = 'claim') OVER w AS run, coalesce(lead(ts) OVER w, until) AS nxt, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
d AS (SELECT *, greatest(min(ts) FILTER (kind = 'claim') OVER (PARTITION BY job_id, run) + INTERVAL 24 HOUR, ts + INTERVAL 12 HOUR) AS deadline FROM r WHERE run > 0),
s AS (SELECT job_id, run, arg_min(CASE WHEN kind IN ('done', 'error') THEN ts ELSE deadline END, i) AS "at", arg_min(kind, i) = 'done' AS done FROM d WHERE kind IN ('done', 'error') OR nxt > deadline GROUP BY 1, 2),
m AS (SELECT job_id, run, ts AS "at", 0 AS closing, 0 AS fails, 'processing' AS status FROM d WHERE kind = 'claim' UNION ALL SELECT job_id, run, "at", 1, CASE WHEN done THEN 0 ELSE 1 END, CASE WHEN done THEN 'completed' END FROM s),
f AS (SELECT *, sum(fails) OVER (PARTITION BY job_id ORDER BY run, closing) AS failures FROM m)
SELECT job_id, "at", coalesce(status, CASE WHEN failures >= 3 THEN 'blocked' ELSE 'pending' END) AS status, failures::INTEGER AS failures FROM f WHERE failures - fails < 3"""

SQL = {
    "verdict_rollup": f"""WITH {C}, v AS (SELECT *, coalesce(human_verdict, verdict) AS v FROM cells),
      c AS (SELECT strategy, count(*) AS n, count(*) FILTER (v = 'correct') AS correct, count(*) FILTER (v = 'partial') AS partial, count(*) FILTER (v = 'wrong') AS wrong, count(*) FILTER (v = 'unable_to_verify') AS abstain FROM v GROUP BY 1)
      SELECT *, round(correct / nullif(correct + partial + wrong, 0), 6) AS rate FROM c""",
    "confusion": _confusion("strategy"),
    "confusion_slices": _confusion("strategy, query_class"),
    "disagreements": f"""WITH {C}, {_STATES}, d AS (SELECT query_id, string_agg(DISTINCT strategy, ',' ORDER BY strategy) FILTER (state = 'TP') AS right, string_agg(DISTINCT strategy, ',' ORDER BY strategy) FILTER (state = 'FP') AS wrong FROM st GROUP BY 1)
      SELECT query_id, "right", wrong FROM d WHERE "right" IS NOT NULL AND wrong IS NOT NULL""",
    "pr_curve": f"""WITH {C}, v AS (SELECT query_id, strategy, {_V} AS v, CASE WHEN k % 10 = 9 THEN NULL ELSE confidence END AS confidence, k % 6 AS n_chunks, CASE k % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'd' WHEN 3 THEN 'e' END AS expected FROM cells),
      o AS (SELECT query_id, arg_min({{'v': v, 'c': confidence, 'n': n_chunks}}, {{'s': strategy, 'v': v, 'c': coalesce(confidence, -1), 'n': n_chunks}}) AS r FROM v WHERE expected = strategy OR expected = 'e' GROUP BY 1),
      b AS (SELECT query_id, arg_max({{'v': v, 'c': confidence, 'n': n_chunks}}, {{'k': CASE v WHEN 'correct' THEN 3 WHEN 'partial' THEN 2 WHEN 'unable_to_verify' THEN 1 ELSE 0 END, 'c': coalesce(confidence, 0), 'v': v, 'n': n_chunks}}) AS r FROM v GROUP BY 1),
      e AS (SELECT strategy, v, confidence AS c, n_chunks AS n FROM v UNION ALL SELECT 'system_oracle', r.v, r.c, r.n FROM o UNION ALL SELECT 'system_best', r.v, r.c, r.n FROM b),
      g AS (SELECT unnest(range(21)) AS i), x AS (SELECT strategy, i, count(*) AS n_total, count(*) FILTER (hit) AS n_answered, count(*) FILTER (hit AND v = 'correct') AS c, count(*) FILTER (hit AND v = 'partial') AS p, count(*) FILTER (hit AND v = 'wrong') AS w
        FROM (SELECT *, coalesce(c, 0) + 1e-9 / 20 >= i / 20.0::DOUBLE AND NOT (n = 0 AND v = 'unable_to_verify') AS hit FROM e, g) GROUP BY 1, 2)
      SELECT strategy, round(i / 20.0::DOUBLE, 6) AS tau, n_answered, n_total, round((c + 0.5::DOUBLE * p) / nullif(c + p + w, 0), 4) AS precision, round((c + 0.5::DOUBLE * p) / nullif(n_total, 0), 4) AS recall FROM x""",
    "ab_movers": f"""WITH {C}, a AS (SELECT query_id, avg(recall) AS a FROM cells WHERE dayofmonth(day) % 2 = 0 GROUP BY 1), b AS (SELECT query_id, avg(recall) AS b FROM cells WHERE dayofmonth(day) % 2 = 1 GROUP BY 1)
      SELECT query_id, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM a JOIN b USING (query_id) WHERE abs(b - a) > 1e-9""",
    "compared_runs": f"""WITH {C}, r AS (SELECT dayofmonth(day) % 2 AS h, min(strategy) || max(k % 3)::VARCHAR AS x, max(k) AS m, count(DISTINCT k % 2) AS b FROM cells GROUP BY 1),
      w AS (SELECT a.x <> b.x AS p, a.m <> b.m AS l, a.b = 1 AND b.b = 1 AS stable FROM r a, r b WHERE a.h = 0 AND b.h = 1)
      SELECT array_to_string(list_filter(list_value(CASE WHEN p THEN 'priors_version' END, CASE WHEN l THEN 'lexicon_revision' END), lambda z: z IS NOT NULL), ',') AS changed, (p::INT + l::INT)::BIGINT AS n_changed, stable, p::INT + l::INT > 1 OR NOT stable AS confounded FROM w""",
    "metric_lift": f"""WITH {C}, a AS (SELECT strategy AS metric, avg(recall) AS v FROM cells WHERE dayofmonth(day) % 2 = 0 GROUP BY 1), b AS (SELECT strategy AS metric, avg(recall) AS v FROM cells WHERE dayofmonth(day) % 2 = 1 GROUP BY 1)
      SELECT metric, round(b.v - a.v, 6) AS lift FROM a JOIN b USING (metric)""",
    "prod_rollup": f"""WITH {C} SELECT strategy, count(*) AS n, round(avg(recall), 3) AS grade_mean, round(stddev_samp(recall), 3) AS grade_std, count(*) FILTER (k % 7 = 0 OR k % 9 = 0) AS n_contradicted FROM cells JOIN (SELECT event_id, ts FROM t) USING (event_id)
      WHERE k % 3 <> 0 AND k % 8 <> 7 AND ts >= (SELECT max(ts) FROM t) - INTERVAL 200 HOUR GROUP BY 1""",
    "build_stability": f"""WITH {C}, v AS (SELECT day, CASE WHEN dayofmonth(day) % 3 = 0 THEN 'v' || (k % 3)::VARCHAR ELSE 'v0' END AS v FROM cells) SELECT day::VARCHAR AS run_id, count(DISTINCT v) AS n_versions, string_agg(DISTINCT v, ',' ORDER BY v) AS versions, count(DISTINCT v) <= 1 AS stable FROM v GROUP BY 1""",
    "pooled_priors": f"WITH {C} SELECT query_class, strategy, count(*) AS n, round(avg(recall), 6) AS mean, round(coalesce(stddev_samp(recall), 0), 6) AS std FROM cells GROUP BY ALL",
    "cell_priors": f"WITH {C} SELECT query_id, strategy, count(*) AS n, round(avg(recall), 6) AS mean, round(coalesce(stddev_samp(recall), 0), 6) AS std FROM cells GROUP BY ALL",
    "finalised_runs": f"""WITH {C}, r AS (SELECT day::VARCHAR AS run_id, CASE verdict WHEN 'unable_to_verify' THEN 'unable' ELSE verdict END AS v, CASE WHEN k % 3 < 2 THEN k % 3 = 0 END AS rc, CASE WHEN k % 5 < 4 THEN k % 5 < 2 END AS ch, coalesce(CASE WHEN k % 20 = 0 THEN NULL ELSE latency_ms END, 0) AS ms FROM cells),
      i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ms) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM r)
      SELECT run_id, count(*) AS n_queries, count(*) FILTER (v = 'correct') AS n_correct, count(*) FILTER (v = 'partial') AS n_partial, count(*) FILTER (v = 'wrong') AS n_wrong, count(*) FILTER (v = 'unable') AS n_unable,
        round(avg(rc::INT), 6) AS routing_correct_rate, round(avg(ch::INT), 6) AS citation_hit_rate, floor(median(ms))::BIGINT AS median_ms, floor(max(ms) FILTER (i = least(n - 1, floor(0.95 * n)::BIGINT) + 1))::BIGINT AS p95_ms FROM i GROUP BY 1""",
    "deterministic_checks": """WITH d AS (SELECT doc_id, source, lang FROM documents), c AS (SELECT doc_id AS result_id, CASE WHEN doc_id % 4 < 3 THEN CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'e' END = CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 THEN 'e' ELSE 'b' END END AS routing_correct,
      CASE WHEN doc_id % 2 = 0 THEN contains(source, 'src1') OR (lang = 'fr' AND doc_id % 6 = 0) END AS citation_hit, CASE WHEN doc_id % 4 = 2 THEN CASE WHEN doc_id % 8 = 2 THEN doc_id % 5 = 0 ELSE doc_id % 5 < 2 END END AS fail_fast_correct FROM d)
      SELECT result_id, coalesce(routing_correct::VARCHAR, '-') AS routing_correct, coalesce(citation_hit::VARCHAR, '-') AS citation_hit, coalesce(fail_fast_correct::VARCHAR, '-') AS fail_fast_correct FROM c""",
    "assembly_ratios": f"""WITH r AS (SELECT source AS query_id, CASE WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 3 END AS t FROM documents LEFT JOIN labels USING (doc_id)),
      c AS (SELECT query_id, count(*) AS n, count(*) FILTER (t = 0) AS contract, count(*) FILTER (t = 1) AS policy, count(*) FILTER (t = 2) AS fyi, count(*) FILTER (t = 3) AS untagged FROM r GROUP BY 1)
      SELECT *, round((contract + policy) / n, 3) AS canonical_ratio, round(contract / n, 3) AS strict_ratio FROM c""",
    "stale_jobs": """WITH j AS (SELECT doc_id AS job_id, doc_id, doc_id % 4 AS f, doc_id % 3 <> 0 AS working, (SELECT max(ts) FROM events) - to_minutes(doc_id % 60) AS s FROM documents), e AS (SELECT user_id AS doc_id, max(ts) AS last FROM events GROUP BY 1)
      SELECT job_id, doc_id, CASE WHEN f >= 2 THEN 'blocked' ELSE 'pending' END AS status, f + 1 AS failure_count FROM j LEFT JOIN e USING (doc_id) WHERE working AND s < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AND (last IS NULL OR last <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE)""",
    "finalised_zombies": """WITH j AS (SELECT doc_id AS job_id, doc_id, doc_id % 3 <> 0 AS working, doc_id % 5 = 0 AS skip, (SELECT max(ts) FROM events) - to_minutes(doc_id % 60) AS s FROM documents), e AS (SELECT user_id AS doc_id, max(ts) AS last FROM events GROUP BY 1)
      SELECT job_id, doc_id, 'completed' AS status, NOT skip AS embed FROM j LEFT JOIN e USING (doc_id) WHERE working AND s < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE AND (last IS NULL OR last <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE) AND doc_id IN (SELECT doc_id FROM labels)""",
    "failed_jobs": """SELECT doc_id AS job_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 60 > 30 THEN 'failed' WHEN doc_id % 3 <> 0 THEN 'processing' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 <> 0 AND doc_id % 60 > 30 THEN 'stuck' ELSE '-' END AS error FROM documents""",
    "linear_router": f"""WITH {T}, {_FEATURES}, s AS ({_linear(_LINEAR)}), r AS (SELECT *, row_number() OVER w AS n, lead(strategy) OVER w AS fallback, lead(score) OVER w AS next_score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, strategy))
      SELECT query_id, strategy, score, fallback, round(score - next_score, 6) AS gap, 'deterministic' AS method, (score - next_score < 0.08::DOUBLE AND score >= 0.3::DOUBLE AND next_score >= 0.3::DOUBLE)::VARCHAR AS invoke_all FROM r WHERE n = 1""",
    "second_router": f"""WITH {T}, {_FEATURES}, s0 AS ({_linear(_LINEAR_2)}), x AS (SELECT event_id AS query_id, k FROM t),
      s AS (SELECT s0.* FROM s0 JOIN x USING (query_id) WHERE NOT (k % 6 = 0 AND strategy = 'a') AND NOT (k % 6 = 3 AND strategy IN ('a', 'b', 'c', 'd')) AND NOT (k % 4 = 1 AND strategy = 'd') AND k % 25 <> 0),
      r AS (SELECT *, row_number() OVER w AS n, lead(strategy) OVER w AS fallback, lead(score) OVER w AS next_score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, strategy))
      SELECT query_id, coalesce(strategy, 'e') AS strategy, score, fallback, round(score - next_score, 6) AS gap, CASE WHEN strategy IS NULL THEN 'fail_fast' ELSE 'deterministic' END AS method,
        (k % 6 NOT IN (0, 3) AND coalesce(score - next_score < 0.08::DOUBLE AND score >= 0.3::DOUBLE AND next_score >= 0.3::DOUBLE, false))::VARCHAR AS invoke_all FROM x LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (query_id)""",
    "forced_strategies": f"""WITH {T}, {_FEATURES}, s AS ({_linear(_LINEAR)}), m AS (SELECT query_id, string_agg(strategy || '=' || printf('%.4f', round(score, 4)), ',' ORDER BY strategy) AS scores FROM s GROUP BY 1)
      SELECT query_id, CASE WHEN k % 2 = 0 THEN 'b' ELSE 'd' END AS strategy, scores, 'override' AS method FROM m JOIN (SELECT event_id AS query_id, k FROM t) USING (query_id)""",
    "registry_stream": "SELECT user_id, max(ts) AS last_ts, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1",
    "job_transitions": _TRANSITIONS.format("max(ts)"),
    "job_transitions_stream": _TRANSITIONS.format("date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY"),
    "windowed_stream": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "calibration_summary": f"""WITH {C}, b AS (SELECT strategy, count(*) AS n, count(*) FILTER (answered) / count(*) AS answer_rate, avg(recall) AS recall, avg(precision) AS precision,
      sum(contradicted) / count(*) AS contra_per_cell, floor(median(latency_ms))::BIGINT AS median_latency_ms FROM cells GROUP BY 1),
      s AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + median_latency_ms / 1000.0::DOUBLE) AS speed FROM b JOIN {_p(0.95, "strategy", "p95_latency_ms")} USING (strategy))
      SELECT strategy, n, round(answer_rate, 6) AS answer_rate, round(recall, 6) AS recall, round(precision, 6) AS precision, round(contra_per_cell, 6) AS contra_per_cell, median_latency_ms,
        p95_latency_ms, round(speed, 6) AS speed, round(0.45::DOUBLE * recall + 0.3::DOUBLE * precision + 0.25::DOUBLE * speed, 6) AS composite FROM s""",
    "oracle_summary": f"""WITH {C}, f AS (SELECT * FROM cells WHERE strategy IN ('a', 'b', 'c', 'd')), b AS (SELECT query_id, max(recall) AS best FROM f GROUP BY 1),
      s AS (SELECT max(r) AS best_single FROM (SELECT avg(recall) AS r FROM f GROUP BY strategy))
      SELECT count(*) AS n_queries, round(avg(best), 6) AS oracle_recall, round(avg((best >= 0.67::DOUBLE)::INT), 6) AS union_proxy, round(max(best_single), 6) AS best_single, round(avg(best) - max(best_single), 6) AS headroom FROM b, s""",
    "score_statistics": f"WITH {C} SELECT strategy, count(*) AS n, round(avg(recall), 6) AS mean_recall, round(stddev_samp(recall), 6) AS std_recall FROM cells GROUP BY 1",
    "routing_stats": f"""WITH {T} SELECT strategy, count(*) AS n, round(avg(total_ms), 6) AS avg_ms, round(quantile_cont(total_ms, 0.5), 6) AS p50_ms, round(quantile_cont(total_ms, 0.95), 6) AS p95_ms,
      count(*) FILTER (total_ms < 1000) AS fast, count(*) FILTER (total_ms > 10000) AS slow FROM t GROUP BY 1""",
    "class_pivot": f"WITH {C} SELECT query_class, " + ", ".join(f"count(*) FILTER (strategy = '{s}') AS {s}" for s in ("a", "b", "c", "d", "natural")) + " FROM cells GROUP BY 1",
    "prior_cells": f"""WITH {C}, c AS (SELECT strategy, query_class, count(*) AS n, count(*) FILTER (verdict = 'correct') AS c, count(*) FILTER (verdict = 'wrong') AS w, count(*) FILTER (verdict = 'partial') AS p,
      avg(recall) AS r, avg(latency_ms) AS m FROM cells GROUP BY ALL)
      SELECT strategy, query_class, n, round(c / nullif(c + w, 0), 6) AS accuracy, round((c + 0.5::DOUBLE * p) / n, 6) AS soft_accuracy, round(r, 6) AS recall_capacity, round(m, 6) AS mean_ms FROM c""",
    "drift_band": f"""WITH {C}, r AS (SELECT day, round(avg(recall), 6) AS metric FROM cells GROUP BY 1),
      b AS (SELECT 'f' || (dayofmonth(day) % 3)::VARCHAR AS fingerprint, count(*) AS n, avg(metric) AS mean, stddev_pop(metric) AS sigma, arg_max(metric, day) AS latest FROM r GROUP BY 1),
      x AS (SELECT * FROM b ORDER BY n DESC, fingerprint LIMIT 1)
      SELECT fingerprint, n, round(mean, 6) AS mean, round(sigma, 6) AS sigma, round(mean - 2 * sigma, 6) AS low, round(mean + 2 * sigma, 6) AS high, round(latest, 6) AS latest, NOT latest BETWEEN mean - 2 * sigma AND mean + 2 * sigma AS drifted FROM x""",
    "latency_quantiles": f"WITH {C} SELECT * FROM {_p(0.9, 'strategy, query_class', 'p90_ms')}",
    "rubric_scores": f"""WITH {T}, s AS (SELECT event_id, greatest(0, least(1, (k % 6 - k % 4 + 0.5::DOUBLE * (k % 3) - 2 * (k % 17 = 0)::INT) / greatest(k % 6 + k % 4, 1))) AS s FROM t)
      SELECT event_id, round(s, 6) AS score, CASE WHEN s >= 0.85 THEN 'correct' WHEN s >= 0.5 THEN 'partial' ELSE 'wrong' END AS band FROM s""",
}
