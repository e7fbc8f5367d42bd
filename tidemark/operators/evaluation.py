"""Evaluation algebra over cells (query_id, strategy, verdict, recall, precision, answered, contradicted, latency_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import COMPOSITE, CORRECT

STRATEGIES = ["a", "b", "c", "d"]


#: Parts of a group's range of values in which ranks are counted.
PARTS = 256


def _ranked(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, upto (rows up to the value) and all: ranks of a group's distinct values, counted within equal parts of its range, so that a large group spreads."""
    own = rows.where(F.col(value).isNotNull())
    span = own.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    part = F.least(F.lit(PARTS - 1), F.coalesce(F.floor((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0)) * PARTS), F.lit(0)))
    counts = own.join(span, by).withColumn("_part", part.cast("int")).groupBy(*by, "_part", value).agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))
    upto = Window.partitionBy(*by).orderBy("_part")
    before = sums.select(*by, "_part", (F.sum("_sum").over(upto) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(*by)).alias("all"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy(value))
    return counts.withColumn("_inside", inside).join(before, [*by, "_part"]).select(*by, value, (F.col("_before") + F.col("_inside")).alias("upto"), "all")


def exact_rank(rows: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """The nearest-rank quantile of each group: sorted[min(n - 1, int(p n))]."""
    ranked = _ranked(rows, by, value)
    wanted = F.least(F.col("all") - 1, F.floor(F.col("all") * p))
    return ranked.where(F.col("upto") > wanted).groupBy(*by).agg(F.min(value).alias(name))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each group, by name."""
    ranked = _ranked(rows, by, value)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    out = []
    for name, p in wanted.items():
        place = (F.col("all") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * (F.max(place) - F.floor(F.max(place)))).alias(name))
    return ranked.groupBy(*by).agg(*out)


def calibration_summary(cells: DataFrame) -> DataFrame:
    """Per strategy: n, answer rate, mean recall and precision, contradictions, median and p95 latency, speed, composite."""
    by = cells.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if("answered") / F.count(F.lit(1))).alias("answer_rate"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        (F.sum("contradicted") / F.count(F.lit(1))).alias("contra_per_cell"),
    )
    middle = exact_quantiles(cells, ["strategy"], "latency_ms", {"m": 0.5}).select("strategy", F.floor("m").alias("median_latency_ms"))
    by = by.join(middle, "strategy").join(exact_rank(cells, ["strategy"], "latency_ms", 0.95, "p95_latency_ms"), "strategy")
    speed = 1.0 / (1.0 + F.col("median_latency_ms") / 1000.0)
    composite = COMPOSITE["recall"] * F.col("recall") + COMPOSITE["precision"] * F.col("precision") + COMPOSITE["speed"] * speed
    return by.withColumns({"speed": speed, "composite": composite})


def oracle_summary(cells: DataFrame) -> DataFrame:
    """One row: queries, mean of the best forced arm per query, best single arm, headroom and the share with a correct arm."""
    forced = cells.where(F.col("strategy").isin(STRATEGIES))
    best = forced.groupBy("query_id").agg(F.max("recall").alias("best"))
    oracle = best.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("best").alias("oracle_recall"), F.avg((F.col("best") >= CORRECT).cast("double")).alias("union_proxy"))
    single = forced.groupBy("strategy").agg(F.avg("recall").alias("r")).agg(F.max("r")).scalar()
    return oracle.withColumn("best_single", single).withColumn("headroom", F.col("oracle_recall") - F.col("best_single"))


def verdict_rollup(cells: DataFrame, key: str) -> DataFrame:
    """Counts by effective verdict (the human's before the judge's) and the rate of correct among judged."""
    v = F.coalesce("human_verdict", "verdict")
    rows = cells.withColumn("v", v).groupBy(key)
    counts = [F.count_if(F.col("v") == x).alias(x) for x in ("correct", "partial", "wrong")]
    out = rows.agg(F.count(F.lit(1)).alias("n"), *counts, F.count_if(F.col("v") == "unable_to_verify").alias("abstain"))
    judged = F.col("correct") + F.col("partial") + F.col("wrong")
    return out.withColumn("rate", F.col("correct") / F.nullif(judged, F.lit(0)))


def score_statistics(cells: DataFrame) -> DataFrame:
    return cells.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("mean_recall"), F.stddev_samp("recall").alias("std_recall"))


def routing_stats(log: DataFrame) -> DataFrame:
    """Per strategy: n, average, interpolated p50 and p95 of total_ms, fast and slow calls."""
    by = log.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg("total_ms").alias("avg_ms"), F.count_if(F.col("total_ms") < 1000).alias("fast"), F.count_if(F.col("total_ms") > 10000).alias("slow"))
    return by.join(exact_quantiles(log, ["strategy"], "total_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), "strategy", "left")


def prod_rollup(decisions: DataFrame, hours: int) -> DataFrame:
    """Per strategy over the last hours of production: n, mean and sample deviation of the grade, and rows whose ledger has a contradicted claim.

    decisions: strategy, ts, is_prod, grade, ledger (array of structs with status).
    """
    newest = decisions.agg(F.max("ts")).scalar()
    rows = decisions.where(F.col("is_prod") & F.col("grade").isNotNull() & (F.col("ts") >= newest - F.make_dt_interval(F.lit(0), F.lit(hours))))
    contradicted = F.exists("ledger", lambda c: c["status"] == "contradicted")
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("grade"), 3).alias("grade_mean"), F.round(F.stddev_samp("grade"), 3).alias("grade_std"), F.count_if(contradicted).alias("n_contradicted"))


def build_stability(cells: DataFrame) -> DataFrame:
    """Per run (run_id, version): the distinct versions that its cells ran on, sorted, and whether that is one at most."""
    by = cells.groupBy("run_id").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    return by.select("run_id", F.size("versions").cast("long").alias("n_versions"), "versions", (F.size("versions") <= 1).alias("stable"))


def pooled_priors(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of repeats (query_id, query_class, strategy, score): n, mean and sample deviation (0 for one) by query and strategy, and pooled by class and strategy."""
    of = lambda *keys: scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"))
    return of("query_id", "strategy"), of("query_class", "strategy")


def finalise(results: DataFrame) -> DataFrame:
    """Per run (run_id, verdict, routing_correct, citation_hit, total_ms): counts by verdict, rates over what was judged, median and nearest-rank p95 of the latency."""
    ms = results.withColumn("ms", F.coalesce("total_ms", F.lit(0.0)))
    rate = lambda c: F.avg(F.col(c).cast("int")).alias(f"{c}_rate")
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("correct", "partial", "wrong", "unable")]
    by = ms.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_queries"), *counts, rate("routing_correct"), rate("citation_hit"))
    middle = exact_quantiles(ms, ["run_id"], "ms", {"m": 0.5}).select("run_id", F.floor("m").cast("long").alias("median_ms"))
    tail = exact_rank(ms, ["run_id"], "ms", 0.95, "p").select("run_id", F.floor("p").cast("long").alias("p95_ms"))
    return by.join(middle, "run_id").join(tail, "run_id")


def deterministic_checks(results: DataFrame) -> DataFrame:
    """result_id, routing_correct, citation_hit and fail_fast_correct; null where nothing was expected.

    results: expected and used strategy, expected and given refusal, must_cite (names), must_cite_url, names, urls
    (arrays). A name is hit if one of a pair holds the other, in any case.
    """
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    names = F.exists(low(F.col("must_cite")), lambda d: F.exists(low(F.col("names")), lambda n: (n != "") & (F.contains(n, d) | F.contains(d, n))))
    urls = F.exists(low(F.col("must_cite_url")), lambda s: F.exists(low(F.col("urls")), lambda u: F.contains(u, s)))
    asked = (F.coalesce(F.size("must_cite"), F.lit(0)) > 0) | (F.coalesce(F.size("must_cite_url"), F.lit(0)) > 0)
    wanted = F.lower(F.coalesce("expected_strategy", F.lit("")))
    refusal = F.when(F.col("expected_refusal").isNotNull(), F.col("refusal").eqNullSafe(F.col("expected_refusal"))).otherwise(F.col("refusal").isNotNull())
    return results.select(
        "result_id",
        F.when(wanted != "", wanted == F.lower(F.coalesce("strategy_used", F.lit("")))).alias("routing_correct"),
        F.when(asked, names | urls).alias("citation_hit"),
        F.when(wanted == "e", refusal).alias("fail_fast_correct"),
    )


def class_pivot(log: DataFrame) -> DataFrame:
    """Per query class the number of calls of each strategy."""
    wide = log.groupBy("query_class").pivot("strategy", [*STRATEGIES, "natural"]).agg(F.count(F.lit(1)))
    return wide.fillna(0)


def prior_cells(cells: DataFrame) -> DataFrame:
    """Per strategy and class: accuracy c / (c + w), which leaves partial ones out, soft accuracy, mean recall and latency."""
    c, w, p = (F.count_if(F.col("verdict") == x) for x in ("correct", "wrong", "partial"))
    return cells.groupBy("strategy", "query_class").agg(
        F.count(F.lit(1)).alias("n"),
        (c / F.nullif(c + w, F.lit(0))).alias("accuracy"),
        ((c + 0.5 * p) / F.count(F.lit(1))).alias("soft_accuracy"),
        F.avg("recall").alias("recall_capacity"),
        F.avg("latency_ms").alias("mean_ms"),
    )


ORACLE_TAU = 0.7


def cell_states(cells: DataFrame, tau: float = ORACLE_TAU) -> DataFrame:
    """cells (query_id, strategy, verdict, score) with their state: TP, WP, FP, MISS, and for honest abstentions FN where some arm reached tau, else TN."""
    v, s = F.lower("verdict"), F.coalesce("score", F.lit(0.0))
    state = (
        F.when(v == "agent_error", "MISS")
        .when(v == "correct", "TP")
        .when(v == "partial", F.when(s >= 0.7, "TP").otherwise("WP"))
        .when(v == "wrong", "FP")
        .when(v == "unable_to_verify", F.when(s == 0, "MISS").otherwise("HA"))
        .when(s >= 0.7, "TP")
        .when(s == 0, "MISS")
        .when(s >= 0.3, "WP")
        .otherwise("FP")
    )
    best = cells.groupBy("query_id").agg((F.max(s) >= tau).alias("answerable"))
    rows = cells.withColumn("state", state).join(best, "query_id")
    return rows.withColumn("state", F.when(F.col("state") != "HA", F.col("state")).when(F.col("answerable"), "FN").otherwise("TN"))


def confusion(cells: DataFrame, by: tuple[str, ...] = ("strategy",), tau: float = ORACLE_TAU) -> DataFrame:
    """Per strategy (or slice): counts by state, precision, recall and F1 with partial credit, utility tp - 2 fp + .5 tn - fn, and abstention rates."""
    s = F.coalesce("score", F.lit(0.0))
    of = lambda x: F.count_if(F.col("state") == x)
    counted = cell_states(cells, tau).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("state").isin("TP", "WP"), s).otherwise(0.0)).alias("credit"),
        *(of(x.upper()).alias(x) for x in ("tp", "wp", "fp", "tn", "fn", "miss")), F.count_if("answerable").alias("n_answerable"),
    )
    credit, zero = F.col("credit"), F.lit(0)
    out = counted.withColumns({"precision": credit / F.nullif(credit + F.col("fp"), F.lit(0.0)), "recall": credit / F.nullif(credit + F.col("fn") + F.col("miss"), F.lit(0.0))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({
        "f1": 2 * p * r / F.nullif(p + r, F.lit(0.0)),
        "utility": credit - 2 * F.col("fp") + 0.5 * F.col("tn") - F.col("fn"),
        "honest_abstain": F.col("tn") / F.nullif(F.col("n") - F.col("n_answerable"), zero),
        "over_abstain": F.col("fn") / F.nullif(F.col("n_answerable"), zero),
    })


def disagreements(cells: DataFrame) -> DataFrame:
    """query_id, the strategies that were right and those that were wrong, sorted, of queries that have both."""
    rows = cell_states(cells).groupBy("query_id").agg(*(F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == x, F.col("strategy")))), ",").alias(n) for x, n in (("TP", "right"), ("FP", "wrong"))))
    return rows.where("`right` <> '' and wrong <> ''")


VERDICT_RANK = {"correct": 3, "partial": 2, "unable_to_verify": 1, "wrong": 0}


def system_rows(cells: DataFrame) -> DataFrame:
    """cells (query_id, strategy, expected, v: effective verdict, confidence) and two systems over them: system_oracle takes the expected strategy's cell of a query (for e its first), system_best the one with the best verdict, then confidence."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in VERDICT_RANK.items() for x in kv))[F.col("v")], F.lit(0))
    row = F.struct("v", "confidence", "n_chunks")
    oracle = cells.where((F.col("expected") == F.col("strategy")) | (F.col("expected") == "e")).groupBy("query_id").agg(F.min_by(row, F.struct("strategy", "v", F.coalesce("confidence", F.lit(-1.0)), "n_chunks")).alias("r"))
    best = cells.groupBy("query_id").agg(F.max_by(row, F.struct(rank, F.coalesce("confidence", F.lit(0.0)), "v", "n_chunks")).alias("r"))
    named = lambda df, n: df.select(F.lit(n).alias("strategy"), "r.*")
    return cells.select("strategy", "v", "confidence", "n_chunks").unionByName(named(oracle, "system_oracle")).unionByName(named(best, "system_best"))


def pr_curve(cells: DataFrame, steps: int = 20) -> DataFrame:
    """strategy, tau, n_answered, n_total, precision and recall over a grid of thresholds on the confidence, for strategies and systems.

    Partial answers count half. Abstentions whose verdict is open are in no count but the total; a missing confidence is 0. A row is
    counted at the grid's steps by its own step: the sums over thresholds run over steps, not rows.
    """
    rows = system_rows(cells)
    skipped = (F.coalesce("n_chunks", F.lit(0)) == 0) & (F.col("v") == "unable_to_verify")
    step = F.when(~skipped, F.floor(F.coalesce("confidence", F.lit(0.0)) * steps + 1e-9)).cast("int")
    of = lambda v: F.count_if(F.col("v") == v).alias(v)
    counted = rows.withColumn("step", step).groupBy("strategy", "step").agg(F.count(F.lit(1)).alias("n"), *(of(v) for v in ("correct", "partial", "wrong")))
    total = counted.groupBy("strategy").agg(F.sum("n").alias("n_total"))
    grid = total.select("strategy", "n_total", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    full = grid.join(counted.where("step is not null"), ["strategy", "step"], "left").fillna(0)
    down = Window.partitionBy("strategy").orderBy(F.desc("step"))
    sums = full.select("strategy", "n_total", "step", *(F.sum(c).over(down).alias(c) for c in ("n", "correct", "partial", "wrong")))
    good = F.col("correct") + 0.5 * F.col("partial")
    decided = F.col("correct") + F.col("partial") + F.col("wrong")
    return sums.select("strategy", (F.col("step") / float(steps)).alias("tau"), F.col("n").alias("n_answered"), "n_total", F.round(good / F.nullif(decided, F.lit(0)), 4).alias("precision"), F.round(good / F.nullif("n_total", F.lit(0)), 4).alias("recall"))


def drift_band(runs: DataFrame) -> DataFrame:
    """The largest group of runs with one fingerprint: mean, population deviation, the band of two of them and whether the last run leaves it."""
    by = runs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"), F.stddev_pop("metric").alias("sigma"), F.max_by("metric", "at").alias("latest"))
    top = by.orderBy(F.desc("n"), "fingerprint").limit(1)
    low, high = F.col("mean") - 2 * F.col("sigma"), F.col("mean") + 2 * F.col("sigma")
    return top.select("fingerprint", "n", "mean", "sigma", low.alias("low"), high.alias("high"), "latest", (~F.col("latest").between(low, high)).alias("drifted"))


FINGERPRINT = ("priors_version", "lexicon_revision", "agent_revision", "retrieval_config_hash", "judge_model", "bank_hash")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for two runs (one row each: FINGERPRINT, stable, metrics): the parts of the fingerprint that changed, and whether a difference can't be attributed: more than one changed, or a run wasn't stable."""
    left, right = (df.select(*(F.col(c).alias(f"{n}_{c}") for c in (*FINGERPRINT, "stable")), F.lit(1).alias("_one")) for df, n in ((a, "a"), (b, "b")))
    both = left.join(right, "_one")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in FINGERPRINT)))
    steady = F.coalesce("a_stable", F.lit(True)) & F.coalesce("b_stable", F.lit(True))
    return both.select(F.array_join(changed, ",").alias("changed"), F.size(changed).cast("long").alias("n_changed"), steady.alias("stable"), ((F.size(changed) > 1) | ~steady).alias("confounded"))


def movers(before: DataFrame, after: DataFrame, key: str, metric: str, changed_only: bool = False) -> DataFrame:
    """key, a, b and delta of all keys of either run; of those in both whose metric moved, if changed_only."""
    a, b = before.select(key, F.col(metric).alias("a")), after.select(key, F.col(metric).alias("b"))
    rows = a.join(b, key, "full").withColumn("delta", F.col("b") - F.col("a"))
    return rows.where(F.abs("delta") > 1e-9) if changed_only else rows


def rubric(must: Column, missed: Column, bonus: Column, forbidden: Column) -> tuple[Column, Column]:
    """(must hits - misses + .5 bonus - 2 forbidden) / must within 0 and 1, and its band."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (must - missed + 0.5 * bonus - 2 * forbidden) / F.greatest(must + missed, F.lit(1))))
    return score, F.when(score >= 0.85, "correct").when(score >= 0.5, "partial").otherwise("wrong")


def lift(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric and lift, final less baseline, of metrics (metric, value) that both have."""
    return before.select("metric", F.col("value").alias("a")).join(after.select("metric", F.col("value").alias("b")), "metric").select("metric", (F.col("b") - F.col("a")).alias("lift"))


def host_majority(rows: DataFrame, key: str, host: str, least: int = 3) -> DataFrame:
    """Each key's most common host, where the key has at least so many rows and so has the host."""
    by = rows.groupBy(key, host).agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy(key).agg(F.max(F.struct("n", host)).alias("t"), F.sum("n").alias("total"))
    return top.where((F.col("total") >= least) & (F.col("t.n") >= least)).select(key, F.col(f"t.{host}").alias(host), F.col("t.n").alias("n"), "total")
