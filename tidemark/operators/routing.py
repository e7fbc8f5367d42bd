"""Routing: preferences, query classes, priors, linear scores, decisions, success and escalation.

A router decides for a table of queries at once. What an agent would do in a loop is a table of attempts
here, from which windows choose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import (
    BOOSTED,
    CALLER_PRESETS,
    CANONICAL_PRIORS,
    CRAWLABILITY,
    DAMPED,
    DEFAULT_CALLER,
    FLOOR,
    GAP,
    GENERIC_UNTAGGED,
    LINEAR_BASE,
    LINEAR_WEIGHTS,
    LINEAR_WEIGHTS_2,
    REQUIRED,
    SHAPE_MISS,
    SHAPE_WEIGHT,
    SPEED_WEIGHTS,
    WITHDRAW,
)


def _lookup(key: Column, values: dict, default) -> Column:
    return reduce(lambda acc, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(acc), values.items(), default if isinstance(default, Column) else F.lit(default))


def query_type(has_literal: Column, coverage: Column, has_tags: Column) -> Column:
    return F.when(has_literal, "PRECISION_DOMINANT").when((coverage >= 0.5) & has_tags, "CONCEPTUAL").when((coverage >= 0.2) & has_tags, "MIXED").otherwise("VAGUE")


def query_class(query_type: Column, has_literal: Column, exploratory: Column, has_domain: Column, pool_size: Column) -> Column:
    pool = F.coalesce(pool_size, F.lit(0))
    return (
        F.when(has_literal, "literal_anchor")
        .when(exploratory, "exploratory")
        .when(query_type == "VAGUE", "vague")
        .when(query_type == "CONCEPTUAL", "conceptual")
        .when((pool > 0) & (pool <= 500), "tight_pool")
        .when(pool > 500, "wide_pool")
        .when(has_domain, "tight_pool")
        .otherwise("vague")
    )


def canonicality(query_type: Column, has_jurisdiction: Column, has_domain: Column, pool_size: Column) -> Column:
    """How much a query is one after a policy: 1 for pools of 100 to 500 documents, falling to 0 at 50 and 900."""
    pool = F.coalesce(pool_size, F.lit(0))
    weight = F.when(pool.between(100, 500), 1.0).when(pool < 100, F.greatest(F.lit(0.0), (pool - 50) / 50.0)).otherwise(F.greatest(F.lit(0.0), (900 - pool) / 400.0))
    return F.when(has_jurisdiction & has_domain & (query_type != "VAGUE") & (pool > 0), weight).otherwise(0.0)


NUMERIC_PRIORS = ("accuracy", "accuracy_std", "recall_capacity", "recall_std", "speed")


def blended_priors(base: DataFrame, weight: DataFrame) -> DataFrame:
    """query_id, strategy, shapes and the numeric priors of base (strategy, shapes, NUMERIC_PRIORS), each moved towards the canonical profile by the query's weight (query_id, w)."""
    rows = [(s, *(float(v[c]) for c in NUMERIC_PRIORS)) for s, v in CANONICAL_PRIORS.items()]
    canon = base.sparkSession.createDataFrame(rows, "strategy string, " + ", ".join(f"c_{c} double" for c in NUMERIC_PRIORS))
    own = F.array(*(F.struct(F.lit(s).alias("strategy")) for s in CANONICAL_PRIORS))
    every = weight.select("query_id", "w", F.explode(own).alias("s")).select("query_id", "w", "s.strategy")
    both = every.join(F.broadcast(base.join(canon, "strategy")), "strategy")
    moved = [((1 - F.col("w")) * F.col(c) + F.col("w") * F.col(f"c_{c}")).alias(c) for c in NUMERIC_PRIORS]
    return both.select("query_id", "strategy", "shapes", *moved)


def prior_score(accuracy_need: Column, recall_demand: Column, speed_budget: Column, answer_shape: Column) -> Column:
    """The score of a row of blended priors for a caller's preferences; the needier, the more spread counts against a strategy."""
    risk = F.greatest(F.lit(0.0), (accuracy_need - 0.5) * 2)
    sure = lambda mean, std: F.greatest(F.lit(0.0), F.col(mean) - risk * F.col(std))
    shape = F.when(answer_shape.isNull() | (answer_shape == "any") | F.array_contains("shapes", answer_shape), 1.0).otherwise(SHAPE_MISS)
    speed = F.col("speed") * _lookup(speed_budget, SPEED_WEIGHTS, 1.0)
    return sure("accuracy", "accuracy_std") * accuracy_need + sure("recall_capacity", "recall_std") * recall_demand + speed + shape * SHAPE_WEIGHT


PREFERENCES = ("answer_shape", "accuracy_need", "recall_demand", "speed_budget")


def resolve_preferences(asked: DataFrame) -> DataFrame:
    """asked with its preferences filled in: what the caller said, else the preset of its mode, else the default preset."""
    mode = F.coalesce("caller_mode", F.lit(DEFAULT_CALLER))
    default = CALLER_PRESETS[DEFAULT_CALLER]
    filled = {}
    for i, name in enumerate(PREFERENCES):
        preset = _lookup(mode, {m: v[i] for m, v in CALLER_PRESETS.items()}, default[i])
        said = F.when(F.col(name) == "", None).otherwise(F.col(name)) if dict(asked.dtypes)[name] == "string" else F.col(name)
        filled[name] = F.coalesce(said, preset)
    return asked.withColumns({**filled, "caller_mode": mode})


def escalation_budget(caller_mode: Column, speed_budget: Column) -> Column:
    """How many further strategies may be tried when the first answer abstains."""
    mode, speed = F.lower(F.coalesce(caller_mode, F.lit(""))), F.lower(F.coalesce(speed_budget, F.lit("")))
    return F.when(mode.isin("fast", "copilot") | (speed == "real_time"), 0).when(mode.isin("thinking", "research"), 2).otherwise(1)


def crawlability(payor: Column) -> Column:
    """How much of a payor's site can be fetched, by parts of its code; .3 for others."""
    bare = F.regexp_replace(F.lower(payor), "[_-]", "")
    return F.coalesce(reduce(lambda acc, kv: acc.when(bare.contains(kv[0]), kv[1]), list(CRAWLABILITY.items())[1:], F.when(bare.contains(list(CRAWLABILITY)[0]), list(CRAWLABILITY.values())[0])).otherwise(0.3), F.lit(0.3))


def partition_term(selectivity: Column, tagged: Column) -> Column:
    """REQUIRED, BOOSTED or DROP; an untagged term is never required."""
    return F.when((selectivity >= REQUIRED) & tagged, "REQUIRED").when(selectivity >= BOOSTED, "BOOSTED").otherwise("DROP")


def untagged_selectivity(term: Column, generic: Column | None = None) -> Column:
    """By length; next to nothing for general words, and for those that `generic` says the documents are full of."""
    n = F.length(term)
    dull = F.lower(term).isin(GENERIC_UNTAGGED)
    dull = dull if generic is None else dull | generic
    return F.when(term == "", 0.0).when(dull, 0.05).when(n >= 5, 0.5).when(n >= 3, 0.3).otherwise(0.1)


def linear_features(profile: DataFrame) -> DataFrame:
    """query_id and the features within 0 and 1 of profiles (pool_size, has_literal, has_payor, inherited, thematic, crawlability, and n_domain_tags for the second router)."""
    size = F.greatest(F.lit(1), F.coalesce("pool_size", F.lit(500)))
    one = lambda c: c.cast("int").cast("double")
    exclusive = F.least(F.lit(1.0), 50.0 / size)
    deep = F.col("has_payor") & ((size >= 20) | F.col("inherited"))
    narrow = F.when(exclusive >= 0.2, F.least(F.lit(1.0), F.col("n_domain_tags") / 3.0)).otherwise(0.0) if "n_domain_tags" in profile.columns else F.lit(0.0)
    return profile.select(
        "query_id",
        exclusive.alias("exclusivity"),
        (one(deep) * exclusive).alias("depth_x_excl"),
        narrow.alias("tag_coverage"),
        one(F.col("has_literal")).alias("literal"),
        one(deep).alias("corpus_depth"),
        one(F.col("thematic")).alias("thematic_policy"),
        one(size > 500).alias("wide_pool"),
        one(F.col("inherited")).alias("inheritance"),
        F.coalesce("crawlability", F.lit(0.3)).alias("crawlability"),
    )


def linear_scores(features: DataFrame, second: bool = False) -> DataFrame:
    """query_id, strategy, score; in the first router the penalties of d shrink with crawlability."""
    scores = []
    for s, base in LINEAR_BASE.items():
        score = F.lit(base)
        for name, w in (LINEAR_WEIGHTS_2 if second else LINEAR_WEIGHTS)[s].items():
            weight = w * (1 - F.col("crawlability")) if not second and s == "d" and w < 0 and name in DAMPED else F.lit(w)
            score = score + weight * F.col(name)
        scores.append(F.struct(F.lit(s).alias("strategy"), score.alias("score")))
    return features.select("query_id", F.explode(F.array(*scores)).alias("s")).select("query_id", "s.strategy", "s.score")


def decide(scores: DataFrame, tried: DataFrame | None = None, est_recall: DataFrame | None = None, refused: DataFrame | None = None) -> DataFrame:
    """Per query the best strategy left (ties by name), the fallback, their gap, the method, and invoke_all where both are good and close at a first attempt.

    Withdrawn: tried strategies (query_id, strategy), and those with an estimated recall below .05 (query_id,
    strategy, est_recall). Where all are, and for refused queries (query_id), the strategy is e.
    """
    left = scores
    if tried is not None:
        left = left.join(tried.select("query_id", "strategy").distinct(), ["query_id", "strategy"], "left_anti")
    if est_recall is not None:
        left = left.join(est_recall, ["query_id", "strategy"], "left").where(F.coalesce("est_recall", F.lit(1.0)) >= WITHDRAW)
    if refused is not None:
        left = left.join(refused.select("query_id"), "query_id", "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "strategy")
    ranked = left.withColumns({"n": F.row_number().over(order), "fallback": F.lead("strategy").over(order), "next_score": F.lead("score").over(order)})
    best = ranked.where("n = 1").select("query_id", "strategy", "score", "fallback", "next_score")
    every = scores.select("query_id").distinct()
    if tried is not None:
        every = every.join(tried.select("query_id", F.lit(True).alias("again")).distinct(), "query_id", "left")
    else:
        every = every.withColumn("again", F.lit(False))
    found = every.join(best, "query_id", "left")
    gap = F.col("score") - F.col("next_score")
    close = ~F.coalesce("again", F.lit(False)) & F.coalesce((gap < GAP) & (F.col("score") >= FLOOR) & (F.col("next_score") >= FLOOR), F.lit(False))
    method = F.when(F.col("strategy").isNull(), "fail_fast").otherwise("deterministic")
    return found.select("query_id", F.coalesce("strategy", F.lit("e")).alias("strategy"), "score", "fallback", gap.alias("gap"), method.alias("method"), close.alias("invoke_all"))


def override(scores: DataFrame, forced: DataFrame) -> DataFrame:
    """The forced strategy of each query (query_id, strategy) with all scores kept beside it, and no fallback."""
    kept = scores.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", F.round("score", 4).alias("score"))))).alias("scores"))
    return forced.select("query_id", "strategy").join(kept, "query_id").withColumn("method", F.lit("override"))


WIDE_POOL = 2000


def strategy_order(query_type: Column, pool_size: Column, widest: int = WIDE_POOL) -> Column:
    """The retrieval steps to try, in order."""
    steps = lambda *names: F.array(*map(F.lit, names))
    tight = (pool_size > 0) & (pool_size <= widest)
    return (
        F.when(query_type == "PRECISION_DOMINANT", steps("phrase_strict", "bm25_in_pool"))
        .when(query_type == "VAGUE", steps("vector_broad"))
        .when(tight & (query_type == "MIXED"), steps("bm25_in_pool", "vector_in_pool", "phrase_strict"))
        .when(tight, steps("bm25_in_pool", "vector_in_pool"))
        .when(query_type == "MIXED", steps("vector_broad", "bm25_in_pool", "phrase_strict"))
        .otherwise(steps("vector_broad", "bm25_in_pool"))
    )


def step_success(step: Column, n_chunks: Column, top_rerank: Column, new_docs: Column, top_new_similarity: Column, anchors: Column, anchors_in_name: Column, anchors_in_text: Column, anchors_in_either: Column) -> Column:
    """high, medium or null (failed) by each step's own criterion.

    anchors: how many terms a strict phrase step looked for; the others how many of them stand in the name,
    the text, or one of both, of its best chunk.
    """
    graded = lambda high, low: F.when(top_rerank >= high, "high").when(top_rerank >= low, "medium")
    named = (anchors_in_name >= 1) & (anchors_in_either == anchors)
    return (
        F.when(n_chunks == 0, None)
        .when(step == "phrase_strict", F.when((anchors > 0) & (named | (anchors_in_text / anchors >= 0.8)), "high"))
        .when(step.isin("bm25_in_pool", "vector_in_pool"), graded(0.5, 0.3))
        .when(step == "hybrid", graded(0.4, 0.25))
        .when(step == "vector_broad", F.when((new_docs >= 2) & (top_new_similarity >= 0.4), "high"))
    )


def confidence(attempts: DataFrame) -> DataFrame:
    """Per query of attempts (query_id, attempt, grade, n_chunks): high if the first succeeded well, medium if any did, else low."""
    by = attempts.groupBy("query_id").agg(
        F.min_by("grade", "attempt").alias("first"), F.count("grade").alias("succeeded"), F.max("n_chunks").alias("most_chunks")
    )
    label = F.when(F.col("first") == "high", "high").when(F.col("succeeded") > 0, "medium").otherwise("low")
    return by.select("query_id", label.alias("confidence"), "most_chunks")


def hint(confidence: Column, query_type: Column, n_untagged: Column, most_chunks: Column) -> Column:
    """What to say differently; null where nothing would help to say."""
    low = confidence == "low"
    return (
        F.when(confidence == "high", None)
        .when((query_type == "VAGUE") & low, "add_specifics")
        .when((query_type == "CONCEPTUAL") & (n_untagged == 0), "add_data_point")
        .when((query_type == "PRECISION_DOMINANT") & low, "literal_not_indexed")
        .when(low & (most_chunks > 0), "widen")
    )


CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}


def escalate(attempts: DataFrame, most: int = 4) -> DataFrame:
    """Per query the answer that is kept: attempts (query_id, attempt, strategy, confidence, abstained, signature, budget) up to the first that didn't abstain, within the budget and `most` tries.

    An attempt that repeats an earlier one's signature ends the search too. Of those made the one with the best confidence is
    kept, the earlier of equal ones.
    """
    order = Window.partitionBy("query_id").orderBy("attempt")
    n = F.row_number().over(order)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    done = F.max((~F.col("abstained")).cast("int")).over(before)
    seen = F.array_contains(F.collect_set("signature").over(before), F.col("signature"))
    marked = attempts.withColumns({"n": n, "_done": F.coalesce(done, F.lit(0)), "_seen": seen})
    made = marked.where((F.col("n") <= F.least(F.col("budget") + 1, F.lit(most))) & (F.col("_done") == 0))
    stopped = F.min(F.when(F.col("_seen"), F.col("n"))).over(Window.partitionBy("query_id"))
    made = made.withColumn("_stop", stopped).where(F.col("_stop").isNull() | (F.col("n") < F.col("_stop")))
    rank = _lookup(F.col("confidence"), CONFIDENCE_RANK, 0)
    return made.groupBy("query_id").agg(F.count(F.lit(1)).alias("tries"), F.max_by(F.struct("attempt", "strategy", "confidence"), F.struct(rank, -F.col("n"))).alias("kept")).select("query_id", "tries", "kept.*")


def inherited_scores(rows: DataFrame, escalated: bool) -> DataFrame:
    """rows (query_id, id, score, own_top) of an inherited authority's chunks with their score: .99 where fetched directly (score null), and on escalation above the plan's best."""
    raw = F.coalesce("score", F.lit(0.99))
    lifted = F.greatest(F.coalesce("own_top", F.lit(0.0)) + 0.15, F.least(F.lit(1.0), raw + 0.45))
    return rows.withColumn("score", lifted if escalated else raw)
