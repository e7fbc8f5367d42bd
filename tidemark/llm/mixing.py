"""Operator 5: mixing sources to target weights by Pfair scheduling.

A source's rows are dealt into blocks of BLOCK_ROWS. In a mix with weight w, block k of a source may
not start before slot floor(k / w), its release, and has to be done by slot ceil((k + 1) / w), its
deadline; earliest deadline first then gives every source, up to every slot, less than one block more
or less than its weight asks for. Weights are whole shares of PERIOD slots, so releases, deadlines
and the schedule repeat with that period: one period is worked out on the driver (a bounded table,
whatever the input's size) and block k of a source is found in it by arithmetic.

A row's place in its source is a running number: sources are split into parts by a hash of the id, the
parts are counted, and rows are numbered within parts, so that a hot source spreads over all tasks.

A source runs out of blocks where its supply ends; its later slots stay empty. `horizon` cuts the
mix after so many slots: rows of blocks that fall behind it are not in the mix.

Cases: a null source is a source of its own. Rows with the same doc_id are ordered by text; repeated
rows keep places of their own. An empty table gives no rows. More than MOST_SOURCES sources stop the
job. Null texts and other columns don't matter.
"""

from __future__ import annotations

import heapq
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import read, written

BLOCK_ROWS = 16
#: Slots of a period at least; a source's weight is a whole number of them, one at least.
PERIOD = 4096
MOST_SOURCES = 20_000
#: Exponent of a source's share of rows in its target weight: below 1, small sources gain.
TEMPER = 0.7


def shares(weights: dict, period: int = PERIOD) -> tuple[dict, int]:
    """Whole shares, one at least, that add up to the period (returned; at least 8 slots per source)."""
    period = max(period, 8 * len(weights))
    total = sum(weights.values())
    exact = {k: w / total * (period - len(weights)) for k, w in weights.items()}
    out = {k: 1 + int(x) for k, x in exact.items()}
    rest = sorted(weights, key=lambda k: (int(exact[k]) - exact[k], str(k)))
    for k in rest[: period - sum(out.values())]:
        out[k] += 1
    return out, period


def schedule(whole: dict, period: int) -> list[tuple]:
    """One period: (source, block, release, deadline, slot) by earliest deadline first among the released."""
    order = sorted(whole, key=str)
    waiting = [(0, i, 0) for i in range(len(order))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            a = whole[order[i]]
            heapq.heappush(ready, (ceil((k + 1) * period / a), i, k, release))
            if k + 1 < a:
                heapq.heappush(waiting, ((k + 1) * period // a, i, k + 1))
        deadline, i, k, release = heapq.heappop(ready)
        out.append((order[i], k, release, deadline, slot))
    return out


def source_sizes(docs: DataFrame) -> dict:
    counted = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r["source"]: r["n"] for r in counted}


def tempered(sizes: dict, exponent: float = TEMPER) -> dict:
    """Target weights in proportion to a power of the sources' sizes."""
    powers = {k: n**exponent for k, n in sizes.items()}
    total = sum(powers.values())
    return {k: p / total for k, p in powers.items()}


def numbered(docs: DataFrame, sizes: dict) -> DataFrame:
    """docs with `place`, a number from 0 within the row's source, in the order of a hash of the id."""
    # The root of the largest source: as many parts to sum over as rows to number in a part, both few.
    parts = ceil(max(sizes.values(), default=1) ** 0.5)
    place = F.xxhash64("doc_id", F.lit("mix"))
    # Equal steps of the hash, in its order, so that parts follow each other.
    part = F.floor((F.shiftright(place, 32) + F.lit(1 << 31)) * F.lit(parts) / F.lit(1 << 32)).cast("int")
    rows = docs.withColumns({"_hash": place, "_part": part})
    counts = rows.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")
    offsets = written(counts.select(F.col("source").alias("_source"), F.col("_part").alias("_of"), before.alias("_before")))
    ties = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]
    inside = F.row_number().over(Window.partitionBy("source", "_part").orderBy("_hash", *ties)) - 1
    rows = rows.withColumn("_inside", inside)
    joined = rows.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("place", (F.col("_before") + F.col("_inside")).cast("long")).select(*docs.columns, "place")


def mix(docs: DataFrame, weights: dict | None = None, horizon: int | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """docs with block, release, deadline, slot and position (the row's number in the mix, with gaps where sources ran out), in place of columns of these names.

    weights: target weight by source (tempered sizes if None); rows of other sources are not mixed.
    horizon: slots after which the mix ends (never if None).
    """
    added = ["block", "release", "deadline", "slot", "position"]
    docs = docs.drop(*added, "place")
    sizes = source_sizes(docs)
    if not sizes:
        return docs.withColumns({c: F.lit(0).cast("long") for c in added})
    whole, period = shares({k: w for k, w in (weights or tempered(sizes)).items() if w > 0}, period)
    plan = docs.sparkSession.createDataFrame(
        [(s, k, r, d, t, whole[s]) for s, k, r, d, t in schedule(whole, period)],
        "_source string, _k long, _release long, _deadline long, _slot long, _share long",
    )
    lanes = plan.select("_source", "_share").distinct()
    placed = numbered(docs, sizes).withColumn("block", F.floor(F.col("place") / block_rows).cast("long"))
    # Both tables have `period` rows at most.
    placed = placed.join(F.broadcast(lanes), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumns({"_round": F.floor(F.col("block") / F.col("_share")).cast("long"), "_in": F.col("block") % F.col("_share")}).drop("_share")
    found = placed.join(F.broadcast(plan.drop("_share")), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_in") == F.col("_k")))
    later = lambda c: F.col(c) + F.col("_round") * period
    slot = later("_slot")
    found = found.select(
        *docs.columns,
        "block",
        later("_release").alias("release"),
        later("_deadline").alias("deadline"),
        slot.alias("slot"),
        (slot * block_rows + F.col("place") % block_rows).alias("position"),
    )
    return found if horizon is None else found.where(F.col("slot") < horizon)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = docs.select("doc_id", "source", F.xxhash64("text").alias("text"))  # only breaks ties between equal ids
    return mix(docs).select("doc_id", "source", "block", "release", "deadline", "slot", "position")
