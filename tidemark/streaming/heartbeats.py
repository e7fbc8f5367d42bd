"""Jobs as state with timers: claimed, kept alive by their events, completed, failed, or taken from a silent worker.

An event is a claim (a worker starts the job), a beat, a completion or an error. A job at work that was claimed longer than
`timeout` minutes ago, with no event for `silent` minutes, is taken back at the moment when both have passed. It is pending again, as after an
error, or blocked from its third failure on; a blocked job takes part in nothing more. Completions and errors of jobs that aren't at work say nothing.

`follow` keeps this up by a stream: a job's events wait in its state until the watermark passes them, and a timer stands for its next event
or deadline, so that a worker that has gone silent is noticed without any event of its job. `transitions` is the same over a table by
windows. Both take a job's events in order in one task. Events without a job or a time are left out, and so are those that come later than `delay`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_FAILURES = 3
MINUTE = 60_000_000
OUT = "job_id bigint, at bigint, status string, failures int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _moves(events: DataFrame) -> DataFrame:
    """job_id, at (microseconds), event_id and kind of the events that can be placed."""
    return events.where("job_id is not null and ts is not null and kind is not null").select("job_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "kind", F.col("ts").cast("timestamp").alias("ts"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "status", "failures")


def transitions(events: DataFrame, until: Column, timeout: int = 10, silent: int = 5) -> DataFrame:
    """job_id, at, status (processing, completed, pending, blocked) and failures of each change of a job's status, as known at `until`, by windows.

    events: job_id, ts, event_id and kind (claim, beat, done, error); later ones than `until` aren't known yet.
    """
    end = F.unix_micros(until.cast("timestamp"))
    rows = _moves(events).drop("ts").withColumn("end", end).where(F.col("at") <= F.col("end"))
    job = Window.partitionBy("job_id").orderBy("at", "event_id")
    run = Window.partitionBy("job_id", "run")
    claim = F.col("kind") == "claim"
    rows = rows.withColumns({"run": F.sum(claim.cast("int")).over(job), "next": F.coalesce(F.lead("at").over(job), F.col("end")), "place": F.row_number().over(job)}).where("run > 0")
    deadline = F.greatest(F.min(F.when(claim, F.col("at"))).over(run) + timeout * MINUTE, F.col("at") + silent * MINUTE)
    closes = F.col("kind").isin("done", "error")
    rows = rows.withColumn("deadline", deadline).withColumn("ends", closes | (F.col("next") > F.col("deadline")))
    rows = rows.withColumn("last", F.min(F.when(F.col("ends"), F.col("place"))).over(run)).where(claim | (F.col("place") == F.col("last")))
    fails = F.when(F.col("place") == F.col("last"), F.col("kind") != "done").otherwise(False)
    # A claim can be its run's last row as well, and is then two changes.
    start = F.when(claim, F.struct(F.col("at"), F.lit("processing").alias("status"), F.lit(0).alias("fails")))
    stop = F.when(F.col("place") == F.col("last"), F.struct(F.when(closes, F.col("at")).otherwise(F.col("deadline")).alias("at"), F.when(fails, "failed").otherwise("completed").alias("status"), fails.cast("int").alias("fails")))
    both = rows.select("job_id", "run", F.explode(F.filter(F.array(start, stop), lambda x: x.isNotNull())).alias("m")).select("job_id", "run", "m.*")
    order = Window.partitionBy("job_id").orderBy("run", F.col("status") != "processing")
    both = both.withColumn("failures", F.sum("fails").over(order).cast("int"))
    status = F.when(F.col("status") != "failed", F.col("status")).when(F.col("failures") >= MOST_FAILURES, "blocked").otherwise("pending")
    return _shown(both.where(F.col("failures") - F.col("fails") < MOST_FAILURES).withColumn("status", status))


class Jobs(StatefulProcessor):
    """One job: its status, its claim's and last event's time, its failures, its timer and the events that the watermark hasn't passed.

    All of it is one value, since each call to the state is a round trip: one to read, one to write, and those for a timer that changes.
    """

    def __init__(self, timeout: int, silent: int):
        self.timeout, self.silent = timeout * MINUTE, silent * MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, started bigint, last bigint, failures int, wake bigint, waiting array<struct<at: bigint, event_id: bigint, kind: string>>")

    def _deadline(self, started: int, last: int) -> int:
        return max(started + self.timeout, last + self.silent)

    def _load(self) -> tuple[str, int, int, int, int | None, list]:
        *state, waiting = self.job.get() or ("pending", 0, 0, 0, None, [])
        return *state, [tuple(w) for w in waiting]

    def _keep(self, status: str, started: int, last: int, failures: int, wake: int | None, waiting: list) -> None:
        """One timer: at the next event that waits or, without one, at the deadline. It may wake a millisecond late, never early. wake: the one that is set."""
        new = None
        if waiting:
            new = -(-min(w[0] for w in waiting) // 1000)
        elif status == "processing":
            new = self._deadline(started, last) // 1000 + 1
        if new != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            if new is not None:
                self.handle.registerTimer(new)
        self.job.update((status, started, last, failures, new, waiting))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(e), k) for df in rows for a, e, k in zip(df["at"], df["event_id"], df["kind"])]
        *state, waiting = self._load()
        if state[0] != "blocked" and new:
            self._keep(*state, waiting + new)
        yield pd.DataFrame({"job_id": [], "at": [], "status": [], "failures": []}).astype({"job_id": "int64", "at": "int64", "status": "object", "failures": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        status, started, last, failures, wake, waiting = self._load()
        waiting.sort()
        passed, later = [w for w in waiting if w[0] <= now], [w for w in waiting if w[0] > now]
        out = []

        def move(at, to):
            nonlocal status, failures
            if to == "failed":
                failures += 1
                to = "blocked" if failures >= MOST_FAILURES else "pending"
            status = to
            out.append((at, to, failures))

        for at, _, kind in [*passed, (now, 0, "now")]:
            if status == "processing" and at > self._deadline(started, last):
                move(self._deadline(started, last), "failed")
            if status == "blocked":
                later = []
                break
            if kind == "claim":
                started = last = at
                move(at, "processing")
            elif status == "processing" and kind != "now":
                last = at
                if kind in ("done", "error"):
                    move(at, "completed" if kind == "done" else "failed")
        self._keep(status, started, last, failures, wake, later)
        yield pd.DataFrame({"job_id": [key[0]] * len(out), "at": [o[0] for o in out], "status": [o[1] for o in out], "failures": [o[2] for o in out]}).astype({"job_id": "int64", "at": "int64", "status": "object", "failures": "int32"})

    def close(self) -> None:
        pass


def follow(events: DataFrame, folder: str, timeout: int = 10, silent: int = 5, delay: str = "1 day") -> DataFrame:
    """The changes of `transitions` up to the watermark, by a stream over all that is there; a later call goes on where this one stopped.

    events: a stream as in `transitions`. The changes are appended to files in `folder`, each once, beside the stream's state.
    """
    spark: SparkSession = events.sparkSession
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROCKS)
    try:
        moves = _moves(events).withWatermark("ts", delay)
        changes = moves.groupBy("job_id").transformWithStateInPandas(Jobs(timeout, silent), OUT, "append", "eventTime")
        query = changes.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return _shown(spark.read.schema(OUT).parquet(f"{folder}/changes"))
