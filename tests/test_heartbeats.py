"""Jobs as state with timers: the stream and the windows against a plain walk over each job's events."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import heartbeats

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, job_id long, kind string"
TIMEOUT, SILENT = 10, 5


def walk(events, until):
    out = []
    for job in {e[2] for e in events if e[2] is not None}:
        status, started, last, failures = "pending", None, None, 0
        own = sorted((e[1], e[0], e[3]) for e in events if e[2] == job and e[1] is not None and e[1] <= until)
        for at, _, kind in [*own, (until, 0, "")]:
            if status == "processing":
                deadline = max(started + timedelta(minutes=TIMEOUT), last + timedelta(minutes=SILENT))
                if at > deadline:
                    failures += 1
                    status = "blocked" if failures >= 3 else "pending"
                    out.append((job, deadline, status, failures))
            if status == "blocked":
                break
            if kind == "claim":
                status, started, last = "processing", at, at
            elif status == "processing" and kind in ("done", "error"):
                failures += kind == "error"
                status = "completed" if kind == "done" else "blocked" if failures >= 3 else "pending"
            else:
                last = at if status == "processing" and kind else last
                continue
            out.append((job, at, status, failures))
    return sorted(out)


def said(df):
    return sorted((r.job_id, r.at, r.status, r.failures) for r in df.collect())


def made():
    rng = random.Random(3)
    events, at = [], START
    for i in range(900):
        at += timedelta(seconds=rng.choice([0, 5, 20, 40]))
        events.append((i, at, rng.randrange(12) if rng.random() < 0.7 else 99, rng.choices(["claim", "beat", "done", "error"], [3, 8, 2, 1])[0]))
    # A job whose worker falls silent, exact deadlines, and rows that can't be placed.
    events += [(1000, START, 50, "claim"), (1001, START, 51, "claim"), (1002, START + timedelta(minutes=10), 51, "beat"), (1003, START + timedelta(minutes=15), 51, "done")]
    events += [(1004, None, 50, "done"), (1005, START, None, "claim"), (1006, START, 52, None), (1007, START, 53, "done")]
    return events, at


def test_windows_are_a_walk(spark):
    events, end = made()
    df = spark.createDataFrame(events, SCHEMA)
    for until in (START, START + timedelta(hours=1), end):
        assert said(heartbeats.transitions(df, F.lit(until), TIMEOUT, SILENT)) == walk(events, until)
    assert heartbeats.transitions(df.where("false"), F.lit(end)).count() == 0


def test_a_stream_in_parts_is_a_walk(spark, tmp_path):
    """The files come one by one, in two calls, with rows out of order within the delay."""
    events, end = made()
    rng = random.Random(9)
    events.sort(key=lambda e: (e[1] or START) + timedelta(minutes=rng.uniform(0, 4)))
    folder = tmp_path / "events"
    folder.mkdir()
    size = -(-len(events) // 4)
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for n in range(4):
        spark.createDataFrame(events[n * size : (n + 1) * size], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/part-{n}")
        file = next((tmp_path / f"part-{n}").glob("*.parquet"))
        file.rename(folder / f"file-{n}.parquet")
        os.utime(folder / f"file-{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
        if n in (1, 3):
            got = said(heartbeats.follow(read(), f"{tmp_path}/jobs", TIMEOUT, SILENT, "5 minutes"))
            until = max(e[1] for e in events[: (n + 1) * size] if e[1]) - timedelta(minutes=5)
            assert got == walk(events[: (n + 1) * size], until)


def test_a_job_takes_few_round_trips():
    """Each call to the state is one: a job's events took seven of them, its timer ten."""
    import pandas as pd

    calls, at = [], 1_700_000_000_000_000

    class Value:
        def __init__(self):
            self.kept = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("update", "put"):
                    self.kept = args[0]
                if name == "appendList":
                    self.kept = [*(self.kept or []), *args[0]]
                return self.kept is not None if name == "exists" else iter([self.now]) if name == "listTimers" else self.kept

            return call

    class Handle(Value):
        now = at // 1000
        getValueState = getListState = lambda self, *_: Value()

    class Times:
        def getCurrentWatermarkInMs(self):
            return at // 1000 + 60_000

    jobs = heartbeats.Jobs(TIMEOUT, SILENT)
    jobs.init(Handle())
    list(jobs.handleInputRows((1,), iter([pd.DataFrame({"at": [at, at + 1_000_000], "event_id": [1, 2], "kind": ["claim", "beat"]})]), None))
    assert calls == ["get", "registerTimer", "update"]
    out = pd.concat(jobs.handleExpiredTimer((1,), Times(), None))
    assert out.values.tolist() == [[1, at, "processing", 0]]
    assert calls[3:] == ["get", "deleteTimer", "registerTimer", "update"]
