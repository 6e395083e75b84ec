"""Streams of job events against their batch forms, across restarts and late files."""

import json
import random
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from reelspan.streaming import jobs, progress

SCHEMA = "job string, ts timestamp, t string, stage string, fraction double, message string, seq bigint"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(autouse=True)
def state_store(spark):
    for k, v in jobs.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in jobs.STATE_STORE:
        spark.conf.unset(k)


def event(job, s, t="progress", stage=None, fraction=None, message=None, seq=0):
    return {"job": job, "ts": (START + timedelta(seconds=s)).isoformat().replace("+00:00", "Z"), "t": t, "stage": stage, "fraction": fraction, "message": message, "seq": seq}


def log():
    rng, out = random.Random(7), []
    for j in range(12):
        s = rng.randrange(50)
        for n in range(rng.randrange(3, 25)):
            t = rng.choice(["progress"] * 8 + ["pause", "resume", "done", "error"])
            out.append(event(f"j{j}", s, t, rng.choice(["vad", "asr", None]) if t == "progress" else None, rng.random() if t == "progress" else None, f"m{n}", n))
            s += rng.choice([0, 1, 20, 290, 301, 500, 899, 901, 2000])
    out += [event("still", 0, "progress", "vad", 0.5), event("still", 10, "pause"), event("back", 0, "progress", "vad", 0.5), event("back", 10, "pause"), event("back", 9000, "resume"), event("back", 9100, "done")]
    return sorted(out, key=lambda e: (e["ts"], e["seq"]))


@contextmanager
def folder_of(tmp_path, rows):
    folder = tmp_path / "events"
    folder.mkdir()
    count = [0]

    def add(part):
        count[0] += 1
        (folder / f"{count[0]:03}.json").write_text("\n".join(map(json.dumps, part)))

    yield folder, add


def run(spark, folder, make, tmp_path, name):
    """Everything that has come so far, in one run that ends; later runs go on from the same checkpoint."""
    rows = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder)))

    def write(df, n):
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={n}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/check-{name}").trigger(availableNow=True).start().awaitTermination()


def result(spark, tmp_path, name):
    return spark.read.option("basePath", f"{tmp_path}/{name}").parquet(f"{tmp_path}/{name}/batch=*").drop("batch")


FAR = event("far", 10_000_000)


def test_streams_equal_batch_across_a_restart(spark, tmp_path):
    rows = log()
    with folder_of(tmp_path, rows) as (folder, add):
        cut = len(rows) // 3
        near = rows[cut : cut + 4][::-1]  # late within the delay, and out of order
        for k, part in enumerate([rows[:cut], near, rows[cut + 4 : 2 * cut], rows[2 * cut :], [FAR]]):
            add(part)
            if k in (1, 2, 4):
                run(spark, folder, lambda e: jobs.stalls_stream(e, "1 hour", keep_ms=1 << 40), tmp_path, "stalls")
                run(spark, folder, lambda e: jobs.job_states_stream(e, "1 hour", keep_ms=1 << 40), tmp_path, "states")
        batch = spark.read.schema(SCHEMA).json(str(folder)).filter("job <> 'far'")
    stalls = sorted(tuple(r) for r in result(spark, tmp_path, "stalls").drop("_batch").filter("job <> 'far'").collect())
    expected = sorted(tuple(r) for r in progress.stalled_sessions_batch(batch, ["seq"]).collect())
    assert stalls == expected and len(expected) > 8
    assert not any(r[0] in ("still", "back") for r in stalls)
    states = sorted(tuple(r) for r in jobs.newest(result(spark, tmp_path, "states")).filter("job <> 'far'").collect())
    wanted = sorted(tuple(r) for r in jobs.job_states(batch, ["seq"]).collect())
    assert states == wanted
    assert {r[4] for r in wanted} == {"ok", "falhou", None} and any(r[-1] for r in wanted)


def test_a_job_that_has_ended_keeps_its_stage(spark):
    rows = [event("a", 0, "progress", "asr", 0.5, "half"), event("a", 60, "done"), event("b", 0, "progress", "asr", 0.25, "x"), event("b", 10, "pause"), event("b", 110, "resume"), event("b", 120, "progress", None, 0.5, "y"), event("c", 0, "error", message="m" * 600)]
    df = spark.createDataFrame([{**r, "ts": datetime.fromisoformat(r["ts"])} for r in rows], SCHEMA)
    out = {r.job: r for r in jobs.job_states(df, ["seq"]).collect()}
    assert (out["a"].stage, out["a"].fraction, out["a"].message, out["a"].outcome, out["a"].eta_ms) == ("asr", 0.5, "half", "ok", None)
    assert (out["b"].stage, out["b"].outcome, out["b"].paused_ms, out["b"].elapsed_ms, out["b"].eta_ms) == ("asr", None, 100_000, 20_000, 20_000)
    assert (out["c"].outcome, len(out["c"].reason), out["c"].stage) == ("falhou", 500, None)
    assert jobs.job_states(df.limit(0), ["seq"]).count() == 0


def test_state_is_bounded(spark, tmp_path):
    with folder_of(tmp_path, []) as (folder, add):
        for day in range(4):
            add([event(f"d{day}-{i}", day * 200_000 + i, "done" if i % 2 else "progress", "vad", 0.5) for i in range(20)])
        add([FAR])
        rows = jobs.job_states_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder)), keep_ms=1000)
        q = rows.writeStream.foreachBatch(lambda df, n: df.count()).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        numbers = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(numbers) < 200 and numbers[-1] <= 6


class Handle:
    """A job's state and timers, and how often they were called."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_state_is_called_few_times_whatever_waits():
    handle, job = Handle(), jobs.Stalls(keep_ms=1_000_000)
    job.init(handle)
    text = [json.dumps({"ms": n * 1000, "seq": n, "t": "progress"}) for n in range(500)]
    assert list(job.advance(("a",), text[::-1], 0)) == [] and handle.calls == 3
    assert list(job.advance(("a",), [json.dumps({"ms": 600_000, "t": "progress"})], 0)) == [] and handle.calls == 5 and handle.timers == {1001}
    handle.timers.clear()  # fired
    rows = list(job.advance(("a",), [], 950_000, 1001))
    assert [tuple(r) for r in rows] == [("a", 0, 0, 600_000, 501, 300_000)] and handle.calls == 8
    assert handle.timers == {1_600_001} and handle.value[-2] is None
    handle.timers.clear()
    assert list(job.advance(("a",), [], 1_600_001, 1_600_001)) == [] and handle.value is None and not handle.timers and handle.calls == 10


def test_an_odd_fraction_stays():
    states = jobs.States(1)
    state = dict(zip(jobs.names_of(states.FOLD), states.FIRST))
    states.step(state, {"ms": 5, "t": "progress", "fraction": "NaN"})
    assert state["fraction"] != state["fraction"] and states.rows([], state, True)[0][-1] is None
    states.step(state, {"ms": 6, "t": "progress"})
    assert state["fraction"] is None and state["message"] is None
