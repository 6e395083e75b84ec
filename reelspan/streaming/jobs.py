"""Jobs followed by keyed state with event-time timers: stalls whose clock pauses stop, live state with an outcome.

Events of a job wait until the watermark has passed them and are then taken in order, so the
streams give what ``progress.stalled_sessions_batch`` and ``job_states`` give for the same log, in
whatever order the files arrive. A timer wakes a job at its next waiting event, at the deadline of its stall,
and at the end of its time to live, when all its state goes. All of a job's state is one value, read and
written once a call. The session needs Spark's RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelspan.streaming.progress import LEAST_FRACTION, STALL_ASR_S, STALL_S, millis, paused_time

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
TERMINAL = {"done": "ok", "error": "falhou"}
REASON_CHARS = 500
STALLS = "job {job}, session_no bigint, first_ms bigint, last_ms bigint, n_events bigint, limit_ms bigint"
STATES = "job {job}, stage string, fraction double, message string, outcome string, reason string, started_ms bigint, last_ms bigint, paused_ms bigint, elapsed_ms bigint, eta_ms bigint"


def names_of(schema: str) -> list[str]:
    return [f.strip().split()[0] for f in schema.split(",")]


class Ordered(StatefulProcessor):
    """Takes a job's events in order of (ms, seq) once the watermark has passed them.

    A subclass names its fields (``FOLD``, their schema, and ``FIRST``, their values before any event), what it
    uses of an event besides ms and seq (``EVENT``) and the columns of its rows (``OUT``, the job first), and gives
    ``step`` (one event) and ``idle`` (the watermark alone), both of which change the fields and return rows;
    ``deadline`` is when ``idle`` has something to do next.
    """

    FOLD = OUT = ""
    FIRST: tuple = ()
    EVENT: tuple = ()

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names, self.row = names_of(self.FOLD), Row(*names_of(self.OUT))
        # Every call of the handle goes to the JVM and back, which takes longer than the events do: one value holds the
        # fields, the events that wait (as JSON) and the time of the timer.
        self.held = handle.getValueState("held", f"{self.FOLD}, waiting string, timer bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # The event is the last column of a row.
        yield from self.advance(key, [r[-1] for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def advance(self, key, come: list[str], watermark: int, fired: int | None = None) -> Iterator[Row]:
        *held, waiting, timer = self.held.get() or (*self.FIRST, None, None)
        events = json.loads(f"[{','.join([*([waiting] if waiting else []), *come])}]")
        events.sort(key=lambda e: (e["ms"], e.get("seq", -1)))
        ready, later = [e for e in events if e["ms"] <= watermark], [e for e in events if e["ms"] > watermark]
        state, out = dict(zip(self.names, held)), []
        for event in ready:
            out += self.step(state, event)
        out += self.idle(state, watermark)
        end = state["last_ms"] + self.keep_ms if state["last_ms"] is not None else None
        if not later and (end is None or watermark > end):
            wake = None
            self.held.clear()
        else:
            wake = max(min(t for t in (later[0]["ms"] if later else None, self.deadline(state), end) if t is not None) + 1, watermark + 1)
            self.held.update((*(state[n] for n in self.names), json.dumps(later)[1:-1] if later else None, wake))
        if wake != timer:
            if timer not in (None, fired):  # Spark deletes the one that fired
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        yield from (self.row(*key, *r) for r in self.rows(out, state, bool(ready)))

    def rows(self, out: list[tuple], state: dict, moved: bool) -> list[tuple]:
        return out

    def step(self, state: dict, event: dict) -> list[tuple]:
        """An event as JSON gives it: what is null isn't there."""
        raise NotImplementedError

    def idle(self, state: dict, watermark: int) -> list[tuple]:
        return []

    def deadline(self, state: dict) -> int | None:
        return None

    def close(self) -> None:
        pass


def limit_of(stage: str | None) -> int:
    return (STALL_ASR_S if stage == "asr" else STALL_S) * 1000


class Stalls(Ordered):
    """Sessions that end without 'done' or 'error', each once: when its deadline has passed."""

    OUT, EVENT = STALLS, ("t", "stage")
    FOLD = "session_no bigint, first_ms bigint, last_ms bigint, n_events bigint, limit_ms bigint, stage string, paused boolean, ended boolean, told boolean"
    FIRST = (0, None, None, 0, STALL_S * 1000, None, False, False, False)

    def step(self, s: dict, e: dict) -> list[tuple]:
        out = []
        if s["last_ms"] is not None and not s["paused"] and e["ms"] - s["last_ms"] > s["limit_ms"]:
            out = self.stall(s)
            s.update(session_no=s["session_no"] + 1, first_ms=None, n_events=0, ended=False, told=False)
        kind = e.get("t")
        if kind == "progress" and "stage" in e:
            s["stage"] = e["stage"]
        s.update(first_ms=e["ms"] if s["first_ms"] is None else s["first_ms"], last_ms=e["ms"], n_events=s["n_events"] + 1, limit_ms=limit_of(s["stage"]))
        s["ended"] = s["ended"] or kind in TERMINAL
        s["paused"] = kind == "pause" or s["paused"] and kind != "resume"
        return out

    def stall(self, s: dict) -> list[tuple]:
        if s["ended"] or s["told"]:
            return []
        s["told"] = True
        return [tuple(s[n] for n in ("session_no", "first_ms", "last_ms", "n_events", "limit_ms"))]

    def idle(self, s: dict, watermark: int) -> list[tuple]:
        due = self.deadline(s)
        return self.stall(s) if due is not None and watermark > due else []

    def deadline(self, s: dict) -> int | None:
        """None while the job is paused, has ended, or has been told of."""
        return None if s["last_ms"] is None or s["paused"] or s["ended"] or s["told"] else s["last_ms"] + s["limit_ms"]


class States(Ordered):
    """The newest state of each job, whenever events have moved it."""

    OUT, EVENT = STATES, ("t", "stage", "fraction", "message")
    FOLD = "stage string, fraction double, message string, outcome string, reason string, started_ms bigint, last_ms bigint, paused_ms bigint, paused_at bigint"
    FIRST = (None, None, None, None, None, None, None, 0, None)

    def step(self, s: dict, e: dict) -> list[tuple]:
        kind = e.get("t")
        s.update(started_ms=e["ms"] if s["started_ms"] is None else s["started_ms"], last_ms=e["ms"])
        if s["paused_at"] is not None and kind in ("pause", "resume"):
            s.update(paused_ms=s["paused_ms"] + e["ms"] - s["paused_at"], paused_at=None)
        if kind == "pause":
            s["paused_at"] = e["ms"]
        elif kind == "progress":
            # JSON has NaN and infinities as text.
            s.update(stage=e.get("stage", s["stage"]), fraction=float(e["fraction"]) if "fraction" in e else None, message=e.get("message"), outcome=None, reason=None)
        elif kind in TERMINAL:
            s.update(outcome=TERMINAL[kind], reason=e.get("message", "")[:REASON_CHARS] if kind == "error" else None)
        return []

    def rows(self, out: list[tuple], s: dict, moved: bool) -> list[tuple]:
        if not moved:
            return []
        paused = s["paused_ms"] + (s["last_ms"] - s["paused_at"] if s["paused_at"] is not None else 0)
        elapsed, f = s["last_ms"] - s["started_ms"] - paused, s["fraction"]
        left = int(elapsed / f - elapsed + 0.5) if s["outcome"] is None and f is not None and LEAST_FRACTION <= f < 1 else None
        return [(*(s[n] for n in ("stage", "fraction", "message", "outcome", "reason", "started_ms", "last_ms")), paused, elapsed, left)]


def job_states(events: DataFrame, order: list[str]) -> DataFrame:
    """Batch: one row per job of a log (job, ts, t, stage, fraction, message and ``order``).

    stage is the last that a 'progress' event named; fraction and message are those of the last such event. outcome is
    'ok' after 'done', 'falhou' after 'error' (reason: its message, cut), null while no such event has come, or progress
    has come since. elapsed_ms leaves out pauses; eta_ms is null as in ``progress.eta``, and once a job has ended.
    """
    at = F.struct(millis("ts").alias("ms"), *order)
    message = F.col("message") if "message" in events.columns else F.lit(None).cast("string")
    rows = events.select("job", "t", "stage", "fraction", message.alias("message"), millis("ts").alias("ms"), at.alias("at"))
    is_progress = F.col("t") == "progress"
    last = rows.groupBy("job").agg(
        F.max_by("stage", F.when(is_progress & F.col("stage").isNotNull(), F.col("at"))).alias("stage"),
        F.max_by(F.struct("fraction", "message"), F.when(is_progress, F.col("at"))).alias("p"),
        F.max_by(F.struct("t", "message"), F.when(is_progress | F.col("t").isin(*TERMINAL), F.col("at"))).alias("e"),
        F.min("ms").alias("started_ms"), F.max("ms").alias("last_ms"),
    ).join(paused_time(events, order), "job", "left")
    outcome = F.when(F.col("e.t") == "done", TERMINAL["done"]).when(F.col("e.t") == "error", TERMINAL["error"])
    reason = F.when(F.col("e.t") == "error", F.substring(F.coalesce("e.message", F.lit("")), 1, REASON_CHARS))
    paused = F.coalesce("paused_ms", F.lit(0)).cast("bigint")
    out = last.select("job", "stage", "p.fraction", "p.message", outcome.alias("outcome"), reason.alias("reason"), "started_ms", "last_ms", paused.alias("paused_ms"))
    out = out.withColumn("elapsed_ms", F.col("last_ms") - F.col("started_ms") - F.col("paused_ms"))
    known = F.col("outcome").isNull() & (F.col("fraction") >= LEAST_FRACTION) & (F.col("fraction") < 1)
    return out.withColumn("eta_ms", F.when(known, F.floor(F.col("elapsed_ms") / F.col("fraction") - F.col("elapsed_ms") + 0.5).cast("bigint")))


def _followed(events: DataFrame, processor: Ordered, delay: str) -> DataFrame:
    seq = F.col("seq").cast("bigint") if "seq" in events.columns else F.lit(None).cast("bigint")
    message = F.col("message") if "message" in events.columns else F.lit(None).cast("string")
    rows = events.select("job", F.col("ts").cast("timestamp").alias("ts"), "t", "stage", F.col("fraction").cast("double").alias("fraction"), message.alias("message"), seq.alias("seq"))
    rows = rows.filter(F.col("job").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay).withColumn("ms", millis("ts"))
    kind = events.schema["job"].dataType.simpleString()
    # An event goes to Python as one text, since every column of a row is converted by itself; the time goes with it, as Spark
    # leaves out by it what comes too late.
    grouped = rows.select("job", "ts", F.to_json(F.struct("ms", "seq", *processor.EVENT), {"ignoreNullFields": "true"}).alias("event")).groupBy("job")
    return grouped.transformWithState(statefulProcessor=processor, outputStructType=processor.OUT.format(job=kind), outputMode="Append", timeMode="EventTime")


def stalls_stream(events: DataFrame, delay: str = "10 seconds", keep_ms: int = 86_400_000) -> DataFrame:
    """Streaming: (job, session_no, first_ms, last_ms, n_events, limit_ms) of each stall, once its deadline has passed the watermark.

    While a job is paused its clock stands still and it can't stall. ``delay`` is how late events may come; a job without
    events for ``keep_ms`` is forgotten, and its sessions are numbered from 0 if it comes back. Events without a job or a time are left out.
    """
    return _followed(events, Stalls(keep_ms), delay)


def job_states_stream(events: DataFrame, delay: str = "10 seconds", keep_ms: int = 86_400_000) -> DataFrame:
    """Streaming: ``job_states`` of each job that events have moved, batch by batch; the newest row of a job counts.

    State is kept for jobs with an event in the last ``keep_ms``, whether they have ended or not.
    """
    return _followed(events, States(keep_ms), delay)


def newest(states: DataFrame) -> DataFrame:
    """The row of most progress of every job among those that ``job_states_stream`` has given."""
    w = Window.partitionBy("job").orderBy(F.col("last_ms").desc(), F.col("_batch").desc())
    return states.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_batch")
