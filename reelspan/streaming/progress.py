"""Progress events as streams: latest state, stalls, time left, stage changes, new results. Batch forms share the code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.tolerant import clamp
from reelspan.schemas import RESULT_DOCUMENT

STALL_S, STALL_ASR_S, LEAST_FRACTION = 300, 900, 0.08
# Share of the whole job before and after each stage, in percent.
STAGE_SPANS = {"probe": (0, 5), "extract": (5, 12), "vad": (12, 20), "asr": (20, 80), "align": (80, 85), "diarize": (85, 91), "render": (91, 100)}


def millis(c: Column | str) -> Column:
    return F.unix_millis((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def latest_progress(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(job, stage, fraction, message, ts, started): the newest event of each job, by ts and ``order``."""
    key = F.struct("ts", *(order or []))
    message = F.col("message") if "message" in events.columns else F.lit(None).cast("string")
    return events.groupBy("job").agg(F.max_by(F.struct("stage", "fraction", message.alias("message"), "ts"), key).alias("e"), F.min("ts").alias("started")).select("job", "e.*", "started")


def eta(latest: DataFrame, paused_ms: Column | None = None) -> DataFrame:
    """Adds elapsed_ms (pauses aside) and eta_ms: elapsed / fraction - elapsed; null below 8 % and at 100 %."""
    elapsed = millis("ts") - millis("started") - (paused_ms if paused_ms is not None else F.lit(0))
    known = (F.col("fraction") >= LEAST_FRACTION) & (F.col("fraction") < 1)
    left = F.round(elapsed / F.col("fraction") - elapsed).cast("bigint")
    return latest.withColumn("elapsed_ms", elapsed).withColumn("eta_ms", F.when(known, left))


def stalled_sessions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming: sessions of a job's events that closed without a terminal event.

    A session closes 300 s after its last event, 900 s in stage 'asr', once the watermark has passed.
    """
    gap = F.when(F.col("stage") == "asr", F.lit(f"{STALL_ASR_S} seconds")).otherwise(F.lit(f"{STALL_S} seconds"))
    rows = events.withWatermark("ts", delay).groupBy("job", F.session_window("ts", gap).alias("w"))
    ended = F.max(F.col("t").isin("done", "error"))
    return rows.agg(F.count("*").alias("n_events"), ended.alias("ended")).filter("not ended").select("job", "w.start", "w.end", "n_events")


def stall_sessions_batch(events: DataFrame, order: list[str]) -> DataFrame:
    """(job, session_no, first_ms, last_ms, n_events): sessions of a finished log, those that ended well among them."""
    w = Window.partitionBy("job").orderBy("ts", *order)
    limit = F.when(F.lag("stage").over(w) == "asr", STALL_ASR_S * 1000).otherwise(STALL_S * 1000)
    new = F.when(millis("ts") - F.lag(millis("ts")).over(w) > limit, 1).otherwise(0)
    cut = events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("job", "session_no").agg(F.min(millis("ts")).alias("first_ms"), F.max(millis("ts")).alias("last_ms"), F.count("*").alias("n_events"))


def stalled_sessions_batch(events: DataFrame, order: list[str]) -> DataFrame:
    """(job, session_no, first_ms, last_ms, n_events, limit_ms): sessions of a finished log (job, ts, t, stage) that ended in a stall.

    A session is over once the next event is later than its stage allows, or no event follows; it is no
    stall if it holds 'done' or 'error'. While a job is paused its clock stands still: time from
    'pause' to 'resume' (or to the job's last event) doesn't count, and a job that stays paused has not stalled.
    """
    w = Window.partitionBy("job").orderBy("ts", *order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # Rows 'pause' and 'resume' are marks; whether a row lies in a pause is known from the last mark before it.
    mark = F.last(F.when(F.col("t").isin("pause", "resume"), F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    waited = F.when(mark.eqNullSafe(F.lit("pause")), 0).otherwise(millis("ts") - F.lag(millis("ts")).over(w))
    paused = F.last(F.when(F.col("t").isin("pause", "resume"), F.col("t")), ignorenulls=True).over(so_far).eqNullSafe(F.lit("pause"))
    rows = events.withColumn("_waited", waited).withColumn("_paused", paused).withColumn("_stage", F.last(F.when(F.col("t") == "progress", F.col("stage")), ignorenulls=True).over(so_far))
    limit = F.when(F.col("_stage") == "asr", STALL_ASR_S * 1000).otherwise(STALL_S * 1000)
    rows = rows.withColumn("_limit", limit)
    new = F.when(F.col("_waited") > F.lag("_limit").over(w), 1).otherwise(0)
    cut = rows.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(so_far))
    sessions = cut.groupBy("job", "session_no").agg(
        F.min(millis("ts")).alias("first_ms"), F.max(millis("ts")).alias("last_ms"), F.count("*").alias("n_events"),
        F.max_by("_limit", F.struct("ts", *order)).cast("bigint").alias("limit_ms"), F.max(F.col("t").isin("done", "error")).alias("_ended"),
        F.max_by("_paused", F.struct("ts", *order)).alias("_paused"),
    )
    return sessions.filter("not _ended and not _paused").drop("_ended", "_paused")


def stage_changes(events: DataFrame, order: list[str]) -> DataFrame:
    """Only the events whose stage differs from the one before."""
    w = Window.partitionBy("job").orderBy("ts", *order)
    return events.withColumn("_last", F.lag("stage").over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col("stage").eqNullSafe(F.col("_last"))).drop("_last", "_n")


def stage_changes_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming: the first event of each stage of a job within the watermark; a stage that comes back soon is not repeated."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job", "stage"])


def paused_time(events: DataFrame, order: list[str]) -> DataFrame:
    """(job, paused_ms): from each 'pause' to the job's next event of kind 'resume', or to its last event."""
    w = Window.partitionBy("job").orderBy("ts", *order)
    marks = events.filter(F.col("t").isin("pause", "resume"))
    until = F.lead("ts").over(w)
    last = events.groupBy("job").agg(F.max("ts").alias("_last"))
    spans = marks.withColumn("_until", until).filter("t = 'pause'").join(last, "job")
    return spans.groupBy("job").agg(F.sum(millis(F.coalesce("_until", "_last")) - millis("ts")).alias("paused_ms"))


def overall_fraction(stage: Column | str = "stage", fraction: Column | str = "fraction") -> Column:
    """Fraction of the whole job, from the stage's own fraction and the share it has."""
    stage, fraction = (F.col(c) if isinstance(c, str) else c for c in (stage, fraction))
    low = F.create_map(*[F.lit(x) for s, (a, _) in STAGE_SPANS.items() for x in (s, a)])[stage]
    high = F.create_map(*[F.lit(x) for s, (_, b) in STAGE_SPANS.items() for x in (s, b)])[stage]
    return F.round((low + clamp(fraction, 0.0, 1.0) * (high - low)) / 100.0, 6)


def watch_results(spark, folder: str, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Take in new result documents of a folder, once each; ``each`` gets every batch and its number."""
    reader = spark.readStream.schema(RESULT_DOCUMENT + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    docs = reader.json(folder).withColumn("rec_id", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\.data)?\.json$", ""))
    docs = docs.withColumn("readable", F.col("_bad").isNull() | F.col("segments").isNotNull()).drop("_bad")
    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
