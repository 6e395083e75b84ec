"""Incremental processing: fingerprints, job keys, and a ledger that says which stages are done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages in order.
STAGES = ("probe", "extract", "vad", "asr", "align", "diarize", "render")
FORMAT_VERSION, TTL_DAYS = 1, 7


def fingerprint(columns: list[str]) -> Column:
    """16 hex digits of the SHA-256 of the columns, by name, as JSON; nulls are left out."""
    return F.left(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256), F.lit(16))


def job_key(sha: Column | str, print_: Column | str) -> Column:
    """Content hash prefix and options fingerprint."""
    sha, print_ = (F.col(c) if isinstance(c, str) else c for c in (sha, print_))
    return F.concat(F.left(sha, F.lit(16)), F.lit("-"), print_)


def stage_index(stage: Column | str) -> Column:
    """Place of a stage from 0; -1 for an unknown one."""
    stage = F.col(stage) if isinstance(stage, str) else stage
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage), F.lit(0)).cast("int") - 1


def valid_rows(ledger: DataFrame, now: Column, ttl_days: int = TTL_DAYS, payload: str | None = None) -> DataFrame:
    """Rows of this format, no older than the time to live, and, with ``payload``, whose saved JSON can be read."""
    ok = (F.col("format_version") == FORMAT_VERSION) & (F.col("saved_at") >= now - F.expr(f"interval {ttl_days} days"))
    return ledger.filter(ok & (F.try_parse_json(payload).isNotNull() if payload else F.lit(True)))


def latest_rows(ledger: DataFrame, order: list[str]) -> DataFrame:
    """The newest row of each job."""
    place = F.row_number().over(Window.partitionBy("job_key").orderBy(*[F.desc(c) for c in order]))
    return ledger.withColumn("_place", place).filter("_place = 1").drop("_place")


def resume_plan(jobs: DataFrame, ledger: DataFrame, order: list[str], now: Column | None = None, payload: str | None = None) -> DataFrame:
    """(job_key, done_through, stage, stage_no): stages still to run for each job (job_key, diarize_key).

    A job whose saved diarization has another fingerprint goes back to 'align'. With ``now``, only
    valid rows of the ledger count; a job without any starts over.
    """
    ledger = ledger if now is None else valid_rows(ledger, now, payload=payload)
    saved = latest_rows(ledger, order).select("job_key", "stage", F.col("diarize_key").alias("_key"))
    rows = jobs.join(saved, "job_key", "left")
    stale = (F.col("stage") == "diarize") & (F.coalesce("_key", F.lit("")) != "") & (F.col("_key") != F.col("diarize_key"))
    done = F.when(F.col("stage").isNull(), F.lit(-1)).when(stale, F.lit(STAGES.index("align"))).otherwise(stage_index("stage"))
    planned = rows.select("job_key", done.alias("done_through"), F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("stage_no", "todo"))
    return planned.filter(F.col("stage_no") > F.col("done_through")).select("job_key", "done_through", F.col("todo").alias("stage"), "stage_no")


def purge(ledger: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Rows within the time to live."""
    return ledger.filter(F.col("saved_at") >= now - F.expr(f"interval {ttl_days} days"))


def purged(ledger: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """(removed, kept): how many rows a purge takes away and leaves."""
    old = F.col("saved_at") < now - F.expr(f"interval {ttl_days} days")
    return ledger.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


def clear_done(ledger: DataFrame, completed: DataFrame) -> DataFrame:
    return ledger.join(completed.select("job_key").distinct(), "job_key", "left_anti")


def interrupted(ledger: DataFrame, order: list[str], attempts: DataFrame | None = None, sources: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """(job_key, source, stage, saved_at, n_segments, attempts) of every job that is still in the ledger.

    ``attempts`` (job_key) has a row per attempt, ``sources`` (job_key, source) the file's name, ``segments``
    (job_key) the saved segments; what isn't given is null, or 0 for counts.
    """
    rows = latest_rows(ledger, order).select("job_key", "stage", "saved_at")
    for table, name in ((attempts, "attempts"), (segments, "n_segments")):
        counted = table.groupBy("job_key").agg(F.count("*").alias(name)) if table is not None else None
        rows = rows.join(counted, "job_key", "left") if counted is not None else rows.withColumn(name, F.lit(None).cast("bigint"))
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    rows = rows.join(sources.select("job_key", "source"), "job_key", "left") if sources is not None else rows.withColumn("source", F.lit(None).cast("string"))
    return rows.select("job_key", "source", "stage", "saved_at", "n_segments", "attempts")
