"""Registered queries that run streams over the driver's events to their end, and the batch form of their state."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.plans.catalogue import query
from reelspan.plans.catalogue_files import _KIND, STALLED
from reelspan.plans.views import prog_ev, with_views
from reelspan.shared import fresh_path
from reelspan.streaming import jobs

DELAY_MS = 10_000
#: Longer than any log.
KEEP_MS = 1 << 50
_WITH_ERRORS = _KIND.replace("CASE ", "CASE WHEN seq%55=0 THEN 'error' ", 1)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drained(rows: DataFrame, name: str) -> DataFrame:
    """What a stream gives until its source has no more, with the number of the batch as ``_batch``."""
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, name)

    def write(batch: DataFrame, n: int) -> None:
        # By number, so that a batch that is tried again replaces itself.
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/rows/n={n}")

    with _settings(spark, jobs.STATE_STORE):
        rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _batch int, n int").option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("n")


def _log(spark: SparkSession, d: str, stream: bool) -> DataFrame:
    """Progress events with kinds and messages, read as a stream or as a table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{d}/events.parquet"
    # As a pattern: a plain path has to be a folder for a stream.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/[e]vents.parquet") if stream else None
    return prog_ev(spark, d, rows).withColumn("t", F.expr(_WITH_ERRORS)).withColumn("message", F.concat(F.lit("m"), F.col("seq").cast("string")))


_STATE = f"""SELECT job, arg_max(stage,(ms,seq)) FILTER (t='progress' AND stage IS NOT NULL) AS stage, arg_max(fraction,(ms,seq)) FILTER (t='progress') AS fraction, arg_max('m'||seq,(ms,seq)) FILTER (t='progress') AS message,
CASE arg_max(t,(ms,seq)) FILTER (t IN ('progress','done','error')) WHEN 'done' THEN 'ok' WHEN 'error' THEN 'falhou' END AS outcome, CASE WHEN arg_max(t,(ms,seq)) FILTER (t IN ('progress','done','error'))='error' THEN arg_max('m'||seq,(ms,seq)) FILTER (t='error') END AS reason,
min(ms) AS started_ms, max(ms) AS last_ms, CAST(coalesce(sum(CASE WHEN t='pause' THEN coalesce(nx, last)-ms END),0) AS BIGINT) AS paused_ms FROM (
SELECT *, lead(CASE WHEN t IN ('pause','resume') THEN ms END IGNORE NULLS) OVER (PARTITION BY job ORDER BY ms, seq) AS nx, max(ms) OVER (PARTITION BY job) AS last FROM log) GROUP BY job"""
_ETA = "SELECT *, CASE WHEN outcome IS NULL AND fraction>=0.08 AND fraction<1 THEN CAST(floor(elapsed_ms/fraction-elapsed_ms+0.5) AS BIGINT) END AS eta_ms FROM (SELECT *, last_ms-started_ms-paused_ms AS elapsed_ms FROM (" + _STATE + "))"


def _state_sql(passed: str) -> str:
    log = f"SELECT * FROM (SELECT *, epoch_us(ts)//1000 AS ms, {_WITH_ERRORS} AS t FROM prog_ev) WHERE {passed}"
    return with_views("SELECT * FROM (" + _ETA + ")", "prog_ev").replace(" SELECT * FROM (SELECT *, CASE", f", log AS ({log}) SELECT * FROM (SELECT *, CASE", 1)


@query(_state_sql("true"))
def job_state(spark, d):
    """Stage, outcome and time left of every job, pauses aside."""
    return jobs.job_states(_log(spark, d, stream=False), ["seq"])


_PASSED = f"ms <= (SELECT max(epoch_us(ts)//1000) FROM prog_ev) - {DELAY_MS}"


@query(_state_sql(_PASSED))
def job_state_stream(spark, d):
    """The same by a stream over the events, as far as the watermark has come when they end."""
    states = jobs.job_states_stream(_log(spark, d, stream=True), f"{DELAY_MS} milliseconds", KEEP_MS)
    return jobs.newest(drained(states, "job-states"))


@query(with_views(f"SELECT * FROM ({STALLED}) WHERE last_ms + limit_ms < (SELECT max(epoch_us(ts)//1000) FROM prog_ev) - {DELAY_MS}", "prog_ev").replace(_KIND, _WITH_ERRORS))
def stalled_jobs_stream(spark, d):
    """``stalled_jobs`` by timers of a stream: those whose deadline the watermark has passed when the events end."""
    return drained(jobs.stalls_stream(_log(spark, d, stream=True), f"{DELAY_MS} milliseconds", KEEP_MS), "stalls").drop("_batch")
