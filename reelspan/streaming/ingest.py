"""New result documents taken into history and coverage tables, each once, whatever fails in between.

A batch of the stream writes its segments and coverage under its own number, so that a batch that is tried
again replaces what its first try has left; the history, which is one small table, is committed with the batch's
number and takes each number once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelspan.operators.history import KEPT, entries_from_results
from reelspan.operators.intervals import coverage_summary
from reelspan.sources.readers import result_segments
from reelspan.sources.sinks import append_history
from reelspan.streaming.progress import watch_results

STREAM = "results"


def recordings_of(results: DataFrame) -> DataFrame:
    """(rec_id, duration in ms) of readable documents; null where the probe has none."""
    return results.filter("readable").select("rec_id", F.bround(F.col("probe.duration") * 1000).cast("bigint").alias("duration"))


def coverage_of(results: DataFrame, segments: DataFrame) -> DataFrame:
    """Coverage (rec_id, analyzed, ratio, n_gaps, gap_seconds): as the document says, else worked out from its segments with no known silence."""
    none = segments.select("rec_id", "st", "en").limit(0)
    worked = coverage_summary(segments, none, recordings_of(results)).select("rec_id", "analyzed", "ratio", "n_gaps", "gap_seconds")
    said = results.filter("readable").select("rec_id", F.col("coverage").alias("c"))
    own = lambda field, other: F.coalesce(F.col(f"c.{field}"), F.col(other))
    gaps = F.when(F.col("c.gaps").isNotNull(), F.size("c.gaps")).otherwise(F.col("n_gaps")).cast("bigint")
    return worked.join(said, "rec_id").select("rec_id", own("analyzed", "analyzed").alias("analyzed"), own("ratio", "ratio").alias("ratio"), gaps.alias("n_gaps"), own("gap_seconds", "gap_seconds").alias("gap_seconds"))


def history_rows(results: DataFrame, coverage: DataFrame, segments: DataFrame) -> DataFrame:
    """History rows of readable documents."""
    p = "processing"
    runs = results.filter("readable").select(
        F.col("rec_id"), F.col("rec_id").alias("run_id"), F.col(f"{p}.finished_at").alias("finished_at"), F.col("source.name").alias("file_name"), F.col("source.path").alias("input_path"),
        F.col("probe.duration").alias("duration"), F.col(f"{p}.model").alias("model"), F.col(f"{p}.device").alias("device"), F.col(f"{p}.realtime_factor").alias("realtime_factor"),
        F.coalesce(F.size("partial_failures"), F.lit(0)).alias("failures"), F.coalesce("summary.available", F.lit(False)).alias("summarized"), F.col("outputs")["report"].alias("report_path"),
        F.col("outputs")["transcript"].alias("transcript_path"),
    )
    return entries_from_results(runs, coverage, segments).drop("rec_id")


def take_in(batch: DataFrame, number: int, out: str, keep: int = KEPT) -> None:
    """Write one batch of documents (as ``readers.read_results`` gives) under ``out``: segments and coverage by number, then the history."""
    spark = batch.sparkSession
    result_segments(batch).write.mode("overwrite").parquet(f"{out}/segments/batch={number}")
    segments = spark.read.parquet(f"{out}/segments/batch={number}")
    coverage_of(batch, segments).write.mode("overwrite").parquet(f"{out}/coverage/batch={number}")
    coverage = spark.read.parquet(f"{out}/coverage/batch={number}")
    append_history(history_rows(batch, coverage, segments), f"{out}/history", keep, batch=(STREAM, number))


def follow_results(spark: SparkSession, folder: str, out: str, checkpoint: str, keep: int = KEPT) -> StreamingQuery:
    """Take in what has come to ``folder`` since the last run with this checkpoint; ends when there is no more."""
    return watch_results(spark, folder, lambda batch, number: take_in(batch, number, out, keep), checkpoint)
