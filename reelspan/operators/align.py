"""Segment boundaries: trimming to words, removing overlaps, normalising raw engine output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.text import strip
from reelspan.schemas import WORDS

MAX_SLACK_MS, MIN_LENGTH_MS = 2000, 80


def normalise_segments(raw: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Raw segments (rec, ord, start, end in seconds, text, words, scores) as table rows: trimmed text, whole ms, ids from 0.

    Words keep their order and text; their times become whole ms, their probability is rounded like the scores.
    """
    ms = lambda c: F.bround((F.col(c) if isinstance(c, str) else c) * 1000).cast("bigint")
    scores = [F.bround(F.col(c), 4).alias(c) for c in ("avg_logprob", "no_speech_prob", "compression_ratio") if c in raw.columns]
    if "temperature" in raw.columns:
        scores.append(F.col("temperature"))
    if "words" in raw.columns:
        word = lambda w: F.struct(w.word.alias("word"), ms(w.start).alias("st"), ms(w.end).alias("en"), F.bround(w.probability, 4).alias("probability"))
        scores.append(F.coalesce(F.transform("words", word), F.array().cast(WORDS)).alias("words"))
    number = F.row_number().over(Window.partitionBy(rec).orderBy("ord")) - 1
    return raw.select(rec, number.cast("bigint").alias("seg_id"), ms("start").alias("st"), ms("end").alias("en"), strip("text").alias("text"), *scores)


def from_windows(raw: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Offsets inside a window (win_st, win_en, rel_st, rel_en in ms) as file times; blank texts are dropped."""
    rows = raw.filter(strip("text") != "")
    st = F.col("win_st") + F.coalesce("rel_st", F.lit(0))
    en = F.col("win_st") + F.coalesce("rel_en", F.col("win_en") - F.col("win_st"))
    number = F.row_number().over(Window.partitionBy(rec).orderBy("win_st", "ord")) - 1
    return rows.select(rec, number.cast("bigint").alias("seg_id"), st.alias("st"), en.alias("en"), strip("text").alias("text"))


def align_trim(segments: DataFrame, words: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Shrink segments to their first and last word (by list order, words of some length only).

    An edge moves when the slack is above 0 and at most 2 s; nothing moves when under 80 ms would be left.
    """
    valid = words.filter("en > st").groupBy(rec, "seg_id").agg(F.min_by("st", "word_idx").alias("_first"), F.max_by("en", "word_idx").alias("_last"))
    rows = segments.join(valid, [rec, "seg_id"], "left")
    front, back = F.col("_first") - F.col("st"), F.col("en") - F.col("_last")
    st = F.when((front > 0) & (front <= MAX_SLACK_MS), F.col("_first")).otherwise(F.col("st"))
    en = F.when((back > 0) & (back <= MAX_SLACK_MS), F.col("_last")).otherwise(F.col("en"))
    moved = rows.withColumn("_st", st).withColumn("_en", en)
    ok = F.col("_en") - F.col("_st") >= MIN_LENGTH_MS
    return moved.withColumn("st", F.when(ok, F.col("_st")).otherwise(F.col("st"))).withColumn("en", F.when(ok, F.col("_en")).otherwise(F.col("en"))).drop("_first", "_last", "_st", "_en")


def align_overlaps(segments: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Move a segment's start to the end of the one before it, when they overlap and 80 ms remain.

    Only starts move and only ends are looked at, so one look back is exact.
    """
    before = F.lag("en").over(Window.partitionBy(rec).orderBy("seg_id"))
    moves = (F.col("st") < before) & (F.col("en") - before >= MIN_LENGTH_MS)
    return segments.withColumn("st", F.when(moves, before).otherwise(F.col("st")))
