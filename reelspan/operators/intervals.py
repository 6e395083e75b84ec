"""Interval algebra over timelines of all recordings: union, complement, overlap, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.tolerant import span_length

MIN_GAP_MS, SILENT_SHARE, LOW_COVERAGE = 1500, 0.60, 0.95
#: Recordings whose timelines are long are cut into bins of this width for interval joins.
BIN_MS = 30_000
#: Width of the bins of a sweep, from one to the next of which sums are carried.
SWEEP_MS = 600_000


def merge_spans(spans: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Union of the spans of each recording (rec, st, en); touching spans merge, empty ones are dropped."""
    order = Window.partitionBy(rec).orderBy("st", "en")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    opened = spans.filter("en > st").select(rec, "st", "en").withColumn("_most", F.max("en").over(before))
    islands = opened.withColumn("_new", F.when(F.col("st") > F.col("_most"), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(so_far))
    return islands.groupBy(rec, "_island").agg(F.min("st").alias("st"), F.max("en").alias("en")).drop("_island")


def gap_complement(merged: DataFrame, recordings: DataFrame, min_gap: int = 0, rec: str = "rec_id") -> DataFrame:
    """Parts of [0, duration] of each recording (rec, duration) that no merged span covers."""
    ends = merged.join(recordings.select(rec, "duration"), rec)
    inside = ends.select(
        rec,
        F.coalesce(F.lag("en").over(Window.partitionBy(rec).orderBy("st")), F.lit(0)).alias("st"),
        F.least("st", "duration").alias("en"),
    )
    last = merged.groupBy(rec).agg(F.max("en").alias("last"))
    tails = recordings.select(rec, "duration").join(last, rec, "left").select(rec, F.coalesce("last", F.lit(0)).cast("bigint").alias("st"), F.col("duration").alias("en"))
    return inside.unionByName(tails).filter((F.col("en") > F.col("st")) & (F.col("en") - F.col("st") >= min_gap))


def _binned(df: DataFrame, bin_ms: int) -> DataFrame:
    """One row per bin that a span touches, with its first bin."""
    first, last = F.expr(f"st div {bin_ms}"), F.expr(f"(en - 1) div {bin_ms}")
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_pairs(left: DataFrame, right: DataFrame, bin_ms: int = BIN_MS, rec: str = "rec_id") -> DataFrame:
    """Pairs of overlapping spans, with their shared milliseconds as ``overlap``; right columns are prefixed r_.

    Both sides meet on (recording, bin), so the work of a long recording spreads
    over as many keys as it has bins, and a pair counts in the first bin that both touch.
    """
    right = right.select(F.col(rec), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != rec])
    meets = (F.col("st") < F.col("r_en")) & (F.col("r_st") < F.col("en"))
    shared = F.least("en", "r_en") - F.greatest("st", "r_st")
    rights = _binned(right.withColumnsRenamed({"r_st": "st", "r_en": "en"}).filter("en > st"), bin_ms)
    rights = rights.withColumnsRenamed({"st": "r_st", "en": "r_en", "_first": "_r_first"})
    pairs = _binned(left.filter("en > st"), bin_ms).join(rights, [rec, "_bin"])
    return pairs.filter(meets & (F.col("_bin") == F.greatest("_first", "_r_first"))).withColumn("overlap", shared).drop("_bin", "_first", "_r_first")


def measure_until(points: DataFrame, spans: DataFrame, bin_ms: int = SWEEP_MS, rec: str = "rec_id") -> DataFrame:
    """``points`` (rec, t, others) with ``measure``: the summed length of the spans of the recording before t, overlaps counted each.

    A sweep over the sorted union of starts, ends and points: with k spans open at t, whose starts sum
    to a and ends of closed ones to b, the measure is k t - a + b. Sums run within bins of time and
    carry on from bin to bin, so a long recording spreads over as many keys as it has bins.
    """
    others = [c for c in points.columns if c not in (rec, "t")]
    real = spans.filter("en > st")
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in others]
    edges = [real.select(F.col(rec), F.col(at).alias("t"), F.lit(n).cast("bigint").alias("_n"), (F.col(at) * n).alias("_sum"), F.lit(False).alias("_point"), *none) for at, n in (("st", 1), ("en", -1))]
    zero = F.lit(0).cast("bigint")
    union = points.select(rec, "t", zero.alias("_n"), zero.alias("_sum"), F.lit(True).alias("_point"), *others).unionByName(edges[0]).unionByName(edges[1])
    union = union.withColumn("_bin", F.expr(f"t div {bin_ms}"))
    # A row for each bin in which a span starts or ends.
    totals = edges[0].unionByName(edges[1]).groupBy(rec, F.expr(f"t div {bin_ms}").alias("_bin")).agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
    marks = totals.unionByName(points.select(rec, F.expr(f"t div {bin_ms}").alias("_bin"), zero.alias("_n"), zero.alias("_sum")).distinct()).groupBy(rec, "_bin").agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
    earlier = Window.partitionBy(rec).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(rec, "_bin", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_carry{c}") for c in ("_n", "_sum")])
    # Edges at t itself add nothing, so ties may stand in any order.
    so_far = Window.partitionBy(rec, "_bin").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = union.select("*", F.sum("_n").over(so_far).alias("_k"), F.sum("_sum").over(so_far).alias("_a")).filter("_point").join(carried, [rec, "_bin"])
    return run.select(rec, "t", *others, ((F.col("_k") + F.col("_carry_n")) * F.col("t") - F.col("_a") - F.col("_carry_sum")).alias("measure"))


def overlap_ms(spans: DataFrame, others: DataFrame, key: str, bin_ms: int = SWEEP_MS, rec: str = "rec_id") -> DataFrame:
    """Spans (rec, ``key``, st, en) with the summed overlap with ``others``; 0 where there is none, or a span is empty.

    What lies before a span's end less what lies before its start; no pairs are formed.
    """
    ends = spans.filter("en > st").select(rec, F.col(key).alias("_key"), F.inline(F.array(F.struct(F.col("st").alias("t"), F.lit(-1).alias("_sign")), F.struct(F.col("en").alias("t"), F.lit(1).alias("_sign")))))
    summed = measure_until(ends, others.select(rec, "st", "en"), bin_ms, rec).groupBy(rec, F.col("_key").alias(key)).agg(F.sum(F.col("measure") * F.col("_sign")).alias("overlap"))
    return spans.join(summed, [rec, key], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)).cast("bigint"))


def unspoken_gaps(segments: DataFrame, silences: DataFrame, recordings: DataFrame, min_gap: int = MIN_GAP_MS, rec: str = "rec_id") -> DataFrame:
    """Gaps between segments that are long enough and not mostly silence (under 60 %)."""
    gaps = gap_complement(merge_spans(segments, rec), recordings, min_gap, rec).withColumn("gap_st", F.col("st"))
    measured = overlap_ms(gaps, silences, "gap_st", rec=rec)
    return measured.filter(10 * F.col("overlap") < int(SILENT_SHARE * 10) * (F.col("en") - F.col("st"))).select(rec, "st", "en")


def coverage_summary(segments: DataFrame, silences: DataFrame, recordings: DataFrame, min_gap: int = MIN_GAP_MS, rec: str = "rec_id") -> DataFrame:
    """How much of each recording (rec, duration) is transcribed, and what is missing.

    Returns analyzed, covered_seconds, ratio (both capped at the duration), silence_seconds,
    gaps, n_gaps, gap_seconds (of gaps rounded to 10 ms), low_coverage and reason. Unknown
    durations are not analysed.
    """
    known = recordings.filter("duration > 0")
    covered = merge_spans(segments, rec).groupBy(rec).agg(F.sum(F.col("en") - F.col("st")).alias("covered"))
    silent = silences.groupBy(rec).agg(F.sum(span_length()).alias("silent"))
    ten = lambda c: F.expr(f"({c} + 5) div 10") / 100.0
    gaps = unspoken_gaps(segments, silences, known, min_gap, rec).select(rec, ten("st").alias("st"), ten("en").alias("en"))
    listed = gaps.groupBy(rec).agg(
        F.sort_array(F.collect_list(F.struct("st", "en"))).alias("gaps"), F.count("*").alias("n_gaps"), F.sum(F.round((F.col("en") - F.col("st")) * 100).cast("bigint")).alias("gap_cs")
    )
    rows = recordings.select(rec, "duration").join(covered, rec, "left").join(silent, rec, "left").join(listed, rec, "left")
    ok = F.coalesce(F.col("duration") > 0, F.lit(False))
    ratio = F.round(F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.col("duration")), 4)
    n_gaps = F.coalesce("n_gaps", F.lit(0)).cast("bigint")
    return rows.select(
        rec,
        ok.alias("analyzed"),
        F.when(ok, F.round(F.least(F.coalesce("covered", F.lit(0)), F.col("duration")) / 1000.0, 3)).alias("covered_seconds"),
        F.when(ok, ratio).alias("ratio"),
        F.when(ok, F.round(F.coalesce("silent", F.lit(0)) / 1000.0, 3)).alias("silence_seconds"),
        F.when(ok, F.coalesce("gaps", F.array().cast("array<struct<st:double,en:double>>"))).alias("gaps"),
        F.when(ok, n_gaps).alias("n_gaps"),
        F.when(ok, F.coalesce("gap_cs", F.lit(0)) / 100.0).alias("gap_seconds"),
        (ok & (ratio < LOW_COVERAGE) & (n_gaps > 0)).alias("low_coverage"),
        F.when(~ok, F.lit("duração desconhecida")).alias("reason"),
    )


def speech_stats(segments: DataFrame, recordings: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Summed segment time (overlaps count twice), its share, the number of segments, and whether there is speech."""
    summed = segments.groupBy(rec).agg(F.sum(span_length()).alias("ms"), F.count("*").alias("n"))
    rows = recordings.select(rec, "duration").join(summed, rec, "left")
    ms, n = F.coalesce("ms", F.lit(0)), F.coalesce("n", F.lit(0))
    return rows.select(
        rec,
        F.round(ms / 1000.0, 3).alias("speech_seconds"),
        F.when(F.col("duration") > 0, F.round(F.least(F.lit(1.0), ms / F.col("duration")), 4)).alias("speech_ratio"),
        n.cast("bigint").alias("vad_segments"),
        ((n > 0) & (ms > 200)).alias("speech_detected"),
    )


def silence_stats(silences: DataFrame, recordings: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Total silence of each recording and its share, at most 1."""
    summed = silences.groupBy(rec).agg(F.sum(span_length()).alias("ms"))
    rows = recordings.select(rec, "duration").join(summed, rec, "left")
    ms = F.coalesce("ms", F.lit(0))
    return rows.select(rec, F.round(ms / 1000.0, 3).alias("silence_seconds"), F.when(F.col("duration") > 0, F.round(F.least(F.lit(1.0), ms / F.col("duration")), 4)).alias("silence_ratio"))


def pair_silences(logs: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Silence spans of log text (rec, log, duration): the i-th start with the i-th end, a last open one to the duration."""
    found = lambda p: F.transform(F.regexp_extract_all("log", F.lit(p), F.lit(1)), lambda x: F.round(x.cast("double") * 1000).cast("bigint"))
    known = F.coalesce(F.col("duration"), F.lit(0)) > 0
    rows = logs.select(rec, "duration", found(r"silence_start:\s*(-?[0-9.]+)").alias("starts"), found(r"silence_end:\s*(-?[0-9.]+)").alias("ends"))
    rows = rows.withColumn("ends", F.when((F.size("ends") < F.size("starts")) & known, F.array_append("ends", F.col("duration").cast("bigint"))).otherwise(F.col("ends")))
    n = F.least(F.size("starts"), F.size("ends"))
    spans = rows.select(rec, "duration", F.explode(F.arrays_zip(F.slice("starts", F.lit(1), n).alias("a"), F.slice("ends", F.lit(1), n).alias("b"))).alias("s"))
    st = F.greatest(F.lit(0).cast("bigint"), F.col("s")["a"])
    en = F.when(F.coalesce(F.col("duration"), F.lit(0)) > 0, F.least(F.col("s")["b"], F.col("duration").cast("bigint"))).otherwise(F.col("s")["b"])
    return spans.select(rec, st.alias("st"), en.alias("en")).filter("en > st")

