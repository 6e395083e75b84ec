"""Sinks: result documents, subtitles, transcripts, history, ledger."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions.text import safe_stem, wrap
from reelspan.operators.history import KEPT, retain
from reelspan.operators.intervals import coverage_summary
from reelspan.operators.packing import paragraphs
from reelspan.operators.report import NO_REASON, availability
from reelspan.operators.speakers import speaker_stats
from reelspan.operators.textstats import joined_text, text_counts, top_words
from reelspan.schemas import LEDGER, WORDS
from reelspan.sources.versions import VersionedTable

SCHEMA_VERSION, WIDTH = 1, 78


def output_path(folder: Column | str, name: Column | str, suffix: str) -> Column:
    """folder/stem.suffix, with a safe stem of the file's name."""
    folder, name = (F.col(c) if isinstance(c, str) else c for c in (folder, name))
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), safe_stem(F.regexp_replace(name, r"\.[^.]+$", "")), F.lit(suffix))


def result_rows(recordings: DataFrame, segments: DataFrame, rec: str = "rec_id") -> DataFrame:
    """One document per recording with its segments in order (seconds), their words and scores, stamped with the schema version.

    ``recordings`` brings the other blocks of the document (coverage, stats, speakers, ...) as
    columns of one row per recording; a column that segments lack is null in the document.
    """
    s = lambda c: (F.col(c) if isinstance(c, str) else c) / 1000.0
    has = lambda c, kind: F.col(c) if c in segments.columns else F.lit(None).cast(kind)
    scores = [has(c, "double").alias(c) for c in ("avg_logprob", "no_speech_prob", "compression_ratio", "temperature")]
    words = F.transform(has("words", WORDS), lambda w: F.struct(s(w.st).alias("start"), s(w.en).alias("end"), w.word.alias("word"), w.probability.alias("probability")))
    item = F.struct(F.col("seg_id").alias("id"), s("st").alias("start"), s("en").alias("end"), F.col("text"), has("speaker", "string").alias("speaker"), *scores, words.alias("words"))
    parts = segments.groupBy(rec).agg(F.sort_array(F.collect_list(item)).alias("segments"))
    return recordings.join(parts, rec, "left").select(F.lit(SCHEMA_VERSION).alias("schema_version"), *[c for c in recordings.columns], "segments")


def document_blocks(segments: DataFrame, silences: DataFrame, recordings: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Recordings (rec, duration in ms, language) with the blocks of a document that follow from their segments: coverage, stats, speakers, diarization and text."""
    covered = coverage_summary(segments, silences, recordings, rec=rec)
    pairs = F.transform("gaps", lambda g: F.array(g.st, g.en))
    coverage = covered.select(rec, F.struct("analyzed", "covered_seconds", "ratio", "silence_seconds", "gap_seconds", pairs.alias("gaps"), "low_coverage", "reason").alias("coverage"))
    text = joined_text(segments, rec)
    known = text.join(recordings.select(rec, (F.col("duration") / 1000.0).alias("_s"), F.coalesce("language", F.lit("")).alias("lang")), rec)
    top = top_words(known, key=rec).groupBy(rec).agg(F.sort_array(F.collect_list(F.struct("rank", "word", "count"))).alias("_top"))
    counts = text_counts(known, rec, "text", "_s").join(top, rec, "left")
    top_words_ = F.transform(F.coalesce("_top", F.array().cast("array<struct<rank:int,word:string,count:bigint>>")), lambda t: F.struct(t.word.alias("word"), t["count"].alias("count")))
    stats = counts.select(rec, F.struct("words", "unique_words", "characters", "characters_no_spaces", "words_per_minute", top_words_.alias("top_words")).alias("stats"))
    spoken = speaker_stats(segments, rec).groupBy(rec).agg(F.sort_array(F.collect_list(F.struct("rank", "speaker", "seconds", "ratio", "segments"))).alias("_s"))
    speakers = spoken.select(rec, F.transform("_s", lambda x: F.struct(x.speaker.alias("speaker"), x.seconds.alias("seconds"), x.ratio.alias("ratio"), x.segments.alias("segments"))).alias("speakers"))
    rows = recordings
    for part in (coverage, stats, speakers, text):
        rows = rows.join(part, rec, "left")
    rows = availability(rows, {"diarization": (F.size("speakers") > 0, NO_REASON)})
    counted = F.when(F.col("diarization_available"), F.size("speakers")).otherwise(0).cast("bigint")
    return rows.withColumn("diarization", F.struct(F.col("diarization_available").alias("available"), counted.alias("speaker_count"), F.col("diarization_reason").alias("reason"))).drop("diarization_available", "diarization_reason")


def merged_documents(documents: DataFrame, changed: DataFrame, rec: str = "rec_id") -> DataFrame:
    """(rec, content): JSON of ``documents`` (rec, blocks, as ``readers.whole_documents`` gives) with the columns of ``changed`` (rec, ...) as their blocks.

    Blocks that aren't among the columns stay as they were, unknown keys and nested values too; a null column
    keeps the old block. A document of ``changed`` without an old one is made of its columns alone. Times
    and other values are written as they are.
    """
    names = [c for c in changed.columns if c != rec]
    rows = documents.select(rec, "blocks").join(changed, rec, "full")
    own = F.array(*[F.struct(F.lit(c).alias("key"), F.when(F.col(c).isNotNull(), F.parse_json(F.to_json(F.struct(F.col(c).alias("v"))))).alias("value")) for c in names])
    fresh = F.map_from_entries(F.transform(F.filter(own, lambda x: x.value.isNotNull()), lambda x: F.struct(x.key.alias("key"), F.variant_get(x.value, "$.v", "variant").alias("value"))))
    old = F.coalesce(F.map_filter("blocks", lambda k, v: ~F.map_contains_key("_new", k)), F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>")))
    return rows.withColumn("_new", fresh).select(rec, F.to_json(F.map_concat(old, "_new")).alias("content"))


def write_documents(rows: DataFrame, path: str, rec: str = "rec_id") -> None:
    """JSON documents in one folder per recording."""
    rows.withColumn("_rec", F.col(rec)).repartition(rec).write.mode("overwrite").partitionBy("_rec").json(path)


def write_texts(contents: DataFrame, path: str, rec: str = "rec_id") -> None:
    """Text of each recording (rec, content) in a folder of its own."""
    contents.select(rec, "content").repartition(rec).write.mode("overwrite").partitionBy(rec).text(path)


def plain_transcripts(segments: DataFrame, width: int = WIDTH, rec: str = "rec_id") -> DataFrame:
    """(rec, content): paragraphs wrapped, a blank line between."""
    rows = paragraphs(segments, rec=rec).withColumn("lines", F.array_join(wrap("text", width), "\n"))
    joined = rows.groupBy(rec).agg(F.sort_array(F.collect_list(F.struct("par_no", "lines"))).alias("p"))
    return joined.select(rec, F.concat(F.array_join(F.transform("p", lambda x: x.lines), "\n\n"), F.lit("\n")).alias("content"))


def latest_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the history at ``path``; None where there is none yet."""
    return VersionedTable(spark, path).read()


def append_history(rows: DataFrame, path: str, keep: int = KEPT, batch: tuple[str, int] | None = None) -> int | None:
    """Commit the newest ``keep`` rows of the history at ``path`` and ``rows`` as its next version; its number.

    Of two writers neither is lost: the one that comes second starts from what the first has written. A write
    that breaks off leaves the last version as it was. ``batch`` (stream, number): a batch counts once, and None is returned if it is in.
    """

    def merge(before: DataFrame | None, new: DataFrame) -> DataFrame:
        every = new if before is None else before.unionByName(new, allowMissingColumns=True)
        return retain(every, keep).drop("place").coalesce(1)

    return VersionedTable(rows.sparkSession, path).commit(rows, merge, batch)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append stage rows as one folder of their own; they are visible at once, when its commit is. Writers don't meet."""
    rows.write.parquet(f"{path.rstrip('/')}/part={uuid.uuid4().hex}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Stage rows of every append that was committed; none where there is no ledger."""
    try:
        return spark.read.schema(f"{LEDGER}, part string").parquet(path).drop("part")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
