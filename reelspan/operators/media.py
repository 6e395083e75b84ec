"""Media metadata from raw probe documents and diagnostic logs, and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.tolerant import parse_rate, to_float, to_int
from reelspan.schemas import PROBE_DOCUMENT

# Transfer functions of HDR video, usual sample rates, file suffixes of video, limits.
HDR = ("smpte2084", "arib-std-b67", "smpte428", "bt2020-10", "bt2020-12")
USUAL_RATES = (8000, 11025, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000)
VIDEO_SUFFIXES = (".mp4", ".mkv", ".webm", ".mov", ".avi", ".m4v", ".mpg", ".mpeg", ".wmv", ".ts")
LOW_VOLUME_DB, LOW_RATE, SILENT = -38.0, 16_000, 0.9


def probe_documents(raw: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Raw JSON documents (rec, raw) as one row per recording with typed video, audio, subtitle and chapter arrays."""
    d = raw.select(rec, F.explode(F.array(F.from_json("raw", PROBE_DOCUMENT))).alias("d"))
    of_kind = lambda kind: F.filter("d.streams", lambda s: s.codec_type == kind)
    tag = lambda s, k: F.get(F.map_values(F.map_filter(s.tags, lambda a, _: F.lower(a) == k)), F.lit(0))

    def video(s: Column) -> Column:
        cover = F.coalesce(to_int(F.try_element_at(s.disposition, F.lit("attached_pic"))), F.lit(0)) == 1
        side = F.get(F.filter(F.transform(s.side_data_list, lambda x: to_int(x.rotation)), lambda x: x.isNotNull()), F.lit(0))
        return F.struct(
            s["index"].alias("index"), s.codec_name.alias("codec"), s.codec_long_name.alias("codec_long"), s.profile.alias("profile"), to_int(s.width).alias("width"), to_int(s.height).alias("height"),
            to_int(s.coded_width).alias("coded_width"), to_int(s.coded_height).alias("coded_height"), s.sample_aspect_ratio.alias("sar"), s.display_aspect_ratio.alias("dar"),
            parse_rate(s.r_frame_rate).alias("fps"), parse_rate(s.avg_frame_rate).alias("avg_fps"), s.pix_fmt.alias("pix_fmt"), s.color_space.alias("color_space"),
            s.color_primaries.alias("color_primaries"), s.color_transfer.alias("color_transfer"), F.coalesce(F.lower(s.color_transfer).isin(*HDR), F.lit(False)).alias("is_hdr"),
            to_int(s.bit_rate).alias("bit_rate"), F.coalesce(to_int(s.nb_frames), F.when(cover, F.lit(1).cast("bigint"))).alias("nb_frames"),
            F.pmod(F.coalesce(side, to_int(tag(s, "rotate"))), F.lit(360)).alias("rotation"), to_float(s.duration).alias("duration"), tag(s, "language").alias("language"),
        )

    def audio(s: Column) -> Column:
        bits = F.coalesce(F.nullif(to_int(s.bits_per_raw_sample), F.lit(0)), F.nullif(to_int(s.bits_per_sample), F.lit(0)))
        return F.struct(
            s["index"].alias("index"), s.codec_name.alias("codec"), s.codec_long_name.alias("codec_long"), s.profile.alias("profile"), to_int(s.sample_rate).alias("sample_rate"),
            to_int(s.channels).alias("channels"), s.channel_layout.alias("channel_layout"), to_int(s.bit_rate).alias("bit_rate"), bits.alias("bits_per_sample"),
            to_float(s.duration).alias("duration"), tag(s, "language").alias("language"), tag(s, "title").alias("title"),
        )

    subtitle = lambda s: F.struct(s["index"].alias("index"), s.codec_name.alias("codec"), tag(s, "language").alias("language"), tag(s, "title").alias("title"))
    chapter = lambda c, i: F.struct(
        F.coalesce(to_int(c.id), i.cast("bigint")).alias("index"), to_float(c.start_time).alias("start"), to_float(c.end_time).alias("end"), tag(c, "title").alias("title")
    )
    rows = d.select(
        rec, F.col("d.format.format_name").alias("format_name"), F.col("d.format.format_long_name").alias("format_long_name"), to_float("d.format.duration").alias("container_duration"),
        to_int("d.format.bit_rate").alias("bit_rate"), to_int("d.format.nb_streams").alias("nb_streams"), F.col("d.format.tags").alias("tags"),
        F.transform(of_kind("video"), video).alias("video"), F.transform(of_kind("audio"), audio).alias("audio"), F.transform(of_kind("subtitle"), subtitle).alias("subtitles"),
        F.transform("d.chapters", chapter).alias("chapters"),
    )
    longest = F.array_max(F.transform(F.concat(F.transform("video", lambda s: s.duration), F.transform("audio", lambda s: s.duration)), lambda x: x))
    duration = F.coalesce(F.nullif("container_duration", F.lit(0.0)), F.nullif(longest, F.lit(0.0)))
    return rows.withColumn("duration", duration).withColumn("has_audio", F.coalesce(F.size("audio") > 0, F.lit(False))).withColumn(
        "has_video", F.coalesce(F.exists("video", lambda v: v.nb_frames.isNull() | (v.nb_frames > 1)), F.lit(False))
    )


def resolutions(probed: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Coded and displayed size of every video stream; a quarter turn swaps the sides."""
    rows = probed.select(rec, F.explode("video").alias("v"))
    size = lambda a, b: F.concat(F.col(f"v.{a}").cast("string"), F.lit("x"), F.col(f"v.{b}").cast("string"))
    turned = F.coalesce(F.col("v.rotation").isin(90, 270), F.lit(False))
    return rows.select(rec, F.col("v.index").alias("index"), size("width", "height").alias("coded"), F.when(turned, size("height", "width")).otherwise(size("width", "height")).alias("displayed"))


def is_video_path(path: Column | str) -> Column:
    """Whether a path's suffix is one of video; a hint, not a filter."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]+)$", 1)).isin(*VIDEO_SUFFIXES)


def log_metrics(logs: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Volumes, full-scale samples and silence of diagnostic log text (rec, log, and duration in ms where it is known).

    mean_volume_db, max_volume_db and clipping_samples (null where the log has none) are those of the first line that has one; clipping_suspected follows from
    them. silence_seconds is the sum of all silences that the log measured, silence_ratio its share of the duration, at most 1.
    """
    number = lambda p: to_float(F.regexp_extract("log", p, 1))
    full = F.nullif(F.regexp_extract("log", r"histogram_0db:\s*(\d+)", 1), F.lit("")).cast("bigint")
    silent = F.aggregate(F.regexp_extract_all("log", F.lit(r"silence_duration:\s*(\d+(?:\.\d+)?)"), F.lit(1)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    duration = F.col("duration") / 1000.0 if "duration" in logs.columns else F.lit(None).cast("double")
    rows = logs.select(
        rec, number(r"mean_volume:\s*(-?[0-9.]+) dB").alias("mean_volume_db"), number(r"max_volume:\s*(-?[0-9.]+) dB").alias("max_volume_db"), full.alias("clipping_samples"),
        F.round(silent, 3).alias("silence_seconds"), F.when(duration > 0, F.round(F.least(F.lit(1.0), silent / duration), 4)).alias("silence_ratio"),
    )
    return rows.withColumn("clipping_suspected", clipping("max_volume_db", "clipping_samples"))


def clipping(peak: str, samples: str) -> Column:
    return F.coalesce((F.col(samples) > 100) | ((F.col(peak) >= -0.1) & (F.col(samples) > 0)), F.lit(False))


def scene_cuts(logs: DataFrame, rec: str = "rec_id") -> DataFrame:
    return logs.select(rec, F.regexp_count("log", F.lit(r"pts_time:\d")).alias("scene_cuts"))


def scene_cuts_from_scores(frames: DataFrame, threshold: float = 0.35, rec: str = "rec_id") -> DataFrame:
    return frames.groupBy(rec).agg(F.count_if(F.col("score") > threshold).alias("scene_cuts"))


def volume_stats(frames: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Mean and peak in dB and full-scale samples from frames (rec, frame_idx, ms = mean square, peak, n_full)."""
    agg = frames.groupBy(rec).agg(F.avg("ms").alias("ms"), F.max("peak").alias("peak"), F.sum("n_full").alias("clipping_samples"))
    db = lambda c, k: F.when(F.col(c) > 0, F.round(k * F.log10(c), 1))
    return agg.select(rec, db("ms", 10).alias("mean_volume_db"), db("peak", 20).alias("max_volume_db"), "clipping_samples")


def silence_runs(frames: DataFrame, frame_ms: int, below_db: float = -35.0, least_ms: int = 600, rec: str = "rec_id") -> DataFrame:
    """Runs of frames below a level that last long enough."""
    from pyspark.sql import Window

    quiet = frames.filter(F.when(F.col("ms") > 0, 10 * F.log10("ms")).otherwise(F.lit(-200.0)) < below_db)
    run = F.col("frame_idx") - F.row_number().over(Window.partitionBy(rec).orderBy("frame_idx"))
    runs = quiet.withColumn("_run", run).groupBy(rec, "_run").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    return runs.select(rec, (F.col("a") * frame_ms).cast("bigint").alias("st"), ((F.col("b") + 1) * frame_ms).cast("bigint").alias("en")).filter(F.col("en") - F.col("st") >= least_ms)


def quality_warnings(media: DataFrame, vad_enabled: bool = True, rec: str = "rec_id") -> DataFrame:
    """(rec, warnings): codes and values of the rules a recording meets, in a fixed order.

    Takes has_audio, duration (seconds), audio (array of index, channels, sample_rate) and the
    diagnostics mean_volume_db, max_volume_db, clipping_samples, clipping_suspected,
    silence_ratio and speech_detected. A recording without audio has that one warning.
    """
    rule = lambda condition, text: F.when(F.coalesce(condition, F.lit(False)), text if isinstance(text, Column) else F.lit(text))

    def stream(s: Column) -> Column:
        at = F.concat(F.lit("#"), s["index"].cast("string"), F.lit(": "))
        return F.array(
            F.when(s.channels == 1, F.concat(at, F.lit("mono"))).when(s.channels > 2, F.concat(at, s.channels.cast("string"), F.lit(" channels"))),
            rule((s.sample_rate > 0) & ~s.sample_rate.isin(*USUAL_RATES), F.concat(at, F.lit("unusual rate "), s.sample_rate.cast("string"))),
            rule((s.sample_rate > 0) & (s.sample_rate < LOW_RATE), F.concat(at, F.lit("low rate "), s.sample_rate.cast("string"))),
        )

    first = F.array(rule(F.col("duration").isNull(), "duration unknown"), rule(F.col("duration") <= 0.05, "duration near zero"))
    last = F.array(
        rule(F.col("mean_volume_db") < LOW_VOLUME_DB, F.format_string("low volume %.1f dB", "mean_volume_db")),
        rule(F.col("clipping_suspected"), F.coalesce(F.format_string("clipping, peak %.1f dB, %d samples", "max_volume_db", "clipping_samples"), F.lit("clipping"))),
        rule(F.col("silence_ratio") > SILENT, F.format_string("%.0f%% silence", F.col("silence_ratio") * 100)),
        rule(F.col("speech_detected") == F.lit(False), "no speech"),
        rule(F.lit(not vad_enabled), "vad off"),
    )
    every = F.array_compact(F.concat(first, F.flatten(F.transform("audio", stream)), last))
    return media.select(rec, F.when(F.col("has_audio"), every).otherwise(F.array(F.lit("no audio"))).alias("warnings"))
