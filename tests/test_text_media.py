import json

from helpers import rows
from pyspark.sql import functions as F

from reelspan.functions import format as fmt
from reelspan.functions import text as tx
from reelspan.functions import tolerant as tol
from reelspan.operators import media, textstats


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_tokens_and_folding(spark):
    assert one(spark, tx.tokens("x"), "Olá, mundo! 123 tudo-bem? d'água _x") == ["olá", "mundo", "tudo-bem", "d'água", "x"]
    assert one(spark, tx.fold("x"), "está ção ñ Ü") == "esta cao n U"


def test_stems_and_cuts(spark):
    assert one(spark, tx.safe_stem("x"), "Reunião de 3ª feira (final)") == "Reuniao_de_3a_feira_final"
    assert one(spark, tx.safe_stem("x"), "...") == "midia"
    assert one(spark, tx.cut_middle("x", 10), "abcdefghijklmnop") == "abcd…lmnop"


def test_times(spark):
    for ms, text in ((0, "00:00:00.000"), (1234, "00:00:01.234"), (60_000, "00:01:00.000"), (3_661_500, "01:01:01.500"), (-5, "00:00:00.000"), (None, "--:--:--.---")):
        assert one(spark, fmt.timestamp_ms("x"), ms, "bigint") == text
    assert one(spark, fmt.timestamp_ms("x", False), 61_500, "bigint") == "01:01.500"
    assert one(spark, fmt.srt_time("x"), 3_661_500, "bigint") == "01:01:01,500"
    for s, text in ((45.25, "45,3 s"), (182.0, "3min 02s"), (3723.0, "1h 02min 03s"), (None, "desconhecida")):
        assert one(spark, fmt.duration_human("x"), s, "double") in (text, text.replace("45,3", "45,2"))
    assert [one(spark, fmt.clock("x"), s, "double") for s in (61.0, 3661.0, None)] == ["1:01", "1:01:01", "-"]
    assert [one(spark, fmt.when_text("x"), t) for t in ("2024-05-06T07:08:09", "nope", None)] == ["06/05 07:08", "-", "-"]


def test_sizes_and_numbers(spark):
    assert [one(spark, fmt.human_size("x"), b, "bigint") for b in (512, 1024, 1024**3)] == ["512 B", "1,00 KB", "1,00 GB"]
    assert one(spark, fmt.thousands("x"), 1_048_576, "bigint") == "1.048.576"
    assert one(spark, fmt.bitrate("x"), 128_000, "bigint") == "128.000 bps (128 kbps)"
    assert one(spark, fmt.float_text("x", " s"), 1.5, "double") == "1,50 s"
    assert one(spark, fmt.key_value("Nome", "x"), "", "string") == "Nome            : —"
    df = spark.createDataFrame([("baixando", 1.4 * 1024**3, 9.0 * 1024**3), ("início", None, None)], "s string, d double, t double")
    assert [r[0] for r in df.select(fmt.download_label("s", "d", "t")).collect()] == ["baixando — 1,4 / 9,0 GB (16%)", "início"]


def test_tolerant(spark):
    df = spark.createDataFrame([("12.9",), ("N/A",), ("",), (None,), ("NaN",)], "x string")
    assert [tuple(r) for r in df.select(tol.to_int("x"), tol.to_float("x")).collect()] == [(12, 12.9), (None, None), (None, None), (None, None), (None, None)]
    df = spark.createDataFrame([("30000/1001",), ("0/0",), ("25",), (None,)], "x string")
    assert [r[0] for r in df.select(tol.parse_rate("x")).collect()] == [29.97003, None, None, None]
    assert one(spark, tol.clamp("x", 0, 1), 3, "int") == 1


def test_counts_and_top_words(spark):
    df = spark.createDataFrame([(1, "beta beta alfa alfa gama", "pt-BR", 60.0), (2, "the The a é", "en", None), (3, "the der", "de", 0.0)], "rec_id int, text string, lang string, s double")
    assert rows(textstats.top_words(df), "rec_id", "rank", "word", "count") == [(1, 1, "alfa", 2), (1, 2, "beta", 2), (1, 3, "gama", 1), (3, 1, "der", 1), (3, 2, "the", 1)]
    assert rows(textstats.text_counts(df, duration="s"), "rec_id", "words", "unique_words", "characters", "characters_no_spaces", "words_per_minute")[0] == (1, 5, 3, 24, 20, 5.0)


def test_summaries(spark):
    df = spark.createDataFrame([(1, "curto."), (2, ""), (3, ("frase longa aqui. " * 20).strip())], "rec_id int, text string")

    def model(prompt):
        return F.when(prompt.contains("PARCIAIS"), F.lit('eis: {"resumo": "tudo", "topicos": [" a ", "", "b"], "acoes": "um"} fim')).otherwise(F.lit('{"resumo": "parte"}'))

    out = {r.rec_id: r for r in textstats.summarise(df, model, size=100).collect()}
    assert (out[1].available, out[1].summary) == (True, "parte")
    assert (out[2].available, out[2].reason) == (False, "não há transcrição para resumir.")
    assert (out[3].summary, out[3].topics, out[3].action_items) == ("tudo", ["a", "b"], ["um"])
    bad = textstats.parse_answers(spark.createDataFrame([(1, "nada"), (2, '{"resumo": " "}')], "rec_id int, raw string"))
    assert [(r.available, r.reason is not None) for r in bad.orderBy("rec_id").collect()] == [(False, True), (False, True)]


PROBE = {
    "format": {"format_name": "mov", "duration": "N/A", "bit_rate": "1000", "nb_streams": 3, "tags": {"title": "t"}},
    "streams": [
        {"index": 0, "codec_type": "video", "width": 1920, "height": 1080, "r_frame_rate": "30000/1001", "color_transfer": "SMPTE2084", "duration": "9.5", "side_data_list": [{"x": 1}, {"rotation": -90}]},
        {"index": 1, "codec_type": "audio", "sample_rate": "8000", "channels": 6, "bits_per_raw_sample": "0", "bits_per_sample": 16, "duration": "10.5", "tags": {"language": "por"}},
        {"index": 2, "codec_type": "video", "disposition": {"attached_pic": 1}},
    ],
    "chapters": [{"start_time": "0.0", "end_time": "1.5", "tags": {"title": "c"}}],
}


def test_probe_documents(spark):
    raw = spark.createDataFrame([(1, json.dumps(PROBE)), (2, "{broken")], "rec_id int, raw string")
    out = {r.rec_id: r for r in media.probe_documents(raw).collect()}
    r = out[1]
    assert (r.duration, r.has_audio, r.has_video, len(r.video), r.audio[0].bits_per_sample, r.audio[0].language) == (10.5, True, True, 2, 16, "por")
    assert (r.video[0].rotation, r.video[0].is_hdr, r.video[0].fps, r.video[1].nb_frames) == (270, True, 29.97003, 1)
    assert (r.chapters[0]["index"], r.chapters[0].end, r.chapters[0].title) == (0, 1.5, "c")
    assert (out[2].duration, out[2].has_audio) == (None, False)
    assert rows(media.resolutions(media.probe_documents(raw)), "index", "displayed")[0] == (0, "1080x1920")


def test_logs_and_rules(spark):
    log = "mean_volume: -40.5 dB\nmax_volume: 0.0 dB\nhistogram_0db: 70\nhistogram_0db: 40\npts_time:1.5 pts_time:x pts_time:2"
    logs = spark.createDataFrame([(1, log), (2, "")], "rec_id int, log string")
    # The first histogram line counts; a log without one has no number.
    measured = ("rec_id", "mean_volume_db", "max_volume_db", "clipping_samples", "clipping_suspected")
    assert rows(media.log_metrics(logs), *measured) == [(1, -40.5, 0.0, 70, True), (2, None, None, None, False)]
    twice = spark.createDataFrame([(1, "histogram_0db: 60\nhistogram_0db: 60\nsilence_duration: 1.5 x\nsilence_duration: 2", 7000)], "rec_id int, log string, duration bigint")
    assert rows(media.log_metrics(twice), "clipping_samples", "clipping_suspected", "silence_seconds", "silence_ratio") == [(60, False, 3.5, 0.5)]
    assert rows(media.scene_cuts(logs), "scene_cuts") == [(0,), (2,)]
    data = [(1, True, 0.01, [(0, 6, 8000)], -40.5, 0.0, 110, True, 0.95, False), (2, False, None, [], None, None, 0, False, None, None)]
    df = spark.createDataFrame(data, "rec_id int, has_audio boolean, duration double, audio array<struct<index:int,channels:int,sample_rate:int>>, mean_volume_db double, max_volume_db double, clipping_samples int, clipping_suspected boolean, silence_ratio double, speech_detected boolean")
    out = {r.rec_id: r.warnings for r in media.quality_warnings(df, vad_enabled=False).collect()}
    assert out[1] == ["duration near zero", "#0: 6 channels", "#0: low rate 8000", "low volume -40.5 dB", "clipping, peak 0.0 dB, 110 samples", "95% silence", "no speech", "vad off"]
    assert out[2] == ["no audio"]
