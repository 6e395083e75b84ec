import random
import textwrap

from helpers import rows
from pyspark.sql import functions as F

from reelspan.functions import text as tx
from reelspan.operators import media, packing, report, textstats
from reelspan.sources import readers, sinks
from reelspan.streaming import progress


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_lines_break_as_the_standard_library_breaks_them(spark):
    rng = random.Random(4)
    pool = ["a", "word", "well-known", "x-y", "e-mail-list", "dash--dash", "ab-cd-ef", "-lead", "trail-", "long" * 15, "3-4", "d'água", "fim."]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["a  b", "  lead", "x\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for t, plain, broken in df.select("x", tx.wrap("x", 42), tx.wrap("x", 42, hyphens=True)).collect():
        assert plain == textwrap.wrap(t.strip(), 42, break_long_words=False, break_on_hyphens=False)
        assert broken == textwrap.wrap(t.strip(), 42, break_long_words=False)


def test_white_space_of_every_kind_is_stripped(spark):
    assert one(spark, tx.strip("x"), "\t\n  a b \r\n") == "a b"
    df = spark.createDataFrame([(1, "\n\t ", "en")], "rec_id int, text string, lang string")
    assert textstats.map_prompts(df).count() == 0


def test_stems_keep_compatible_letters(spark):
    assert one(spark, tx.safe_stem("x"), "Reunião de 3ª feira (ﬁnal ½)") == "Reuniao_de_3a_feira_final_12"


def test_fixed_values_of_media():
    assert {"smpte428", "bt2020-10", "bt2020-12"} <= set(media.HDR) and 88200 in media.USUAL_RATES and ".ts" in media.VIDEO_SUFFIXES and ".flv" not in media.VIDEO_SUFFIXES


def test_a_density_for_each_recording(spark):
    data = [(r, i, i * 3000, i * 3000 + 2500, f"palavra {i} " * 5, d) for r, d in ((1, "curta"), (2, "longa"), (3, "other")) for i in range(12)]
    df = spark.createDataFrame(data, "rec_id int, seg_id int, st bigint, en bigint, text string, d string")
    mixed = packing.build_cues(df, F.col("d"))
    for rec, density in ((1, "curta"), (2, "longa"), (3, None)):
        assert rows(mixed.filter(F.col("rec_id") == rec)) == rows(packing.build_cues(df.filter(F.col("rec_id") == rec), density))


def test_history_versions(spark, tmp_path):
    path = f"{tmp_path}/history"
    assert sinks.latest_history(spark, path) is None
    for k in range(3):
        sinks.append_history(spark.createDataFrame([(f"2024-01-0{k + 1}", k)], "finished_at string, run_id int"), path, keep=2)
    assert rows(sinks.latest_history(spark, path), "run_id") == [(1,), (2,)]


def test_corrupt_documents_of_a_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.data.json").write_text('{"schema_version": 1, "segments": []}')
    (tmp_path / "in" / "b.json").write_text('{"segments": [')
    seen = []
    progress.watch_results(spark, str(tmp_path / "in"), lambda df, _: seen.extend((r.rec_id, r.readable) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("a", True), ("b", False)]
    assert sorted((r.rec_id, r.readable) for r in readers.read_results(spark, str(tmp_path / "in")).collect()) == sorted(seen)


def test_report_blocks(spark):
    raw = '{"format":{"format_name":"mov"},"streams":[{"index":0,"codec_type":"video","codec_name":"h264","width":640,"height":360,"r_frame_rate":"25/1"},{"index":1,"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2}],"chapters":[{"start_time":"0","end_time":"1.5"}]}'
    probed = media.probe_documents(spark.createDataFrame([(1, raw)], "rec_id int, raw string")).drop("duration", "tags", "bit_rate")
    rec = probed.withColumn("duration", F.lit(9000)).withColumn("word_timestamps", F.lit(True)).withColumn("stages", F.array(F.struct(F.lit("asr").alias("stage"), F.lit(1500).cast("bigint").alias("ms"), F.lit("ok").alias("status"))))
    words = "array<struct<word:string,st:bigint,en:bigint,probability:double>>"
    seg = spark.createDataFrame([(1, 0, 0, 2000, "olá mundo", None, [("olá", 0, 900, 0.5), ("mundo", 900, 2000, None)])], f"rec_id int, seg_id int, st bigint, en bigint, text string, speaker string, words {words}")
    quiet = spark.createDataFrame([(1, 2000, 9000)], "rec_id int, st bigint, en bigint")
    text = report.reports(rec, seg, quiet).first().content
    for part in ("Stream de vídeo #0", "resolução       : 640x360", "Stream de áudio #1", "canais          : 2 (layout desconhecido)", "[00:00:00.000 → 00:00:01.500] (sem título)", "Tempo por etapa", "asr                1,50 s   [ok]",
                 "[BLOCO C] Timestamps por palavra", "00:00:00.000 → 00:00:00.900  olá  p=0,50", "00:00:00.900 → 00:00:02.000  mundo", "Silêncio        : 7,0 s"):
        assert part in text, part


def test_availability(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "rec_id int, s string")
    out = report.availability(df, {"summary": (F.col("s").isNotNull(), "desligado")})
    assert rows(out, "rec_id", "summary_available", "summary_reason") == [(1, False, "desligado"), (2, True, None)]


def test_whole_documents_come_back(spark, tmp_path):
    import json

    doc = {"schema_version": 1, "probe": {"duration": 2.5, "streams": [{"index": 0, "side": {"rotation": -90}}], "chapters": [{"id": 1}]}, "segments": [{"start": 0.0, "text": "oi", "extra": None}], "processing": {"threads": 4, "nested": [[1, "é"]]}, "future": [1, {"a": None}], "text": "oi"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.data.json").write_text(json.dumps(doc))
    (tmp_path / "in" / "b.json").write_text("[1, 2]")
    (tmp_path / "in" / "c.json").write_text("{broken")
    docs = readers.read_whole_documents(spark, str(tmp_path / "in"))
    assert rows(docs.select("rec_id", F.col("blocks").isNull())) == [("a", False), ("b", True), ("c", True)]
    changed = spark.createDataFrame([("a", "ola", None), ("new", "x", 3)], "rec_id string, text string, stats int")
    out = {r.rec_id: json.loads(r.content) for r in sinks.merged_documents(docs.filter("rec_id = 'a'"), changed).collect()}
    assert out == {"a": doc | {"text": "ola"}, "new": {"text": "x", "stats": 3}}
    docs.write.parquet(str(tmp_path / "table"))  # blocks as VARIANT
    assert "variant" in dict(spark.read.parquet(str(tmp_path / "table")).dtypes)["blocks"]


def test_report_sections_with_all_that_they_can_hold(spark):
    rec = spark.createDataFrame(
        [(1, 9000, "small", "faster", "cpu", "int8", "pyannote", "Resumo\nem dois", "local", "m7", ["a", "b"], ["fazer"], ["disse"], "640x360", "sem cortes", {"srt": "/out/x.srt", "txt": "/out/x.txt"}, "curta", "/models", "pt-BR", ["t1.jpg"])],
        "rec_id int, duration int, model string, engine string, device string, compute_type string, diarization_backend string, summary string, summary_provider string, summary_model string, topics array<string>, action_items array<string>, "
        "quotes array<string>, resolution string, visual_reason string, outputs map<string,string>, subtitle_density string, model_path string, language string, thumbnails array<string>",
    )
    long = "palavra " * 20
    seg = spark.createDataFrame([(1, 0, 0, 2000, long.strip(), "SPEAKER_00"), (1, 1, 2000, 4000, "sem dono", None), (1, 2, 4000, 4500, "", None)], "rec_id int, seg_id int, st bigint, en bigint, text string, speaker string")
    quiet = spark.createDataFrame([], "rec_id int, st bigint, en bigint")
    text = report.reports(rec, seg, quiet).first().content
    prefix = "[00:00:00.000 → 00:00:02.000] SPEAKER_00: "
    wrapped = textwrap.wrap(long.strip(), 78 - len(prefix))
    assert "\n".join([prefix + wrapped[0], *[" " * len(prefix) + w for w in wrapped[1:]], "[00:00:02.000 → 00:00:04.000] SPEAKER_??: sem dono", "[00:00:04.000 → 00:00:04.500] SPEAKER_??: "]) in text
    for part in (
        "Engine          : faster small | device=cpu | compute_type=int8", "Backend         : pyannote", "Segmentos       : 3", "Palavras mais frequentes (stopwords de 'pt' removidas)", "  Resumo local (local / m7)\n    Resumo\n    em dois\n\n  Tópicos\n    - a\n    - b\n\n  Itens de ação\n    - fazer\n\n  Citações\n    - disse",
        "Observação: sem cortes", "    t1.jpg", "Tamanho das legendas: curta (1 a 2 s por legenda)", "Pasta de saída  : /out", "Modelos         : /models",
    ):
        assert part in text, (part, text)
    bare = report.reports(rec.select("rec_id", "duration"), seg.withColumn("speaker", F.lit(None).cast("string")), quiet).first().content
    assert "[00:00:02.000 → 00:00:04.000] sem dono" in bare and "A transcrição acima segue válida" in bare and "(sem lista de stopwords para este idioma)" in bare and "Pasta de saída  : ." in bare


def test_columns_that_are_not_used_are_not_parsed(spark):
    raw = spark.createDataFrame([(1, '{"segments":[{"id":0,"text":"a"}],"later":{"x":1}}'), (2, "{"), (3, None)], "rec_id int, raw string")
    documents = readers.whole_documents(raw)
    assert sorted((r.rec_id, r.readable, r.blocks is not None) for r in documents.collect()) == [(1, True, True), (2, False, False), (3, True, False)]
    plan = documents.select("rec_id", "blocks")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "schema_version" not in plan
