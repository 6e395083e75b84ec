import json
import wave

import numpy as np
from helpers import rows
from pyspark.sql import functions as F

from reelspan.operators import history, ledger, media, report
from reelspan.sources import readers, sinks
from reelspan.streaming import progress


def test_confidence_and_history_rows(spark):
    df = spark.createDataFrame([(-0.10,), (-0.50,), (-0.90,), (None,)], "c double")
    assert [r[0] for r in df.select(history.confidence_label("c")).collect()] == ["alta -0.10", "média -0.50", "baixa -0.90", "desconhec."]
    failed = history.entries_from_failures(spark.createDataFrame([("r", "t", "/a/b.mp4", "first\nsecond"), ("s", "t", "c.wav", " ")], "run_id string, finished_at string, input_path string, message string"))
    assert rows(failed, "file_name", "detail") == [("b.mp4", "first"), ("c.wav", "falha sem detalhe")]


def history_table(spark, n):
    data = [(f"r{i:03}", f"2024-05-06T07:{i % 60:02}:00", f"file{i}.mp4", "error" if i == 2 else "ok", 61.0, "m", "cpu", 3.0, 0.95, 1, 12.4, 0, False, -0.3, i) for i in range(n)]
    return spark.createDataFrame(data, "run_id string, finished_at string, file_name string, status string, duration double, model string, device string, realtime_factor double, coverage double, gaps int, gap_seconds double, failures int, summarized boolean, confidence double, seq int")


def test_retention_and_text(spark):
    h = history_table(spark, 70)
    kept = history.retain(h, 60, ("seq",))
    assert (kept.count(), kept.agg(F.min("seq")).first()[0]) == (60, 10)
    text = history.history_text(history_table(spark, 3).withColumn("detail", F.lit("disco cheio"))).first().content
    rule = "  " + "  ".join("-" * w for _, w in history.COLUMNS)
    assert text.split("\n") == [
        "HISTÓRICO", "", "  3 trabalho(s)  •  1 com erro  •  cobertura média 95.0%  •  velocidade média 3.0x", "",
        "  QUANDO        ARQUIVO                         DURAÇÃO    QUALIDADE         ONDE    VELOC    COBERT   BURACOS   AVISOS   RESUMO   CONFIANÇA", rule,
        "  06/05 07:02   file2.mp4                       -          -                 -       -        -        -         ERRO     -        -",
        "  06/05 07:01   file1.mp4                       1:01       m                 cpu     3.0x     95.0%    1 (12s)   -        não      alta -0.30",
        "  06/05 07:00   file0.mp4                       1:01       m                 cpu     3.0x     95.0%    1 (12s)   -        não      alta -0.30",
        "", "O QUE MERECE UM OLHAR", "", "  file2.mp4: disco cheio",
    ]
    low = history_table(spark, 2).withColumns({"coverage": F.lit(0.5), "failures": F.lit(2)}).unionByName(history_table(spark, 2).withColumns({"coverage": F.lit(None).cast("double"), "failures": F.lit(1)}))
    text = history.history_text(low).first().content
    assert text.count("file0.mp4: só 50.0% do arquivo virou texto (12 s fora do silêncio).") == 1 and text.count("file1.mp4: 1 bloco(s) indisponível(is) no laudo.") == 1 and "cobertura média 50.0%" in text
    assert history.history_text(history_table(spark, 3).limit(0)).first().content.startswith("HISTÓRICO\n\n  Nenhum trabalho ainda.")


def test_lookups_and_sizes(spark):
    files = spark.createDataFrame([("d/a.report.txt", 3), ("d/a.transcript.txt", 4), ("d/e/b.srt", 5)], "path string, length long")
    past = spark.createDataFrame([("d/a", "old", 1), ("d/a", "new", 2)], "base string, name string, seq int")
    assert rows(history.latest_file_lookup(files, past, "seq"), "path", "name") == [("d/a.report.txt", "new"), ("d/a.transcript.txt", "new"), ("d/e/b.srt", "d/e/b")]
    assert rows(history.dir_sizes(files)) == [("d", 12, 3), ("d/e", 5, 1)]
    names = spark.createDataFrame([("Torch-2.dist", 7), ("torch_x", 1), ("other", 9)], "name string, length long")
    assert rows(history.component_sizes(names, {"engine": ["torch", "torch-2"]})) == [("engine", 8)]
    models = spark.createDataFrame([("x/models--Org--small/a", 2), ("x/models--Org--small/b", 3)], "path string, length long")
    assert rows(history.model_inventory(models)) == [("small", 5)]


def test_resume(spark):
    saved = spark.createDataFrame([("j1", "asr", 1, "a"), ("j1", "diarize", 2, "b"), ("j2", "align", 1, "a")], "job_key string, stage string, seq int, diarize_key string")
    jobs = spark.createDataFrame([("j1", "a"), ("j2", "a"), ("j3", "a")], "job_key string, diarize_key string")
    plan = {}
    for r in ledger.resume_plan(jobs, saved, ["seq"]).orderBy("stage_no").collect():
        plan.setdefault(r.job_key, []).append(r.stage)
    assert plan == {"j1": ["diarize", "render"], "j2": ["diarize", "render"], "j3": list(ledger.STAGES)}
    assert rows(ledger.clear_done(saved, jobs.filter("job_key = 'j1'")), "job_key") == [("j2",)]
    assert rows(spark.createDataFrame([("vad",), ("x",)], "s string").select(ledger.stage_index("s"))) == [(-1,), (2,)]
    dated = spark.sql("select 'a' job_key, timestamp'2024-01-01' saved_at, 1 format_version union all select 'b', timestamp'2024-01-09', 1 union all select 'c', timestamp'2024-01-09', 2")
    now = F.lit("2024-01-10").cast("timestamp")
    assert rows(ledger.valid_rows(dated, now), "job_key") == [("b",)]
    assert rows(ledger.purge(dated, now), "job_key") == [("b",), ("c",)]


def test_fingerprints_see_only_their_options(spark):
    df = spark.createDataFrame([("small", "x"), ("large", "x"), ("small", "y")], "model string, output string")
    a, b, c = [r[0] for r in df.select(ledger.fingerprint(["model"])).collect()]
    assert a == c != b and len(a) == 16


EVENTS = [
    ("j", "2024-01-01 00:00:00", "progress", "vad", 0.1), ("j", "2024-01-01 00:04:00", "progress", "asr", 0.5), ("j", "2024-01-01 00:18:00", "progress", "asr", 0.6),
    ("j", "2024-01-01 00:34:00", "done", "render", 1.0), ("k", "2024-01-01 00:00:00", "progress", "vad", 0.2), ("k", "2024-01-01 00:06:00", "pause", "vad", 0.2), ("k", "2024-01-01 00:07:00", "resume", "vad", 0.25),
]


def write_events(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    lines = [json.dumps({"job": j, "ts": t.replace(" ", "T") + "Z", "t": k, "stage": s, "fraction": f}) for j, t, k, s, f in EVENTS]
    (folder / "a.json").write_text("\n".join(lines[:3] + ["", "not json"]))
    (folder / "b.json").write_text("\n".join(lines[3:]))
    return str(folder)


def test_progress_in_batches(spark, tmp_path):
    events = readers.read_progress(spark, write_events(spark, tmp_path))
    assert events.count() == len(EVENTS)
    latest = progress.eta(progress.latest_progress(events))
    assert rows(latest, "job", "stage", "fraction", "elapsed_ms", "eta_ms") == [("j", "render", 1.0, 2_040_000, None), ("k", "vad", 0.25, 420_000, 1_260_000)]
    assert rows(progress.paused_time(events, [])) == [("k", 60_000)]
    assert rows(progress.stage_changes(events, []), "job", "stage") == [("j", "asr"), ("j", "render"), ("j", "vad"), ("k", "vad")]
    assert rows(progress.stall_sessions_batch(events, []), "job", "session_no", "n_events") == [("j", 0, 3), ("j", 1, 1), ("k", 0, 1), ("k", 1, 2)]
    assert rows(events.select(progress.overall_fraction())) [0] == (0.128,)


def test_stream_equals_batch(spark, tmp_path):
    events = readers.read_progress(spark, write_events(spark, tmp_path), stream=True)
    q = progress.latest_progress(events).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = progress.latest_progress(readers.read_progress(spark, str(tmp_path / "events")))
    assert rows(spark.table("latest")) == rows(batch)
    q = progress.stage_changes_stream(readers.read_progress(spark, str(tmp_path / "events"), stream=True)).writeStream.format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("changes").select("job", "stage").distinct()) == [("j", "asr"), ("j", "render"), ("j", "vad"), ("k", "vad")]


def test_stalled_sessions_stream(spark, tmp_path):
    folder = write_events(spark, tmp_path)
    late = {"job": "z", "ts": "2024-01-02T00:00:00Z", "t": "progress", "stage": "vad", "fraction": 0.0}
    (tmp_path / "events" / "c.json").write_text(json.dumps(late))
    q = progress.stalled_sessions(readers.read_progress(spark, folder, stream=True)).writeStream.format("memory").queryName("stalled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("stalled").select("job", "n_events")) == [("j", 3), ("k", 1), ("k", 2)]


def test_results_round_trip(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    doc = {"schema_version": 1, "future": [1], "segments": [{"start": 0.0, "end": 1.2345, "text": " oi ", "words": [{"start": 0.1, "end": 0.2, "word": "oi"}]}]}
    (folder / "a.data.json").write_text(json.dumps(doc))
    (folder / "b.data.json").write_text("{broken")
    results = readers.read_results(spark, str(folder))
    assert rows(results, "rec_id", "readable") == [("a", True), ("b", False)]
    seg = readers.result_segments(results)
    assert rows(seg, "rec_id", "seg_id", "st", "en") == [("a", 0, 0, 1234)]
    rec = spark.createDataFrame([("a", "nome")], "rec_id string, name string")
    sinks.write_documents(sinks.result_rows(rec, seg), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().segments[0].end == 1.234
    sinks.write_texts(sinks.plain_transcripts(seg), str(tmp_path / "texts"))
    assert [r.value for r in spark.read.text(str(tmp_path / "texts")).collect() if r.value] == ["oi"]
    assert readers.read_history(spark, str(tmp_path / "none.json")).count() == 0
    taken = []
    progress.watch_results(spark, str(folder), lambda df, _: taken.append(df.count()), str(tmp_path / "check")).awaitTermination()
    assert sum(taken) == 2


def test_wav_frames(spark, tmp_path):
    rate = 16_000
    tone = (np.sin(np.arange(rate) * 0.3) * 20_000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.concatenate([tone, np.zeros(rate, "<i2"), tone]).tobytes())
    (tmp_path / "b.wav").write_bytes(b"junk")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(tmp_path))
    frames = readers.wav_frames(files)
    assert rows(media.silence_runs(frames, readers.FRAME_MS), "st", "en") == [(1000, 2000)]
    assert abs(media.volume_stats(frames).first().max_volume_db - 20 * np.log10(20_000 / 32768)) < 0.1
    assert [r[1] for r in rows(readers.wav_durations(files), "rec_id", "duration_s")] == [3.0, None]
    listed = readers.list_files(spark, str(tmp_path), [".wav"])
    assert listed.count() == 2 and rows(readers.file_identity(spark, str(tmp_path), "*.wav"), "stem") == [("a",), ("b",)]


def test_report(spark):
    rec = spark.createDataFrame([(1, 10_000, "a.mp4", 1_048_576), (2, None, "b.mp4", None)], "rec_id bigint, duration bigint, name string, size_bytes bigint")
    seg = spark.createDataFrame([(1, 0, 0, 2000, "olá mundo", "SPEAKER_00")], "rec_id bigint, seg_id bigint, st bigint, en bigint, text string, speaker string")
    sil = spark.createDataFrame([], "rec_id bigint, st bigint, en bigint")
    out = {r.rec_id: r.content for r in report.reports(rec, seg, sil).collect()}
    places = [out[1].index(f"{i}. {t.upper()}") for i, t in enumerate(report.TITLES, 1)]
    assert places == sorted(places) and "1.048.576 bytes" in out[1] and "20.0% do arquivo" in out[1]
    assert "[INDISPONÍVEL] Transcrição" in out[2]


def test_download_state(spark):
    e = spark.createDataFrame([("a", 1, "x", 1.0, 4.0, None), ("a", 2, "x", 2.0, 4.0, None), ("b", 1, None, None, None, "no"), ("b", 2, None, None, None, "later")], "job string, seq int, status string, completed double, total double, error string")
    assert rows(readers.download_state(e)) == [("a", None, 0.5), ("b", "no", None)]
