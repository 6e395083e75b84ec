"""Report of a recording as text: nine sections, each worked out as a column of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.format import NONE_MARK, bitrate, decimal_comma, duration_human, float_text, human_size, key_value, tag_name, thousands, timestamp_ms
from reelspan.functions.text import strip, wrap, wrap_indented
from reelspan.operators.intervals import coverage_summary, silence_stats, speech_stats
from reelspan.operators.packing import paragraphs
from reelspan.operators.speakers import speaker_stats
from reelspan.operators.textstats import STOPWORDS, joined_text, language_key, text_counts, top_words
from reelspan.schemas import AUDIO_STREAM, CHAPTER, SUBTITLE_STREAM, VIDEO_STREAM, WORDS
from reelspan.shared import materialise

WIDTH = 78
# Titles of the sections, in order, and texts for what is missing.
TITLES = (
    "Identidade do arquivo", "Metadados técnicos", "Qualidade e diagnóstico", "Idioma", "Transcrição completa", "Diarização", "Estrutura e resumo local", "Camada visual", "Rodapé",
)
MISSING = "[INDISPONÍVEL] "
NO_SPEECH, NO_LANGUAGE, NO_REASON = "nenhum segmento de fala foi produzido para este arquivo.", "não houve transcrição para detectar o idioma.", "motivo não informado."
GAPS_SHOWN, THUMBS_SHOWN = 20, 40
UNLABELLED, STILL_VALID = "SPEAKER_??", "A transcrição acima segue válida; apenas a atribuição de falantes não foi feita."
DENSITY_TEXTS = {"curta": "curta (1 a 2 s por legenda)", "equilibrada": "equilibrada (5 a 8 s por legenda)", "longa": "longa (blocos de até 1 min)"}


def line(text: str) -> Column:
    return F.array(F.lit(text))


class Many(list):
    """One column that holds an array of lines, where a plain column is one line."""


def many(c: Column) -> Many:
    return Many([c])


def lines(*parts: Column | Many) -> Column:
    return F.concat(*[p[0] if isinstance(p, Many) else F.array(p) for p in parts])


def title(number: int) -> Many:
    return many(F.array(F.lit(""), F.lit(f"{number}. {TITLES[number - 1].upper()}"), F.lit("-" * WIDTH)))


def missing(block: str, reason: Column | str) -> Many:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return many(wrap(F.concat(F.lit(f"{MISSING}{block}: "), reason), WIDTH))


def either(condition: Column, yes: Column, no: Column | Many) -> Many:
    return many(F.when(F.coalesce(condition, F.lit(False)), yes).otherwise(no[0] if isinstance(no, Many) else no))


def engine_line(row) -> Column:
    """Engine, model, device and number format of a run; null without an engine."""
    said = lambda c: F.coalesce(row(c), F.lit(NONE_MARK))
    return F.when(row("engine").isNotNull(), F.concat(row("engine"), F.lit(" "), said("model"), F.lit(" | device="), said("device"), F.lit(" | compute_type="), said("compute_type")))


def header(row) -> Column:
    return lines(F.lit("=" * WIDTH), F.lit("RELATÓRIO DE MÍDIA"), F.lit("=" * WIDTH), key_value("Arquivo", row("name")), key_value("SHA-256", row("sha256")), key_value("Processado em", row("finished_at")), key_value("Engine", engine_line(row)), F.lit("-" * WIDTH))


def identity(row) -> Column:
    size = F.when(row("size_bytes").isNotNull(), F.concat(thousands(row("size_bytes")), F.lit(" bytes ("), human_size(row("size_bytes")), F.lit(")")))
    return lines(title(1), *[key_value(n, row(c)) for n, c in (("Nome", "name"), ("Caminho", "path"))], key_value("Tamanho", size), *[key_value(n, row(c)) for n, c in (("SHA-256", "sha256"), ("Modificado em", "modified_at"), ("Engine STT", "engine"), ("Modelo", "model"), ("Device", "device"))])


def video_lines(s: Column) -> Column:
    kv = lambda label, value: key_value(label, value, "    ")
    dash = lambda c: F.coalesce(c.cast("string"), F.lit(NONE_MARK))
    size = lambda a, b: F.when((a > 0) & (b > 0), F.concat(a.cast("string"), F.lit("x"), b.cast("string"))).otherwise(F.lit(NONE_MARK))
    return F.array(
        F.concat(F.lit("  Stream de vídeo #"), s["index"].cast("string")), kv("codec", F.concat(dash(s.codec), F.lit(" ("), F.coalesce(s.codec_long, F.lit("sem descrição")), F.lit(")"))), kv("perfil", s.profile),
        kv("resolução", size(s.width, s.height)), kv("coded", size(s.coded_width, s.coded_height)), kv("SAR / DAR", F.concat(dash(s.sar), F.lit(" / "), dash(s.dar))),
        kv("fps", F.concat(float_text(s.fps, "", 3), F.lit(" (média "), float_text(s.avg_fps, "", 3), F.lit(")"))), kv("bitrate", bitrate(s.bit_rate)), kv("pix_fmt", s.pix_fmt),
        kv("cor", F.concat(F.lit("space="), dash(s.color_space), F.lit(" primaries="), dash(s.color_primaries), F.lit(" transfer="), dash(s.color_transfer))),
        kv("HDR", F.when(s.is_hdr, "sim").otherwise("não")), kv("rotação", F.concat(F.coalesce(s.rotation, F.lit(0)).cast("string"), F.lit("°"))), kv("nb_frames", s.nb_frames), kv("idioma", s.language), F.lit(""),
    )


def audio_lines(s: Column) -> Column:
    kv = lambda label, value: key_value(label, value, "    ")
    return F.array(
        F.concat(F.lit("  Stream de áudio #"), s["index"].cast("string")), kv("codec", F.concat(F.coalesce(s.codec, F.lit(NONE_MARK)), F.lit(" ("), F.coalesce(s.codec_long, F.lit("sem descrição")), F.lit(")"))),
        kv("perfil", s.profile), kv("sample_rate", F.when(s.sample_rate > 0, F.concat(s.sample_rate.cast("string"), F.lit(" Hz")))),
        kv("canais", F.when(s.channels > 0, F.concat(s.channels.cast("string"), F.lit(" ("), F.coalesce(s.channel_layout, F.lit("layout desconhecido")), F.lit(")")))), kv("bitrate", bitrate(s.bit_rate)),
        kv("bits/amostra", s.bits_per_sample), kv("duração", F.when(s.duration > 0, timestamp_ms(F.bround(s.duration * 1000).cast("bigint")))), kv("idioma", s.language), kv("título", s.title), F.lit(""),
    )


def subtitle_line(s: Column) -> Column:
    named = F.concat(F.lit("    #"), s["index"].cast("string"), F.lit(": "), F.coalesce(s.codec, F.lit(NONE_MARK)), F.lit(" ["), F.coalesce(s.language, F.lit("idioma não declarado")), F.lit("] "), F.coalesce(s.title, F.lit("")))
    return F.rtrim(named)


def chapter_line(c: Column) -> Column:
    at = lambda x: timestamp_ms(F.bround(x * 1000).cast("bigint"))
    return F.concat(F.lit("    ["), at(c.start), F.lit(" → "), at(c.end), F.lit("] "), F.coalesce(c.title, F.lit("(sem título)")))


def metadata(row) -> Column:
    duration = F.concat(timestamp_ms(row("duration")), F.lit("  ("), float_text(row("duration") / 1000.0, " s"), F.lit(")"))
    empty = F.array().cast("array<string>")

    def tag(e: Column) -> Column:
        """A tag's lines: its name stands at the first one."""
        shown = F.transform(F.array(wrap(e.value, WIDTH - 24)), lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(F.lit(NONE_MARK))))[0]
        return F.transform(shown, lambda part, i: F.concat(F.lit("    "), F.rpad(F.when(i == 0, tag_name(e.key)).otherwise(F.lit("")), 16, " "), F.lit(": "), part))

    tags = F.flatten(F.transform(F.sort_array(F.map_entries(row("tags"))), tag))
    streams = lambda c, f, none: either(F.size(row(c)) > 0, F.flatten(F.transform(row(c), f)), F.array(F.lit(none), F.lit("")))
    subtitles = either(F.size(row("subtitles")) > 0, F.concat(line("  Legendas embutidas"), F.transform(row("subtitles"), subtitle_line), line("")), empty)
    return lines(
        title(2), F.lit("  Container"), key_value("formato", F.concat(row("format_name"), F.lit(" ("), F.coalesce(row("format_long_name"), F.lit("sem descrição")), F.lit(")")), "    "), key_value("duração", duration, "    "), key_value("bitrate", bitrate(row("bit_rate")), "    "),
        key_value("streams", row("nb_streams"), "    "), F.lit(""), streams("video", video_lines, "  Stream de vídeo : nenhum"), streams("audio", audio_lines, "  Stream de áudio : nenhum"), subtitles,
        F.lit("  Tags do container"), either(F.size(row("tags")) > 0, tags, line("    (nenhuma)")), F.lit(""), F.lit("  Capítulos"),
        either(F.size(row("chapters")) > 0, F.transform(row("chapters"), chapter_line), line("    (nenhum)")),
    )


def quality(row) -> Column:
    share = lambda c: F.concat(F.lit(" ("), float_text(F.coalesce(row(c), F.lit(0.0)) * 100, "%", 1), F.lit(" do arquivo)"))
    yes_no = lambda c: F.when(row(c), "sim").when(~row(c), "não")
    warned = F.flatten(F.transform(row("warnings"), lambda w: wrap_indented(w, WIDTH, "    - ", "      ")))
    stage = lambda s: F.concat(F.lit("    "), F.rpad(s.stage, 12, " "), F.lit(" "), F.lpad(float_text(s.ms / 1000.0, " s"), 12, " "), F.lit("   ["), s.status, F.lit("]"))
    stages = either(F.size(row("stages")) > 0, F.concat(F.array(F.lit(""), F.lit("  Tempo por etapa")), F.transform(row("stages"), stage)), F.array().cast("array<string>"))
    return lines(
        title(3), key_value("Trilha de áudio", F.when(F.coalesce(row("has_audio"), F.size(row("audio")) > 0, F.lit(False)), "sim").otherwise("não")), key_value("Fala detectada", yes_no("speech_detected")),
        key_value("Volume médio", float_text(row("mean_volume_db"), " dB", 1)), key_value("Pico", float_text(row("max_volume_db"), " dB", 1)),
        key_value("Clipping", F.when(row("clipping_suspected"), "suspeito").otherwise("não detectado")), key_value("Silêncio", F.concat(duration_human(row("measured_silence")), share("silence_ratio"))),
        key_value("Fala", F.concat(duration_human(row("speech_seconds")), share("speech_ratio"))), key_value("Segmentos VAD", row("vad_segments")), F.lit(""),
        key_value("Tempo total", float_text(row("elapsed_seconds"), " s", 1)), key_value("Velocidade", F.when(row("realtime_factor") > 0, float_text(row("realtime_factor"), "x tempo real"))), stages,
        F.lit(""), F.lit("  Avisos"), either(F.size(row("warnings")) > 0, warned, line("    (nenhum)")),
    )


def language(row) -> Column:
    body = F.array(key_value("Idioma", row("language")), key_value("Confiança", F.when(row("language_probability") > 0, float_text(row("language_probability") * 100, "%", 1))))
    return lines(title(4), either(row("language").isNotNull(), body, missing("Idioma", NO_LANGUAGE)))


def coverage_lines(row) -> Many:
    gaps = F.coalesce(row("gaps"), F.array().cast("array<struct<st:double,en:double>>"))
    ms = lambda c: F.round(c * 1000).cast("bigint")
    shown = F.transform(F.slice(gaps, 1, GAPS_SHOWN), lambda g: F.concat(F.lit("    "), timestamp_ms(ms(g.st)), F.lit(" → "), timestamp_ms(ms(g.en)), F.format_string("  (%.1f s)", g.en - g.st)))
    more = F.when(F.size(gaps) > GAPS_SHOWN, F.array(F.format_string("    ... e mais %d.", F.size(gaps) - GAPS_SHOWN))).otherwise(F.array().cast("array<string>"))
    lost = F.when(F.size(gaps) == 0, F.lit("nenhum trecho fora do silêncio")).otherwise(F.concat(F.size(gaps).cast("string"), F.lit(" trecho(s), somando "), float_text(row("gap_seconds"), " s")))
    body = F.concat(
        F.array(F.lit("[BLOCO A2] Cobertura da linha do tempo"), F.lit(""), key_value("Transcrito", F.format_string("%.1f%% do arquivo", row("ratio") * 100)), key_value("Com fala", float_text(row("covered_seconds"), " s")), key_value("Silêncio medido", float_text(row("silence_seconds"), " s")), key_value("Sem texto", lost)),
        shown, more, F.array(F.lit("")),
    )
    return either(row("analyzed"), body, missing("Cobertura", F.coalesce(row("coverage_reason"), F.lit("não foi possível medir."))))


def word_block(row) -> Many:
    """Block C: word times, for recordings whose run asked for them."""
    none = missing("Timestamps por palavra", "a engine não retornou marcação em nível de palavra.")[0]
    body = F.concat(F.array(F.lit(""), F.lit("[BLOCO C] Timestamps por palavra"), F.lit("")), F.when(F.size(row("word_lines")) > 0, row("word_lines")).otherwise(none))
    return either(row("word_timestamps"), body, F.array().cast("array<string>"))


def word_lines_of(segment: Column, start: Column, words: Column) -> Column:
    """Lines of one segment's words; none where it has no words."""
    sure = lambda w: F.coalesce(F.concat(F.lit("  p="), decimal_comma(F.format_string("%.2f", w.probability))), F.lit(""))
    each = F.transform(words, lambda w: F.concat(F.lit("    "), timestamp_ms(w.st), F.lit(" → "), timestamp_ms(w.en), F.lit("  "), strip(w.word), sure(w)))
    head = F.array(F.concat(F.lit("  Segmento #"), segment.cast("string"), F.lit(" ["), timestamp_ms(start), F.lit("]")))
    return F.when(F.size(words) > 0, F.concat(head, each)).otherwise(F.array().cast("array<string>"))


def transcript(row) -> Column:
    body = F.concat(F.array(F.lit("[BLOCO A] Texto corrido"), F.lit("")), row("paragraph_lines"), coverage_lines(row)[0], F.array(F.lit("[BLOCO B] Segmentos com timestamps"), F.lit("")), row("segment_lines"), word_block(row)[0])
    return lines(title(5), either(F.size(row("segment_lines")) > 0, body, missing("Transcrição", NO_SPEECH)))


def diarization(row) -> Column:
    stat = lambda s: F.concat(F.lit("    "), F.rpad(s.speaker, 14, " "), F.lit(" "), F.lpad(duration_human(s.seconds), 12, " "), F.lit("  ("), F.lpad(float_text(s.ratio * 100, "%", 1), 6, " "), F.lit(")  "), s.segments.cast("string"), F.lit(" segmento(s)"))
    body = F.concat(F.array(key_value("Backend", row("diarization_backend")), key_value("Falantes", F.size(row("speakers"))), F.lit(""), F.lit("  Tempo de fala por falante")), F.transform(row("speakers"), stat))
    without = F.concat(missing("Diarização", F.coalesce(row("diarization_reason"), F.lit(NO_REASON)))[0], line(""), wrap(F.lit(STILL_VALID), WIDTH))
    return lines(title(6), either(F.size(row("speakers")) > 0, body, without))


def structure(row) -> Column:
    word = lambda w: F.concat(F.lit("    "), F.lpad(w.rank.cast("string"), 2, " "), F.lit(". "), F.rpad(w.word, 24, " "), F.lit(" "), F.lpad(w["count"].cast("string"), 5, " "))
    empty = F.array().cast("array<string>")
    listed = lambda c, name: F.when(F.size(row(c)) > 0, F.concat(F.array(F.lit(""), F.lit(f"  {name}")), F.transform(row(c), lambda x: F.concat(F.lit("    - "), x)))).otherwise(empty)
    made_by = F.concat(F.lit("  Resumo local ("), F.coalesce(row("summary_provider"), F.lit(NONE_MARK)), F.lit(" / "), F.coalesce(row("summary_model"), F.lit(NONE_MARK)), F.lit(")"))
    text = F.flatten(F.transform(F.split(row("summary"), "\n"), lambda p: wrap_indented(p, WIDTH - 4, "    ")))
    told = F.concat(F.array(made_by), text, listed("topics", "Tópicos"), listed("action_items", "Itens de ação"), listed("quotes", "Citações"))
    summary = either(row("summary").isNotNull(), told, missing("Resumo com LLM local", F.coalesce(row("summary_reason"), F.lit("bloco desativado."))))
    key = language_key(F.coalesce(row("language"), F.lit("")))
    note = F.when(key.isin(*STOPWORDS), F.concat(F.lit(" (stopwords de '"), key, F.lit("' removidas)"))).otherwise(F.lit(" (sem lista de stopwords para este idioma)"))
    return lines(
        title(7), *[key_value(n, thousands(row(c))) for n, c in (("Palavras", "words"), ("Palavras únicas", "unique_words"), ("Caracteres", "characters"), ("Sem espaços", "characters_no_spaces"))],
        key_value("Segmentos", F.coalesce(row("n_segments"), F.lit(0))), key_value("Ritmo", float_text(row("words_per_minute"), " palavras/min", 1)), F.lit(""), F.concat(F.lit("  Palavras mais frequentes"), note),
        either(F.size(row("top")) > 0, F.transform(row("top"), word), line("    (nenhuma)")), F.lit(""), summary,
    )


def visual(row) -> Column:
    thumbs = row("thumbnails")
    shown = F.transform(F.slice(thumbs, 1, THUMBS_SHOWN), lambda t: F.concat(F.lit("    "), t))
    more = F.when(F.size(thumbs) > THUMBS_SHOWN, F.array(F.format_string("    … e mais %d arquivo(s)", F.size(thumbs) - THUMBS_SHOWN))).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    cuts = F.when(row("scene_threshold").isNotNull(), F.concat(row("scene_cuts").cast("string"), F.lit(" (limiar "), float_text(row("scene_threshold")), F.lit(")"))).otherwise(row("scene_cuts").cast("string"))
    taken = F.when(row("thumbnail_interval").isNotNull(), F.format_string("%d a cada %.0f s", F.coalesce(F.size(thumbs), F.lit(0)), row("thumbnail_interval")))
    remark = F.when(row("visual_reason").isNotNull(), F.concat(line(""), wrap(F.concat(F.lit("Observação: "), row("visual_reason")), WIDTH))).otherwise(empty)
    listed = F.when(F.size(thumbs) > 0, F.concat(F.array(F.lit(""), F.lit("  Arquivos gerados (pasta sidecar)")), shown, F.coalesce(more, empty))).otherwise(empty)
    body = F.concat(F.array(key_value("Res. codificada", row("coded_resolution")), key_value("Res. exibida", row("resolution")), key_value("Cortes de cena", cuts), key_value("Thumbnails", taken)), F.coalesce(listed, empty), remark)
    return lines(title(8), either(row("resolution").isNotNull(), body, missing("Camada visual", F.coalesce(row("visual_reason"), F.lit("desligada.")))))


def footer(row) -> Column:
    outputs = F.transform(F.sort_array(F.map_entries(row("outputs"))), lambda e: F.concat(F.lit("    "), F.rpad(e.key, 15, " "), F.lit(" "), e.value))
    failures = F.flatten(F.transform(row("partial_failures"), lambda f: wrap_indented(f, WIDTH, "    - ", "      ")))
    empty = F.array().cast("array<string>")
    density = F.coalesce(F.create_map(*[F.lit(x) for kv in DENSITY_TEXTS.items() for x in kv])[row("subtitle_density")], row("subtitle_density"))
    subtitled = F.coalesce(F.map_contains_key(row("outputs"), F.lit("srt")) | F.map_contains_key(row("outputs"), F.lit("vtt")), F.lit(False)) & (F.coalesce(row("subtitle_density"), F.lit("")) != "")
    first = F.get(F.map_values(row("outputs")), F.lit(0))
    folder = F.when(first.isNull() | ~first.contains("/"), F.lit(".")).otherwise(F.coalesce(F.nullif(F.regexp_replace(first, "/[^/]*$", ""), F.lit("")), F.lit("/")))
    return lines(
        title(9), F.lit("  Arquivos gerados"), either(F.size(row("outputs")) > 0, outputs, line("    (nenhum)")), either(subtitled, F.array(F.lit(""), key_value("Tamanho das legendas", density)), empty),
        F.lit(""), key_value("Pasta de saída", folder), key_value("Modelos", row("model_path")), F.lit(""), F.lit("  Erros parciais"),
        either(F.size(row("partial_failures")) > 0, failures, line("    (nenhum)")), F.lit(""), F.lit("=" * WIDTH),
    )


OPTIONAL = {
    "name": "string", "path": "string", "sha256": "string", "size_bytes": "bigint", "modified_at": "string", "finished_at": "string", "engine": "string", "model": "string", "device": "string",
    "format_name": "string", "bit_rate": "bigint", "nb_streams": "int", "tags": "map<string,string>", "warnings": "array<string>", "realtime_factor": "double", "language": "string",
    "language_probability": "double", "summary": "string", "summary_reason": "string", "resolution": "string", "scene_cuts": "int", "thumbnails": "array<string>", "outputs": "map<string,string>",
    "partial_failures": "array<string>", "format_long_name": "string", "video": f"array<{VIDEO_STREAM}>", "audio": f"array<{AUDIO_STREAM}>", "subtitles": f"array<{SUBTITLE_STREAM}>",
    "chapters": f"array<{CHAPTER}>", "has_audio": "boolean", "mean_volume_db": "double", "max_volume_db": "double", "clipping_suspected": "boolean", "elapsed_seconds": "double",
    "compute_type": "string", "diarization_backend": "string", "diarization_reason": "string", "summary_provider": "string", "summary_model": "string", "topics": "array<string>", "action_items": "array<string>",
    "quotes": "array<string>", "visual_reason": "string", "subtitle_density": "string", "model_path": "string",
    "stages": "array<struct<stage:string,ms:bigint,status:string>>", "word_timestamps": "boolean", "coded_resolution": "string", "scene_threshold": "double", "thumbnail_interval": "double",
}


def availability(rows: DataFrame, blocks: dict[str, tuple[Column, str | Column]]) -> DataFrame:
    """Adds (name_available, name_reason) for every optional block: a condition, and what is said where it doesn't hold."""
    for name, (ok, reason) in blocks.items():
        held = F.coalesce(ok, F.lit(False))
        reason = F.lit(reason) if isinstance(reason, str) else F.coalesce(reason, F.lit(NO_REASON))
        rows = rows.withColumn(f"{name}_available", held).withColumn(f"{name}_reason", F.when(~held, reason))
    return rows


def reports(recordings: DataFrame, segments: DataFrame, silences: DataFrame, rec: str = "rec_id") -> DataFrame:
    """(rec, content): the report of every recording (rec, duration in ms, and what there is of OPTIONAL).

    Every block is worked out per recording and joined on it; what is missing says so instead of failing.
    """
    # Written once: each block reads them again, and what they come from may be dear.
    recordings, segments, silences = (materialise(df, name) for df, name in ((recordings, "recordings"), (segments, "segments"), (silences, "silences")))
    base = recordings.select(rec, F.col("duration").cast("bigint").alias("duration"), *[(F.col(c) if c in recordings.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()])
    # Where some segment of a recording has a speaker, those without one say so.
    speaker = F.nullif(F.col("speaker"), F.lit("")) if "speaker" in segments.columns else F.lit(None).cast("string")
    named = F.max(speaker.isNotNull()).over(Window.partitionBy(rec))
    label = F.when(named, F.concat(F.coalesce(speaker, F.lit(UNLABELLED)), F.lit(": "))).otherwise(F.lit(""))
    rows = segments.withColumn("_s", F.concat(F.lit("["), timestamp_ms("st"), F.lit(" → "), timestamp_ms("en"), F.lit("] "), label))
    cut = F.transform(F.array(wrap(F.col("text"), F.greatest(F.lit(20), WIDTH - F.length("_s")))), lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(F.lit(""))))[0]
    wrapped = F.transform(cut, lambda t, i: F.concat(F.when(i == 0, F.col("_s")).otherwise(F.repeat(F.lit(" "), F.length("_s"))), t))
    seg_lines = rows.select(rec, "seg_id", wrapped.alias("l")).groupBy(rec).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seg_id", "l"))), lambda x: x.l)).alias("segment_lines"), F.count("*").alias("n_segments"))
    par = paragraphs(segments, rec=rec).select(rec, "par_no", F.concat(wrap("text", WIDTH), F.array(F.lit(""))).alias("l"))
    par_lines = par.groupBy(rec).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("par_no", "l"))), lambda x: x.l)).alias("paragraph_lines"))
    covered = coverage_summary(segments, silences, recordings, rec=rec).withColumnRenamed("reason", "coverage_reason")
    spoken = speech_stats(segments, recordings, rec)
    quiet = silence_stats(silences, recordings, rec).select(rec, F.col("silence_seconds").alias("measured_silence"), "silence_ratio")
    own = F.coalesce("words", F.array().cast(WORDS)) if "words" in segments.columns else F.array().cast(WORDS)
    timed = segments.select(rec, "seg_id", word_lines_of(F.col("seg_id"), F.col("st"), own).alias("l")).filter(F.size("l") > 0)
    word_lines = timed.groupBy(rec).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seg_id", "l"))), lambda x: x.l)).alias("word_lines"))
    speakers = speaker_stats(segments, rec).groupBy(rec).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "speaker", "seconds", "ratio", "segments"))), lambda x: x).alias("speakers"))
    text = joined_text(segments, rec).join(recordings.select(rec, (F.col("duration") / 1000.0).alias("_s")), rec)
    counts = text_counts(text, rec, "text", "_s")
    langs = text.join(base.select(rec, "language"), rec).withColumn("lang", F.coalesce("language", F.lit("")))
    top = top_words(langs, key=rec).groupBy(rec).agg(F.sort_array(F.collect_list(F.struct("rank", "word", "count"))).alias("top"))
    full = base
    for part in (seg_lines, par_lines, word_lines, covered, spoken, quiet, speakers, counts, top):
        full = full.join(part, rec, "left")
    sections = [f(F.col) for f in (header, identity, metadata, quality, language, transcript, diarization, structure, visual, footer)]
    return full.select(rec, F.concat(F.array_join(F.concat(*sections), "\n"), F.lit("\n")).alias("content"))
