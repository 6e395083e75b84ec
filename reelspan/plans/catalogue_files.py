"""Registered queries of the operators that take JSON, log text and file listings, all built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspan.functions.format import bitrate, clock_padded, download_label, duration_words, float_text, human_size, iso_from_epoch, key_value, tag_name, thousands, when_text
from reelspan.functions.text import safe_stem, tokens
from reelspan.functions.tolerant import clamp
from reelspan.operators import align, history, intervals, ledger, media, packing, speakers, textstats
from reelspan.plans.catalogue import query
from reelspan.plans.views import DAY, chunk_emb, hist_ord, inv_pages, ledger_ev, prog_ev, seg_conv, seg_ev, seg_words, table, turn_ev, with_views
from reelspan.sources import readers, sinks
from reelspan.streaming import progress


def text_of(*parts):
    """A text column of literals and string columns, in order."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def pick(values, key):
    """One of some literals, by a key modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values, key: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{key} % {len(values)} + 1]"


# -- probe documents and logs -----------------------------------------------------------

TRANSFERS = ("bt709", "smpte2084", "BT2020-10", "arib-std-b67", "bt2020-12", "smpte428", "gamma22")


def probed(spark, d):
    """One raw probe document per order: streams, tags and flags follow from its key."""
    k = F.col("o_orderkey")
    part = lambda cond, text: F.when(cond, text if not isinstance(text, str) else F.lit(text)).otherwise(F.lit(""))
    raw = text_of(
        '{"format":{"format_name":"mov","format_long_name":"QuickTime","duration":"', F.when(k % 7 == 0, F.lit("N/A")).otherwise((k % 100).cast("string")), '","bit_rate":"', (k * 10).cast("string"), '","nb_streams":"3","tags":{"b":"2","a":"1"}},"streams":[',
        '{"index":0,"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"30000/1001","avg_frame_rate":"0/0","color_transfer":"', pick(TRANSFERS, k), '","disposition":{"attached_pic":', (k % 5 == 0).cast("int").cast("string"), "}",
        part(k % 3 != 0, ',"nb_frames":"100"'), ',"tags":{"ROTATE":"', pick(("0", "90", "180", "270"), k), '"}', part(k % 4 == 0, ',"side_data_list":[{},{"rotation":"-90"}]'), ',"duration":"', (k % 50).cast("string"), '.5"}',
        part(k % 6 != 0, text_of(',{"index":1,"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":', (k % 3).cast("string"), ',"bits_per_raw_sample":"', pick(("0", "24"), k), '","bits_per_sample":"16","duration":"3.25"}')),
        ',{"index":2,"codec_type":"subtitle","codec_name":"srt","tags":{"language":"pt"}}],"chapters":[{"start_time":"0.0","end_time":"5.5"},{"id":"', (k % 9).cast("string"), '","start_time":"5.5","end_time":"N/A","tags":{"title":"fim"}}]}',
    )
    return media.probe_documents(table(spark, d, "orders").select(k.alias("rec_id"), raw.alias("raw")))


@query(f"""SELECT k AS rec_id, CASE WHEN k%7=0 OR k%100=0 THEN (CASE WHEN k%6=0 THEN k%50+0.5 ELSE greatest(k%50+0.5, 3.25) END)::DOUBLE ELSE (k%100)::DOUBLE END AS duration, k*10 AS bit_rate, k%6<>0 AS has_audio,
NOT (k%3=0 AND k%5=0) AS has_video, {pick_sql(TRANSFERS, 'k')} NOT IN ('bt709','gamma22') AS is_hdr, CASE WHEN k%4=0 THEN 270 ELSE (k%4)*90 END AS rotation, CASE WHEN k%3<>0 THEN 100 WHEN k%5=0 THEN 1 END AS nb_frames,
29.97003::DOUBLE AS fps, CAST(NULL AS DOUBLE) AS avg_fps, CASE WHEN k%6<>0 THEN CASE WHEN k%2=1 THEN 24 ELSE 16 END END AS bits, CASE WHEN k%6<>0 THEN k%3 END AS channels, 'pt' AS subtitle_language, [0, k%9] AS chapter_ids, 'fim' AS chapter_title
FROM (SELECT o_orderkey AS k FROM orders)""")
def probe_documents(spark, d):
    v, a = F.get("video", F.lit(0)), F.get("audio", F.lit(0))
    return probed(spark, d).select(
        "rec_id", "duration", "bit_rate", "has_audio", "has_video", v.is_hdr.alias("is_hdr"), v.rotation.alias("rotation"), v.nb_frames.alias("nb_frames"), v.fps.alias("fps"), v.avg_fps.alias("avg_fps"), a.bits_per_sample.alias("bits"),
        a.channels.alias("channels"), F.get("subtitles", F.lit(0)).language.alias("subtitle_language"), F.transform("chapters", lambda c: c["index"]).alias("chapter_ids"), F.get("chapters", F.lit(1)).title.alias("chapter_title"),
    )


@query("SELECT o_orderkey AS rec_id, 0 AS \"index\", '1920x1080' AS coded, CASE WHEN o_orderkey%4 IN (0, 1, 3) THEN '1080x1920' ELSE '1920x1080' END AS displayed FROM orders")
def resolutions(spark, d):
    return media.resolutions(probed(spark, d))


SUFFIXES = (".ts", ".mp4", ".flv", ".MKV", ".txt", ".mpeg", ".3gp", ".wmv", ".opus", ".Webm", ".m4v")


@query(f"SELECT page_id, {pick_sql(SUFFIXES, 'page_id')} IN ('.ts','.mp4','.MKV','.mpeg','.wmv','.Webm','.m4v') AS is_video FROM pages")
def video_paths(spark, d):
    return table(spark, d, "pages").select("page_id", media.is_video_path(F.concat("url", pick(SUFFIXES, F.col("page_id")))).alias("is_video"))


@query("""SELECT o_orderkey AS rec_id, CASE WHEN o_orderkey%11>0 THEN -(o_orderkey%60)-0.5 END::DOUBLE AS mean_volume_db, -(o_custkey%30+1)/10 AS max_volume_db, o_orderkey%150 AS clipping_samples, (o_custkey%50)/4+0.75 AS silence_seconds,
CASE WHEN o_orderkey%5>0 THEN round(least(1.0, ((o_custkey%50)/4+0.75)/(o_orderkey%5*4)), 4) END AS silence_ratio, o_orderkey%150>100 OR (o_custkey%30=0 AND o_orderkey%150>0) AS clipping_suspected, CAST(o_orderkey%4 AS INTEGER) AS scene_cuts FROM orders""")
def log_metrics(spark, d):
    """Volumes, full-scale samples and scene cuts of diagnostic logs."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mean = F.when(k % 11 > 0, text_of("mean_volume: -", (k % 60).cast("string"), ".5 dB\n")).otherwise(F.lit("mean_volume: none\n"))
    log = text_of("[x] ", mean, "[x] max_volume: -", F.format_string("%.1f", (c % 30 + 1) / 10.0), " dB\n[x] histogram_0db: ", (k % 150).cast("string"), "\nhistogram_1db: 7\n histogram_0db: ", (c % 2).cast("string"), "\nsilence_end: 2 | silence_duration: ", ((c % 50) / 4.0).cast("string"), "\nsilence_duration: 0.75\n", F.repeat(F.lit("pts_time:1.5 pts_time:x\n"), (k % 4).cast("int")))
    logs = table(spark, d, "orders").select(k.alias("rec_id"), log.alias("log"), (k % 5 * 4000).alias("duration"))
    return media.log_metrics(logs).join(media.scene_cuts(logs), "rec_id")


def frames(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").cast("bigint").alias("frame_idx"), (F.col("l_discount").cast("double") * F.col("l_discount").cast("double") / 100).alias("ms"), F.col("l_tax").cast("double").alias("peak"), (F.col("l_quantity") % 3).cast("bigint").alias("n_full"), F.col("l_discount").cast("double").alias("score"),
    )


_FRAMES = "frames AS (SELECT l_orderkey AS rec_id, CAST(l_linenumber AS BIGINT) AS frame_idx, CAST(l_discount AS DOUBLE)*CAST(l_discount AS DOUBLE)/100 AS ms, CAST(l_tax AS DOUBLE) AS peak, CAST(l_quantity%3 AS BIGINT) AS n_full, CAST(l_discount AS DOUBLE) AS score FROM lineitem)"


@query(f"WITH {_FRAMES} SELECT rec_id, CASE WHEN avg(ms)>0 THEN round(10*log10(avg(ms)),1) END AS mean_volume_db, CASE WHEN max(peak)>0 THEN round(20*log10(max(peak)),1) END AS max_volume_db, CAST(sum(n_full) AS BIGINT) AS clipping_samples, count(*) FILTER (WHERE score>0.05) AS scene_cuts FROM frames GROUP BY rec_id")
def volume_stats(spark, d):
    return media.volume_stats(frames(spark, d)).join(media.scene_cuts_from_scores(frames(spark, d), 0.05), "rec_id")


@query(f"""WITH {_FRAMES}, quiet AS (SELECT rec_id, frame_idx, frame_idx-row_number() OVER (PARTITION BY rec_id ORDER BY frame_idx) AS run FROM frames WHERE CASE WHEN ms>0 THEN 10*log10(ms) ELSE -200 END < -48)
SELECT rec_id, min(frame_idx)*20 AS st, (max(frame_idx)+1)*20 AS en FROM quiet GROUP BY rec_id, run HAVING (max(frame_idx)+1-min(frame_idx))*20>=40""")
def silence_runs(spark, d):
    return media.silence_runs(frames(spark, d), 20, -48.0, 40)


# -- raw engine output ---------------------------------------------------------------------


@query(with_views("""SELECT rec_id, seg_id, st, en, trim(text, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS text, round(-(seg_id%7)/7, 4) AS avg_logprob, CAST(len(toks) AS INTEGER) AS n_words, CASE WHEN len(toks)>0 THEN st+400 END AS first_end, CASE WHEN len(toks)>0 THEN 0.3333::DOUBLE END AS first_probability
FROM (SELECT *, regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+(?:[’''-][\\p{L}\\p{Nl}\\p{No}]+)*') AS toks, row_number() OVER (PARTITION BY rec_id ORDER BY s0)-1 AS seg_id FROM (SELECT rec_id, seg_id AS s0, st, en, text FROM seg_conv))""", "seg_conv"))
def normalised_segments(spark, d):
    """Segments as an engine gives them, in seconds and with white space, made table rows again."""
    at = lambda i: (F.col("st") + 400 * i) / 1000.0
    words = F.transform(tokens("text"), lambda w, i: F.struct(w.alias("word"), at(i).alias("start"), at(i + 1).alias("end"), F.lit(1 / 3).alias("probability")))
    raw = seg_conv(spark, d).select("rec_id", F.col("seg_id").alias("ord"), (F.col("st") / 1000.0 + 0.0002).alias("start"), (F.col("en") / 1000.0 - 0.0002).alias("end"), F.concat(F.lit("\t\n "), "text", F.lit(" \n")).alias("text"), words.alias("words"))
    raw = raw.withColumn("number", F.expr("row_number() over (partition by rec_id order by ord) - 1")).withColumn("avg_logprob", -(F.col("number") % 7) / 7.0)
    rows = align.normalise_segments(raw)
    first = F.get("words", F.lit(0))
    return rows.select("rec_id", "seg_id", "st", "en", "text", "avg_logprob", F.size("words").alias("n_words"), first.en.alias("first_end"), first.probability.alias("first_probability"))


@query(with_views("""SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY win_st, seg_id)-1 AS seg_id, st, en, text FROM (
SELECT rec_id, seg_id, st AS win_st, st+CASE WHEN seg_id%3=0 THEN 0 ELSE 100 END AS st, CASE WHEN seg_id%2=0 THEN en ELSE st+200 END AS en, text FROM seg_ev WHERE seg_id%5<>0)""", "ev", "seg_ev"))
def window_segments(spark, d):
    """Offsets inside a window as file times; every fifth text is white space only."""
    k = F.col("seg_id")
    raw = seg_ev(spark, d).select(
        "rec_id", k.alias("ord"), F.col("st").alias("win_st"), F.col("en").alias("win_en"), F.when(k % 3 != 0, F.lit(100)).cast("bigint").alias("rel_st"), F.when(k % 2 != 0, F.lit(200)).cast("bigint").alias("rel_en"),
        F.when(k % 5 == 0, F.lit("\n\t ")).otherwise(F.concat(F.lit("\t"), "text", F.lit("\n"))).alias("text"),
    )
    return align.from_windows(raw)


@query(with_views("SELECT rec_id, unnest(range(0, en, 3000)) AS at FROM (SELECT rec_id, max(en) AS en FROM seg_conv GROUP BY rec_id)", "seg_conv"))
def frame_times(spark, d):
    return packing.frame_times(seg_conv(spark, d).groupBy("rec_id").agg(F.max("en").alias("duration")), 3)


@query(with_views("SELECT rec_id, round(sum(en-st)/1000.0,3) AS speech_seconds FROM merged GROUP BY rec_id", "ev", "seg_ev", "merged"))
def speech_after_vad(spark, d):
    return history.speech_after_vad(intervals.merge_spans(seg_ev(spark, d)))


@query("""SELECT rec_id, 'SPEAKER_'||lpad(CAST(min(cluster) AS VARCHAR),2,'0') AS speaker, min(st) AS st, max(en) AS en FROM (SELECT *, idx-row_number() OVER (PARTITION BY rec_id, cluster ORDER BY idx) AS run FROM (
SELECT vec_id//10 AS rec_id, vec_id%10 AS idx, (vec_id//3)%2 AS cluster, (vec_id%10)*4000 AS st, (vec_id%10)*4000+4000 AS en FROM embeddings)) GROUP BY rec_id, cluster, run""")
def chunk_turns(spark, d):
    """Turns of chunks of 4 s whose clusters change every three chunks."""
    vec = F.col("rec_id") * 10 + F.col("idx")
    chunks = chunk_emb(spark, d).select("rec_id", "idx", (F.col("idx") * 4000).cast("bigint").alias("st"), (F.col("idx") * 4000 + 4000).cast("bigint").alias("en"), F.pmod(F.floor(vec / 3), F.lit(2)).cast("int").alias("cluster"))
    return speakers.chunk_turns(chunks.drop("cluster"), chunks.select("rec_id", "idx", "cluster"))


# -- history, files, ledger ------------------------------------------------------------------


def runs_of(spark, d):
    """Runs with the columns of the history table."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at"), text_of("gravacao-de-nome-bem-comprido-", k.cast("string"), ".mp4").alias("file_name"),
        (k % 5000).cast("double").alias("duration"), F.when(k % 4 != 0, F.lit("small")).alias("model"), F.when(k % 3 != 0, F.lit("cuda:0")).otherwise(F.lit("")).alias("device"),
        F.when(k % 5 != 0, (k % 50) / 10.0).alias("realtime_factor"), (k % 3).cast("int").alias("failures"), (k % 2 == 0).alias("summarized"), (F.col("o_custkey") % 90).alias("gap_seconds"), ((k % 100) / 100.0).alias("ratio"),
        (k % 6 != 0).alias("analyzed"), (k % 4).alias("n_gaps"),
    )


_CONFIDENCE = "CASE WHEN c IS NULL THEN 'desconhec.' WHEN c>=-0.35 THEN printf('alta %.2f', c) WHEN c>=-0.60 THEN printf('média %.2f', c) ELSE printf('baixa %.2f', c) END"
_CLOCK = "CASE WHEN s>=3600 THEN printf('%d:%02d:%02d', s//3600, s//60%60, s%60) ELSE printf('%d:%02d', s//60, s%60) END"


_RUNS = """FROM (SELECT o_orderkey AS run_id, o_orderdate, 'ok' AS status, NULL AS detail, 'gravacao-de-nome-bem-comprido-'||o_orderkey||'.mp4' AS f, o_orderkey%5000 AS s, o_custkey%90 AS gs, CASE WHEN o_orderkey%8<>0 THEN -(o_orderkey%10)/10-0.05 END AS c FROM orders
UNION ALL SELECT -o_orderkey, o_orderdate, 'error', CASE WHEN o_orderkey%2=0 THEN 'falha sem detalhe' ELSE 'disco cheio' END, 'f'||o_orderkey||'.mp4', 0, 0, NULL FROM orders WHERE o_orderstatus='P')"""
_CELLS = f"""SELECT run_id, status, detail, CASE WHEN status='ok' THEN [strftime(o_orderdate, '%d/%m %H:%M'), f[1:14]||'…'||right(f,15), {_CLOCK}, CASE WHEN run_id%4<>0 THEN 'small' ELSE '-' END, CASE WHEN run_id%3<>0 THEN 'cuda:0' ELSE '-' END,
CASE WHEN run_id%5<>0 THEN printf('%.1fx', run_id%50/10) ELSE '-' END, CASE WHEN run_id%6<>0 THEN printf('%.1f%%', run_id%100/100*100) ELSE '-' END, CASE WHEN run_id%6=0 THEN '-' WHEN run_id%4=0 THEN 'nenhum' ELSE printf('%d (%.0fs)', run_id%4, gs::DOUBLE) END,
CASE WHEN run_id%3>0 THEN CAST(run_id%3 AS VARCHAR) ELSE '-' END, CASE WHEN run_id%2=0 THEN 'sim' ELSE 'não' END, {_CONFIDENCE}] ELSE [strftime(o_orderdate, '%d/%m %H:%M'), f, '-', '-', '-', '-', '-', '-', 'ERRO', '-', '-'] END AS cells
{_RUNS}"""


@query(_CELLS)
def history_cells(spark, d):
    """History rows of finished and of failed runs as cells of the table."""
    return history.display_rows(runs_and_failures(spark, d)).select("run_id", "status", "detail", "cells")


def runs_and_failures(spark, d):
    runs = runs_of(spark, d)
    coverage = runs.select("run_id", "analyzed", "ratio", "n_gaps", "gap_seconds")
    scores = F.explode(F.array(F.lit(-0.1), F.lit(0.0), F.lit(None).cast("double"))).alias("p")
    segments = runs.select("run_id", scores).select("run_id", F.when(F.col("run_id") % 8 != 0, -(F.col("run_id") % 10) / 10.0 + F.col("p")).alias("avg_logprob"))
    done = history.entries_from_results(runs.drop("analyzed", "ratio", "n_gaps", "gap_seconds"), coverage, segments, "run_id")
    k = F.col("o_orderkey")
    failed = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(
        (-k).alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at"), text_of("C:\\pasta/f", k.cast("string"), ".mp4").alias("input_path"),
        F.when(k % 2 == 0, F.lit(" \n\t")).otherwise(F.lit("disco cheio\nlinha 2")).alias("message"),
    )
    return history.all_entries(done, history.entries_from_failures(failed))


_WIDTHS = [w for _, w in history.COLUMNS]
_PADDED = " || '  ' || ".join(f"rpad(cells[{k}], CAST(greatest({w}, length(cells[{k}])) AS INTEGER), ' ')" for k, w in enumerate(_WIDTHS, 1))
_HEAD = "'" + ("  " + "  ".join(n.ljust(w) for n, w in history.COLUMNS)).rstrip() + "' || chr(10) || '" + "  " + "  ".join("-" * w for w in _WIDTHS) + "'"


@query(f"""WITH rows AS ({_CELLS.replace("SELECT run_id, status, detail,", "SELECT run_id, status, detail, f, gs, o_orderdate, CASE WHEN status='ok' THEN run_id%3 END AS failures, CASE WHEN status='ok' AND run_id%6<>0 THEN run_id%100/100 END AS cov, CASE WHEN status='ok' AND run_id%5<>0 AND run_id%50<>0 THEN run_id%50/10 END AS speed,", 1)}),
kept AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, run_id DESC) AS place FROM rows QUALIFY place <= 60),
said AS (SELECT *, CASE WHEN status<>'ok' THEN detail WHEN cov<0.95 THEN printf('só %.1f%% do arquivo virou texto (%.0f s fora do silêncio).', cov*100, gs::DOUBLE) WHEN failures>0 THEN failures||' bloco(s) indisponível(is) no laudo.' END AS look FROM kept)
SELECT 'HISTÓRICO' || chr(10) || chr(10) || '  ' || count(*) || ' trabalho(s)' || CASE WHEN count(*) FILTER (status<>'ok')>0 THEN '  •  ' || count(*) FILTER (status<>'ok') || ' com erro' ELSE '' END
|| coalesce(printf('  •  cobertura média %.1f%%', avg(cov)*100), '') || coalesce(printf('  •  velocidade média %.1fx', avg(speed)), '') || chr(10) || chr(10) || {_HEAD} || chr(10)
|| string_agg(rtrim('  ' || {_PADDED}), chr(10) ORDER BY place) || coalesce(chr(10) || chr(10) || 'O QUE MERECE UM OLHAR' || chr(10) || chr(10) || string_agg('  ' || f || ': ' || look, chr(10) ORDER BY place) FILTER (look IS NOT NULL), '') AS content FROM said""")
def history_text(spark, d):
    """The history's text: totals, the table of the newest runs, and what deserves a look."""
    return history.history_text(runs_and_failures(spark, d))


@query("""WITH f AS (SELECT url AS path, page_id, length(html) AS n FROM pages) SELECT 'org'||page_id%7||'-m' AS model, CAST(sum(n) AS BIGINT) AS length FROM f GROUP BY 1""")
def model_inventory(spark, d):
    k = F.col("page_id")
    files = table(spark, d, "pages").select(text_of("cache/models--Org--org", (k % 7).cast("string"), "-m/blobs/", k.cast("string")).alias("path"), F.length("html").cast("bigint").alias("length"))
    return history.model_inventory(files)


@query("""SELECT c AS component, CAST(sum(n) AS BIGINT) AS length FROM (SELECT unnest(CASE page_id%4 WHEN 0 THEN ['asr','all'] WHEN 1 THEN ['vad','all'] WHEN 2 THEN ['all'] ELSE []::VARCHAR[] END) AS c, length(html) AS n FROM pages) GROUP BY c""")
def component_sizes(spark, d):
    k = F.col("page_id")
    files = table(spark, d, "pages").select(F.concat(pick(("Models-Whisper-", "models_silero-", "models-", "other-"), k), k.cast("string")).alias("name"), F.length("html").cast("bigint").alias("length"))
    return history.component_sizes(files, {"asr": ["models-whisper", "models_whisper"], "vad": ["models--silero", "models_silero"], "all": ["models-"]})


def listing(spark, d):
    """Output files of runs: a subtitle of each, a report of most."""
    k = F.col("o_orderkey")
    names = F.array_compact(F.array(F.lit(".srt"), F.when(k % 3 != 0, F.lit(".report.txt")), F.when(k % 5 == 0, F.lit(".vtt"))))
    return table(spark, d, "orders").select(k, F.explode(names).alias("s")).select(text_of("out/", k.cast("string"), F.col("s")).alias("path"))


_LISTING = "listing AS (SELECT 'out/'||k||s AS path, 'out/'||k AS base, k FROM (SELECT o_orderkey AS k, unnest(list_filter(['.srt', CASE WHEN o_orderkey%3<>0 THEN '.report.txt' END, CASE WHEN o_orderkey%5=0 THEN '.vtt' END], lambda x: x IS NOT NULL)) AS s FROM orders))"


@query(f"WITH {_LISTING} SELECT path, CASE WHEN k%3<>0 THEN base||'.report.txt' END AS report_path, count(*) OVER (PARTITION BY base) AS n_formats FROM listing")
def files_with_report(spark, d):
    base = F.regexp_replace("path", r"\.report\.txt$|\.[^./]+$", "")
    return history.formats_per_base(history.files_with_report(listing(spark, d)).withColumn("base", base)).select("path", "report_path", "n_formats")


@query(f"WITH {_LISTING} SELECT path FROM listing WHERE k%3<>0")
def files_that_have_a_report(spark, d):
    return history.files_with_report(listing(spark, d), "left_semi")


@query(with_views("SELECT job AS job_key, count(*) AS attempts FROM prog_ev WHERE stage='extract' GROUP BY job", "prog_ev"))
def attempts_per_job(spark, d):
    return history.attempts_per_job(prog_ev(spark, d).filter("stage = 'extract'").withColumnRenamed("job", "job_key"))


_ST = "[" + ",".join(f"'{s}'" for s in ledger.STAGES) + "]"


@query(with_views(f"""SELECT job, CAST(k AS INTEGER) AS stage_no, s AS stage, CAST(coalesce(ms,0) AS BIGINT) AS ms, CASE WHEN bad>0 THEN 'erro' WHEN ms IS NOT NULL THEN 'ok' ELSE 'pulado' END AS status FROM (
SELECT job, k, {_ST}[k+1] AS s FROM (SELECT DISTINCT job, unnest(range(7)) AS k FROM prog_ev)) j LEFT JOIN (SELECT job, stage, max(epoch_us(ts)//1000)-min(epoch_us(ts)//1000) AS ms, count(*) FILTER (WHERE seq%50=0) AS bad FROM prog_ev GROUP BY ALL) t
ON j.job=t.job AND j.s=t.stage""".replace("SELECT job, CAST(k", "SELECT j.job, CAST(k"), "prog_ev"))
def stage_status(spark, d):
    events = prog_ev(spark, d)
    return history.stage_status(events, history.stage_timings(events), events.filter("seq % 50 = 0"), ledger.STAGES)


_SAVED = "saved AS (SELECT *, seq%3<>0 AS this_format, seq%4<>0 AS parses FROM ledger_ev), now AS (SELECT max(saved_at) AS t FROM ledger_ev)"


def saved_rows(spark, d):
    """The ledger view with format versions and saved JSON, every third and fourth of them wrong."""
    k = F.col("seq")
    payload = F.when(k % 4 == 0, F.lit('{"segments": [')).otherwise(F.lit('{"segments": []}'))
    return ledger_ev(spark, d).withColumn("format_version", F.when(k % 3 == 0, 0).otherwise(1)).withColumn("payload", payload)


def now_of(rows):
    """The newest time of the ledger, as the present: one value."""
    return F.lit(rows.agg(F.max("saved_at")).first()[0])


@query(with_views("", "prog_ev", "ledger_ev").rstrip() + f""", {_SAVED}, v AS (SELECT job_key, arg_max(stage,(saved_at,seq)) AS stage, arg_max(diarize_key,(saved_at,seq)) AS dk FROM saved, now WHERE this_format AND parses AND saved_at>=t-INTERVAL 7 DAY GROUP BY 1),
j AS (SELECT DISTINCT job_key FROM ledger_ev), p AS (SELECT j.job_key, CAST(CASE WHEN stage IS NULL THEN -1 WHEN stage='diarize' AND dk<>'' AND dk<>'a' THEN 4 ELSE list_position({_ST}, stage)-1 END AS INTEGER) AS done_through FROM j LEFT JOIN v USING (job_key))
SELECT job_key, done_through, {_ST}[k+1] AS stage, CAST(k AS INTEGER) AS stage_no FROM (SELECT *, unnest(range(7)) AS k FROM p) WHERE k>done_through""")
def resume_plan_valid(spark, d):
    """What is left to do where only readable rows of this format from the last seven days count."""
    rows = saved_rows(spark, d)
    jobs = rows.select("job_key").distinct().withColumn("diarize_key", F.lit("a"))
    return ledger.resume_plan(jobs, rows, ["saved_at", "seq"], now_of(rows), "payload")


@query(with_views("SELECT count(*) FILTER (WHERE saved_at<t-INTERVAL 7 DAY) AS removed, count(*) FILTER (WHERE saved_at>=t-INTERVAL 7 DAY) AS kept FROM ledger_ev, (SELECT max(saved_at) AS t FROM ledger_ev)", "prog_ev", "ledger_ev"))
def ledger_purged(spark, d):
    rows = ledger_ev(spark, d)
    return ledger.purged(rows, now_of(rows))


@query(with_views("SELECT job_key, seq FROM ledger_ev, (SELECT max(saved_at) AS t FROM ledger_ev) WHERE saved_at>=t-INTERVAL 7 DAY AND job_key%3<>0", "prog_ev", "ledger_ev"))
def ledger_left(spark, d):
    """The ledger after a purge and after completed jobs, every third one, were cleared."""
    rows = ledger_ev(spark, d)
    return ledger.clear_done(ledger.purge(rows, now_of(rows)), rows.filter("job_key % 3 = 0")).select("job_key", "seq")


@query(with_views("""SELECT job_key, 'job-'||job_key AS source, stage, n_segments, attempts FROM (SELECT job_key, arg_max(stage,(saved_at,seq)) AS stage, count(*) FILTER (WHERE stage='extract') AS attempts, count(*) FILTER (WHERE stage='asr') AS n_segments
FROM ledger_ev GROUP BY 1)""", "prog_ev", "ledger_ev"))
def interrupted_jobs(spark, d):
    rows = ledger_ev(spark, d)
    sources = rows.select("job_key").distinct().withColumn("source", text_of("job-", F.col("job_key").cast("string")))
    return ledger.interrupted(rows, ["saved_at", "seq"], rows.filter("stage = 'extract'"), sources, rows.filter("stage = 'asr'")).drop("saved_at")


# -- progress -----------------------------------------------------------------------------------


_KIND = "CASE WHEN seq%40=0 THEN 'done' WHEN seq%17=0 THEN 'pause' WHEN seq%17=3 THEN 'resume' ELSE 'progress' END"


STALLED = f"""SELECT job, CAST(sn AS BIGINT) AS session_no, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n_events, CAST(arg_max(lim,(ts,seq)) AS BIGINT) AS limit_ms FROM (
SELECT *, sum(nw) OVER (PARTITION BY job ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sn FROM (SELECT *, CASE WHEN waited > lag(lim) OVER (PARTITION BY job ORDER BY ts, seq) THEN 1 ELSE 0 END AS nw FROM (
SELECT *, CASE WHEN last_value(CASE WHEN t='progress' THEN stage END IGNORE NULLS) OVER (PARTITION BY job ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)='asr' THEN 900000 ELSE 300000 END AS lim,
CASE WHEN last_value(CASE WHEN t IN ('pause','resume') THEN t END IGNORE NULLS) OVER (PARTITION BY job ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)='pause' THEN 0 ELSE ms-lag(ms) OVER (PARTITION BY job ORDER BY ts, seq) END AS waited,
coalesce(last_value(CASE WHEN t IN ('pause','resume') THEN t END IGNORE NULLS) OVER (PARTITION BY job ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)='pause', false) AS paused
FROM (SELECT *, epoch_us(ts)//1000 AS ms, {_KIND} AS t FROM prog_ev)))) GROUP BY job, sn HAVING NOT bool_or(t IN ('done','error')) AND NOT arg_max(paused,(ts,seq))"""


@query(with_views(STALLED, "prog_ev"))
def stalled_jobs(spark, d):
    """Sessions that ended in a stall; pauses don't count, sessions that ended well are none."""
    return progress.stalled_sessions_batch(prog_ev(spark, d).withColumn("t", F.expr(_KIND)), ["seq"])


@query(with_views(f"""SELECT job, CAST(sum(coalesce(nx, last)-ms) AS BIGINT) AS paused_ms FROM (SELECT job, ms, t, lead(ms) OVER (PARTITION BY job ORDER BY ts, seq) AS nx, last FROM (
SELECT *, epoch_us(ts)//1000 AS ms, {_KIND} AS t, max(epoch_us(ts)//1000) OVER (PARTITION BY job) AS last FROM prog_ev) WHERE t IN ('pause','resume')) WHERE t='pause' GROUP BY job""", "prog_ev"))
def paused_time(spark, d):
    return progress.paused_time(prog_ev(spark, d).withColumn("t", F.expr(_KIND)), ["seq"])


@query("SELECT CAST(event_id AS VARCHAR) AS job, 'asr' AS stage, event_id/2 AS fraction FROM events WHERE event_id%4=0")
def progress_lines(spark, d):
    """Events of JSON lines; three of four lines are blank or broken."""
    k = F.col("event_id")
    line = F.when(k % 4 == 0, text_of('{"job":"', k.cast("string"), '","t":"progress","stage":"asr","fraction":', (k / 2).cast("string"), ',"extra":1}')).when(k % 4 == 1, F.lit(" \t")).when(k % 4 == 2, F.lit('{"job":')).otherwise(F.lit('["x"]'))
    return readers.parse_progress(table(spark, d, "events").select(line.alias("value"))).select("job", "stage", "fraction")


@query("""SELECT user_id AS job, arg_min('falha '||event_id, event_id) FILTER (WHERE event_id%97=0) AS error, round(max(CASE WHEN event_id%10>0 THEN greatest(0.0, least(1.0, (event_id%13)/(event_id%10))) END),4) AS fraction FROM events GROUP BY user_id""")
def download_state(spark, d):
    k = F.col("event_id")
    events = table(spark, d, "events").select(F.col("user_id").alias("job"), k.alias("seq"), (k % 13).cast("double").alias("completed"), (k % 10).cast("double").alias("total"), F.when(k % 97 == 0, text_of("falha ", k.cast("string"))).alias("error"))
    return readers.download_state(events)


# -- documents and cards ------------------------------------------------------------------------


@query(with_views("""SELECT rec_id, seg_id, st, en, text, speaker, CASE WHEN seg_id%2=1 THEN len(t) ELSE 0 END AS n_words, CASE WHEN seg_id%2=1 THEN t[len(t)] END AS last_word, CASE WHEN seg_id%2=1 AND len(t)>0 THEN st+400*len(t) END AS last_end,
-(seg_id%10)/10 AS avg_logprob, n_segments, chars AS characters, speakers AS speaker_count, 0.5 AS temperature
FROM (SELECT *, regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+(?:[’''-][\\p{L}\\p{Nl}\\p{No}]+)*') AS t, count(*) OVER (PARTITION BY rec_id) AS n_segments FROM seg_conv)
JOIN (SELECT rec_id, length(string_agg(trim(text),' ' ORDER BY seg_id)) AS chars, count(DISTINCT speaker) AS speakers FROM seg_conv GROUP BY 1) USING (rec_id)""", "seg_conv"))
def document_round_trip(spark, d):
    """Result documents written as JSON text and read back: segments with words and scores, and blocks of the document."""
    segments = seg_words(spark, d).withColumn("avg_logprob", -(F.col("seg_id") % 10) / 10.0).withColumn("temperature", F.lit(0.5))
    recordings = segments.groupBy("rec_id").agg((F.max("en") + 1000).alias("duration"), F.lit("en").alias("language"))
    silences = segments.select("rec_id", F.col("en").alias("st"), (F.col("en") + 200).alias("en"))
    blocks = sinks.document_blocks(segments, silences, recordings).drop("language", "duration")
    raw = sinks.result_rows(blocks, segments)
    documents = readers.parse_results(raw.select("rec_id", F.to_json(F.struct(*[F.col(c) for c in raw.columns])).alias("raw")))
    of = documents.select("rec_id", F.size("segments").cast("bigint").alias("n_segments"), F.col("stats.characters").alias("characters"), F.col("diarization.speaker_count").alias("speaker_count"))
    last = F.try_element_at("words", F.lit(-1))
    return readers.result_segments(documents).join(of, "rec_id").select(
        "rec_id", "seg_id", "st", "en", "text", "speaker", F.size("words").cast("bigint").alias("n_words"), last.word.alias("last_word"), last.en.alias("last_end"), "avg_logprob", "n_segments", "characters", "speaker_count", "temperature",
    )


@query(with_views("""SELECT rec_id, concat_ws(chr(10), 'ARQUIVOS GERADOS', '', CASE WHEN rec_id%2=0 THEN '  srt              /o/'||rec_id||'.srt'||chr(10)||'  txt              /o/'||rec_id||'.txt' END, CASE WHEN rec_id%3=0 THEN '  cópia            /v/'||rec_id||'.srt' END, '', 'RESUMO DO PROCESSAMENTO', '', '  Duração do arquivo   '||replace(printf('%.1f', dur/1000),'.',',')||' s', '  Tempo de trabalho    '||replace(printf('%.1f', rec_id%90+0.5),'.',',')||' s ('||replace(printf('%.2f', rec_id%9+0.25),'.',',')||'x tempo real)',
'  Modelo               small em '||CASE WHEN rec_id%2=0 THEN 'cpu' ELSE '-' END, '  Idioma               en', '  Palavras             '||words, '  Trechos              '||n, '  Falantes             '||sp,
'  Cobertura            '||printf('%.1f%%  (', round(least(1.0, covered/dur),4)*100)||CASE WHEN g=0 THEN 'nenhum trecho fora do silêncio' ELSE printf('%d trecho(s) sem texto, %.0f s', g, g*2.5) END||')', CASE WHEN rec_id%5=0 THEN concat_ws(chr(10), '', 'AVISOS', '', '  - sem espaço') END, CASE WHEN rec_id%7=0 THEN concat_ws(chr(10), '', 'RECUPERACAO', '', '  - modelo menor') END) AS card
FROM (SELECT rec_id, max(en)+1000 AS dur, CAST(sum(en-st) AS DOUBLE) AS covered, count(*) AS n, count(DISTINCT speaker) AS sp, count(*) FILTER (WHERE seg_id%3=2 AND more) AS g, CAST(sum(len(regexp_extract_all(text, '[\\p{L}\\p{Nl}\\p{No}]+(?:[’''-][\\p{L}\\p{Nl}\\p{No}]+)*'))) AS BIGINT) AS words
FROM (SELECT *, lead(seg_id) OVER (PARTITION BY rec_id ORDER BY seg_id) IS NOT NULL AS more FROM seg_conv) GROUP BY rec_id)""", "seg_conv"))
def job_cards(spark, d):
    segments = seg_conv(spark, d)
    recordings = segments.groupBy("rec_id").agg((F.max("en") + 1000).alias("duration"))
    none = segments.select("rec_id", "st", F.col("st").alias("en"))
    coverage = intervals.coverage_summary(segments, none, recordings)
    k = F.col("rec_id")
    runs = recordings.select(
        k, (F.col("duration") / 1000.0).alias("duration"), (k % 90 + 0.5).alias("elapsed_seconds"), (k % 9 + 0.25).alias("realtime_factor"), F.lit("small").alias("model"), F.when(k % 2 == 0, F.lit("cpu")).alias("device"), F.lit("en").alias("language"),
        F.when(k % 5 == 0, F.array(F.lit("sem espaço"))).otherwise(F.array().cast("array<string>")).alias("partial_failures"),
        F.when(k % 2 == 0, F.create_map(F.lit("txt"), text_of("/o/", k.cast("string"), ".txt"), F.lit("srt"), text_of("/o/", k.cast("string"), ".srt"))).alias("outputs"), F.when(k % 3 == 0, F.array(text_of("/v/", k.cast("string"), ".srt"))).alias("copies"),
        F.when(k % 7 == 0, F.array(F.lit("modelo menor"))).alias("recovery"),
    )
    stats = textstats.text_counts(textstats.joined_text(segments))
    return history.job_cards(runs, coverage, segments, stats)


# -- values as text -----------------------------------------------------------------------------


@query("""SELECT event_id, printf('%02d:%02d:%02d', s//3600, s//60%60, s%60) AS padded, CASE WHEN s<60 THEN greatest(s,1)||' s' WHEN s<3600 THEN s//60||' min' WHEN s%3600//60=0 THEN s//3600||' h' ELSE s//3600||' h '||s%3600//60||' min' END AS words,
strftime(ts, '%d/%m %H:%M') AS at, strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S')||'Z' AS iso, replace(printf('%.2f s', s/8),'.',',') AS number, replace(format('{:,}', s*1000),',','.') AS grouped,
CASE WHEN s=0 THEN '—' ELSE replace(format('{:,}', s*1000),',','.')||' bps ('||s||' kbps)' END AS rate, rpad('Nome',16,' ')||': '||CASE WHEN event_id%3=0 THEN '—' ELSE CAST(s AS VARCHAR) END AS line,
CASE WHEN event_id%2=0 THEN 'GPS (location)' ELSE 'other' END AS tag, least(1.0, greatest(0.0, s/1000-1)) AS held, CASE WHEN event_id%4=0 THEN 'baixando' ELSE replace(printf('puxando — %.1f / 8.0 GB (%.0f%%)', (s%9)::DOUBLE, (s%9)*12.5),'.',',') END AS pull
FROM (SELECT event_id, ts, (event_id*37)%9000 AS s FROM events)""")
def format_values(spark, d):
    k, s = F.col("event_id"), F.col("s")
    giga = F.lit(1024**3).cast("bigint")
    rows = table(spark, d, "events").withColumn("s", (k * 37) % 9000)
    done, total = F.when(k % 4 != 0, (s % 9) * giga), F.when(k % 4 != 0, 8 * giga)
    return rows.select(
        "event_id", clock_padded(s).alias("padded"), duration_words(s).alias("words"), when_text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("at"), iso_from_epoch(s).alias("iso"), float_text(s / 8.0, " s").alias("number"),
        thousands(s * 1000).alias("grouped"), bitrate(s * 1000).alias("rate"), key_value("Nome", F.when(k % 3 != 0, s.cast("string")).otherwise(F.lit(""))).alias("line"),
        tag_name(F.when(k % 2 == 0, F.lit("location")).otherwise(F.lit("other"))).alias("tag"), clamp(s / 1000.0 - 1, 0.0, 1.0).alias("held"),
        download_label(F.when(k % 4 != 0, F.lit("puxando")), done, total).alias("pull"),
    )


@query("SELECT page_id, regexp_replace('fi1a2-5-e_'||regexp_replace(left(url,20),'[^A-Za-z0-9._-]+','_','g'),'[._-]+$','') AS stem, left(regexp_replace('fi1a2-5-e_'||regexp_replace(url,'[^A-Za-z0-9._-]+','_','g'),'[._-]+$',''),80) AS long_stem FROM pages")
def compatible_stems(spark, d):
    """Stems of names with ligatures, ordinal marks, superscripts and accents."""
    odd = F.lit("..ﬁ1ª²-⑤-é ")
    return table(spark, d, "pages").select("page_id", safe_stem(F.concat(odd, F.left("url", F.lit(20)))).alias("stem"), safe_stem(F.concat(odd, "url")).alias("long_stem"))


@query("SELECT page_id, 'out/'||left(regexp_replace(page_id||'_x','[^A-Za-z0-9._-]+','_','g'),80)||'.srt' AS path FROM pages")
def output_paths(spark, d):
    return table(spark, d, "pages").select("page_id", sinks.output_path(F.lit("out//"), text_of(F.col("page_id").cast("string"), " x.mp4"), ".srt").alias("path"))


@query("SELECT o_orderkey AS run_id, CASE WHEN o_custkey%7>0 THEN round((o_orderkey%500)/(o_custkey%7),2) END AS realtime_factor FROM orders")
def realtime_factor(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), history.realtime_factor(F.col("o_orderkey") % 500, F.col("o_custkey") % 7).alias("realtime_factor"))


# -- whole documents ------------------------------------------------------------------------


@query("""SELECT o_orderkey AS rec_id, 2 + o_orderkey%3 AS streams, 'c'||(o_orderkey%7) AS second_codec, CASE WHEN o_orderkey%2=0 THEN 'parte '||o_orderkey END AS chapter, CAST(o_orderkey%5 AS BIGINT) AS threads,
'local-'||(o_orderkey%4) AS provider, CAST(o_orderkey%9 AS BIGINT) AS future, CAST(o_orderkey%11 AS BIGINT) AS words, 'olá' AS said FROM orders""")
def document_lossless(spark, d):
    """Documents are read, one block is worked out anew, and they are written and read again: what the schema doesn't know comes back."""
    k = F.col("o_orderkey")
    t = lambda c: c.cast("string")
    stream = F.array_join(F.transform(F.sequence(F.lit(1), (1 + k % 3).cast("int")), lambda i: text_of('{"index":', t(i), ',"codec_name":"c', t(k % 7), '"}')), ",")
    raw = text_of(
        '{"probe":{"duration":1.5,"streams":[{"index":0,"codec_name":"h264"},', stream, '],"chapters":[', F.when(k % 2 == 0, text_of('{"title":"parte ', t(k), '"}')).otherwise(F.lit("")),
        ']},"segments":[{"id":0,"start":0,"end":1,"text":"olá","provider_id":7}],"stats":{"words":0},"processing":{"model":"small","threads":', t(k % 5),
        '},"summary":{"available":true,"provider":"local-', t(k % 4), '"},"future":{"deep":[', t(k % 9), "]}}",
    )
    documents = readers.whole_documents(table(spark, d, "orders").select(k.alias("rec_id"), raw.alias("raw")))
    stats = documents.select("rec_id", F.struct((F.col("rec_id") % 11).alias("words")).alias("stats"))
    again = readers.whole_documents(sinks.merged_documents(documents, stats).withColumnRenamed("content", "raw"))
    get = lambda block, path, kind: F.try_variant_get(F.col("blocks")[block], path, kind)
    return again.select(
        "rec_id", F.size(get("probe", "$.streams", "array<variant>")).cast("bigint").alias("streams"), get("probe", "$.streams[1].codec_name", "string").alias("second_codec"), get("probe", "$.chapters[0].title", "string").alias("chapter"),
        get("processing", "$.threads", "bigint").alias("threads"), get("summary", "$.provider", "string").alias("provider"), get("future", "$.deep[0]", "bigint").alias("future"),
        F.col("stats.words").alias("words"), F.col("segments")[0]["text"].alias("said"),
    )
