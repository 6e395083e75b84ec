"""Run history: rows, labels, totals, retention, listings, throughput, stages, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.format import clock, decimal_comma, fixed, when_text
from reelspan.functions.text import cut_middle, strip

KEPT, HIGH, LOW, LOW_COVERAGE = 60, -0.35, -0.60, 0.95

# Columns of the history table and their widths, and the texts around it.
COLUMNS = (
    ("QUANDO", 12), ("ARQUIVO", 30), ("DURAÇÃO", 9), ("QUALIDADE", 16), ("ONDE", 6), ("VELOC", 7), ("COBERT", 7), ("BURACOS", 8), ("AVISOS", 7), ("RESUMO", 7), ("CONFIANÇA", 11),
)
TITLE, LOOK_AT = "HISTÓRICO", "O QUE MERECE UM OLHAR"
NOTHING_YET = "  Nenhum trabalho ainda. Assim que o primeiro terminar, ele aparece\n  aqui — com duração, qualidade, velocidade, cobertura e confiança."


def confidence_label(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    word = F.when(c >= HIGH, "alta").when(c >= LOW, "média").otherwise("baixa")
    return F.when(c.isNull(), F.lit("desconhec.")).otherwise(F.format_string("%s %.2f", word, F.bround(c, 2)))


def entries_from_results(runs: DataFrame, coverage: DataFrame, segments: DataFrame, rec: str = "rec_id") -> DataFrame:
    """History rows of finished runs (rec, run columns), with coverage and mean confidence."""
    confidence = segments.groupBy(rec).agg(F.avg("avg_logprob").alias("confidence"))
    covered = coverage.select(rec, F.when(F.col("analyzed"), F.col("ratio")).alias("coverage"), F.coalesce("n_gaps", F.lit(0)).alias("gaps"), "gap_seconds")
    return runs.join(covered, rec, "left").join(confidence, rec, "left").withColumn("status", F.lit("ok"))


def entries_from_failures(failures: DataFrame) -> DataFrame:
    """History rows of failed runs (run_id, finished_at, input_path, message): the message's first line, or a default."""
    detail = F.coalesce(F.nullif(F.split(strip("message"), "\n")[0], F.lit("")), F.lit("falha sem detalhe"))
    return failures.select("run_id", "finished_at", F.element_at(F.split("input_path", "[/\\\\]"), -1).alias("file_name"), "input_path", F.lit("error").alias("status"), detail.alias("detail"))


def all_entries(finished: DataFrame, failed: DataFrame) -> DataFrame:
    return finished.unionByName(failed, allowMissingColumns=True)


def history_totals(history: DataFrame) -> DataFrame:
    """jobs, errors, mean coverage and mean speed (zero and unknown speeds aside) of finished runs."""
    ok = F.col("status") == "ok"
    return history.agg(
        F.count("*").alias("jobs"),
        F.count_if(~ok).alias("errors"),
        F.round(F.avg(F.when(ok, F.col("coverage"))), 6).alias("mean_coverage"),
        F.round(F.avg(F.when(ok & (F.col("speed") != 0), F.col("speed"))), 6).alias("mean_speed"),
    )


def needs_attention(history: DataFrame) -> DataFrame:
    """Runs with an error, failures or low coverage, and why."""
    bad = F.coalesce(F.col("coverage") < LOW_COVERAGE, F.lit(False))
    reason = (
        F.when(F.col("status") == "error", "error").when(bad, F.format_string("coverage %.1f%%, %d s", F.bround(F.col("coverage") * 100, 1), F.col("gap_seconds").cast("bigint"))).otherwise(F.format_string("%d failures", F.col("failures")))
    )
    rows = history.filter((F.col("status") == "error") | (F.col("failures") > 0) | bad)
    return rows.select("run_id", "status", reason.alias("reason"), confidence_label("confidence").alias("confidence_label"))


def retain(history: DataFrame, keep: int = KEPT, by: tuple[str, ...] = ("finished_at", "run_id")) -> DataFrame:
    """The newest ``keep`` rows, newest first. Only ``keep`` rows of each partition travel."""
    top = history.orderBy(*[F.desc(c) for c in by]).limit(keep)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*[F.desc(c) for c in by])))


def display_rows(history: DataFrame) -> DataFrame:
    """Cells of the history table; unknown values and rows of failed runs show '-'."""
    ok = F.col("status") == "ok"
    cell = lambda value, known=None: F.when(ok & (known if known is not None else F.lit(True)), value).otherwise(F.lit("-"))
    gaps = F.when(F.coalesce("gaps", F.lit(0)) == 0, F.lit("nenhum")).otherwise(F.format_string("%d (%.0fs)", "gaps", F.bround(F.col("gap_seconds").cast("double"))))
    has = F.col("coverage").isNotNull()
    cells = [
        when_text("finished_at"),
        cut_middle("file_name", 30),
        cell(clock("duration")),
        cell(cut_middle(F.coalesce(F.nullif("model", F.lit("")), F.lit("-")), 16)),
        cell(F.left(F.coalesce(F.nullif("device", F.lit("")), F.lit("-")), F.lit(6))),
        cell(F.format_string("%.1fx", F.bround("realtime_factor", 1)), F.col("realtime_factor").isNotNull()),
        F.when(ok, F.when(has, F.format_string("%.1f%%", F.bround(F.col("coverage") * 100, 1))).otherwise("-")).otherwise("-"),
        cell(gaps, has),
        F.when(ok, cell(F.col("failures").cast("string"), F.coalesce("failures", F.lit(0)) > 0)).otherwise(F.lit("ERRO")),
        cell(F.when(F.col("summarized"), "sim").otherwise("não")),
        cell(confidence_label("confidence")),
    ]
    return history.select("*", F.array(*cells).alias("cells"))


def attention_line(history: DataFrame) -> Column:
    """What is said of a run that deserves a look; null of others."""
    low = F.coalesce(F.col("coverage") < LOW_COVERAGE, F.lit(False))
    covered = F.format_string("só %.1f%% do arquivo virou texto (%.0f s fora do silêncio).", F.bround(F.col("coverage") * 100, 1), F.bround(F.col("gap_seconds").cast("double")))
    said = F.when(F.col("status") != "ok", F.col("detail")).when(low, covered).when(F.col("failures") > 0, F.format_string("%d bloco(s) indisponível(is) no laudo.", "failures"))
    return F.when(said.isNotNull(), F.concat(F.lit("  "), F.coalesce("file_name", F.lit("")), F.lit(": "), said))


def history_text(history: DataFrame, keep: int = KEPT) -> DataFrame:
    """(content): one text of the newest ``keep`` runs: totals, the table, newest first, and what deserves a look; a hint without any run.

    ``history`` has the columns of ``display_rows`` and, of failed runs, detail.
    """
    rows = history if "detail" in history.columns else history.withColumn("detail", F.lit(None).cast("string"))
    kept = display_rows(retain(rows, keep))
    padded = F.transform(F.arrays_zip(F.col("cells").alias("c"), F.array(*[F.lit(w) for _, w in COLUMNS]).alias("w")), lambda x: F.rpad(x.c, F.greatest(x.w, F.length(x.c)), " "))
    line = F.rtrim(F.concat(F.lit("  "), F.array_join(padded, "  ")))
    ok = F.col("status") == "ok"
    in_order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("place", F.col(c).alias("line"))))), lambda x: x.line), "\n")
    # ``keep`` rows at most.
    one = kept.withColumn("_line", line).withColumn("_look", attention_line(kept)).agg(
        F.count("*").alias("jobs"), F.count_if(~ok).alias("errors"), F.avg(F.when(ok, F.col("coverage"))).alias("coverage"),
        F.avg(F.when(ok & (F.col("realtime_factor") != 0), F.col("realtime_factor"))).alias("speed"), in_order("_line").alias("table"), in_order("_look").alias("look"),
    )
    totals = F.concat_ws(
        "  •  ", F.format_string("%d trabalho(s)", "jobs"), F.when(F.col("errors") > 0, F.format_string("%d com erro", "errors")),
        F.when(F.col("coverage").isNotNull(), F.format_string("cobertura média %.1f%%", F.bround(F.col("coverage") * 100, 1))),
        F.when(F.col("speed").isNotNull(), F.format_string("velocidade média %.1fx", F.bround("speed", 1))),
    )
    head, rule = ("  " + "  ".join(n.ljust(w) for n, w in COLUMNS)).rstrip(), "  " + "  ".join("-" * w for _, w in COLUMNS)
    look = F.when(F.col("look") != "", F.concat(F.lit(f"\n\n{LOOK_AT}\n\n"), "look")).otherwise("")
    text = F.concat(F.lit(f"{TITLE}\n\n  "), totals, F.lit(f"\n\n{head}\n{rule}\n"), "table", look)
    return one.select(F.when(F.col("jobs") == 0, F.lit(f"{TITLE}\n\n{NOTHING_YET}")).otherwise(text).alias("content"))


def ab_throughput(bench: DataFrame, engines: tuple[str, str], order: list[str], key: str = "k") -> DataFrame:
    """Latest speed of each engine by key, the winner (ties go to the second) and the ratio of the faster to the slower."""
    latest = bench.groupBy(key, "engine").agg(F.max_by("speed", F.struct(*order)).alias("speed"))
    a, b = engines
    wide = latest.groupBy(key).pivot("engine", [a, b]).agg(F.first("speed"))
    x, y = F.col(a), F.col(b)
    both = x.isNotNull() & y.isNotNull()
    return wide.select(
        key, x.alias("speed_a"), y.alias("speed_b"), F.when(both, F.when(x > y, F.lit(a)).otherwise(F.lit(b))).alias("winner"),
        F.when(both & (F.least(x, y) > 0), F.round(F.greatest(x, y) / F.least(x, y), 4)).alias("advantage"),
    )


def stage_timings(events: DataFrame, job: str = "job") -> DataFrame:
    """(job, stage, ms, events): from the first to the last event of each stage."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.groupBy(job, "stage").agg((F.max(ms) - F.min(ms)).alias("ms"), F.count("*").alias("n_events"))


def stage_status(jobs: DataFrame, timings: DataFrame, failed: DataFrame, stages: tuple[str, ...], job: str = "job") -> DataFrame:
    """(job, stage_no, stage, ms, status) of every stage of every job: 'ok', 'erro' where it failed, 'pulado' (0 ms) where it never ran.

    ``failed`` has (job, stage) of stages that ended in an error.
    """
    every = jobs.select(job).distinct().select(job, F.posexplode(F.array(*[F.lit(s) for s in stages])).alias("stage_no", "stage"))
    bad = failed.select(job, "stage").distinct().withColumn("_bad", F.lit(True))
    rows = every.join(timings.select(job, "stage", "ms"), [job, "stage"], "left").join(bad, [job, "stage"], "left")
    status = F.when(F.col("_bad"), "erro").when(F.col("ms").isNotNull(), "ok").otherwise("pulado")
    return rows.select(job, "stage_no", "stage", F.coalesce("ms", F.lit(0)).cast("bigint").alias("ms"), status.alias("status"))


def stage_rollup(timings: DataFrame) -> DataFrame:
    """jobs, mean, greatest and 90th percentile (exact, between neighbours by proportion) of the times of each stage."""
    return timings.groupBy("stage").agg(
        F.count("*").alias("jobs"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.max("ms").alias("max_ms"), F.round(F.percentile("ms", 0.9), 3).alias("p90_ms")
    )


def realtime_factor(duration: Column | str, elapsed: Column | str) -> Column:
    duration, elapsed = (F.col(c) if isinstance(c, str) else c for c in (duration, elapsed))
    return F.round(F.try_divide(duration, elapsed), 2)


def attempts_per_job(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("job_key").agg(F.count("*").alias("attempts"))


def backfill_todo(results: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Results with no file yet, classed by what can be done: 'todo', 'no_speech' (no segments) or 'failed' (unreadable)."""
    kind = F.when(F.col("readable") == F.lit(False), "failed").when(F.coalesce("n_segments", F.lit(0)) == 0, "no_speech").otherwise("todo")
    return results.join(existing.select(key).distinct(), key, "left_anti").withColumn("state", kind)


def listing_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either listing that the other lacks, as change 'new' or 'gone'."""
    return after.subtract(before).withColumn("change", F.lit("new")).unionByName(before.subtract(after).withColumn("change", F.lit("gone")))


def latest_file_lookup(files: DataFrame, history: DataFrame, order: str) -> DataFrame:
    """Files (path) with the latest history row (base, name, ...) of their base path; the base itself where there is none."""
    base = F.regexp_replace("path", r"\.(report|transcript)\.txt$|\.[^./]+$", "")
    latest = history.groupBy("base").agg(F.max_by("name", order).alias("name"), F.max(order).alias("seq"))
    return files.withColumn("base", base).join(latest, "base", "left").withColumn("name", F.coalesce("name", "base"))


def files_with_report(files: DataFrame, kind: str = "left", suffix: str = ".report.txt") -> DataFrame:
    """Files (path) with ``report_path`` where their base has a report among them; ``kind`` 'left_semi' keeps only such files."""
    base = F.regexp_replace("path", r"\.(report|transcript)\.txt$|\.[^./]+$", "")
    reports = files.filter(F.endswith("path", F.lit(suffix))).select(F.col("path").alias("report_path"), F.regexp_replace("path", r"\.report\.txt$", "").alias("_base")).distinct()
    return files.withColumn("_base", base).join(reports, "_base", kind).drop("_base")


def speech_after_vad(windows: DataFrame, rec: str = "rec_id") -> DataFrame:
    """(rec, speech_seconds): summed length of the windows that speech detection left."""
    return windows.groupBy(rec).agg(F.round(F.sum(F.greatest(F.lit(0), F.col("en") - F.col("st"))) / 1000.0, 3).alias("speech_seconds"))


def job_cards(runs: DataFrame, coverage: DataFrame, segments: DataFrame, stats: DataFrame, rec: str = "rec_id") -> DataFrame:
    """(rec, card): files, metrics, warnings and recovery of each finished run as text.

    ``runs`` has duration and elapsed_seconds (seconds), realtime_factor, model, device, language and
    partial_failures and, where there are any, outputs (map), copies and recovery (arrays); ``coverage`` is that of coverage_summary, ``stats`` has the words of each recording.
    """
    counted = segments.groupBy(rec).agg(F.count("*").alias("_segments"), F.count_distinct("speaker").alias("_speakers"))
    rows = runs.join(counted, rec, "left").join(stats.select(rec, "words"), rec, "left").join(coverage.select(rec, "analyzed", "ratio", "n_gaps", "gap_seconds"), rec, "left")
    number = lambda c, d: decimal_comma(fixed(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), d))
    pair = lambda label, value: F.concat(F.lit(f"  {label:<21}"), value)
    lost = F.when(F.col("n_gaps") == 0, F.lit("nenhum trecho fora do silêncio")).otherwise(F.format_string("%d trecho(s) sem texto, %.0f s", "n_gaps", F.bround(F.col("gap_seconds").cast("double"))))
    none = F.array().cast("array<string>")
    has = lambda c, kind: F.col(c) if c in runs.columns else F.lit(None).cast(kind)
    kinds = F.transform(F.sort_array(F.map_entries(has("outputs", "map<string,string>"))), lambda e: F.concat(F.lit("  "), F.rpad(e.key, F.greatest(F.lit(16), F.length(e.key)), " "), F.lit(" "), e.value))
    copies = F.transform(has("copies", "array<string>"), lambda x: F.concat(F.lit(f"  {'cópia':<16} "), x))
    listed = lambda c, name: F.when(F.size(c) > 0, F.concat(F.array(F.lit(""), F.lit(name), F.lit("")), F.transform(c, lambda x: F.concat(F.lit("  - "), x)))).otherwise(none)
    lines = F.concat(
        F.array(F.lit("ARQUIVOS GERADOS"), F.lit("")), F.coalesce(kinds, none), F.coalesce(copies, none), F.array(F.lit("")),
        F.array(
            F.lit("RESUMO DO PROCESSAMENTO"), F.lit(""), pair("Duração do arquivo", F.concat(number("duration", 1), F.lit(" s"))),
            pair("Tempo de trabalho", F.concat(number("elapsed_seconds", 1), F.lit(" s ("), number("realtime_factor", 2), F.lit("x tempo real)"))),
            pair("Modelo", F.concat(F.coalesce("model", F.lit("-")), F.lit(" em "), F.coalesce("device", F.lit("-")))), pair("Idioma", F.coalesce("language", F.lit("-"))),
            pair("Palavras", F.coalesce("words", F.lit(0)).cast("string")), pair("Trechos", F.coalesce("_segments", F.lit(0)).cast("string")),
        ),
        F.when(F.col("_speakers") > 0, F.array(pair("Falantes", F.col("_speakers").cast("string")))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("analyzed") & F.col("ratio").isNotNull(), F.array(pair("Cobertura", F.concat(fixed(F.col("ratio") * 100, 1), F.lit("%  ("), lost, F.lit(")"))))).otherwise(F.array().cast("array<string>")),
        listed(F.col("partial_failures"), "AVISOS"), listed(has("recovery", "array<string>"), "RECUPERACAO"),
    )
    return rows.select(rec, F.array_join(lines, "\n").alias("card"))


def formats_per_base(files: DataFrame) -> DataFrame:
    """Adds the number of files that share a base."""
    return files.withColumn("n_formats", F.count("*").over(Window.partitionBy("base")))


def dir_sizes(files: DataFrame) -> DataFrame:
    """(dir, length, n_files) of every ancestor folder of the files (path, length)."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = files.filter(F.size(parts) > 1).select(F.explode(dirs).alias("dir"), "length")
    return rows.groupBy("dir").agg(F.sum("length").cast("bigint").alias("length"), F.count("*").alias("n_files"))


def model_inventory(files: DataFrame) -> DataFrame:
    """(model, length): sizes by the last part of folders named 'models--Org--name', largest first."""
    folder = F.regexp_extract("path", r"(models--[^/]+)", 1)
    rows = files.withColumn("_f", folder).filter("_f <> ''")
    return rows.groupBy(F.element_at(F.split("_f", "--"), -1).alias("model")).agg(F.sum("length").alias("length")).orderBy(F.desc("length"), "model")


def component_sizes(files: DataFrame, prefixes: dict[str, list[str]]) -> DataFrame:
    """(component, length): sizes of the files (name, length) by component, matched by the start of the name."""
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(p.lower().replace("-", "_")).alias("prefix")) for c, ps in prefixes.items() for p in ps])
    table = files.sparkSession.range(1).select(F.inline(rows))  # as long as the dictionary
    name = F.lower(F.replace(F.col("name"), F.lit("-"), F.lit("_")))
    hit = files.join(F.broadcast(table), F.startswith(name, F.col("prefix"))).select("component", "name", "length").distinct()
    return hit.groupBy("component").agg(F.sum("length").alias("length")).orderBy(F.desc("length"), "component")
