"""Readers: result documents, history, files, media, logs and events. All are tolerant: bad rows never stop the rest."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import schemas
from reelspan.functions.text import safe_stem, strip
from reelspan.functions.tolerant import clamp

FRAME_MS = 20


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored result documents, one row each, with path, base and readable; unknown keys are ignored, absent ones null."""
    docs = (
        spark.read.schema(schemas.RESULT_DOCUMENT + ", _bad string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
        .withColumn("path", F.input_file_name())
    )
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.data)?\.json$", "")
    return docs.withColumn("rec_id", base).withColumn("readable", F.col("_bad").isNull() | F.col("segments").isNotNull()).drop("_bad")


def parse_results(raw: DataFrame, rec: str = "rec_id") -> DataFrame:
    """The same from rows (rec, raw) of JSON text, as a stream or table of documents brings them."""
    parsed = F.from_json("raw", schemas.RESULT_DOCUMENT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = raw.select(F.col(rec).alias("rec_id"), F.explode(F.array(parsed)).alias("d"))
    return rows.select("rec_id", "d.*").withColumn("readable", F.col("_bad").isNull() | F.col("segments").isNotNull()).drop("_bad")


def whole_documents(raw: DataFrame, rec: str = "rec_id") -> DataFrame:
    """``parse_results`` with ``blocks``: every block of the document under its name as VARIANT, known or not, with all that is nested in it.

    Typed columns are for computing; ``blocks`` is for writing a document back without loss. Null where the text is no JSON object.
    """
    rows = raw.select(F.col(rec).alias("rec_id"), "raw")
    blocks = F.when(F.try_parse_json("raw").isNotNull() & F.ltrim("raw").startswith("{"), F.from_json("raw", "map<string,variant>"))
    typed = F.from_json("raw", schemas.RESULT_DOCUMENT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    # A plain column, not a generator, so that nothing is parsed for columns that are not used.
    rows = rows.select("rec_id", typed.alias("d"), blocks.alias("blocks"))
    return rows.select("rec_id", "d.*", "blocks").withColumn("readable", F.col("_bad").isNull() | F.col("segments").isNotNull()).drop("_bad")


def read_whole_documents(spark: SparkSession, path: str) -> DataFrame:
    """``whole_documents`` of a folder of files, one document each."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.data)?\.json$", "")
    return whole_documents(texts.withColumn("rec_id", base))


def result_segments(results: DataFrame) -> DataFrame:
    """Segments table of result documents, in milliseconds."""
    ms = lambda c: F.bround(c * 1000).cast("bigint")
    rows = results.filter("readable").select("rec_id", F.posexplode("segments").alias("_p", "s"))
    words = F.transform("s.words", lambda w: F.struct(w.word.alias("word"), ms(w.start).alias("st"), ms(w.end).alias("en"), w.probability.alias("probability")))
    return rows.select(
        "rec_id", F.coalesce("s.id", F.col("_p").cast("bigint")).alias("seg_id"), ms(F.col("s.start")).alias("st"), ms(F.col("s.end")).alias("en"),
        F.coalesce("s.text", F.lit("")).alias("text"), "s.speaker", "s.avg_logprob", "s.no_speech_prob", "s.compression_ratio", "s.temperature",
        F.coalesce(words, F.array().cast(schemas.WORDS)).alias("words"),
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Run history kept as a JSON array; items that aren't objects are skipped, and a missing file is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schemas.HISTORY).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.HISTORY)


def list_files(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """(path, modified_at, length, suffix), newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified_at"), "length")
    suffix = F.coalesce(*[F.when(F.endswith("path", F.lit(s)), F.lit(s)) for s in suffixes])
    return files.withColumn("suffix", suffix).filter(F.col("suffix").isNotNull()).orderBy(F.desc("modified_at"), "path")


def file_identity(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, stem, size_bytes, sha256, modified_at): each file is hashed once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    stem = safe_stem(F.regexp_replace(name, r"\.[^.]+$", ""))
    return files.select("path", name.alias("name"), stem.alias("stem"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"))


def read_progress(spark: SparkSession, folder: str, schema: str = schemas.PROGRESS_EVENT, stream: bool = False) -> DataFrame:
    """JSON lines as events; blank and malformed lines are skipped."""
    return parse_progress((spark.readStream if stream else spark.read).text(folder), schema)


def parse_progress(lines: DataFrame, schema: str = schemas.PROGRESS_EVENT) -> DataFrame:
    """The same from rows (value) of text."""
    parsed = lines.select(F.from_json("value", schema).alias("e"), "value")
    first = schema.split()[0]
    return parsed.filter((strip("value") != "") & F.col(f"e.{first}").isNotNull()).select("e.*")


def download_state(events: DataFrame) -> DataFrame:
    """(job, error, fraction): the first error of a job ends it; events have job, seq, status, completed, total, error."""
    failed = F.col("error").isNotNull()
    return events.groupBy("job").agg(
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("seq"))).alias("error"),
        F.round(F.max(clamp(F.try_divide("completed", "total"), 0.0, 1.0)), 4).alias("fraction"),
    )


def _samples(content: bytes) -> tuple[np.ndarray, int] | None:
    """Mono samples in [-1, 1] of 16-bit PCM; None for anything else."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2 or not w.getframerate():
                return None
            data = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(np.float32) / 32768.0
            return data.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return None


def wav_frames(files: DataFrame, frame_ms: int = FRAME_MS) -> DataFrame:
    """(rec_id, frame_idx, ms, peak, n_full) of files (path, content): mean square, peak and full-scale samples per frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                read = _samples(bytes(content))
                if read is None:
                    continue
                x, rate = read
                n = max(1, rate * frame_ms // 1000)
                starts = np.arange(0, len(x), n)
                if not len(starts):
                    continue
                size = np.minimum(n, len(x) - starts)
                yield pd.DataFrame(
                    {
                        "rec_id": path, "frame_idx": np.arange(len(starts)), "ms": np.add.reduceat(x.astype(np.float64) ** 2, starts) / size,
                        "peak": np.maximum.reduceat(np.abs(x), starts).astype(np.float64), "n_full": np.add.reduceat((np.abs(x) >= 32767 / 32768).astype(np.int64), starts),
                    }
                )

    return files.select("path", "content").mapInPandas(run, "rec_id string, frame_idx long, ms double, peak double, n_full long")


def wav_durations(files: DataFrame) -> DataFrame:
    """(rec_id, duration_s) from the first 4 KB of files (path, content), which hold the header; null for what isn't PCM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    with wave.open(io.BytesIO(bytes(content))) as w:
                        out.append(w.getnframes() / w.getframerate())
                except (wave.Error, EOFError, ZeroDivisionError):
                    out.append(None)
            yield pd.DataFrame({"rec_id": batch["path"], "duration_s": pd.Series(out, dtype="float64")})

    return files.select("path", F.substring("content", 1, 4096).alias("content")).mapInPandas(run, "rec_id string, duration_s double")
