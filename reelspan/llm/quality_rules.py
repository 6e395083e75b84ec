"""Quality rules per document, and verdicts on hosts shrunk towards an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import lean, materialise, plain_columns

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
WINDOW = 8
#: Hosts that are few enough to be sent to every task, and keys per host where they aren't.
BROADCAST_HOSTS, SALTS = 100_000, 64
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Odd multipliers, one per place in a window.
PLACES = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in some ``window``-word run found at two places or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        runs += codes[k : k + n] * PLACES[k]
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += again
    edges[window:] -= again
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str) -> tuple[int, int, int, int, int]:
    """The values of FEATURES for one text."""
    words = text.encode().split()  # on bytes: the six ASCII white-space characters only
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", inside: bool = False) -> DataFrame:
    """One row per document: ``id_col``, host (text, may be null) and FEATURES; null texts have no words.

    ``inside``: text and host are fields of the struct ``id_col``, so a whole row goes along and its text is sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hosts = (batch.column(0).field(text_col), batch.column(0).field(host_col).cast("string")) if inside else (batch.column(1), batch.column(2))
            values = np.empty((len(texts), len(FEATURES)), dtype=np.int64)
            for i, t in enumerate(texts):
                values[i] = measure(t.as_py() or "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), hosts, *[pa.array(values[:, k]) for k in range(len(FEATURES))]],
                names=[id_col, "host", *FEATURES],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    wanted = plain_columns(docs, (id_col,)) if inside else plain_columns(docs, (id_col, text_col, host_col)).withColumn(host_col, F.col(host_col).cast("string"))
    return wanted.mapInArrow(lean(run), f"`{id_col}` {kind}, host string, " + ", ".join(f"{f} bigint" for f in FEATURES))


def host_verdicts(checked: DataFrame, limit: float = 0.5) -> DataFrame:
    """Hosts of a table (host, failed): n_docs, n_failed, shrunk_rate and host_ok.

    The prior's mean is the corpus rate m. Its strength comes from the spread of the hosts'
    rates beyond what chance explains (method of moments, rates weighted by documents):
    m (1 - m) / spread - 1, held between 1 and 1e6. A host passes while its posterior mean
    is no higher than ``limit``. Rows without a host are in none.
    """
    hosts = checked.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    corpus = hosts.agg(
        F.count("*").alias("h"),
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.sum(F.col("n_failed") * rate).alias("ss"),
    ).select((F.col("f") / F.col("n")).alias("m"), (F.col("ss") / F.col("n")).alias("s2"), (F.col("h") / F.col("n")).alias("per_doc"))
    m = F.col("m")
    spread = F.col("s2") - m * m - m * (1 - m) * F.col("per_doc")
    strength = F.when(spread <= 0, F.lit(1e6)).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / spread - 1)))
    prior = corpus.select(m.alias("m"), strength.alias("strength")).first()  # two numbers
    m, strength = F.lit(prior.m), F.lit(prior.strength)
    shrunk = (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= limit).alias("host_ok"))


def apply_quality_rules(
    docs: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", inside: bool = False
) -> DataFrame:
    """Judge every document by its own text and by its host.

    Returns ``id_col``, FEATURES, base_failed (under 20 words, or over 30 % of the words in
    repeated 8-word windows), kept and host_rate. A document counts against its host when it
    fails so, or when symbols make up more than a tenth of its word characters. kept is false
    if base_failed or if the host's shrunk rate of failures is over ``limit``. A null text
    has no words and fails; a null host has no verdict. Long texts are taken whole, one at a time.
    Repeated rows count each; other columns are ignored; no rows give no rows. ``inside``: text
    and host are fields of the struct ``id_col``; ``docs`` is then read twice, so that no row is written.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = (F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars"))).alias("failed")
    measured = measure_documents(docs, id_col, text_col, host_col, inside).withColumn("base_failed", base)
    if inside:
        parts = docs.select(F.lit(0).alias("_row"), *[F.col(f"`{id_col}`.`{c}`").alias(c) for c in (text_col, host_col)])
        checked = materialise(measure_documents(parts, "_row", text_col, host_col).withColumn("base_failed", base).select("host", failed), "quality")
    else:
        measured = materialise(measured, "quality")
        checked = measured.select("host", failed)
    hosts = materialise(host_verdicts(checked, limit).select("host", "shrunk_rate", "host_ok"), "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        judged = measured.join(F.broadcast(hosts), "host", "left")
    else:  # a hot host's documents are dealt over SALTS keys
        salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = measured.withColumn("_salt", F.pmod(F.xxhash64(id_col, *FEATURES), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left")
    return judged.select(
        id_col,
        *FEATURES,
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).alias("kept"),
        F.col("shrunk_rate").alias("host_rate"),
    )
