"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

Totals are sums, so a change needs only its difference: an insert adds a document and its
tokens, a delete takes them away, a revised count takes the old row away and adds the new
one. A batch of changes is summed to one row per key and added to the totals as they stood;
the sum is written as the next version of the totals, and a commit names it together with
the batch. No earlier delta is read again. A batch counts once: one that is in the commits
is not applied again, and totals without a commit (of a writer that was lost half way) are
never read. Tokenizer versions are rank files of byte-level BPE vocabularies.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import kept, lean, plain_columns, shared_dir, sub_batches
from reelspan.llm.text_chunks import ChunkMemo

KEYS = ("source", "lang", "tokenizer_version")
TOTAL_SCHEMA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"
COMMIT_SCHEMA = "version bigint, batch_id string, attempt string"


class Counter:
    """Numbers of tokens of texts in several vocabularies at once; distinct parts of texts are kept in a bounded memo."""

    def __init__(self, paths: tuple[str, ...], pattern: str):
        import base64

        import regex
        import tiktoken

        self.encodings = []
        for path in paths:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.encodings.append(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        self.memo = ChunkMemo(self._parts, regex.compile(pattern).findall)

    def _parts(self, parts: list[str]) -> list[tuple[int, ...]]:
        return [tuple(len(e.encode_ordinary(p)) for e in self.encodings) for p in parts]

    def counts(self, texts: list[str]) -> list[list[int]]:
        """For each vocabulary, the number of tokens of every text."""
        sums = [tuple(map(sum, zip(*parts))) if parts else (0,) * len(self.encodings) for parts in self.memo.batch(texts)]
        return [list(column) for column in zip(*sums)] if sums else [[] for _ in self.encodings]


def counter(paths: tuple[str, ...], pattern: str) -> Counter:
    """One counter for each Python worker and set of vocabularies."""
    return kept("counter", (paths, pattern), lambda: Counter(paths, pattern))


def count_tokens(
    docs: DataFrame, tokenizers: dict[str, str], pattern: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang"
) -> DataFrame:
    """(``id_col``, source, lang, tokenizer_version, n_tokens): one row per document and version.

    ``tokenizers`` maps a version to its rank file, ``pattern`` splits texts before the merges.
    A null or empty text has 0 tokens; whole texts are counted, however long; repeated rows
    are counted each; other columns are ignored; no rows give no rows.
    """
    versions, paths = list(tokenizers), tuple(tokenizers.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(paths, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in sub_batches(texts):
                keys = [batch.column(c).slice(a, b - a) for c in (0, 2, 3)]
                for version, counts in zip(versions, own.counts(texts[a:b])):
                    columns = [*keys, pa.array([version] * (b - a), pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, *KEYS, "n_tokens"])

    rows = plain_columns(docs, (id_col, text_col, source_col, lang_col))
    rows = rows.select(id_col, F.col(text_col).cast("string").alias("_text"), F.col(source_col).cast("string").alias("_source"), F.col(lang_col).cast("string").alias("_lang"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lean(run, "counter"), f"`{id_col}` {kind}, source string, lang string, tokenizer_version string, n_tokens bigint")


class TokenRollup:
    """Totals in a folder that all executors reach; ``path`` None makes a new one in the shared folder.

    One writer at a time: of two that commit the same version, the attempt that sorts first
    counts, and the other one applies its batch again on top of it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/reelspan-rollup-{uuid.uuid4().hex}"
        spark.createDataFrame([], COMMIT_SCHEMA).write.mode("append").parquet(f"{self.path}/commits")

    def commits(self) -> DataFrame:
        """(version, batch_id, attempt): the batches that count."""
        rows = self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.path}/commits")
        return rows.groupBy("version").agg(F.min(F.struct("attempt", "batch_id")).alias("c")).select("version", "c.batch_id", "c.attempt")

    def _latest(self) -> tuple[int, str | None]:
        last = self.commits().agg(F.max(F.struct("version", "attempt")).alias("c")).first().c
        return (last.version, last.attempt) if last else (0, None)

    def _totals(self, attempt: str | None) -> DataFrame:
        if attempt is None:
            return self.spark.createDataFrame([], TOTAL_SCHEMA)
        return self.spark.read.schema(TOTAL_SCHEMA).parquet(f"{self.path}/totals/{attempt}")

    def apply(self, batch_id: str, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> bool:
        """Commit a batch once; a revision is the old rows deleted and the new ones inserted. False if it was there already.

        Rows have the KEYS and n_tokens; null keys are a group of their own. Empty batches count as
        committed. Keys that are left without documents and tokens leave the totals.
        """
        while self.commits().filter(F.col("batch_id") == batch_id).isEmpty():
            version, before = self._latest()
            signed = [self._totals(before)]
            for rows, sign in ((inserted, 1), (deleted, -1)):
                if rows is not None:
                    signed.append(rows.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens")))
            every = signed[0]
            for rows in signed[1:]:
                every = every.unionByName(rows)
            summed = every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            attempt = uuid.uuid4().hex
            summed.filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.path}/totals/{attempt}")
            # One small file makes the batch count.
            marker = self.spark.range(1).select(F.lit(version + 1).cast("long").alias("version"), F.lit(batch_id).alias("batch_id"), F.lit(attempt).alias("attempt"))
            marker.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
            if not self.commits().filter(F.col("attempt") == attempt).isEmpty():
                return True
        return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) after all committed batches; keys without documents are left out."""
        return self._totals(self._latest()[1])
