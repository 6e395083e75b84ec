"""Documents to packed training sequences: quality rules, toxicity, near duplicates, packing.

All stages decide on rows, whatever their ids: null and repeated ids are judged row by row.
Extra columns go along, under any name; an empty table stays empty; texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import crc_bucket, materialise, small_batches
from reelspan.llm.ngram_join import jaccard_components
from reelspan.llm.packing import pack_documents
from reelspan.llm.quality_rules import apply_quality_rules
from reelspan.llm.toxicity import score_toxicity, train_toxicity


#: Name of a whole row where it stands for its id, and rows that go to Python at a time within a stage.
WHOLE, BATCH_ROWS = "_whole_row", 500


def whole(docs: DataFrame) -> DataFrame:
    """Rows as one struct: an operator that reads the text inside and returns the id of a row so returns the row itself."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(WHOLE))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as set it apart from the columns."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, and whose host does.

    A null, empty or blank text fails (it has under 20 words); a null source belongs to no host and is
    judged by its own rules alone. Equal rows get equal verdicts and all stay or all go.
    """
    with small_batches(spark, BATCH_ROWS):
        return apply_quality_rules(whole(docs), id_col=WHOLE, inside=True).filter("kept").select(f"{WHOLE}.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic.

    The classifier learns from labels whose document is still there, so an id that repeats is learned from
    once; a null or wordless text has the score of a blank one. A score of exactly 0.5 is toxic.
    Without any label nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with small_batches(spark, BATCH_ROWS):
        model = train_toxicity(docs, labels, crc_bucket("doc_id", 5) != 0)
    # The rows go through Python once, by the session's own batches, and need no shuffle.
    return score_toxicity(whole(docs), model, id_col=WHOLE, inside=True).filter("predicted = 0").select(f"{WHOLE}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, Jaccard 0.8): that of least id, null last.

    Rows of one id differ by a hash of the text, equal rows by their place. Rows without words (null,
    empty or blank texts) are in no group and stay.
    """
    row = free_name(docs, "_row_number")
    # Written once, so that every use of a row finds the same number.
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    with small_batches(spark, BATCH_ROWS):
        joined = jaccard_components(numbered, words=5, num=80, den=100, id_col=row).select(F.col(row).alias("_r"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"), F.col(row).alias("d"))
    first = joined.join(numbered.select(F.col(row).alias("_r"), order.alias("_order")), "_r").groupBy("component_id").agg(F.min("_order").alias("_order"))
    return numbered.join(first.select(F.col("_order.d").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 1024.

    A null or empty text is one piece of one token; equal rows are packed each; ties in the order
    within a sequence are between equal pieces. Only doc_id and text are used.
    """
    with small_batches(spark, BATCH_ROWS):
        return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("toxicity", toxicity), ("ngram_join", near_duplicates), ("packing", packing)]

#: The network of the second stage has no SQL form; tests/llm/test_pipeline_plain.py holds run() against a plain version, given the verdicts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each to what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
