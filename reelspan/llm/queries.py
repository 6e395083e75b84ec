"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.topk_search import topk_inner_products

    return topk_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.quality_rules import apply_quality_rules

    return apply_quality_rules(table(spark, sf_dir, "documents")).drop("host_rate")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from reelspan.llm.bpe_codec import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from reelspan.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.common import crc_bucket
    from reelspan.llm.toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 5) == 0
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.common import crc_bucket
    from reelspan.llm.langid import predict_language, train_language_model

    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 3) == 1
    model = train_language_model(docs, ~held_out)
    return predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; those of label quality 0 are deleted, toxic ones are recounted without symbols; the first batch is sent again.

    A document with several labels is poor by its least quality, and else toxic by its greatest.
    """
    import public_tokenizers

    from reelspan.llm.common import materialise
    from reelspan.llm.token_counts import TokenRollup, count_tokens

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    versions = {name: public_tokenizers.path(f"{name}.tiktoken") for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    # Both forms of a text are counted in one pass and written, so what meets the labels is counts.
    symbols = r"[#*$%&|<>]+"
    rows = docs.select("doc_id", "source", "lang", "text", F.coalesce(F.col("text").rlike(symbols), F.lit(False)).alias("changes"))
    plain_form = F.struct(F.lit(False).alias("cleaned"), F.col("text"))
    forms = F.when(F.col("changes"), F.array(plain_form, F.struct(F.lit(True).alias("cleaned"), F.regexp_replace("text", symbols, "").alias("text")))).otherwise(F.array(plain_form))
    both = rows.select("doc_id", "source", "lang", "changes", F.inline(forms)).select(F.struct("doc_id", "changes", "cleaned").alias("doc"), "source", "lang", "text")
    counted = count_tokens(both, versions, public_tokenizers.PATTERN, id_col="doc")
    counted = materialise(counted.select("doc.*", "source", "lang", "tokenizer_version", "n_tokens"), "counts")
    state = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    poor, toxic = (state.filter(c).select("doc_id") for c in ("quality = 0", "quality = 1 and toxic = 1"))
    plain = counted.filter("not cleaned")

    def of(condition: str, ids: DataFrame) -> DataFrame:
        return counted.filter(condition).join(ids, "doc_id", "left_semi")

    rollup = TokenRollup(spark)
    rollup.apply("load", inserted=plain)
    rollup.apply("poor", deleted=of("not cleaned", poor))
    # Texts without symbols keep their count, so only the others are revised.
    rollup.apply("toxic", inserted=of("cleaned", toxic), deleted=of("changes and not cleaned", toxic))
    rollup.apply("load", inserted=plain)
    return rollup.totals()


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.merkle import prove_documents

    return prove_documents(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


@query
def op13_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.va_clusters import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256))


@query
def op12_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspan.llm.pii import span_digests

    return span_digests(table(spark, sf_dir, "documents"))
