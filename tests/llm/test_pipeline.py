import pytest
from llm_helpers import rows

import corpus_pipeline
from reelspan.llm import oracles, queries

DIR = "/root/testdata/sf0.001"


def test_names_of_the_queries():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_join", "packing"]


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], DIR)
        out.append(corpus_pipeline.materialise(made, "test"))
    return out


def test_stages_take_effect_in_order(spark, staged):
    docs, good, clean, single, packed = staged
    from reelspan.llm.ngram_join import jaccard_components
    from reelspan.llm.quality_rules import apply_quality_rules

    assert docs.columns == good.columns == clean.columns == single.columns
    assert rows(good, "doc_id") == rows(apply_quality_rules(docs).filter("kept"), "doc_id")
    assert {r[0] for r in rows(clean, "doc_id")} <= {r[0] for r in rows(good, "doc_id")}
    assert rows(single, "doc_id") == rows(jaccard_components(clean, 5, 80, 100).filter("doc_id = component_id"), "doc_id")
    assert rows(packed.filter("start = 0"), "doc_id") == rows(single, "doc_id")


def test_toxic_documents_go_and_clean_ones_stay(spark, staged):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    before, after = staged[1].join(labels, "doc_id"), staged[2].join(labels, "doc_id")
    assert after.filter("toxic = 0").count() >= 0.95 * before.filter("toxic = 0").count()
    assert after.filter("toxic = 1").count() <= 0.3 * max(1, before.filter("toxic = 1").count())


def test_pipeline_on_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DIR)
    assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[3][1](spark, docs, DIR).count() >= docs.count()


def test_run_returns_the_packed_pieces(spark):
    assert corpus_pipeline.run(spark, DIR).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
