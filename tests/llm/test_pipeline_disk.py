"""What the pipeline's stages leave in the shared folder."""

import os
import random

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def held(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def test_quality_writes_no_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(400)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*texts, "too short", None])], DOCS)
    before = held(spark)
    good = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001")
    assert sorted((r.doc_id, r.text) for r in good.collect()) == list(enumerate(texts))
    assert held(spark) - before < sum(map(len, texts)) / 20
