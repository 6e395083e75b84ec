import random

from pyspark.sql import functions as F

from reelspan.llm.toxicity import OWN_CUT, ToxicityModel, train_toxicity

COMMON = {"en": ["the", "thing", "other", "with", "whole"], "de": ["schön", "über", "nicht", "größe", "straße"]}
BAD = {"en": "moron", "de": "mistkerl"}


def skewed(spark, n=3000, rare=0.02):
    """Few texts are German, yet over OWN_CUT of them have each label; a tenth of the texts is toxic."""
    rng, docs, labels = random.Random(5), [], []
    for i in range(n):
        lang = "de" if rng.random() < rare else "en"
        y = int(rng.random() < (0.5 if lang == "de" else 0.1))
        words = [rng.choice(COMMON[lang]) for _ in range(rng.randint(5, 30))] + [BAD[lang]] * y
        docs.append((i, " ".join(words), lang))
        labels.append((i, y))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_a_rare_language_gets_its_cut_from_all_labelled_rows(spark):
    docs, labels = skewed(spark)
    by_label = {r.toxic: r["count"] for r in docs.filter("lang = 'de'").join(labels, "doc_id").groupBy("toxic").count().collect()}
    assert min(by_label.values()) >= OWN_CUT
    # The sample has under OWN_CUT toxic German texts.
    model = train_toxicity(docs, labels, F.lit(True), positives=100, negatives=200)
    assert set(model.cuts) == {"en", "de"}


def test_labels_without_a_document_use_up_no_bound(spark):
    docs, labels = skewed(spark, 400)
    strays = spark.range(10_000, 40_000).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    one, other = (train_toxicity(docs, x, F.lit(True), 40, 80) for x in (labels, labels.unionByName(strays)))
    assert one.cut == other.cut and one.cuts == other.cuts


def test_texts_that_were_not_fitted_on_decide():
    model = ToxicityModel()
    held = [(-1, 1, 300, 0, 20), (-1, 0, 100, 0, 20)]
    model.set_cuts([*held, (-1, 1, 9000, 1, 500), (-1, 0, -9000, 1, 500)])
    assert abs(model.cut - 200.5 / 256) < 1e-9
