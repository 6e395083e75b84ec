import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A maker of documents tables; ``odd`` has nulls, empty, blank and very long texts, and repeated rows."""

    def make(texts, start=0):
        rows = [(start + i, t, ("en", "fr")[i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def odd(spark, documents):
    long = " ".join(f"w{i % 977}x" for i in range(30_000))
    base = documents([None, "", "  \n ", "one", "one two three four", "one two three four", long, long + " end", "á　b c  d", "x" * 5000])
    more = base.filter("doc_id = 4").unionByName(base.filter("doc_id = 0"))
    nulls = spark.createDataFrame([(None, "no id here at all", None, None, None)], DOCS)
    # Extra columns whose names clash with those the operators make.
    out = base.unionByName(more).unionByName(nulls)
    for name in ("sid", "score", "shard", "_key", "host", "start", "label", "cell", "rank", "kept", "sequence_id", "words"):
        out = out.withColumn(name, F.lit("clash"))
    return out
