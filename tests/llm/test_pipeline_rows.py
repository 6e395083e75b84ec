import random

import corpus_pipeline
from reelspan.llm.toxicity import ToxicityModel

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(n))


def table(spark, data):
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(data)], DOCS)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_a_kept_row_brings_no_rejected_row_of_its_id_back(spark):
    good, other, junk = prose(1), prose(2), "too short"
    more = [(20 + i, prose(20 + i)) for i in range(8)]  # so that hosts pass
    docs = table(spark, [(None, good), (None, junk), (None, None), (7, other), (7, junk), *more])
    assert left(corpus_pipeline.quality(spark, docs, DIR)) == sorted([(None, good), (7, other), *more], key=str)


def test_toxic_rows_go_one_by_one(spark, monkeypatch):
    def toxic_if_bad(docs, labels, allowed):
        return ToxicityModel()

    def verdicts(docs, model, id_col="doc_id", text_col="text", inside=False):
        return docs.selectExpr(id_col, "0D AS score", f"int({id_col}.text like '%bad%') AS predicted")

    monkeypatch.setattr(corpus_pipeline, "train_toxicity", toxic_if_bad)
    monkeypatch.setattr(corpus_pipeline, "score_toxicity", verdicts)
    docs = table(spark, [(None, "fine"), (None, "bad"), (7, "fine too"), (7, "bad too")])
    assert left(corpus_pipeline.toxicity(spark, docs, DIR)) == sorted([(None, "fine"), (7, "fine too")], key=str)


def test_one_row_of_each_group_stays(spark):
    a, b, c = prose(3), prose(4), prose(5)
    # Near copies among null ids; an id with two texts, one of them a near copy of another id's.
    docs = table(spark, [(None, a), (None, a + " end"), (None, a), (7, b), (7, c), (3, c + " end"), (9, b)])
    out = left(corpus_pipeline.near_duplicates(spark, docs, DIR))
    assert len(out) == 3 and {x[0] for x in out} == {None, 7, 3}
    assert (7, b) in out and (3, c + " end") in out and out.count((7, c)) == 0
