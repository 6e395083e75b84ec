import random

import numpy as np
from llm_helpers import rows
from pyspark.sql import functions as F

from reelspan.llm.common import crc_bucket
from reelspan.llm.langid import STEPS, ByteGRU, predict_language, train_language_model
from reelspan.llm.toxicity import EMBED, FILTERS, TABLE, WIDTHS, Scorer, ToxicityModel, best_cut, features, score_toxicity, train_toxicity, words_of

TONGUES = {"en": ["the", "thing", "other", "with", "whole", "that"], "de": ["schön", "über", "nicht", "größe", "straße", "und"], "fr": ["être", "château", "leçon", "aux", "où", "les"]}


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = ByteGRU(["a", "b"], units=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, target = rng.integers(1, 50, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    data[4:, 1] = 0

    def loss():
        p = net.label(net.read(data)[0])
        real = (data > 0) / (data > 0).sum()
        return -(np.log(p[:, target, np.arange(4)]) * real).sum()

    grad, _ = net.gradient(data, target)
    for name, g in grad.items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(6)]:
            if name == "x":
                at = (at[0], at[1], int(data[0, 0]))
            step, old = 1e-2, net.w[name][at]
            net.w[name][at] = old + step
            up = loss()
            net.w[name][at] = old - step
            down = loss()
            net.w[name][at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def tongue_table(spark, n=240):
    rng, data = random.Random(0), []
    for i in range(n):
        lang = list(TONGUES)[i % 3]
        data.append((i, " ".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(3, 60))), lang))
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))


def test_language_of_held_out_texts(spark):
    docs = tongue_table(spark)
    held = crc_bucket("doc_id", 3) == 1
    model = train_language_model(docs, ~held, per_language=60)
    out = predict_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(held)
    assert out.filter("lang = lang_pred").count() >= 0.95 * out.count()


def test_language_on_odd_rows(spark, odd):
    model = train_language_model(tongue_table(spark, 30), F.lit(True), per_language=10)
    out = {r.doc_id: r for r in predict_language(odd, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2)) and out[3].lang_pred in TONGUES and 0 < out[3].score <= 1
    assert predict_language(odd.limit(0), model).count() == 0
    assert train_language_model(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None
    assert {r.lang_pred for r in predict_language(odd, None).collect()} == {"und"}
    assert STEPS == 64


def toxic_table(spark, n=500):
    rng, docs, labels = random.Random(1), [], []
    insults = {"en": ["moron", "scum"], "de": ["dummkopf", "mistkerl"], "fr": ["crétin", "ordure"]}
    for i in range(n):
        lang = list(TONGUES)[i % 3]
        words = [rng.choice(TONGUES[lang]) + rng.choice(["", "en", "s"]) for _ in range(rng.randint(5, 80))]
        if y := int(i % 5 == 0):
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(insults[lang]))
        docs.append((i, " ".join(words), lang))
        labels.append((i, y))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_of_held_out_texts(spark):
    docs, labels = toxic_table(spark)
    held = crc_bucket("doc_id", 5) == 0
    model = train_toxicity(docs, labels, ~held)
    out = score_toxicity(docs, model).join(labels, "doc_id").filter(held)
    assert out.filter("toxic = predicted").count() >= 0.95 * out.count()
    assert out.filter("(score >= 0.5) <> (predicted = 1)").count() == 0
    # Labels and languages are no inputs of a score.
    again = score_toxicity(docs.withColumn("lang", F.lit("xx")), model)
    assert rows(again) == rows(score_toxicity(docs, model))


def test_toxicity_on_odd_rows(spark, odd):
    docs, labels = toxic_table(spark, 200)
    out = score_toxicity(odd, train_toxicity(docs, labels, F.lit(True)))
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert out.filter("doc_id in (0, 1, 2)").select("score").distinct().count() == 1
    assert score_toxicity(odd.limit(0), None).count() == 0
    assert train_toxicity(docs, labels.limit(0), F.lit(True)) is None
    assert {r.predicted for r in score_toxicity(odd, train_toxicity(docs, labels.filter("toxic = 1"), F.lit(True))).collect()} == {1}


def test_best_cut():
    cut = best_cut(np.array([5.0, 4.0, 1.0, 0.0]), np.array([1, 1, 0, 0]))
    assert 1 < cut < 4


def plain_response(model, text):
    """Hashed embeddings, every window of every filter, the greatest response, a rectifier and the output unit, in loops."""
    words = words_of(text)
    vectors = [sum(model.embedding[b].astype(float) for b in features(w)) for w in words]
    pooled = []
    for width, f in zip(WIDTHS, model.filters):
        for k in range(FILTERS):
            best = 0.0 if not words else max(
                sum(vectors[i + j] @ f[j, :, k].astype(float) for j in range(width) if i + j < len(words)) for i in range(len(words))
            )
            pooled.append(best)
    hidden = [max(0.0, p + float(b)) for p, b in zip(pooled, model.bias)]
    return sum(h * float(o) for h, o in zip(hidden, model.output)) + float(model.offset)


def plain_guess(model, text):
    votes = np.zeros(len(model.languages))
    for w in words_of(text):
        votes += model.language_table[features(w)[0]]
    return int(votes.argmax()) if words_of(text) else -1


def test_scorer_equals_a_plain_forward_pass():
    rng, model = np.random.default_rng(1), ToxicityModel()
    model.bias, model.output, model.offset = rng.normal(size=len(model.bias)) * 0.1, rng.normal(size=len(model.output)), np.float32(0.3)
    model.languages, model.language_table = ["en", "fr"], rng.normal(size=(TABLE, 2)).astype(np.float32)
    model.cuts, model.cut = {"en": 0.2, "fr": -0.1}, 0.05
    assert model.embedding.shape == (TABLE, EMBED)
    words = [f"{a}{b}word" for a in "abcdefghij" for b in "uvwxyz"] + ["as", "über", "l"]
    pick = random.Random(2)
    texts = [None, "", "12 !?", "one", "two words", *[" ".join(pick.choice(words) for _ in range(pick.randrange(1, 40))) for _ in range(60)]]
    scorer = Scorer(model)
    response, guess = scorer.respond([words_of(t) for t in texts])
    assert guess.tolist() == [plain_guess(model, t) for t in texts]
    assert np.allclose(response, [plain_response(model, t) for t in texts], atol=1e-4)
    cuts = [model.cuts[model.languages[g]] if g >= 0 else model.cut for g in guess]
    assert np.allclose(scorer.scores([words_of(t) for t in texts]), [1 / (1 + np.exp(c - r)) for r, c in zip(response, cuts)], atol=1e-6)


def plain_pooled(net, raw):
    """Every window read byte by byte in both directions; the mean of the labels of all bytes that aren't NUL."""
    k, w, total = net.units, {n: v.astype(float) for n, v in net.w.items()}, np.zeros(len(net.languages))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for a in range(0, len(raw), STEPS):
        window = raw[a : a + STEPS].ljust(STEPS, b"\0")
        states = []
        for d, order in enumerate((range(STEPS), range(STEPS - 1, -1, -1))):
            h, seen = np.zeros(k), {}
            for t in order:
                x, g = w["x"][d][:, window[t]], w["u"][d] @ h
                z, r = sigmoid(x[:k] + g[:k]), sigmoid(x[k : 2 * k] + g[k : 2 * k])
                n = np.tanh(x[2 * k :] + r * (g[2 * k :] + w["b"][d][:, 0]))
                h = (1 - z) * n + z * h
                seen[t] = h
            states.append(seen)
        for t in range(STEPS):
            if window[t]:
                e = np.exp(w["o"][0] @ states[0][t] + w["o"][1] @ states[1][t] + w["c"][:, 0])
                total += e / e.sum()
    return total / total.sum()


def test_pooled_labels_equal_a_plain_loop():
    net = ByteGRU(["a", "b", "c"], units=4)
    net.w["c"] += np.array([[0.2], [0.0], [-0.3]], np.float32)
    rng = random.Random(5)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (1, 5, STEPS - 1, STEPS, STEPS + 1, 3 * STEPS + 7)] + [b"nul\0inside", "größe".encode()]
    assert np.allclose(net.pooled(texts), [plain_pooled(net, t) for t in texts], atol=1e-5)
    assert np.allclose(net.pooled(texts, width=2), net.pooled(texts), atol=1e-6)
