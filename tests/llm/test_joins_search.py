import random

import numpy as np
import pytest
from llm_helpers import rows
from pyspark.sql import functions as F

from reelspan.llm.components import connected_components
from reelspan.llm.ngram_join import Cells, CountTree, jaccard_components, leader_pairs, shingle_hashes
from reelspan.llm.topk_search import topk_inner_products


def plain_components(texts, words, num, den):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        if not w:
            return set()
        return {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng, n, families, sizes):
    out = []
    for _ in range(families):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.randint(1, n)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 60, len(base) // 25])):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 99999)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_components_equal_brute_force(documents, words, num, den):
    rng = random.Random(words)
    texts = near_copies(rng, 12, 25, [1, 2, 3, 8, 12, 30, 100, 400]) + ["", None, " ", "A b", "a B", "common words only here"] * 2
    out = jaccard_components(documents(texts), words, num, den)
    assert sorted(tuple(r) for r in out.collect()) == plain_components(texts, words, num, den)


def test_one_large_family_at_the_threshold(documents):
    """Near copies whose similarity lies about the threshold: links run through some of them only."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    out = jaccard_components(documents(texts), 3, 90, 100)
    assert sorted(tuple(r) for r in out.collect()) == plain_components(texts, 3, 90, 100)


def test_similar_sets_share_a_cell():
    rng = np.random.default_rng(0)
    for num, den in ((90, 100), (80, 100)):
        cells = Cells(num, den)
        for n in (9, 10, 11, 40, 200, 1500):
            for _ in range(20):
                a = rng.integers(0, 1 << 63, n).astype(np.uint64)
                b = a.copy()
                apart = (den - num) * n // (den + num)
                b[:apart] = rng.integers(0, 1 << 63, apart).astype(np.uint64)
                a, b = np.unique(a), np.unique(b)
                shared = len(np.intersect1d(a, b))
                if den * shared >= num * (len(a) + len(b) - shared) and apart:
                    assert np.intersect1d(cells.of(a), cells.of(b)).size


def test_tree_finds_all_that_the_bound_lets_through():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, size=(700, 256)).astype(np.int32)
    points[300:] = points[:400] + (rng.random((400, 256)) < 0.02)
    tree = CountTree(points, 90, 100)
    for i in range(0, 700, 37):
        least = np.minimum(points, points[i]).sum(axis=1) * 190 >= 90 * (points.sum(axis=1) + points[i].sum())
        assert sorted(tree.search(points[i]).tolist()) == np.flatnonzero(least).tolist()
    # Every point that isn't a leader follows one whose bound lets it through.
    pairs = leader_pairs(points, 90, 100)
    followers = [j for _, j in pairs]
    assert len(followers) == len(set(followers)) and not set(followers) & {i for i, _ in pairs}
    for i, j in pairs:
        assert np.minimum(points[i], points[j]).sum() * 190 >= 90 * (points[i].sum() + points[j].sum())
    assert len(followers) >= 300


def test_join_on_odd_rows(odd):
    out = jaccard_components(odd, 5, 80, 100)
    got = rows(out, "doc_id", "n_shingles", "component_id")
    assert len(got) == odd.count()
    by = {r[0]: r for r in got}
    assert by[0][1:] == (0, 0) and by[1][1:] == (0, 1) and by[2][1:] == (0, 2)
    assert by[5][2] == 4 and by[4][2] == 4 and by[7][2] == 6 and by[None][2] is None
    assert jaccard_components(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(200, 201), (201, 200), (5, 5)]
    out = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    label = dict(rows(out, "node", "label"))
    assert label[160] == 100 and label[39] == 7 and label[201] == 200 and 5 not in label


def test_words_are_cut_at_ascii_white_space_only():
    assert len(shingle_hashes("a b c\x1fd", 1)) == 2
    assert (shingle_hashes("ÀB c", 1) == shingle_hashes("Àb c", 1)).all()


def plain_topk(vectors, k):
    whole = {}
    for i, v in vectors:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(len(v), []).append((i, [int(np.floor(1024 * x)) for x in v]))
    out = []
    for group in whole.values():
        for q, a in group:
            if q % 10 == 0:
                scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in group if i != q)[:k]
                out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_topk_equals_brute_force(spark, spread):
    rng = np.random.default_rng(2)
    vectors = []
    for i in range(600):
        v = rng.normal(size=8) if i % 3 else np.ones(8) * 0.5 + rng.normal(size=8) * 0.01
        vectors.append((i, [float(x) for x in v * np.exp(spread * rng.normal())]))
    vectors += [(600, None), (610, []), (620, [1.0, None]), (630, [float("nan")] * 8), (640, [1.0, 2.0]), (641, [3.0, 1.0]), (650, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    out = topk_inner_products(df, F.col("vec_id") % 10 == 0, k=10)
    assert sorted(tuple(r) for r in out.collect()) == plain_topk(vectors, 10)
    assert topk_inner_products(df.limit(0), F.lit(True)).count() == 0


def test_topk_ties_and_repeats(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(7, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    out = rows(topk_inner_products(df, F.col("vec_id") == 7, k=3), "query_id", "rank", "vec_id")
    assert out == [(7, 1, 0), (7, 2, 1), (7, 3, 2)]


def test_products_that_could_wrap_are_an_error():
    import numpy as np

    from reelspan.llm.topk_search import exact_products

    wide = np.array([[1 << 30, -(1 << 30)]])
    assert exact_products(wide, wide)[0, 0] == 1 << 61
    with pytest.raises(ValueError, match="too large"):
        exact_products(wide << 10, wide << 10)
