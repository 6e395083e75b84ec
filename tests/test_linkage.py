"""Clusters in rounds over blocks, and cosine pairs by blocks, against plain loops."""

import numpy as np
import pytest

from reelspan.operators import linkage, speakers
from reelspan.plans import catalogue
from reelspan.plans.views import chunk_emb

SCHEMA = "rec_id bigint, idx int, embedding array<float>"


def plain_clusters(vectors, threshold, target, least, most):
    """Every pair of clusters looked at for every merge."""
    unit = [v / max(np.linalg.norm(v), 1e-9) for v in np.asarray(vectors, dtype=np.float64)]
    apart = 1 - np.clip(np.array(unit) @ np.array(unit).T, -1, 1)
    clusters = [[i] for i in range(len(vectors))]
    while len(clusters) > 1:
        d, i, j = min((round(float(apart[np.ix_(a, b)].mean()), 12), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if len(clusters) <= (target or max(1, least)) or (not target and d > threshold and (most is None or len(clusters) <= most)):
            break
        clusters[i] += clusters.pop(j)
    label = {i: k for k, c in enumerate(sorted(clusters, key=min)) for i in c}
    return [label[i] for i in range(len(vectors))]


def table(spark, recordings):
    return spark.createDataFrame([(r, i, [float(x) for x in v]) for r, vectors in recordings.items() for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def recordings(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    near = lambda n, noise: np.float32([centres[rng.integers(4)] + rng.normal(size=6) * noise for _ in range(n)])
    return {1: near(17, 0.3), 2: np.float32(rng.normal(size=(12, 6))), 3: near(1, 0.1), 4: near(2, 2.0), 5: np.repeat(near(3, 0.2), 5, axis=0), 6: np.float32([[0] * 6, [1] * 6, [0] * 6])}


@pytest.mark.parametrize("rule, finish", [((0.3, None, 1, 8), 0), ((0.6, None, 1, None), 5), ((0.1, None, 3, 4), 9), ((0.3, 2, 1, 8), 2048)])
def test_rounds_equal_plain_merges(spark, rule, finish):
    """All by rounds, all in a task, and both one after the other."""
    data = recordings()
    got = {}
    for r in linkage.long_clusters(table(spark, data), *rule, block=7, finish=finish).collect():
        got.setdefault(r.rec_id, {})[r.idx] = r.cluster
    for rec, vectors in data.items():
        assert [got[rec][i] for i in range(len(vectors))] == plain_clusters(vectors, *rule), rec
        assert speakers.average_linkage(vectors.astype(np.float64), *rule) == plain_clusters(vectors, *rule)


def test_long_and_short_recordings_together(spark, monkeypatch):
    monkeypatch.setattr(speakers, "IN_TASK", 10)
    data = recordings(1)
    got = {(r.rec_id, r.idx): r.cluster for r in speakers.cluster_chunks(table(spark, data)).collect()}
    assert got == {(rec, i): c for rec, v in data.items() for i, c in enumerate(plain_clusters(v, 0.3, None, 1, 8))}
    assert speakers.cluster_chunks(table(spark, data).limit(0)).count() == 0


def test_the_registered_query_equals_plain_merges(spark):
    folder = "/root/testdata/sf0.001"
    vectors = {}
    for r in chunk_emb(spark, folder).collect():
        vectors.setdefault(r.rec_id, {})[r.idx] = r.embedding
    want = {(rec, i): c for rec, v in vectors.items() for i, c in zip(sorted(v), plain_clusters([v[i] for i in sorted(v)], 0.9, None, 1, 8))}
    assert {(r.rec_id, r.idx): r.cluster for r in catalogue.QUERIES["cluster_chunks"](spark, folder).collect()} == want


def test_merges_are_few_rounds(spark):
    rng = np.random.default_rng(3)
    data = {1: np.float32([np.eye(8)[i % 8] + rng.normal(size=8) * 0.02 for i in range(80)])}
    _, merges = linkage.merge_tree(table(spark, data), 0.3, None, 1, 8, "rec_id", 64, finish=0)
    assert merges.count() == 72 and merges.agg({"round": "max"}).first()[0] < 16


@pytest.mark.parametrize("within", [None, 0.05, 0.5, 2.0])
def test_cosine_pairs_by_blocks(spark, within):
    data = recordings(2)
    got = {(r.rec_id, r.i, r.j): r.distance for r in speakers.cosine_pairs(table(spark, data), within, block=4).collect()}
    want = {}
    for rec, v in data.items():
        u = v.astype(np.float64) / np.maximum(np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True), 1e-9)
        for i in range(len(v)):
            for j in range(i + 1, len(v)):
                d = 1 - min(1.0, max(-1.0, float(u[i] @ u[j])))
                if within is None or d <= within:
                    want[rec, i, j] = d
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_blocks_that_are_far_apart_are_left_out(spark):
    from reelspan.operators.blocks import block_pairs, blocked

    data = {1: np.repeat(np.float32(np.eye(10)), 6, axis=0)}
    blocks = blocked(table(spark, data), "idx", "embedding", 6)
    assert block_pairs(blocks).count() == 55 and block_pairs(blocks, most_angle=0.3).count() == 10
