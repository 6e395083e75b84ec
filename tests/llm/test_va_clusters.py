"""Clusters over cells against plain rounds in Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import va_clusters
from reelspan.llm.va_clusters import Grid, Intervals, cluster_vectors, nearest

SCHEMA = "vec_id bigint, embedding array<float>"
def order():
    return F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)


def plain(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[0], []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else centroids[c] for c in range(len(centroids))]
    out = [(i, *near(v)) for i, v in kept]
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in out], key=str)


def got(spark, rows, **how):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("cluster", F.lit("clash")).withColumn("row", F.lit(1))
    return sorted((tuple(r) for r in cluster_vectors(table, order(), **how).collect()), key=str)


def fixture(dims, n=260):
    rng = random.Random(4)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(n)]
    same = [0.25] * dims
    odd = [(900, None), (901, [1.0]), (902, []), (903, [None] * dims), (904, [math.nan] * dims), (905, [math.inf] * dims), (None, rows[0][1]), (7, rows[7][1]), (7, rows[9][1])]
    return rows + odd + [(1000 + i, same) for i in range(90)]  # a third are copies


@pytest.mark.parametrize("bits", [1, 4])
def test_equals_plain_rounds(spark, bits):
    rows = fixture(8)
    assert got(spark, rows, k=9, rounds=4, dims=8, scale=16, bits=bits) == plain(rows, 9, 4, 8, 16)


def test_few_vectors_and_none(spark):
    assert got(spark, [], dims=3) == []
    assert got(spark, [(1, None)], dims=3) == []
    few = [(1, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5]), (3, [9.0, -3.0, 0.0])]
    assert got(spark, few, dims=3, k=5) == plain(few, 5, 5, 3, 256)


def test_wide_components(spark):
    wide = [(i, [(-1) ** i * 200_000.0 + i, 3.0]) for i in range(9)]
    assert got(spark, wide, dims=2, k=3) == plain(wide, 3, 5, 2, 256)
    with pytest.raises(Exception, match="too large for exact"):
        got(spark, [(1, [1e7, 0.0])], dims=2)


def test_intervals_hold_and_leave_the_nearest():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-90, 90, (400, 12)), rng.integers(-90, 90, (15, 12))
    for bits in (1, 3, 6):
        grid = Grid(v.min(axis=0), -(-(np.ptp(v, axis=0) + 1) // (1 << bits)), bits)
        cells = grid.cells(v)
        assert cells.max() < 1 << bits and (grid.unpack(grid.pack(cells)) == cells).all()
        tables = Intervals(grid, c)
        exact = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (tables.total(tables.lower, cells) <= exact).all() and (exact <= tables.total(tables.upper, cells)).all()
        left = tables.left(cells)
        assert left[np.arange(400), exact.argmin(axis=1)].all()
        assert (nearest(v, c, left)[0] == exact.argmin(axis=1)).all()
    assert (left.sum(axis=1) == 1).mean() > 0.5


def test_decided_vectors_are_not_fetched(spark, monkeypatch):
    fetched = []
    real = va_clusters.changes
    monkeypatch.setattr(va_clusters, "changes", lambda df, *a: (fetched.append(df.count()), real(df, *a))[1])
    rng = random.Random(8)
    rows = [(i, [(i % 5) * 4 + rng.gauss(0, 0.05) for _ in range(6)]) for i in range(300)]
    assert got(spark, rows, k=5, rounds=4, dims=6, bits=6) == plain(rows, 5, 4, 6, 256)
    assert fetched and min(fetched) < 100
