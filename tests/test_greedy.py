"""Segmentation by search and doubling, and overlaps by sweep, against plain loops and the folds."""

import random

import pytest

from reelspan.operators import intervals, packing

def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


SEG = "rec_id bigint, seg_id bigint, st bigint, en bigint, text string"


def monologue(n, seed=1, recordings=(1,)):
    rng, out = random.Random(seed), []
    for rec in recordings:
        t = 0
        for i in range(n):
            length = rng.choice([100, 900, 4000, 31_000])
            out.append((rec, i, t, t + length, "x" * rng.choice([1, 7, 60, 300, 900])))
            t += length + rng.choice([0, 10, 400, 400, 1200, 1600] if rec else [0, 10])
    return out


def plain_paragraphs(data, gap=1500, most=700):
    out, now = [], None
    for rec, _, st, en, text in data:
        if now and now[0] == rec and st - now[2] <= gap and now[4] <= most:
            now = (rec, now[1], en, now[3] + " " + text, now[4] + len(text))
            out[-1] = now
        else:
            now = (rec, st, en, text, len(text))
            out.append(now)
    return sorted(p[:4] for p in out)


def plain_windows(data, most=30_000, gap=1000):
    out, now = [], None
    for rec, a, b in sorted((r, x, min(x + most, en)) for r, _, st, en, _ in data for x in range(st, en, most)):
        if now and now[0] == rec and a - now[2] < gap and b - now[1] <= most:
            now = (rec, now[1], b)
            out[-1] = now
        else:
            now = (rec, a, b)
            out.append(now)
    return sorted(out)


@pytest.mark.parametrize("fold_rows", [1, 40, 4096])
def test_any_length_equals_the_fold(spark, monkeypatch, fold_rows):
    """One row at most per fold: all by doubling; 40: both ways beside each other."""
    monkeypatch.setattr(packing, "FOLD_ROWS", fold_rows)
    data = monologue(300, recordings=(0, 1, 2)) + [(9, 0, 0, 50, "alone")]
    df = spark.createDataFrame(data, SEG).repartition(3)
    assert rows(packing.paragraphs(df), "rec_id", "st", "en", "text") == plain_paragraphs(data)
    assert rows(packing.pack_windows(df), "rec_id", "st", "en") == plain_windows(data)
    for out, number in ((packing.paragraphs(df), "par_no"), (packing.pack_windows(df), "win_no")):
        per = {}
        for r in sorted(out.collect(), key=lambda r: (r.rec_id, r.st)):
            per.setdefault(r.rec_id, []).append(r[number])
        assert all(v == list(range(1, len(v) + 1)) for v in per.values())


def test_overlapping_spans_in_long_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "FOLD_ROWS", 1)
    rng = random.Random(3)
    data = [(1, i, st, st + rng.randrange(1, 45_000), "x") for i, st in enumerate(sorted(rng.randrange(200_000) for _ in range(120)))]
    assert rows(packing.pack_windows(spark.createDataFrame(data, SEG)), "rec_id", "st", "en") == plain_windows(data)
    assert packing.pack_windows(spark.createDataFrame([], SEG)).count() == packing.paragraphs(spark.createDataFrame([], SEG)).count() == 0


def test_a_monologue_without_a_pause(spark):
    """Thousands of rows in one island, beyond what a fold may hold."""
    data = monologue(packing.FOLD_ROWS + 900, recordings=(0,))
    assert rows(packing.paragraphs(spark.createDataFrame(data, SEG)), "rec_id", "st", "en", "text") == plain_paragraphs(data)


@pytest.mark.parametrize("bin_ms", [1, 50, 600_000])
def test_overlap_by_sweep(spark, bin_ms):
    rng = random.Random(5)
    span = lambda n, w: [(rng.randrange(3), i, a, a + rng.randrange(-3, w)) for i, a in enumerate(rng.choices(range(-100, 1000), k=n))]
    spans, others = span(60, 200), span(80, 90)
    others += [(1, 100 + i, 10, 400) for i in range(40)]  # overlap each other
    df = lambda x: spark.createDataFrame(x, "rec_id bigint, k bigint, st bigint, en bigint")
    got = {(r.rec_id, r.k): r.overlap for r in intervals.overlap_ms(df(spans), df(others), "k", bin_ms).collect()}
    want = {(r, k): sum(max(0, min(b, d) - max(a, c)) for o, _, c, d in others if o == r and d > c) if b > a else 0 for r, k, a, b in spans}
    assert got == want and sum(want.values()) > 1000
    plan = intervals.overlap_ms(df(spans), df(others), "k")._jdf.queryExecution().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlap_ms(df(spans), df([]), "k").agg({"overlap": "sum"}).first()[0] == 0
