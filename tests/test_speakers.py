import random

import numpy as np
from helpers import rows

from reelspan.operators import align, speakers


def segments(spark, items, speaker=None):
    data = [(1, i, int(a * 1000), int(b * 1000), "x", s) for i, (a, b, s) in enumerate(items)]
    return spark.createDataFrame(data, "rec_id bigint, seg_id bigint, st bigint, en bigint, text string, speaker string")


def turns(spark, items):
    return spark.createDataFrame([(1, i, int(a * 1000), int(b * 1000), s) for i, (s, a, b) in enumerate(items)], "rec_id bigint, turn_idx bigint, st bigint, en bigint, speaker string")


def test_longest_overlap_wins(spark):
    seg = segments(spark, [(0, 4, None), (4, 8, None), (8, 12, None), (50, 51, "kept")])
    out = speakers.assign_speakers(seg, turns(spark, [("A", 0, 3.9), ("B", 3.9, 7.5), ("A", 7.5, 12)]))
    assert rows(out, "seg_id", "speaker") == [(0, "A"), (1, "B"), (2, "A"), (3, "kept")]


def test_ties_go_to_the_first_name(spark):
    out = speakers.assign_speakers(segments(spark, [(0, 4, None)]), turns(spark, [("B", 0, 2), ("A", 2, 4)]))
    assert rows(out, "speaker") == [("A",)]


def test_renumber_by_appearance(spark):
    out = speakers.renumber_speakers(segments(spark, [(0, 1, "02"), (1, 2, "07"), (2, 3, "02"), (3, 4, None)]))
    assert rows(out, "seg_id", "speaker") == [(0, "SPEAKER_00"), (1, "SPEAKER_01"), (2, "SPEAKER_00"), (3, None)]


def test_speaker_stats(spark):
    out = speakers.speaker_stats(segments(spark, [(0, 5, "00"), (5, 9, "01"), (9, 12, "00")]))
    assert rows(out, "rank", "speaker", "seconds", "ratio", "segments") == [(1, "00", 8.0, 0.6667, 2), (2, "01", 4.0, 0.3333, 1)]


def test_merge_turns(spark):
    out = speakers.merge_turns(turns(spark, [("A", 0, 2), ("A", 2.1, 4), ("B", 4, 6), ("A", 6, 7), ("A", 8, 9)]))
    assert rows(out, "speaker", "st", "en") == [("A", 0, 4000), ("A", 6000, 7000), ("A", 8000, 9000), ("B", 4000, 6000)]


def test_chunks(spark):
    out = speakers.chunk_segments(segments(spark, [(0, 0.3, None), (1, 13, None)]))
    assert rows(out, "seg_id", "piece", "chunk_st", "chunk_en") == [(1, 0, 1000, 5000), (1, 1, 5000, 9000), (1, 2, 9000, 13_000)]


def test_clustering(spark):
    two = [[1.0, 0.0, 0.01], [0.99, 0.05, 0.0], [0.0, 1.0, 0.02], [0.02, 1.0, 0.0], [1.0, 0.02, 0.0]]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(two)] + [(2, 0, [1.0, 0.0, 0.0])], "rec_id bigint, idx int, embedding array<float>")
    assert rows(speakers.cluster_chunks(df), "rec_id", "idx", "cluster") == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 0), (2, 0, 0)]
    assert {r[0] for r in rows(speakers.cluster_chunks(df, target=1), "cluster")} == {0}


def slow_linkage(vectors, threshold):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    apart = 1 - unit @ unit.T
    clusters = [[i] for i in range(len(vectors))]
    while len(clusters) > 1:
        best = min(((apart[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j))
        if best[0] > threshold:
            break
        clusters[best[1]] += clusters.pop(best[2])
    label = {i: k for k, c in enumerate(sorted(clusters, key=min)) for i in c}
    return [label[i] for i in range(len(vectors))]


def test_linkage_against_rescans():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v = rng.normal(size=(12, 4))
        assert speakers.average_linkage(v, 0.8, None, 1, None) == slow_linkage(v, 0.8)


def test_trim_to_words(spark):
    seg = segments(spark, [(0, 3, None), (0, 6, None), (0, 30, None)])
    words = [(0, 0, 1200, 1600), (0, 1, 1600, 2400), (1, 0, 1200, 1600), (1, 1, 1600, 2400), (2, 0, 20_000, 20_400)]
    w = spark.createDataFrame([(1, s, i, a, b) for s, i, a, b in words], "rec_id bigint, seg_id bigint, word_idx int, st bigint, en bigint")
    assert rows(align.align_trim(seg, w), "seg_id", "st", "en") == [(0, 1200, 2400), (1, 1200, 6000), (2, 0, 30_000)]


def test_remove_overlaps(spark):
    out = align.align_overlaps(segments(spark, [(0, 5, None), (4, 9, None), (8.95, 9.01, None)]))
    assert rows(out, "seg_id", "st", "en") == [(0, 0, 5000), (1, 5000, 9000), (2, 8950, 9010)]


def test_few_speakers_are_swept_and_many_are_paired(spark, monkeypatch):
    rng = random.Random(7)
    spans = lambda n: [(r, i, a, a + rng.randrange(0, 90_000)) for r in (1, 2) for i in range(n) for a in [rng.randrange(1_500_000)]]
    segments = spark.createDataFrame(spans(60), "rec_id bigint, seg_id bigint, st bigint, en bigint")
    # Four speakers in the first recording, forty in the second.
    turns = spark.createDataFrame([(r, a, b, f"S{i % (4 if r == 1 else 40)}") for r, i, a, b in spans(80)], "rec_id bigint, st bigint, en bigint, speaker string")
    found = lambda s, t: sorted(map(tuple, speakers.assign_speakers(s, t).select("rec_id", "seg_id", "speaker").collect()), key=str)
    both = found(segments, turns)
    with monkeypatch.context() as m:
        m.setattr(speakers, "SWEPT", 0)
        assert both == found(segments, turns)
    # No pairs are formed where speakers are few.
    monkeypatch.setattr(speakers, "overlap_pairs", None)
    first = segments.filter("rec_id = 1"), turns.filter("rec_id = 1")
    assert found(*first) == [r for r in both if r[0] == 1]
