from helpers import rows

from reelspan.operators import intervals
from reelspan.schemas import SPANS


def spans(spark, *items):
    return spark.createDataFrame([(1, int(a * 1000), int(b * 1000)) for a, b in items], SPANS)


def recordings(spark, seconds):
    return spark.createDataFrame([(1, None if seconds is None else int(seconds * 1000))], "rec_id bigint, duration bigint")


def seconds(df):
    return [(a / 1000, b / 1000) for a, b in rows(df, "st", "en")]


def test_union_merges_touching_and_drops_empty(spark):
    assert seconds(intervals.merge_spans(spans(spark, (0, 5), (4, 8), (20, 22), (9, 9)))) == [(0, 8), (20, 22)]


def test_complement(spark):
    merged = intervals.merge_spans(spans(spark, (2, 5)))
    assert seconds(intervals.gap_complement(merged, recordings(spark, 10))) == [(0, 2), (5, 10)]
    empty = intervals.merge_spans(spans(spark))
    assert seconds(intervals.gap_complement(empty, recordings(spark, 10))) == [(0, 10)]
    full = intervals.merge_spans(spans(spark, (0, 10)))
    assert seconds(intervals.gap_complement(full, recordings(spark, 10))) == []


def test_overlap_with_and_without_bins(spark):
    left = spans(spark, (0, 100)).selectExpr("rec_id", "7 as seg_id", "st", "en")
    for bins in (1, 1000, 30_000):
        out = intervals.overlap_ms(left, spans(spark, (2, 4), (80, 200), (500, 600)), "seg_id", bins)
        assert rows(out, "overlap") == [(22_000,)]
        assert rows(intervals.overlap_ms(left, spans(spark, (150, 160)), "seg_id", bins), "overlap") == [(0,)]


def coverage(spark, segments, silences, duration):
    return intervals.coverage_summary(spans(spark, *segments), spans(spark, *silences), recordings(spark, duration)).first()


def test_coverage(spark):
    c = coverage(spark, [(0, 10), (80, 90)], [], 90)
    assert (c.ratio, c.n_gaps, c.gap_seconds, c.low_coverage) == (0.2222, 1, 70.0, True)
    assert [(g.st, g.en) for g in c.gaps] == [(10.0, 80.0)]


def test_silent_gaps_do_not_count(spark):
    assert coverage(spark, [(0, 10), (80, 90)], [(10, 80)], 90).n_gaps == 0
    assert coverage(spark, [(0, 10), (80, 90)], [(10, 40)], 90).n_gaps == 1


def test_short_pauses_overlaps_and_unknown_duration(spark):
    assert coverage(spark, [(0, 10), (10.8, 20)], [], 20).n_gaps == 0
    c = coverage(spark, [(0, 20), (15, 30)], [], 30)
    assert (c.covered_seconds, c.ratio) == (30.0, 1.0)
    c = coverage(spark, [(0, 20)], [], None)
    assert (c.analyzed, c.reason is not None) == (False, True)


def test_open_silence_ends_with_the_recording(spark):
    log = "x silence_start: -0.5\nsilence_end: 2.25 | y\nsilence_start: 9.5"
    logs = spark.createDataFrame([(1, log, 12_000), (2, log, None)], "rec_id bigint, log string, duration bigint")
    assert rows(intervals.pair_silences(logs), "rec_id", "st", "en") == [(1, 0, 2250), (1, 9500, 12_000), (2, 0, 2250)]
