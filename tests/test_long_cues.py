"""Cues of segments with very many words: the work grows with the words, not with their square."""

import time

import pytest

from reelspan.operators import packing

N = 10_000
SCHEMA = "rec_id int, seg_id bigint, st bigint, en bigint, text string, speaker string, words array<struct<word:string,st:bigint,en:bigint,probability:double>>"


def plain(words, length, least=0, most=2000, room=60):
    """Groups of words by characters and pace, timed by words."""
    pace, groups = max(1, most * len(words) // length), []
    for w in words:
        if not groups or sum(len(x) + 1 for x in groups[-1]) + len(w) + 1 > room or len(groups[-1]) >= pace:
            groups.append([])
        groups[-1].append(w)
    out, used = [], 0
    for g in groups:
        out.append((length * used // len(words), length * (used + len(g)) // len(words), " ".join(g)))
        used += len(g)
    return out


@pytest.mark.parametrize("timed", [False, True])
def test_one_segment_of_many_words(spark, timed):
    words = [f"w{i}" for i in range(N)]
    times = [(w, 400 * i, 400 * i + 400, None) for i, w in enumerate(words)] if timed else None
    rows = spark.createDataFrame([(1, 0, 0, 400 * N, " ".join(words), None, times)], SCHEMA)
    packing.build_cues(rows.limit(0), "curta").collect()
    began = time.monotonic()
    found = packing.build_cues(rows, "curta").orderBy("cue_no").collect()
    assert time.monotonic() - began < 60
    assert [(r.st, r.en, r.text) for r in found] == plain(words, 400 * N)


def test_subtitles_of_a_segment_of_many_words(spark):
    words = [f"w{i}" if i % 50 else f"meio-termo{i}" for i in range(N)]
    rows = spark.createDataFrame([(1, 0, 0, 400 * N, " ".join(words), None, None)], SCHEMA)
    began = time.monotonic()
    (found,) = packing.subtitle_text(packing.build_cues(rows)).collect()
    assert time.monotonic() - began < 60
    blocks = found.content.split("\n\n")
    assert len(blocks) == found.n_cues == len(plain(words, 400 * N, most=8000, room=84))
    # A word broken at its hyphen is whole again once its lines are joined.
    assert " ".join(" ".join(b.strip("\n").split("\n")[2:]) for b in blocks).replace("- ", "-").split() == words
