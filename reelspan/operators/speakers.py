"""Speakers: attribution by overlap, relabelling, totals, turns, chunks and clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.tolerant import span_length
from reelspan.operators.blocks import BLOCK, block_pairs, blocked, over_pairs
from reelspan.operators.intervals import BIN_MS, measure_until, overlap_pairs
from reelspan.operators.linkage import long_clusters
from reelspan.shared import materialise

#: Chunks up to which a recording is clustered in one task.
IN_TASK = 256
#: Speakers of a recording up to which overlaps are swept speaker by speaker.
SWEPT = 32
TURN_GAP_MS, CHUNK_MS, CHUNK_LEAST_MS = 400, 4000, 600


def assign_speakers(segments: DataFrame, turns: DataFrame, bin_ms: int | None = BIN_MS, rec: str = "rec_id") -> DataFrame:
    """Give each segment the speaker whose turns overlap it longest; ties go to the first name.

    Segments that no turn overlaps keep the speaker they have.
    """
    summed = _heard(segments.select(rec, "seg_id", "st", "en"), turns.select(rec, "st", "en", "speaker"), bin_ms, rec)
    # The greatest overlap, and of those the least name.
    best = summed.groupBy(rec, "seg_id").agg(F.max("overlap").alias("_most"), F.min_by("r_speaker", F.struct(-F.col("overlap"), F.col("r_speaker"))).alias("_speaker"))
    kept = F.col("speaker") if "speaker" in segments.columns else F.lit(None).cast("string")
    return segments.join(best, [rec, "seg_id"], "left").withColumn("speaker", F.coalesce("_speaker", kept)).drop("_most", "_speaker")


def _heard(segments: DataFrame, turns: DataFrame, bin_ms: int | None, rec: str) -> DataFrame:
    """(rec, seg_id, r_speaker, overlap): milliseconds of each speaker's turns in each segment, where there are any.

    A sweep over each speaker's turns, so the rows are segments times speakers, however many turns overlap.
    Recordings of over ``SWEPT`` speakers pair segments with turns.
    """
    segments, turns = segments.filter("en > st"), turns.filter("en > st")
    names = turns.select(rec, "speaker").distinct()
    counts = names.groupBy(rec).count()
    many = counts.filter(F.col("count") > SWEPT).select(rec)
    if (counts.agg(F.max("count")).first()[0] or 0) <= SWEPT:
        return _swept(segments, turns, names, rec)
    pairs = overlap_pairs(segments.join(many, rec, "left_semi"), turns.join(many, rec, "left_semi"), bin_ms, rec)
    paired = pairs.groupBy(rec, "seg_id", "r_speaker").agg(F.sum("overlap").alias("overlap"))
    few = lambda df: df.join(many, rec, "left_anti")
    return _swept(few(segments), few(turns), few(names), rec).unionByName(paired)


def _swept(segments: DataFrame, turns: DataFrame, names: DataFrame, rec: str) -> DataFrame:
    of = F.struct(rec, "speaker").alias("_of")
    ends = F.inline(F.array(*[F.struct(F.col(at).alias("t"), F.lit(sign).alias("_sign")) for at, sign in (("st", -1), ("en", 1))]))
    until = measure_until(segments.join(names, rec).select(of, "seg_id", ends), turns.select(of, "st", "en"), rec="_of")
    # Both ends of a segment meet once, where its speakers are compared too.
    rows = until.select(F.col("_of")[rec].alias(rec), "seg_id", F.col("_of")["speaker"].alias("r_speaker"), (F.col("measure") * F.col("_sign")).alias("ms")).repartition(rec, "seg_id")
    return rows.groupBy(rec, "seg_id", "r_speaker").agg(F.sum("ms").alias("overlap")).filter("overlap > 0")


def renumber_speakers(segments: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Rename speakers SPEAKER_00, SPEAKER_01, ... by first appearance in segment order."""
    first = segments.filter(F.coalesce("speaker", F.lit("")) != "").groupBy(rec, "speaker").agg(F.min("seg_id").alias("_first"))
    place = F.row_number().over(Window.partitionBy(rec).orderBy("_first", "speaker")) - 1
    names = first.select(rec, "speaker", F.format_string("SPEAKER_%02d", place).alias("_name"))
    return segments.join(names, [rec, "speaker"], "left").withColumn("speaker", F.coalesce("_name", "speaker")).drop("_name")


def speaker_stats(segments: DataFrame, rec: str = "rec_id") -> DataFrame:
    """seconds, share of the labelled speech, segments and rank (longest first, then by name) of each speaker."""
    summed = segments.filter("speaker is not null").groupBy(rec, "speaker").agg(F.sum(span_length()).alias("ms"), F.count("*").alias("segments"))
    total = F.sum("ms").over(Window.partitionBy(rec))
    rows = summed.select(
        rec, "speaker", F.round(F.col("ms") / 1000.0, 3).alias("seconds"), F.round(F.col("ms") / F.when(total == 0, 1000).otherwise(total), 4).alias("ratio"), "segments"
    )
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(rec).orderBy(F.desc("seconds"), "speaker")))


def merge_turns(turns: DataFrame, gap_ms: int = TURN_GAP_MS, rec: str = "rec_id") -> DataFrame:
    """Join consecutive turns of one speaker whose pause is at most ``gap_ms``; another speaker's turn breaks a run."""
    order = Window.partitionBy(rec).orderBy("st", "turn_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    changed = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(order)), 0).otherwise(1)
    in_runs = turns.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(so_far))
    within = Window.partitionBy(rec, "_run").orderBy("st", "turn_idx")
    most = F.max("en").over(within.rowsBetween(Window.unboundedPreceding, -1))
    cut = in_runs.withColumn("_most", most).withColumn("_b", F.when(F.col("st") > F.col("_most") + gap_ms, 1).otherwise(0))
    cut = cut.withColumn("_island", F.sum("_b").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(rec, "_run", "_island", "speaker").agg(F.min("st").alias("st"), F.max("en").alias("en")).drop("_run", "_island")


def chunk_segments(segments: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Equal pieces of at most 4 s of every segment of 0.6 s or more."""
    long = segments.select(rec, "seg_id", "st", "en", span_length().alias("_len")).filter(F.col("_len") >= CHUNK_LEAST_MS)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_len") / CHUNK_MS)).cast("bigint")
    rows = long.withColumn("_n", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    at = lambda k: F.col("st") + F.expr(f"(_len * ({k})) div _n")
    return rows.select(rec, "seg_id", "piece", at("piece").alias("chunk_st"), F.least(F.col("en"), at("piece + 1")).alias("chunk_en"))


def cosine_pairs(chunks: DataFrame, within: float | None = None, rec: str = "rec_id", block: int = BLOCK) -> DataFrame:
    """Cosine distance (rec, i, j, distance) of the pairs of chunks (rec, idx, embedding) of a recording; norms are at least 1e-9.

    Pairs of blocks are multiplied in Arrow batches. With ``within`` only pairs at most so far apart are returned,
    and pairs of blocks that can't hold any are left out by their directions and widths.
    """

    def each(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        apart = 1.0 - np.clip(a @ b.T, -1.0, 1.0)
        wanted = np.triu(np.ones(apart.shape, dtype=bool), 1) if same else np.ones(apart.shape, dtype=bool)
        i, j = np.nonzero(wanted if within is None else wanted & (apart <= within))
        return {"i": ids_a[i], "j": ids_b[j], "distance": apart[i, j]}

    pairs = block_pairs(blocked(chunks, "idx", "embedding", block, rec), rec, None if within is None else float(np.arccos(np.clip(1 - within, -1, 1))))
    kind = chunks.schema["idx"].dataType
    made = over_pairs(pairs, each, "i bigint, j bigint, distance double", rec)
    return made.select(rec, F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "distance")


def average_linkage(vectors: np.ndarray, threshold: float, target: int | None, least: int, most: int | None) -> list[int]:
    """Cluster label of each vector, numbered by smallest member.

    The two nearest clusters merge, ties by lowest pair, until ``target`` clusters are left;
    without one, until the distance is over ``threshold`` and no more than ``most`` are left,
    or ``least`` are. Distances to a merged cluster are means weighted by size.
    """
    n = len(vectors)
    if n < 2:
        return [0] * n
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    apart = 1.0 - np.clip(unit @ unit.T, -1.0, 1.0)
    apart[np.tril_indices(n)] = np.inf
    sizes, alive, member = np.ones(n), n, np.arange(n)
    while alive > (target or max(1, least)):
        i, j = divmod(int(np.argmin(apart)), n)
        if target is None and apart[i, j] > threshold and (most is None or alive <= most):
            break
        to_i, to_j = np.minimum(apart[i], apart[:, i]), np.minimum(apart[j], apart[:, j])
        joined = (sizes[i] * to_i + sizes[j] * to_j) / (sizes[i] + sizes[j])
        joined[i] = joined[j] = np.inf
        apart[:i, i], apart[i, i + 1 :] = joined[:i], joined[i + 1 :]
        apart[j, :], apart[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        member[member == j] = i
        alive -= 1
    order: dict[int, int] = {}
    return [order.setdefault(int(m), len(order)) for m in member]


def cluster_chunks(
    chunks: DataFrame, threshold: float = 0.30, target: int | None = None, least: int = 1, most: int | None = 8, rec: str = "rec_id"
) -> DataFrame:
    """Cluster the chunks (rec, idx, embedding) of each recording; recordings run side by side.

    Recordings of up to ``IN_TASK`` chunks are clustered in a task each; longer ones in rounds over
    blocks that spread over tasks, with the same result (``linkage``).
    """
    kinds = dict(chunks.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        return pd.DataFrame({rec: rows[rec], "idx": rows["idx"], "cluster": average_linkage(vectors, threshold, target, least, most)})

    wanted = chunks.select(rec, "idx", "embedding")
    sizes = materialise(wanted.groupBy(rec).agg(F.count("*").alias("_n")), "sizes")
    long = sizes.filter(F.col("_n") > IN_TASK).select(rec)
    short = wanted.join(long, rec, "left_anti").groupBy(rec).applyInPandas(run, f"{rec} {kinds[rec]}, idx {kinds['idx']}, cluster int")
    if long.isEmpty():
        return short
    return short.unionByName(long_clusters(wanted.join(long, rec, "left_semi"), threshold, target, least, most, rec, BLOCK))


def chunk_turns(chunks: DataFrame, clusters: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Turns of clustered chunks: consecutive chunks of one cluster merge."""
    rows = chunks.join(clusters, [rec, "idx"]).select(rec, F.col("idx").alias("turn_idx"), "st", "en", F.format_string("SPEAKER_%02d", "cluster").alias("speaker"))
    return merge_turns(rows, rec=rec)

