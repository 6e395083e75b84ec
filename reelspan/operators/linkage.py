"""Average-linkage clustering of recordings of any length, in rounds of reciprocal nearest neighbours.

With S and n the sum and the number of a cluster's unit vectors, the mean cosine distance between
clusters is 1 - S_a S_b / (n_a n_b), so a cluster is one row. Average linkage never brings two clusters closer by
merging others, so any two that are each other's nearest may merge at once, in whatever order: the tree
of merges is the same as one by one. Each round finds every cluster's nearest by pairs of blocks, merges
the reciprocal ones, and is written to the shared folder. Once a recording has few clusters left (``FINISH``), one
task makes the rest of its merges. The merges of least height that the stopping rule asks for
are then applied, by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.blocks import block_pairs, blocked, over_pairs, unit
from reelspan.shared import materialise

#: Digits of a distance that count, so that sums in another order give the same ties.
DIGITS = 12
#: Clusters left of a recording from which on its merges are made in one task.
FINISH = 2048


def mean_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between clusters whose mean unit vectors are rows of ``a`` and ``b``."""
    return np.round(1.0 - np.clip(a @ b.T, -1.0, 1.0), DIGITS)


def nearest_in(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, same: bool) -> dict[str, np.ndarray]:
    """Each row's nearest in the other block, ties to the smaller id; ids ascend within a block."""
    d = mean_distances(a, b)
    if same:
        np.fill_diagonal(d, np.inf)
    j, i = d.argmin(axis=1), d.argmin(axis=0)
    first = {"id": ids_a, "d": d[np.arange(len(a)), j], "other": ids_b[j]}
    if same:
        keep = np.isfinite(first["d"])
        return {k: v[keep] for k, v in first.items()}
    second = {"id": ids_b, "d": d[i, np.arange(len(b))], "other": ids_a[i]}
    return {k: np.concatenate([first[k], second[k]]) for k in first}


def merge_all(means: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges (keep, gone, distance) of clusters, the nearest two first, ties to the lowest pair."""
    n, sizes = len(means), sizes.astype(np.float64)
    apart = mean_distances(means, means)
    apart[np.tril_indices(n)] = np.inf
    merges = []
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(apart)), n)
        merges.append((i, j, float(apart[i, j])))
        to_i, to_j = np.minimum(apart[i], apart[:, i]), np.minimum(apart[j], apart[:, j])
        joined = np.round((sizes[i] * to_i + sizes[j] * to_j) / (sizes[i] + sizes[j]), DIGITS)
        joined[i] = joined[j] = np.inf
        apart[:i, i], apart[i, i + 1 :] = joined[:i], joined[i + 1 :]
        apart[j, :], apart[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
    return merges


def wanted_merges(rec: str, progress: DataFrame, threshold: float, target: int | None, least: int, most: int | None) -> DataFrame:
    """(rec, wanted): how many merges the rule asks for, given (rec, n, under): chunks, and merges of at most ``threshold``."""
    n, under = F.col("n"), F.col("under")
    if target:
        asked = n - target
    else:
        asked = F.least(F.greatest(under, n - most if most is not None else F.lit(0)), n - max(1, least))
    return progress.withColumn("wanted", F.greatest(F.lit(0), F.least(asked, n - 1)).cast("bigint"))


def merge_tree(chunks: DataFrame, threshold: float, target: int | None, least: int, most: int | None, rec: str, block: int, finish: int = FINISH) -> tuple[DataFrame, DataFrame]:
    """(rec, id) of the chunks, and merges (rec, keep, gone, d, round): at least the lowest that the rule asks for."""
    start = chunks.select(rec, F.col("idx").cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("n"), F.col("embedding").cast("array<double>").alias("sum"))

    def to_unit(batches):
        import pyarrow as pa

        for batch in batches:
            sums = [unit(np.array([v or [0.0]], dtype=np.float64))[0].tolist() for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(sums, pa.list_(pa.float64()))], names=batch.schema.names)

    clusters = materialise(start.mapInArrow(to_unit, start.schema), "clusters")
    chunks_of, kind = clusters.groupBy(rec).agg(F.count("*").alias("n")), chunks.schema[rec].dataType.simpleString()
    merge_schema = f"{rec} {kind}, keep bigint, gone bigint, d double, round int"
    merges = chunks.sparkSession.createDataFrame([], merge_schema)
    ids, going, number = clusters.select(rec, "id"), clusters, 0

    def rest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        found, sizes = rows["id"].to_numpy(), rows["n"].to_numpy()
        made = merge_all(np.stack(rows["sum"].to_numpy()) / sizes[:, None], sizes)
        first = int(rows["_round"].iloc[0])
        return pd.DataFrame({rec: rows[rec].iloc[0], "keep": [found[i] for i, _, _ in made], "gone": [found[j] for _, j, _ in made], "d": [d for _, _, d in made], "round": range(first, first + len(made))})

    while not going.isEmpty():
        few = materialise(going.groupBy(rec).count().filter(F.col("count") <= finish).select(rec), "few")
        if not few.isEmpty():
            ended = going.join(few, rec, "left_semi").withColumn("_round", F.lit(number)).groupBy(rec).applyInPandas(rest, merge_schema)
            merges = materialise(merges.unionByName(ended), "merges")
            going = materialise(going.join(few, rec, "left_anti"), "clusters")
            if going.isEmpty():
                break
        means = going.select(rec, "id", F.transform("sum", lambda x: x / F.col("n")).alias("mean"))
        pairs = block_pairs(blocked(means, "id", "mean", block, rec, normed=False), rec)
        found = over_pairs(pairs, nearest_in, "id bigint, d double, other bigint", rec)
        near = materialise(found.groupBy(rec, "id").agg(F.min(F.struct("d", "other")).alias("m")).select(rec, "id", "m.d", "m.other"), "nearest")
        # Recordings of which all merges that are asked for are among those made: none that is still to come is lower than the least distance now.
        floor = near.groupBy(rec).agg(F.min("d").alias("floor"))
        made = merges.join(floor, rec).groupBy(rec).agg(F.count_if(F.col("d") <= F.col("floor")).alias("sure"), F.count_if(F.col("d") <= threshold).alias("under"))
        state = floor.join(chunks_of, rec).join(made, rec, "left").select(rec, "floor", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sure", "under")])
        state = wanted_merges(rec, state, threshold, target, least, most)
        open_now = F.lit(False) if target else F.col("floor") <= threshold
        active = materialise(state.filter(open_now | (F.col("sure") < F.col("wanted"))).select(rec), "active")
        near = near.join(active, rec, "left_semi")
        back = near.select(rec, F.col("id").alias("other"), F.col("other").alias("id"))
        joined = materialise(near.join(back, [rec, "id", "other"]).filter("id < other").select(rec, F.col("id").alias("keep"), F.col("other").alias("gone"), "d", F.lit(number).alias("round")), "joined")
        merges = materialise(merges.unionByName(joined), "merges")
        gone = going.join(joined, (going[rec] == joined[rec]) & (going["id"] == joined["gone"])).select(joined[rec], F.col("keep").alias("id"), F.col("n").alias("m"), F.col("sum").alias("more"))
        left = going.join(active, rec, "left_semi").join(joined.select(rec, F.col("gone").alias("id")), [rec, "id"], "left_anti")
        grown = left.join(gone, [rec, "id"], "left")
        total = F.when(F.col("m").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "more", lambda x, y: x + y))
        going = materialise(grown.select(rec, "id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), total.alias("sum")), "clusters")
        number += 1
    return ids, merges


def roots(ids: DataFrame, links: DataFrame, rec: str) -> DataFrame:
    """(rec, id, root): where the links (rec, gone, keep) of each id end; an id has one at most, to a smaller one."""
    up = ids.join(links.select(rec, F.col("gone").alias("id"), F.col("keep").alias("root")), [rec, "id"], "left")
    up = materialise(up.select(rec, "id", F.coalesce("root", "id").alias("root")), "roots")
    while True:
        higher = up.select(rec, F.col("id").alias("root"), F.col("root").alias("top"))
        now = materialise(up.join(higher, [rec, "root"]).select(rec, "id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "roots")
        up = now.drop("moved")
        if now.filter("moved").isEmpty():
            return up


def long_clusters(chunks: DataFrame, threshold: float, target: int | None, least: int, most: int | None, rec: str = "rec_id", block: int = 1024, finish: int = FINISH) -> DataFrame:
    """(rec, idx, cluster) as ``speakers.average_linkage`` gives, for recordings of any length."""
    ids, merges = merge_tree(chunks, threshold, target, least, most, rec, block, finish)
    sizes = ids.groupBy(rec).agg(F.count("*").alias("n"))
    under = merges.groupBy(rec).agg(F.count_if(F.col("d") <= threshold).alias("under"))
    wanted = wanted_merges(rec, sizes.join(under, rec, "left").withColumn("under", F.coalesce("under", F.lit(0))), threshold, target, least, most)
    place = F.row_number().over(Window.partitionBy(rec).orderBy("d", "round", "keep"))
    applied = merges.withColumn("_place", place).join(wanted.select(rec, "wanted"), rec).filter("_place <= wanted")
    found = roots(ids, applied, rec)
    # A root is its cluster's smallest member.
    return found.select(rec, F.col("id").cast(chunks.schema["idx"].dataType).alias("idx"), (F.dense_rank().over(Window.partitionBy(rec).orderBy("root")) - 1).alias("cluster"))
