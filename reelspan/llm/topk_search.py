"""Exact top-k inner products by norm buckets.

Vectors are grouped by length into buckets. Every query first meets a fixed number of the
longest vectors, which bounds its k-th score from below. That bound, over the product of
the query's length and a bucket's greatest length, is the cosine a vector of the bucket must
reach. Above 1, the bucket can't hold a result and the query never travels there. When it is
high, a few of the query's largest coordinates confine where a vector's coordinates may lie
(coordinate pruning); else vectors too short to reach the bound are cut off (length
pruning). What remains is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.llm.common import materialise

BUCKETS = 32
BLOCK_ROWS = 8_192
SEED_ROWS = 1_024
#: Cosine from which coordinates prune better than lengths, and how many of them are used.
COORDINATE_FROM, FOCUS = 0.6, 3
RESULT_SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def exact_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where every partial sum is exact in it. An error where one could pass 64 bits."""
    widest = np.abs(queries).max(initial=0).astype(float) * np.abs(vectors).max(initial=0).astype(float) * queries.shape[1]
    if widest < 2.0**52:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if widest >= 2.0**63:
        raise ValueError("components are too large: an inner product could pass 64 bits")
    return queries @ vectors.T


def best(scores: np.ndarray, ids: np.ndarray, k: int, least: float) -> np.ndarray:
    """Positions of the k best scores no lower than ``least``; ties go to smaller ids."""
    at = np.flatnonzero(scores >= least)
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Block:
    """Vectors of one bucket, longest first, ready to be searched."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.unit = np.nan_to_num(self.vectors / self.norms[:, None])

    def confined(self, query: np.ndarray, norm: float, cosine: float) -> np.ndarray:
        """Positions of the vectors whose largest query coordinates allow that cosine."""
        unit, turn = query / norm, np.arccos(min(1.0, cosine))
        alive = np.ones(len(self.ids), dtype=bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + turn)), np.cos(max(0.0, angle - turn))
            alive &= (self.unit[:, f] >= low - 1e-9) & (self.unit[:, f] <= high + 1e-9)
        return np.flatnonzero(alive)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, vector ids, scores): the k best of this block that reach the query's bound."""
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosines = np.where(norms * self.norms[0] > 0, bounds / (norms * self.norms[0]), np.where(bounds > 0, np.inf, -np.inf))
        dense = []
        for i in np.flatnonzero(cosines <= 1 + 1e-9):
            if cosines[i] < COORDINATE_FROM:
                dense.append(i)
                continue
            at = self.confined(queries[i], norms[i], cosines[i])
            at = at[self.ids[at] != query_ids[i]]
            scores = exact_products(queries[i : i + 1], self.vectors[at])[0]
            found = best(scores, self.ids[at], k, bounds[i])
            yield query_ids[i], self.ids[at][found], scores[found]
        if not dense:
            return
        # Lengths fall along the block, so what can reach a bound is a prefix of it.
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where((bounds[dense] > 0) & (norms[dense] > 0), bounds[dense] / norms[dense] * (1 - 1e-9), -1.0)
        reach = np.searchsorted(-self.norms, -needed, side="right")
        scores = exact_products(queries[dense], self.vectors[: reach.max(initial=0)])
        for row, i in enumerate(dense):
            ids = self.ids[: reach[row]]
            at = np.flatnonzero(ids != query_ids[i])
            found = at[best(scores[row, : reach[row]][at], ids[at], k, bounds[i])]
            yield query_ids[i], ids[found], scores[row, found]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long integer lists."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def results(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    queries = np.repeat(np.array([f[0] for f in found], dtype=np.int64), [len(f[1]) for f in found])
    ids, scores = ([np.concatenate([f[k] for f in found])] if found else [np.zeros(0)] for k in (1, 2))
    return pa.RecordBatch.from_arrays(
        [pa.array(queries), pa.array(ids[0].astype(np.int64)), pa.array(scores[0].astype(np.int64))], names=["query_id", "vec_id", "score"]
    )


def norm_of(ints: str) -> Column:
    return F.sqrt(F.aggregate(ints, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def integer_vectors(vectors: DataFrame, is_query: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, is_query, ints (floor(scale * component)), dim and norm of every vector without null or non-finite parts."""
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.filter(whole & F.col(id_col).isNotNull())
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
            F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("ints"),
        )
        .select("id", "is_query", "ints", F.size("ints").alias("dim"), norm_of("ints").alias("norm"))
    )


def topk_inner_products(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For every row for which ``is_query`` holds, the k other rows of highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. Rows whose id is
    null, or whose vector is null, empty, or holds null or non-finite components, take no part.
    Vectors meet only vectors of their own dimension. Rows that repeat an id are candidates
    each but make one query, and no row with a query's id is a result of it. Components so large that
    a product could pass 64 bits raise an error. Other columns are ignored. No rows, or no queries, give no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(integer_vectors(vectors, is_query, scale, id_col, vector_col), "vectors")
    wanted = rows.filter("is_query")
    # Bounds of the buckets: one small array, whatever the number of rows.
    edges = rows.agg(F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 2000).alias("e")).first().e or []
    bucket = F.lit(0)
    for edge in sorted(set(edges)):
        bucket = bucket + F.when(F.col("norm") >= edge, 1).otherwise(0)
    rows = rows.withColumn("bucket", bucket)
    summary = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()  # BUCKETS rows at most
    if not summary:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    parts = {r.bucket: max(1, -(-r.n // BLOCK_ROWS)) for r in summary}
    seeds = rows.orderBy(F.desc("norm"), "id").limit(SEED_ROWS).select("id", "ints", "dim").collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in seeds}:
        own = [r for r in seeds if r.dim == dim]
        by_dim[dim] = np.array([r.id for r in own], dtype=np.int64), np.array([r.ints for r in own], dtype=np.int64)
    shared = spark.sparkContext.broadcast(by_dim)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = np.asarray(batch.column(0)), np.asarray(batch.column(2)), np.full(batch.num_rows, -np.inf)
            for dim in set(dims.tolist()) & set(shared.value):
                at, (seed_ids, seed) = np.flatnonzero(dims == dim), shared.value[dim]
                scores = exact_products(matrix(batch.column(1).take(pa.array(at))), seed).astype(np.float64)
                scores[seed_ids[None, :] == ids[at][:, None]] = -np.inf
                if scores.shape[1] >= k:
                    out[at] = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["id", "ints", "dim", "norm", "bound"])

    bounded = wanted.groupBy("id").agg(F.min("ints").alias("ints")).select("id", "ints", F.size("ints").alias("dim"), norm_of("ints").alias("norm"))
    bounded = bounded.mapInArrow(bound, "id bigint, ints array<bigint>, dim int, norm double, bound double")
    places = F.array(*[F.struct(F.lit(r.bucket).alias("bucket"), F.lit(parts[r.bucket]).alias("parts"), F.lit(r.longest).alias("longest")) for r in summary])
    travel = (
        bounded.withColumn("p", F.explode(F.filter(places, lambda p: F.col("norm") * p.longest * (1 + 1e-9) >= F.col("bound"))))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("p.parts") - 1)))
        .select(F.col("p.bucket").alias("bucket"), "part", "dim", F.lit(1).alias("kind"), "id", "ints", "bound")
    )
    n_parts = F.create_map(*[F.lit(x) for r in summary for x in (r.bucket, parts[r.bucket])])
    settled = rows.select(
        "bucket", F.pmod(F.xxhash64("id"), n_parts[F.col("bucket")]).cast("int").alias("part"), "dim", F.lit(0).alias("kind"), "id", "ints", F.lit(0.0).alias("bound")
    )
    key = ["bucket", "part", "dim"]
    met = settled.unionByName(travel).repartition(*key).sortWithinPartitions(*key, "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, gathered, block = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in range(4)], axis=1)
            starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, b in zip([0, *starts], [*starts, batch.num_rows]):
                group, part = tuple(keys[a, :3]), batch.slice(a, b - a)
                if group != here:
                    here, gathered, block = group, [], None
                ids, ints = np.asarray(part.column(4)), matrix(part.column(5))
                if keys[a, 3] == 0:
                    gathered.append((ids, ints))
                    continue
                if block is None and gathered:
                    block = Block(np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered]))
                if block is not None:
                    bounds = np.asarray(part.column(6))
                    for at in range(0, len(ids), 256):
                        yield results(list(block.search(ids[at : at + 256], ints[at : at + 256], bounds[at : at + 256], k)))

    found = met.mapInArrow(search, RESULT_SCHEMA)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

