"""Centroid clustering over a VA-file: vectors approximated by few-bit cells.

Every dimension's range is cut into 2^bits cells of equal width; a vector's approximation is its
cell in each dimension, packed. For a set of centroids, lookup tables give the least and the
greatest squared distance that a cell can have in a dimension, and their sums the interval of
a vector's distance from each centroid. Centroids whose interval begins beyond the least upper
end can't be nearest. Those that are left are compared with the centroid that is nearest to the
middle of the cells: what lies between the two distances is linear in the vector, so its interval is
much narrower, and again those that begin above zero go. Where one centroid is left the vector is decided by its cells.

Rounds change sums by differences. A vector that is decided alike under the centroids of the
last round and of this one changes nothing and is not fetched; the full vectors of the others
are fetched by row number from a table bucketed by it, and distances are taken from the
centroids that are left, in integers.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import lean, materialise, plain_columns, shared_dir

#: Components beyond this, once whole, would let squared distances pass 64 bits: an error, not a wrong result.
MOST = 1 << 26
#: Vectors that a task works on at a time.
BLOCK = 2048


@dataclass
class Grid:
    """Cells of every dimension: least value, width (whole numbers) and bits of a cell's number."""

    low: np.ndarray
    width: np.ndarray
    bits: int

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.low) // self.width

    def pack(self, cells: np.ndarray) -> list[bytes]:
        planes = (cells[:, :, None] >> np.arange(self.bits)) & 1
        return [row.tobytes() for row in np.packbits(planes.astype(np.uint8).reshape(len(cells), -1), axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        dims = len(self.low)
        rows = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
        planes = np.unpackbits(rows, axis=1, count=dims * self.bits).reshape(len(packed), dims, self.bits).astype(np.int64)
        return planes @ (1 << np.arange(self.bits))


class Intervals:
    """Lookup tables of a grid and a set of centroids."""

    def __init__(self, grid: Grid, centroids: np.ndarray):
        first = grid.low[:, None] + np.arange(1 << grid.bits) * grid.width[:, None]  # dimension x cell
        last = first + grid.width[:, None] - 1
        c = centroids.T[:, None, :]  # tables are dimension x cell x centroid
        first, last = first[:, :, None], last[:, :, None]
        self.lower = np.maximum(0, np.maximum(first - c, c - last)) ** 2
        self.upper = np.maximum(abs(first - c), abs(last - c)) ** 2
        self.middle = (first + last - 2 * c) ** 2  # of doubled values, so four times the distance
        self.slack = 4 * (abs(centroids[:, None] - centroids[None]) * (grid.width - 1)).sum(axis=2)

    @staticmethod
    def total(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = table[0][cells[:, 0]]
        for d in range(1, cells.shape[1]):
            out = out + table[d][cells[:, d]]
        return out

    def left(self, cells: np.ndarray) -> np.ndarray:
        """Row x centroid: whether it may be the nearest."""
        may = self.total(self.lower, cells) <= self.total(self.upper, cells).min(axis=1)[:, None]
        middle = self.total(self.middle, cells)
        best = middle.argmin(axis=1)
        return may & (middle - middle[np.arange(len(cells)), best][:, None] <= self.slack[best])


def nearest(vectors: np.ndarray, centroids: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals) and squared distance, of those that ``may`` leaves."""
    row, c = np.nonzero(may)
    distance = np.empty(len(row), dtype=np.int64)
    for a in range(0, len(row), 16 * BLOCK):
        apart = vectors[row[a : a + 16 * BLOCK]] - centroids[c[a : a + 16 * BLOCK]]
        distance[a : a + 16 * BLOCK] = np.einsum("ij,ij->i", apart, apart)
    least = np.minimum.reduceat(distance, np.searchsorted(row, np.arange(len(vectors))))
    at = np.flatnonzero(distance == least[row])
    first = np.unique(row[at], return_index=True)[1]
    return c[at[first]], least


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            yield batch.slice(a, BLOCK)


def read_vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dims).astype(np.int64)


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, v): vectors of ``dims`` finite components as floor(scale * x), 32-bit integers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dims)
            if len(values) and np.abs(values).max() > MOST:
                raise ValueError(f"a component is beyond {MOST // scale} in size, too large for exact distances in 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in values.astype("<i4")], pa.binary())], names=["row", "id", "v"])

    x = F.col(f"`{vec_col}`")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kind = vectors.schema[id_col].dataType.simpleString()
    good = plain_columns(vectors, (id_col, vec_col)).filter((F.size(x) == dims) & finite).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), x.cast("array<double>").alias("x"))
    return good.mapInArrow(lean(run), f"row bigint, id {kind}, v binary")


def grid_of(full: DataFrame, dims: int, bits: int) -> Grid:
    """Cells between the least and the greatest value of every dimension, over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            v = read_vectors(batch.column(0), dims)
            yield pa.RecordBatch.from_arrays([pa.array([v.min(axis=0).tolist()], pa.list_(pa.int64())), pa.array([v.max(axis=0).tolist()], pa.list_(pa.int64()))], names=["low", "high"])

    ends = full.select("v").mapInArrow(lean(run), "low array<bigint>, high array<bigint>").select(F.posexplode(F.arrays_zip("low", "high")).alias("d", "e"))
    found = sorted(ends.groupBy("d").agg(F.min("e.low"), F.max("e.high")).collect())  # a row per dimension
    low, high = (np.array([r[k] for r in found], dtype=np.int64) for k in (1, 2))
    return Grid(low, -(-(high - low + 1) // (1 << bits)), bits)


def summed(sums: DataFrame) -> dict[int, np.ndarray]:
    """Totals by cluster of (cluster, total): components' sums, and the number of vectors last."""
    out: dict[int, list[int]] = {}
    for cluster, _, value in sorted(sums.select("cluster", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x")).collect()):
        out.setdefault(cluster, []).append(value)  # clusters x (components + 1) values
    return {c: np.array(x, dtype=object) for c, x in out.items()}


def per_block(cluster: np.ndarray, rows: np.ndarray, k: int, sign: int = 1) -> tuple[list[int], list[list[int]]]:
    """(clusters, totals) of a block: sums of the rows of each cluster and their number."""
    total = np.zeros((k, rows.shape[1] + 1), dtype=np.int64)
    np.add.at(total, cluster, np.hstack([rows, np.ones((len(rows), 1), dtype=np.int64)]) * sign)
    met = np.flatnonzero(total.any(axis=1))
    return met.tolist(), total[met].tolist()


def first_sums(full: DataFrame, grid: Grid, centroids: np.ndarray) -> dict[int, np.ndarray]:
    """Totals of every cluster: here each vector counts, so each is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = Intervals(grid, centroids)
        for batch in blocks(batches):
            v = read_vectors(batch.column(0), len(grid.low))
            clusters, totals = per_block(nearest(v, centroids, intervals.left(grid.cells(v)))[0], v, len(centroids))
            yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int32()), pa.array(totals, pa.list_(pa.int64()))], names=["cluster", "total"])

    return summed(full.select("v").mapInArrow(lean(run), "cluster int, total array<bigint>"))


def open_rows(approximations: DataFrame, grid: Grid, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """(row, was, may): vectors that their cells don't decide alike under both sets of centroids, and the centroids left under each, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = Intervals(grid, old), Intervals(grid, new)
        for batch in blocks(batches):
            cells = grid.unpack(batch.column(1).to_pylist())
            was, may = before.left(cells), now.left(cells)
            still = (was.sum(axis=1) == 1) & (may.sum(axis=1) == 1) & (was == may).all(axis=1)
            masks = [pa.array([r.tobytes() for r in np.packbits(m[~still], axis=1)], pa.binary()) for m in (was, may)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(~still)), *masks], names=["row", "was", "may"])

    return approximations.mapInArrow(lean(run), "row bigint, was binary, may binary")


def changes(fetched: DataFrame, dims: int, old: np.ndarray, new: np.ndarray) -> dict[int, np.ndarray]:
    """What the totals gain and lose by vectors (was, may, v) that change their cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            was, may = (np.unpackbits(np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1, count=len(new)).astype(bool) for i in (0, 1))
            v = read_vectors(batch.column(2), dims)
            a, b = nearest(v, old, was)[0], nearest(v, new, may)[0]
            gone, come = per_block(a[a != b], v[a != b], len(new), -1), per_block(b[a != b], v[a != b], len(new))
            yield pa.RecordBatch.from_arrays([pa.array(gone[0] + come[0], pa.int32()), pa.array(gone[1] + come[1], pa.list_(pa.int64()))], names=["cluster", "total"])

    return summed(fetched.mapInArrow(lean(run), "cluster int, total array<bigint>"))


def assigned(full: DataFrame, grid: Grid, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = Intervals(grid, centroids)
        for batch in blocks(batches):
            v = read_vectors(batch.column(1), len(grid.low))
            cluster, distance = nearest(v, centroids, intervals.left(grid.cells(v)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return full.select("id", "v").mapInArrow(lean(run), f"id {full.schema['id'].dataType.simpleString()}, cluster int, distance bigint")


def pack_cells(full: DataFrame, grid: Grid) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            cells = grid.cells(read_vectors(batch.column(1), len(grid.low)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grid.pack(cells), pa.binary())], names=["row", "cells"])

    return full.select("row", "v").mapInArrow(lean(run), "row bigint, cells binary")


def moved(centroids: np.ndarray, totals: dict[int, np.ndarray]) -> np.ndarray:
    """Centroids at floor(sum / count) of each cluster; empty ones stay."""
    out = centroids.copy()
    for c, total in totals.items():
        if total[-1]:
            out[c] = [int(x) // int(total[-1]) for x in total[:-1]]
    return out


def write_bucketed(df: DataFrame, column: str) -> tuple[str, DataFrame]:
    """(name, table): ``df`` in the shared folder, dealt and bucketed by ``column``, so that joins on it move only the other side."""
    spark: SparkSession = df.sparkSession
    name, n = f"reelspan_vectors_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, column).write.bucketBy(n, column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name, spark.table(name)


def cluster_vectors(
    vectors: DataFrame, seed_order: Column, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, bits: int = 6, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Lloyd's rounds on whole-number vectors, exact in every sum and distance.

    Components become floor(scale * x). The first centroids are the ``k`` vectors that come first by
    ``seed_order`` (an expression of the column ``id``; null last, ties by id, then by components), or all if there are fewer. Each of ``rounds``
    rounds assigns every vector to the nearest centroid (ties to the smaller number) and moves each centroid that
    has vectors to the floor of their mean. Then vectors are assigned once more. Returns ``id_col``,
    cluster, distance (squared), cluster_inertia and inertia (distances summed) and centroid_sha256.

    Vectors of another length, null ones and those with a null or non-finite component are left out. Components
    beyond 2^26 after scaling raise an error. Repeated ids and vectors count each; null ids are clustered like others;
    other columns are ignored. No vectors give no rows.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    name, full = write_bucketed(whole_vectors(vectors, dims, scale, id_col, vec_col), "row")
    seeds = full.select("id", "v", seed_order.alias("_at")).orderBy(F.col("_at").asc_nulls_last(), F.col("id").asc_nulls_last(), "v").limit(k).collect()  # k vectors
    centroids = read_vectors(pa.array([r.v for r in seeds], pa.binary()), dims)
    if not seeds:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    grid = grid_of(full, dims, bits)
    approximations = materialise(pack_cells(full, grid), "cells")
    old, totals = centroids, {}
    for r in range(rounds):
        if r == 0:
            totals = first_sums(full, grid, centroids)
        else:
            fetched = materialise(open_rows(approximations, grid, old, centroids), "open").join(full.select("row", "v"), "row").select("was", "may", "v")
            for c, change in changes(fetched, dims, old, centroids).items():
                totals[c] = totals.get(c, 0) + change
        old, centroids = centroids, moved(centroids, totals)
        if (old == centroids).all():
            break
    final = materialise(assigned(full, grid, centroids), "assigned")
    spark.sql(f"DROP TABLE {name}")  # the name only: its files are in the shared folder
    inertia = {r.cluster: r.inertia for r in final.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # at most k rows
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = json.dumps([{"cluster": c, "cluster_inertia": n, "inertia": sum(inertia.values()), "centroid_sha256": sha[c]} for c, n in inertia.items()])
    of_cluster = spark.range(1).select(F.inline(F.from_json(F.lit(facts), "array<struct<cluster:int,cluster_inertia:bigint,inertia:bigint,centroid_sha256:string>>")))
    return final.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
