"""Vectors of a recording in blocks, and pairs of blocks multiplied in Arrow batches.

A block holds up to ``size`` vectors with the direction of their mean and the widest angle to it.
Pairs of blocks of a recording meet by key, one row each, so a recording of n vectors is
(n / size)^2 / 2 rows of work that spread over tasks. With a bound on the angle, pairs of blocks
whose directions are further apart than the bound and both widths are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.shared import materialise

BLOCK = 1024
BLOCK_SCHEMA = "blk bigint, ids array<bigint>, dims int, vectors binary, centre array<double>, width double"


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def matrix(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, dims)


def blocked(vectors: DataFrame, idx: str, vec: str, size: int = BLOCK, rec: str = "rec_id", normed: bool = True) -> DataFrame:
    """(rec, blk, ids, dims, vectors, centre, width): vectors of a recording in order of ``idx``, ``size`` to a block, written."""
    number = F.row_number().over(Window.partitionBy(rec).orderBy("i")) - 1
    rows = vectors.select(rec, F.col(idx).cast("bigint").alias("i"), F.col(vec).cast("array<double>").alias("v")).withColumn("blk", F.floor(number / size))
    grouped = rows.groupBy(rec, "blk").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m"))  # ``size`` at most
    grouped = grouped.select(rec, "blk", F.transform("m", lambda x: x.i).alias("ids"), F.transform("m", lambda x: x.v).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, data, centres, widths = [], [], [], []
            for m in batch.column(3):
                flat = m.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                v = flat.reshape(len(m), -1) if len(flat) else np.zeros((len(m), 1))
                u = unit(v)
                mean = u.mean(axis=0)
                centre = mean / max(np.linalg.norm(mean), 1e-9)
                dims.append(v.shape[1])
                data.append((u if normed else v).tobytes())
                centres.append(centre.tolist())
                # Vectors without a direction may be at any angle.
                widths.append(float(np.arccos(np.clip(u @ centre, -1, 1)).max()) if np.linalg.norm(u, axis=1).min() > 0.5 and np.linalg.norm(mean) > 1e-9 else np.pi)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(centres, pa.list_(pa.float64())), pa.array(widths, pa.float64())],
                names=[rec, "blk", "ids", "dims", "vectors", "centre", "width"],
            )

    return materialise(grouped.mapInArrow(run, f"{rec} {vectors.schema[rec].dataType.simpleString()}, {BLOCK_SCHEMA}"), "blocks")


def block_pairs(blocks: DataFrame, rec: str = "rec_id", most_angle: float | None = None) -> DataFrame:
    """(rec, a_*, b_*) of every pair of blocks of a recording, each with itself; only pairs that may hold vectors ``most_angle`` apart."""
    side = lambda p: blocks.select(rec, *[F.col(c).alias(f"{p}_{c}") for c in blocks.columns if c != rec])
    pairs = side("a").join(side("b"), rec).filter("a_blk <= b_blk")
    if most_angle is not None:
        dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
        # A little slack for rounding; block sizes are bounded, so is what a pair of them may give.
        pairs = pairs.filter((F.col("a_blk") == F.col("b_blk")) | (apart <= F.col("a_width") + F.col("b_width") + most_angle + 1e-6))
    return pairs.select(rec, *[f"{p}_{c}" for p in "ab" for c in ("blk", "ids", "dims", "vectors")])


def over_pairs(pairs: DataFrame, each: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], dict[str, np.ndarray]], schema: str, rec: str = "rec_id") -> DataFrame:
    """Rows (rec, ``schema``) that ``each`` makes of two blocks' ids and vectors; its last argument says whether they are the same block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                a, b = ((column[f"{p}_ids"][r].values.to_numpy(), matrix(column[f"{p}_vectors"][r].as_py(), column[f"{p}_dims"][r].as_py())) for p in "ab")
                made = each(a[0], a[1], b[0], b[1], column["a_blk"][r] == column["b_blk"][r])
                n = len(next(iter(made.values())))
                yield pa.RecordBatch.from_arrays([pa.repeat(column[rec][r], n), *[pa.array(v) for v in made.values()]], names=[rec, *made])

    return pairs.mapInArrow(run, f"{rec} {pairs.schema[rec].dataType.simpleString()}, {schema}")
