"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.shared import materialise, shared_dir  # noqa: F401

Kept = TypeVar("Kept")

#: A sub-batch closes once it holds this many characters, so that the Python
#: objects made from one Arrow batch stay bounded whatever the batch holds.
SUB_BATCH_CHARS = 1_000_000


def ranked(rows: DataFrame, order: Sequence[Column], within: str = "tree") -> DataFrame:
    """``rows`` with lo = hi = rank among those of equal ``within`` (never null), from 0, and n, their number.

    Rows are dealt by range, so a group of any size spreads; ranks are places in a part plus the
    rows of the parts before. ``order`` sorts null first; rows that it doesn't tell apart must be equal.
    """
    sorted_by = [F.col(within).asc(), *[c.asc_nulls_first() for c in order]]
    # The row number lets rows that are equal throughout fall into several parts.
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*sorted_by, F.col("_row"))
    dealt = materialise(dealt.withColumn("_part", F.spark_partition_id()).drop("_row"), "ranked")
    # A row for each part that a group lies in.
    sizes = dealt.groupBy(within, "_part").agg(F.count("*").alias("_n"))
    of_group = Window.partitionBy(within).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(within, "_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy(within)).alias("n"))
    place = F.row_number().over(Window.partitionBy(within, "_part").orderBy(*[c.asc_nulls_first() for c in order])) - 1
    numbered = dealt.withColumn("_place", place).join(sizes, [within, "_part"]).withColumn("lo", (F.col("_place") + F.col("_before")).cast("bigint"))
    return numbered.withColumn("hi", F.col("lo")).drop("_part", "_place", "_before")


def crc_bucket(column: Column | str, buckets: int) -> Column:
    """crc32 of a value's text, modulo ``buckets``; null goes to bucket 0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string")) % buckets, F.lit(0)).cast("int")


def sub_batches(texts: list[str | None], limit: int = SUB_BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into ranges of about ``limit`` characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 16
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sub_arrays(texts: pa.Array, limit: int = SUB_BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """``sub_batches`` of a text column by its bytes, without making any text a Python object."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        size += n + 16
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: What this Python worker keeps from task to task, by the kind of task that uses it.
_kept: dict[str, dict] = {}


def kept(kind: str, key: Hashable, make: Callable[[], Kept]) -> Kept:
    """The object under ``key``, made when a worker first needs it; a task of another kind drops it."""
    held = _kept.setdefault(kind, {})
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Give freed memory back to the system: Python workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def drop_kept(but: str | None) -> None:
    """Drop what tasks of other kinds than ``but`` have left in this worker."""
    others = [kind for kind in _kept if kind != but]
    for kind in others:
        del _kept[kind]
    if others:
        give_back()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with freed memory given back at its end; at its start all goes that ``kept`` holds for other kinds than ``keeps``."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        yield from run(batches)
        give_back()

    return inner


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, at most so many rows at a time go to Python; what stays lazy beyond it goes by the session's own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plain_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
