"""Greedy segmentation of sequences of any length.

A greedy segment runs from its first row to the row where a limit is met, and the next starts
there. Folding a sequence holds it in one row; here, every row first looks up where the next segment would
start if one started at it, by a search in sorted running values, and pointer doubling then
finds the starts that the first row reaches: with jumps of 1, 2, 4, ... segments, rounds grow with the
logarithm of their number. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.shared import materialise


def next_beyond(rows: DataFrame, group: list[str], at: str, reach: str, limit: str) -> DataFrame:
    """``rows`` (group, ``at``, ``nxt``): for each row the least ``at`` of its group whose ``reach`` is over the row's ``limit``; null where none is.

    ``reach`` must not fall as ``at`` rises. Points and limits are sorted together, so no pairs are formed.
    """
    points = rows.select(*group, F.col(reach).alias("_v"), F.lit(1).alias("_point"), F.col(at).alias("_e"), F.lit(None).cast("bigint").alias(at))
    limits = rows.select(*group, F.col(limit).alias("_v"), F.lit(0).alias("_point"), F.lit(None).cast("bigint").alias("_e"), F.col(at).cast("bigint").alias(at))
    # From the greatest value down: the last point before a limit is the first one above it; equal ones come after the limit.
    order = Window.partitionBy(*group).orderBy(F.col("_v").desc(), F.col("_point"), F.col("_e").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = points.unionByName(limits).withColumn("nxt", F.last("_e", ignorenulls=True).over(order))
    return found.filter("_point = 0").select(*group, at, "nxt")


def reached(jumps: DataFrame, first: DataFrame, group: list[str], at: str) -> DataFrame:
    """(group, ``at``) of the rows that chains of ``jumps`` (group, ``at``, ``nxt``) visit from ``first``, these included."""
    jumps, seen = materialise(jumps.filter("nxt is not null"), "jumps"), materialise(first.select(*group, at), "starts")
    while not jumps.isEmpty():
        # Those seen have fewer jumps behind them than one of these makes, so none is met twice.
        seen = materialise(seen.unionByName(seen.join(jumps, [*group, at]).select(*group, F.col("nxt").alias(at))), "starts")
        onward = jumps.select(*group, F.col(at).alias("nxt"), F.col("nxt").alias("_on"))
        jumps = materialise(jumps.join(onward, [*group, "nxt"]).select(*group, at, F.col("_on").alias("nxt")), "jumps")
    return seen


def numbered_segments(rows: DataFrame, group: list[str], at: str, starts: DataFrame) -> DataFrame:
    """``rows`` with ``_seg``: the start of the segment that each lies in."""
    marked = rows.join(starts.withColumn("_start", F.col(at)), [*group, at], "left")
    return marked.withColumn("_seg", F.last("_start", ignorenulls=True).over(Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))).drop("_start")
