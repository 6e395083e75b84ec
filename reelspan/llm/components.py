"""Connected components by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every node's smaller neighbours, and itself, on the least of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(least, "b").filter(F.col("a") > F.col("m")).select(F.col("m").alias("x"), F.col("a").alias("y"))
    return hung.unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node it reaches.

    Each round is written to the shared folder, so lineage stays short; rounds end when the
    edges form stars. A hub's edges meet its least neighbour in a plain equi-join, which
    adaptive execution splits when the hub is hot.
    """
    now = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now)), "edges")
        last, state = state, _state(now)
        if state == last:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    )
