"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Every shard owns some of them as virtual nodes; a
document falls on the cell of its text's hash and belongs to the next virtual node
clockwise, so equal texts start together. A shard has room for its exact share of the
rows: documents that find it full go on clockwise to the next shard with room, which
makes the counts at most one apart and moves only what overflows.

Rows of a cell stand in order of their texts, so a group of equal texts is cut only where it meets
a full shard. Ranks within cells come from a range partitioning, whatever part of the rows
one text has. The filling is worked out from the number of documents per cell, a table of
fixed size.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import materialise, plain_columns, ranked

PLAN_SCHEMA = "array<struct<c:int,lo:bigint,hi:bigint,shard:int,base:bigint>>"


def ring_nodes(spark: SparkSession, shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in clockwise order; on one cell the lowest shard comes first.

    A node's place depends on its shard and its number alone, so one more shard leaves all others where they are.
    """
    shard, number = F.expr(f"id div {virtual_nodes}"), F.col("id") % virtual_nodes
    nodes = spark.range(shards * virtual_nodes).select(F.pmod(F.xxhash64(F.lit("node"), shard, number), F.lit(cells)).alias("cell"), shard.alias("shard"))
    return sorted((r.cell, r.shard) for r in nodes.collect())


def fill(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, from rank, to rank, shard, first slot) that place ``counts`` rows per cell.

    Each shard takes what its own nodes receive, in ring order, while it has room; then what
    was left over walks on clockwise, in ring order, to the next node whose shard has room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    segments, left = [], []

    def place(cell: int, lo: int, hi: int, shard: int) -> int:
        taken = min(hi - lo, room[shard])
        if taken:
            segments.append((cell, lo, lo + taken, shard, used[shard]))
            room[shard] -= taken
            used[shard] += taken
        return lo + taken

    node = 0
    for cell in range(cells):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        if n := counts.get(cell):
            owner = node % len(nodes)
            at = place(cell, 0, n, nodes[owner][1])
            if at < n:
                left.append((owner, cell, at, n))
    for owner, cell, at, n in left:
        while at < n:
            owner = (owner + 1) % len(nodes)
            at = place(cell, at, n, nodes[owner][1])
    return segments


def shard_documents(
    docs: DataFrame, shards: int = 40, virtual_nodes: int = 100, cells: int = 16_384, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Give every row a shard and a slot in it.

    Returns ``id_col``, size (UTF-8 bytes of the text, none for null, plus 16), text_crc32
    (0 for null), law ('rows': shard sizes in rows differ by one at most), shard, slot (gapless
    from 0 in each shard) and grown_shard (null under this law). Null ids and repeated rows
    are placed like any other; rows that are equal throughout may swap slots. Rows of null texts
    go by their id. Texts are hashed whole. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = plain_columns(docs, (id_col, text_col)).select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNull(), F.xxhash64(F.lit("id"), id_col)).otherwise(F.xxhash64(text)).alias("_key"),
    )
    placed = materialise(rows.withColumn("_cell", F.pmod(F.col("_key"), F.lit(cells)).cast("int")), "shard-rows")
    counts = {r._cell: r.n for r in placed.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    plan = fill(counts, ring_nodes(spark, shards, virtual_nodes, cells), shards, cells)
    text_of_plan = json.dumps([dict(zip(("c", "lo", "hi", "shard", "base"), s)) for s in plan], separators=(",", ":"))
    # At most one row per cell and one more per walk on: a table of fixed size.
    segments = spark.range(1).select(F.inline(F.from_json(F.lit(text_of_plan), PLAN_SCHEMA)))
    order = [F.col(c) for c in ("_key", "text_crc32", "size", f"`{id_col}`")]
    ordered = ranked(placed, order, "_cell").select(F.col(f"`{id_col}`"), "size", "text_crc32", "_cell", F.col("lo").alias("_rank"))
    inside = (F.col("_cell") == F.col("c")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    return ordered.join(F.broadcast(segments), inside).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("_rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
