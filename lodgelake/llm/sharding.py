"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

A document stands on the ring at the hash of its id.  Each shard owns ``virtual_nodes`` points.  A
document goes to the shard of the next point clockwise; a shard takes no more than its load bound, and
what overflows continues clockwise to the next shard that is not full.  With the bound at the mean
(floor or ceiling of rows over shards) counts are at most one apart: law ``rows``.

The ring is a grid of CELLS equal cells, so a cell's documents see the points in the same order.  Only the
row count of each cell reaches the driver (at most CELLS numbers).  The overflow is worked out on
those counts: of a cell's documents, in hash order, the first a go to one shard, the next b to another.
Rank within a cell is one window; hashing makes the cells even whatever the sources or texts are.

Null text counts as empty (size 1, crc 0).  A null doc_id stands at the hash of its text.  Rows equal in
doc_id and text are interchangeable.  An empty table gives an empty result.  Extra columns are left out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelake.llm.common import pick

CELL_BITS = 12
CELLS = 1 << CELL_BITS


def clockwise(shards: int, virtual_nodes: int) -> list[list[int]]:
    """For each cell the shards in the order in which the ring meets them clockwise."""
    points = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - CELL_BITS), s, v)
        for s in range(shards) for v in range(virtual_nodes)
    )
    order: list[list[int]] = []
    at = 0
    for cell in range(CELLS):
        while at < len(points) and points[at][0] < cell:
            at += 1
        seen: dict[int, None] = {}
        for k in range(len(points)):
            seen.setdefault(points[(at + k) % len(points)][1])
            if len(seen) == shards:
                break
        order.append(list(seen))
    return order


def place(counts: dict[int, int], shards: int, virtual_nodes: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): in round r each cell offers what is left to its
    r-th shard clockwise, so a document leaves its home shard only when that one is full."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    done = dict.fromkeys(counts, 0)
    order = clockwise(shards, virtual_nodes)
    out = []
    for r in range(shards):
        for cell in sorted(counts):
            s = order[cell][r]
            n = min(counts[cell] - done[cell], room[s])
            if n:
                out.append((cell, done[cell], done[cell] + n, s, filled[s]))
                done[cell] += n
                room[s] -= n
                filled[s] += n
    return out


def shard(docs: DataFrame, shards: int = 8, virtual_nodes: int = 64) -> DataFrame:
    """Documents' columns with size, text_crc32, shard, slot (gapless from 0 in a shard)."""
    spark = docs.sparkSession
    raw = F.coalesce("text", F.lit("")).cast("binary")
    d = pick(docs).select(
        "*", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"),
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")),
                   F.xxhash64(F.coalesce("text", F.lit("")))).alias("_h"),
    ).withColumn("_cell", F.shiftrightunsigned("_h", 64 - CELL_BITS).cast("int"))
    counts = {r[0]: r[1] for r in d.groupBy("_cell").count().collect()}  # at most CELLS rows
    parts = spark.createDataFrame(place(counts, shards, virtual_nodes) or [],
                                  "_c int, _lo long, _hi long, shard int, _slot long")
    parts = F.broadcast(parts.groupBy("_c").agg(
        F.collect_list(F.struct("_lo", "_hi", "shard", "_slot")).alias("_parts")))  # at most CELLS x shards entries
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "doc_id", "text_crc32", "size")) - 1
    return (
        d.withColumn("_rank", rank.cast("long"))
        .join(parts, F.col("_cell") == F.col("_c"))
        .withColumn("_part", F.expr("filter(_parts, p -> _rank >= p._lo AND _rank < p._hi)[0]"))
        .withColumn("shard", F.col("_part.shard"))
        .withColumn("slot", F.col("_part._slot") + F.col("_rank") - F.col("_part._lo"))
        .drop("_h", "_cell", "_rank", "_c", "_parts", "_part")
    )


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, size, shard and slot of every document; see the module for nulls and repeats."""
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
