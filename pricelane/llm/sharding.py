"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 64-bit positions. A row's position is the hash of its
text, so equal texts lie together; its home is the first point clockwise. A shard takes rows up to its
capacity; what overflows continues clockwise to the next point of a shard with room. Capacities are
the row count divided evenly, so row counts differ by one at most, while only rows near full shards
leave their home.

The walk needs counts alone. Rows are numbered within their home arc, the walk moves number ranges of
arcs, and its result - a few thousand ranges, however many rows there are - is joined back.

Rows are numbered in cells of about `cell_rows` rows. A cell is a range of positions, so equal texts have
numbers side by side; only a text with more than `cell_rows` rows of its own is cut into cells by doc_id,
and its rows follow those of all other texts of the arc. Cells depend on the rows alone, not on how many
partitions or tasks there are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pricelane.llm.work import written

RANGES = "arc int, low long, high long, shard int, first_slot long"
#: Hot texts up to this number are sent to all tasks; more are joined by a shuffle.
FEW = 100_000


def ring(shards: int, vnodes: int = 64, seed: int = 0) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in clockwise order. A shard's points do not depend on
    how many other shards there are."""
    def position(shard, node):
        name = f"{seed}/{shard}/{node}".encode()
        return int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "big", signed=True)
    return sorted((position(s, v), s) for s in range(shards) for v in range(vnodes))


def home(points: list[tuple[int, int]], position: int) -> int:
    """The number of the first point at or after `position`, clockwise."""
    return bisect_left([p for p, _ in points], position) % len(points)


def walk(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple]:
    """Place the rows of all arcs: (arc, low, high, shard, first_slot) for row numbers low to high - 1
    of an arc. In every round each shard accepts the ranges at its points in ring order while it has
    room; what is left moves on to the next point whose shard has room."""
    used, placed = [0] * len(capacity), []
    waiting = [(arc, arc, 0, n) for arc, n in sorted(counts.items()) if n]
    while waiting:
        moving = []
        for at, arc, low, high in waiting:
            shard = owners[at]
            cut = min(high, low + capacity[shard] - used[shard])
            if cut > low:
                placed.append((arc, low, cut, shard, used[shard]))
                used[shard] += cut - low
            if cut < high:
                moving.append((at, arc, cut, high))
        full = [u >= c for u, c in zip(used, capacity)]
        waiting = []
        for at, arc, low, high in moving:
            at = (at + 1) % len(owners)
            while full[owners[at]]:
                at = (at + 1) % len(owners)
            waiting.append((at, arc, low, high))
        waiting.sort()
    return placed


def _in_cells(rows: DataFrame, total: int, cell_rows: int) -> DataFrame:
    """`rows` with the cell that each is numbered in: hot, place and piece, in this order within an arc."""
    bits = max(0, (max(total, 1) - 1).bit_length() - (cell_rows - 1).bit_length())
    grid = F.shiftright("position", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("grid", grid)
    # positions are hashes, so what is far above the mean holds a text of many rows
    full = rows.groupBy("arc", "grid").count().filter(F.col("count") > 2 * cell_rows).select("arc", "grid")
    hot = written(rows.join(full, ["arc", "grid"], "left_semi").groupBy("arc", "position").count()
                  .filter(F.col("count") > cell_rows)
                  .select("arc", "position", F.ceil(F.col("count") / cell_rows).alias("pieces")), "hot")
    if hot.count() <= FEW:
        hot = F.broadcast(hot)
    is_hot = F.col("pieces").isNotNull()
    return rows.join(hot, ["arc", "position"], "left") \
        .withColumn("place", F.when(is_hot, F.col("position")).otherwise(F.col("grid"))) \
        .withColumn("piece", F.pmod("tie", F.coalesce("pieces", F.lit(1).cast("long")))) \
        .withColumn("hot", is_hot.cast("int")).drop("pieces", "grid")


def shards_of(docs: DataFrame, shards: int, vnodes: int = 64, seed: int = 0, cell_rows: int = 1 << 12) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus 16. slot: place within the shard, gapless from 0. A null text
    counts as empty, a null doc_id is an id like others; repeated rows each get a slot. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    points = ring(shards, vnodes, seed)
    positions = np.array([p for p, _ in points], dtype=np.int64)

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        found = np.searchsorted(positions, position.to_numpy(), side="left") % len(positions)
        return pd.Series(found.astype("int32"))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("position"),
        F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("tie"))
        .withColumn("arc", arc_of("position")), "arcs")

    counts = {r.arc: r["count"] for r in rows.groupBy("arc").count().collect()}  # at most one per point
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    ranges = walk(counts, [s for _, s in points], capacity)
    rows = _in_cells(rows, total, cell_rows)
    cell = ["arc", "hot", "place", "piece"]
    before = Window.partitionBy("arc").orderBy(*cell[1:]).rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*cell).count() \
        .select(*cell, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*cell).orderBy("position", "tie", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(inside) - 1) \
        .join(first, cell).withColumn("number", F.col("number") + F.col("first"))
    # as many ranges as points and shards, whatever the number of rows
    target = F.broadcast(spark.createDataFrame(ranges, RANGES).withColumnRenamed("arc", "home"))
    there = (F.col("arc") == F.col("home")) & F.col("number").between(F.col("low"), F.col("high") - 1)
    return numbered.join(target, there).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("first_slot") + F.col("number") - F.col("low")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write the rows of `docs`, which need distinct ids, as one folder shard=N each, in slot order.
    Every shard's file is written by one task, which streams it."""
    placed = shards_of(docs, shards, **options).select(
        F.col("doc_id").alias("placed_id"), F.col("shard").alias("shard"), F.col("slot").alias("slot"))
    plain = docs.drop("shard", "slot")
    plain.join(placed, plain["doc_id"].eqNullSafe(placed["placed_id"])).drop("placed_id") \
        .repartition(shards, "shard").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
