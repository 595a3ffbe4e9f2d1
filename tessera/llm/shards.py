"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has 2**16 cells; a key's cell is the top of its hash. Every shard owns `nodes` virtual nodes, each at a cell of
its own; a cell belongs to the next node clockwise, so the nodes cut the ring into arcs. Loads are bounded exactly: of n
rows each shard takes n // shards, and the first n % shards one more. The keys of an arc, in ring order, fill its shard;
those that overflow continue clockwise to the next shard with room, so counts differ by one at most (law `rows`).

Only the number of rows in each arc (shards * nodes numbers, whatever the input) comes to the driver, where the ring is
filled; the resulting ranges of ranks, at most 2 * arcs + shards rows, are broadcast. A row's rank in its arc is the
number of rows in earlier cells of the arc plus its rank within the cell: 65,536 windows of equal expected size, none
unbounded by a hot source. One shuffle of three narrow columns; texts do not move.

Null text: no bytes (size 8, CRC of nothing). Null ids share one cell. Repeated rows are separate rows with slots of
their own. Empty input: empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def _mix(x: int) -> int:
    """splitmix64 of one integer, for the places of the virtual nodes."""
    x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
    return x ^ x >> 31


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(last cell of its arc, shard) of every virtual node, clockwise; a taken cell sends a node to the next free one."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for k in range(nodes):
            cell = _mix(_mix(shard + 1) + k) >> (64 - CELL_BITS)
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def cell_of(id_col: str = "doc_id") -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - CELL_BITS).cast("int")


def fill(counts: dict[int, int], places: list[tuple[int, int]], shards: int) -> list[dict]:
    """Ranges [lo, hi) of ranks of each arc, their shard and the slot of the first of them."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    out = []
    for arc in range(len(places)):
        lo, left, step = 0, counts.get(arc, 0), 0
        while left:
            shard = places[(arc + step) % len(places)][1]
            take = min(left, room[shard] - used[shard])
            if take > 0:
                out.append({"arc": arc, "lo": lo, "hi": lo + take, "shard": shard, "slot0": used[shard]})
                used[shard] += take
                lo, left = lo + take, left - take
            step += 1
    return out


def assign(docs: DataFrame, shards: int = 24, nodes: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row."""
    spark = docs.sparkSession
    places = ring(shards, nodes)
    cells = _cells(spark, places)
    per_cell = docs.select(cell_of(id_col).alias("cell")).groupBy("cell").count().join(F.broadcast(cells), "cell")
    counts = {r.arc: r.n for r in per_cell.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    kind = "array<struct<arc:int,lo:long,hi:long,shard:int,slot0:long>>"
    pieces = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(fill(counts, places, shards))), kind)).alias("p")).select("p.*")
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_cell.select("cell", "arc", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), cell_of(id_col).alias("cell"), F.xxhash64(F.col(id_col)).alias("h"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    ranked = rows.withColumn("in_cell", F.row_number().over(Window.partitionBy("cell").orderBy("h", id_col, "size", "text_crc32")) - 1)
    placed = ranked.join(starts, "cell").withColumn("rank", F.col("ahead") + F.col("in_cell"))
    out = placed.join(F.broadcast(pieces), "arc").where("rank >= lo and rank < hi")
    return out.select(id_col, "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def _cells(spark, places: list[tuple[int, int]]) -> DataFrame:
    """(cell, arc) of all 65,536 cells."""
    arcs = [{"first": places[k - 1][0] + 1, "last": end, "arc": k} for k, (end, _) in enumerate(places) if k]
    arcs += [{"first": 0, "last": places[0][0], "arc": 0}, {"first": places[-1][0] + 1, "last": CELLS - 1, "arc": 0}]
    kind = "array<struct<first:int,last:int,arc:int>>"
    spans = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([a for a in arcs if a["first"] <= a["last"]])), kind)).alias("a")).select("a.*")
    return spans.select(F.explode(F.sequence("first", "last")).alias("cell"), "arc")
