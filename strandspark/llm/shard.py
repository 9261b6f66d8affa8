"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm.common import cut, fresh, literal_table


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int, int]]:
    """(first cell, last cell, owner) of each arc in ring order: cells run clockwise to the first virtual node at or after them."""
    at = {}
    for s in range(shards):
        for v in range(vnodes):
            at.setdefault(int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") % cells, s)
    points = sorted(at.items())
    arcs, before = [], -1
    for p, s in points:
        arcs.append((before + 1, p, s))
        before = p
    if before < cells - 1:
        arcs.append((before + 1, cells - 1, points[0][1]))
    return arcs


def place(arcs: list[tuple[int, int, int]], load: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard) pieces of all arcs' loads: each owner keeps its arcs until it is full; what overflows continues clockwise to the next shards with room."""
    room = {s: capacity for _, _, s in arcs}
    pieces, over = [], []
    for a, (_, _, s) in enumerate(arcs):
        n = load.get(a, 0)
        kept = min(n, room[s])
        room[s] -= kept
        if kept:
            pieces.append((a, 0, kept, s))
        if n > kept:
            over.append((a, kept, n))
    for a, lo, hi in over:
        for step in range(1, len(arcs) + 1):
            s = arcs[(a + step) % len(arcs)][2]
            if lo < hi and room[s]:
                n = min(hi - lo, room[s])
                room[s] -= n
                pieces.append((a, lo, lo + n, s))
                lo += n
    return pieces


def shard(rows: DataFrame, size: str, shards: int = 8, slack: float = 0.002, vnodes: int = 64, cells: int = 1 << 16, key: str = "doc_id") -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard); columns of these names are replaced.

    A row's hash gives its cell on the ring, the next virtual node its shard. No shard holds more than (1 + slack)
    times the mean size and one row: the rows of an arc run in hash order, and those that begin beyond what the owner
    holds continue clockwise. Only the arcs' sizes (shards * vnodes numbers, whatever the data) come to the driver.
    Rows are dealt by cell, so a window holds 1 / cells of them. The hash is that of the key with all other columns, so
    that rows of a null or repeated key are dealt over all cells too, and no row is joined by its key. A null size
    counts 1, equal rows are placed singly. An empty table stays empty. Other columns stay, whatever their names.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    columns = rows.columns
    _h, _size, _cell, _arc, _lo, _hi, _off, _start, _n = fresh(rows, "_h", "_size", "_cell", "_arc", "_lo", "_hi", "_off", "_start", "_n")
    arcs = ring(shards, vnodes, cells)
    by_arc = literal_table(spark, [(a, lo, hi) for a, (lo, hi, _) in enumerate(arcs)], f"{_arc} int, {_lo} int, {_hi} int")
    arc_of = F.broadcast(by_arc.select(_arc, F.explode(F.sequence(_lo, _hi)).alias(_cell)))  # cells rows, a parameter
    every = F.xxhash64(key, *[c for c, kind in rows.dtypes if "map<" not in kind])
    rows = rows.withColumn(_h, every)
    rows = rows.withColumn(_size, F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("long")).withColumn(_cell, F.pmod(F.shiftrightunsigned(_h, 20), F.lit(cells)).cast("int"))
    per_cell = cut(rows.groupBy(_cell).agg(F.sum(_size).alias(_n)).join(arc_of, _cell))
    load = {r[0]: r[1] for r in per_cell.groupBy(_arc).agg(F.sum(_n)).collect()}
    capacity = int((1 + slack) * sum(load.values()) / shards) + 1
    pieces = F.broadcast(literal_table(spark, place(arcs, load, capacity), f"{_arc} int, {_lo} long, {_hi} long, shard int"))
    before = lambda by, order: F.coalesce(F.sum(_n).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell_starts = per_cell.select(_cell, _arc, before(_arc, _cell).alias(_off))
    order = [_h, key, _size]
    start = F.col(_off) + F.coalesce(F.sum(_size).over(Window.partitionBy(_cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(cell_starts, _cell).withColumn(_start, start)
    placed = placed.join(pieces, _arc).filter((F.col(_start) >= F.col(_lo)) & (F.col(_start) < F.col(_hi)))
    placed = cut(placed.select(*columns, "shard", _h, _size, _cell))
    counts = placed.groupBy("shard", _cell).agg(F.count("*").alias(_n))
    firsts = counts.select("shard", _cell, before("shard", _cell).alias(_off))
    slot = F.col(_off) + F.row_number().over(Window.partitionBy("shard", _cell).orderBy(*order)) - 1
    return placed.join(firsts, ["shard", _cell]).withColumn("slot", slot.cast("long")).select(*columns, "shard", "slot")


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")
