"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual_nodes` points of a 32-bit ring; a row belongs to the arc that ends at
the next point clockwise of its key's position. No shard takes more than its capacity: rows
that find their shard full continue clockwise to the next point whose shard has room.

The plan is made for arcs, not rows: Spark counts the rows of each arc, in bins (shards x virtual_nodes x bins
numbers at most, whatever the input), the driver walks the ring once and cuts each arc's rows into segments of
(shard, first slot). A row finds its segment by its rank in the arc: the rows of the bins before its own,
and its place in its bin. So an arc that holds most rows, as of one key that is repeated or null, is many
small sorts, not one.

Load 1 makes counts equal to within one row, and pays for it in movement: rows overflow on every arc that is a
little too full, and do so anew when a shard is added. A load of 1.25 keeps nearly all rows on their own arc.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 32


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ring points in order, and their owners. Points of a shard do not depend on the other shards."""
    from tidemark.llm.wordhash import mix

    owner = np.repeat(np.arange(shards), virtual_nodes)
    name = owner.astype(np.uint64) * np.uint64(1 << 32) + np.tile(np.arange(virtual_nodes), shards).astype(np.uint64)
    point = (mix(name + np.uint64(1)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((owner, point))
    return point[order], owner[order]


def capacities(total: int, shards: int, load: float) -> np.ndarray:
    """Rows each shard may hold: with load 1 counts at most one apart that add up to the total."""
    if load <= 1:
        return total // shards + (np.arange(shards) < total % shards)
    return np.full(shards, -int(-load * total // shards))


def plan(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank, shard, first slot); an arc's later segments begin at higher ranks."""
    free, used = capacity.astype(np.int64).copy(), np.zeros(len(capacity), np.int64)
    segments, waiting = [], deque()

    def put(arc: int, rank: int, n: int, shard: int) -> None:
        segments.append((arc, rank, shard, int(used[shard])))
        used[shard] += n
        free[shard] -= n

    over = np.zeros(len(counts), np.int64)
    for arc, n in enumerate(counts):  # first what a shard's own arcs hold, in ring order
        shard = int(owner[arc])
        own = int(min(n, free[shard]))
        if own:
            put(arc, 0, own, shard)
        over[arc] = n - own
    lap = 0
    while lap < 2 or waiting:  # then what overflows, clockwise
        for arc in range(len(counts)):
            if lap == 0 and over[arc]:
                waiting.append((arc, int(counts[arc] - over[arc]), int(over[arc])))
            shard = int(owner[arc])
            while waiting and free[shard]:
                of, rank, n = waiting.popleft()
                now = int(min(n, free[shard]))
                put(of, rank, now, shard)
                if n > now:
                    waiting.appendleft((of, rank + now, n - now))
        lap += 1
    return segments


def arc_of(position: Column, shards: int, virtual_nodes: int) -> Column:
    """The arc of a ring position, found in the sorted points."""
    points, _ = ring(shards, virtual_nodes)

    @F.pandas_udf("int")
    def found(p: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, p.to_numpy(), side="left") % len(points)).astype(np.int32))

    return found(position)


def assign(rows: DataFrame, key: str, shards: int, virtual_nodes: int = 128, load: float = 1.0, order: tuple[str, ...] = (), bins: int = 32) -> DataFrame:
    """`rows` with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    Edge cases: a null key hashes as a value of its own; rows with equal keys share an arc, where the columns
    `order` deal them into bins and order them, so a repeated key overflows to further shards like any other
    rows (rows equal in all these columns are one bin); an empty table gives an empty one. Input columns named like the results (shard, slot) or
    beginning with `_ring_` are replaced.
    """
    _, owner = ring(shards, virtual_nodes)
    position = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0null"))), 32)
    # `_ring_at` comes first: with equal keys only, all other sorts decide nothing about balance
    placed = rows.withColumn("_ring_at", position).withColumn("_ring_arc", arc_of(F.col("_ring_at"), shards, virtual_nodes))
    placed = placed.withColumn("_ring_bin", F.pmod(F.xxhash64(key, *order), F.lit(bins)).cast("int"))
    held = np.zeros((len(owner), bins), np.int64)
    for arc, part, n in placed.groupBy("_ring_arc", "_ring_bin").count().collect():  # `bins` rows for each ring point at most
        held[arc, part] = n
    counts = held.sum(axis=1)
    before = np.cumsum(held, axis=1) - held
    total = int(counts.sum())
    segments = plan(counts, owner, capacities(total, shards, load))
    spark = rows.sparkSession
    by_arc: dict[int, list[tuple[int, int, int]]] = {}
    for arc, rank, shard, slot in segments:
        by_arc.setdefault(arc, []).append((rank, shard, slot))
    table = [(arc, before[arc].tolist(), *(list(x) for x in zip(*sorted(found), strict=True))) for arc, found in by_arc.items()]
    cuts = F.broadcast(spark.createDataFrame(table, "_ring_arc int, _ring_before array<bigint>, _ring_from array<bigint>, _ring_to array<int>, _ring_slot array<bigint>"))
    place = F.row_number().over(Window.partitionBy("_ring_arc", "_ring_bin").orderBy("_ring_at", key, *order)).cast("long") - 1
    ranked = placed.withColumn("_ring_place", place).join(cuts, "_ring_arc").withColumn("_ring_rank", F.get("_ring_before", F.col("_ring_bin")) + F.col("_ring_place"))
    at = F.aggregate("_ring_from", F.lit(0), lambda n, x: n + F.when(x <= F.col("_ring_rank"), 1).otherwise(0))
    ranked = ranked.withColumn("_ring_n", at)
    return (
        ranked.withColumn("shard", F.element_at("_ring_to", F.col("_ring_n")))
        .withColumn("slot", F.element_at("_ring_slot", F.col("_ring_n")) + F.col("_ring_rank") - F.element_at("_ring_from", F.col("_ring_n")))
        .drop("_ring_at", "_ring_arc", "_ring_bin", "_ring_before", "_ring_place", "_ring_rank", "_ring_n", "_ring_from", "_ring_to", "_ring_slot")
    )
