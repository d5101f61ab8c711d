"""Consistent-hash ring with virtual nodes and bounded loads.

The ring's points cut it into arcs. A key lies on the arc of its hash; the shard of the arc's end
takes it, or, if that shard is full, the next one clockwise with room. With loads bounded by a share
that differs by at most one row between shards, counts end at most one apart.

Only counts are needed to say where an arc's keys go: the driver lets the arcs' counts flow
clockwise (arcs are few, as many for any input) and gets, for each arc, ranges of ranks with a shard
and a first slot each. Every row then takes its place by its rank within its arc.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_columns

#: Points of each shard on the ring.
VIRTUAL_NODES = 128
#: Rows that are ranked in one task at about the most.
RANKED_ROWS = 100_000
_RING = 1 << 32


def ring(shards: int, virtual: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(point, shard) in ring order; points are below 2^32."""
    return sorted((xxhash.xxh64_intdigest(f"{s}/{v}".encode(), 7) % _RING, s) for s in range(shards) for v in range(virtual))


def flow(counts: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each arc, (first rank, how many, shard, first slot) of its keys in rank order.

    Each arc offers its keys to its own shard first, arcs in ring order; what is left moves one point
    on, and so around the ring until all are placed. The rooms must sum to the counts at least.
    """
    n, used = len(counts), [0] * len(room)
    placed: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]
    waiting = [(a, 0, c) for a, c in enumerate(counts) if c]
    hops = 0
    while waiting:
        later = []
        for a, first, left in waiting:
            s = owners[(a + hops) % n]
            if take := min(left, room[s] - used[s]):
                placed[a].append((first, take, s, used[s]))
                used[s] += take
            if left > take:
                later.append((a, first + take, left - take))
        waiting, hops = later, hops + 1
        assert hops <= n or not waiting, "the shards have no room for all keys"
    return placed


def assign_shards(docs: DataFrame, shards: int = 16, *, virtual: int = VIRTUAL_NODES, key: str = "doc_id", text: str = "text", ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law moves rows when shards are added).

    A row's place on the ring is the hash of its key; equal keys follow each other by text, and rows
    alike in both are interchangeable. A null key counts as a key of its own, a null text as empty.
    """
    points = ring(shards, virtual)
    ends, owners = [p for p, _ in points], [s for _, s in points]
    d = docs.select(F.col(key).alias("doc_id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    d = d.withColumns({"size": F.col("size") + 1, "_at": F.xxhash64("doc_id"), "_more": F.xxhash64("doc_id", "text_crc32")})

    def make():
        def run(at):
            return [pa.array([bisect.bisect_left(ends, x % _RING) % len(ends) for x in at.to_pylist()], pa.int32())]

        return run

    d = map_columns(d, make, ["_at"], "_arc int", d.columns)
    rows = docs.count()
    parts = max(1, -(-rows // (ranked_rows * 16)))
    d = d.withColumn("_part", F.pmod("_more", F.lit(parts)).cast("int"))
    by_part = cut(d.groupBy("_arc", "_part").agg(F.count(F.lit(1)).alias("_n")))
    counts = [0] * len(points)
    for r in by_part.groupBy("_arc").agg(F.sum("_n").alias("n")).collect():  # a row an arc
        counts[r["_arc"]] = r["n"]
    share, more = divmod(rows, shards)
    placed = flow(counts, owners, [share + (s < more) for s in range(shards)])
    held = docs.sparkSession.sparkContext.broadcast([([x[0] for x in p], p) for p in placed])  # an entry an arc, and at most one more a shard that fills up
    before = by_part.select("_arc", "_part", (F.sum("_n").over(Window.partitionBy("_arc").orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_arc", "_part").orderBy("_at", "doc_id", "text_crc32", "size"))
    ranked = d.withColumn("_rank", rank).join(before, ["_arc", "_part"]).withColumn("_rank", F.col("_before") + F.col("_rank") - 1)

    def place():
        by_arc = held.value

        def run(arc, rank):
            shard, slot = [], []
            for a, r in zip(arc.to_pylist(), rank.to_pylist()):
                firsts, own = by_arc[a]
                first, _, s, base = own[bisect.bisect_right(firsts, r) - 1]
                shard.append(s)
                slot.append(base + r - first)
            return pa.array(shard, pa.int32()), pa.array(slot, pa.int64())

        return run

    out = map_columns(ranked, place, ["_arc", "_rank"], "shard int, slot bigint", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
