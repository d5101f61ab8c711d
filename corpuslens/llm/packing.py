"""Best-fit packing by bin completion: documents into as few fixed-length sequences as possible.

Lengths of pieces are small integers, so their histogram (at most ``capacity`` entries, whatever
the input) says all that packing needs. The driver packs the histogram by branch and bound. A branch
completes a sequence around the largest length left: undominated fillings of its room are tried, the
fullest first, each as often as the counts allow at once. A branch ends when its waste leaves no way to
beat the incumbent, which is the best-fit-decreasing plan at first. The plan, a list of sequences by
pattern, is then dealt out to the pieces by their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_columns
from .tokens import encoder

#: Branches that the search for a plan tries after its first dive, and fillings that it looks at in each. They bound the driver's
#: time, not the plan's quality at the first dive; the incumbent stands when they run out. None for no bound: then the plan is optimal.
BRANCHES, FILLINGS = 100, 8
#: Dominated fillings that it passes over in a branch.
PASSED = 64
#: Rows that are ranked in one task at about the most.
RANKED_ROWS = 100_000


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token ids of each text and an end id, cut at ``capacity``.

    A null or empty text has the end id alone. Repeated rows give repeated pieces.
    """

    def make():
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def run(column):
            ids, at = enc.encode(column)
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            lengths, crcs = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                n = b - a + 1
                cuts = range(0, n, capacity)
                lengths.append([min(capacity, n - c) for c in cuts])
                crcs.append([zlib.crc32(end, zlib.crc32(raw[4 * (a + c) : 4 * b])) if c + capacity >= n else zlib.crc32(raw[4 * (a + c) : 4 * (a + c + capacity)]) for c in cuts])
            return pa.array(lengths, pa.list_(pa.int64())), pa.array(crcs, pa.list_(pa.int64()))

        return run

    cutup = map_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), make, ["text"], "lengths array<bigint>, crcs array<bigint>", ["doc_id"])
    p = cutup.select("doc_id", F.posexplode(F.arrays_zip("lengths", "crcs")).alias("piece", "x"))
    return p.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("x.lengths").alias("length"), F.col("x.crcs").alias("ids_crc32"))


Pattern = tuple[tuple[int, int], ...]  # (length, how many), the largest length first


def fillings(counts: np.ndarray, room: int, passed: int | None = None) -> Iterator[Pattern]:
    """Undominated fillings of ``room`` by lengths that have a count left, the fullest first, of equally full ones that with larger lengths.

    One that could take a further length, or a larger one in place of one or more of its own, is dominated. The
    first filling never is; with ``passed`` the list ends after so many that are.
    """
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0][::-1].tolist()
    most = [min(int(counts[n]), room // n) for n in have]
    # sums that the lengths from each on can have, as bits
    bits, reach = (1 << room + 1) - 1, [1] * (len(have) + 1)
    for i in range(len(have) - 1, -1, -1):
        r, k, step = reach[i + 1], most[i], 1
        while k:
            r |= r << min(step, k) * have[i] & bits
            k -= min(step, k)
            step *= 2
        reach[i] = r & bits
    below = [-n for n in have]

    def of_sum(i: int, left: int) -> Iterator[Pattern]:
        """The ways to ``left`` by lengths from the i-th on; every step can be completed."""
        if not left:
            yield ()
            return
        i = max(i, bisect.bisect_left(below, -left))
        while i < len(have):
            n, after = have[i], reach[i + 1]
            for k in range(min(most[i], left // n), 0, -1):
                if after >> (left - k * n) & 1:
                    for rest in of_sum(i + 1, left - k * n):
                        yield ((n, k), *rest)
            if not after >> left & 1:
                return
            i += 1

    for total in range(room, -1, -1):
        if reach[0] >> total & 1:
            for f in of_sum(0, total):
                if not _dominated(f, counts, room - total):
                    yield f
                elif passed is not None:
                    passed -= 1
                    if passed < 0:
                        return


def _dominated(filling: Pattern, counts: np.ndarray, slack: int) -> bool:
    """Whether some of the filling (or nothing) can be exchanged for one larger length that is left, or several for one as large."""
    left = counts.copy()
    one = any_sum = 1
    several = 0  # sums of two or more members
    for n, k in filling:
        left[n] -= k
        for _ in range(k):
            several |= several << n | (any_sum & ~1) << n
            any_sum |= any_sum << n
    one = int.from_bytes(np.packbits(left > 0, bitorder="little").tobytes(), "little") & ~1
    if several & one:
        return True
    # sums raised by 1 to ``slack``
    spread, width = any_sum << 1, 1
    if not slack:
        return False
    while width < slack:
        step = min(width, slack - width)
        spread |= spread << step
        width += step
    return bool(spread & one)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the larger of the volume bound and Martello and Toth's bound over all thresholds."""
    n = np.arange(len(counts))
    best = -(-int((counts * n).sum()) // capacity)
    over = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    volume = np.concatenate([[0], np.cumsum(counts * n)])
    half = capacity // 2
    a = np.arange(half + 1)
    large = np.where(a > 0, over[np.minimum(capacity - a + 1, len(counts))], 0)
    middle = over[half + 1] - large
    free = middle * capacity - (volume[capacity - a + 1] - volume[half + 1])
    small = volume[half + 1] - volume[a]
    return max(best, int((large + middle + np.maximum(0, -(-(small - free) // capacity))).max()))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing: each length, from the largest on, goes to the fullest sequences that it fits into; equal sequences are filled together."""
    by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append((pattern, times))

    for n in np.flatnonzero(counts)[::-1].tolist():
        c = int(counts[n])
        while c and n:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, pattern, times = capacity, (), c
            each = room // n
            full = min(times, c // each)
            put(room - each * n, (*pattern, (n, each)), full)
            c -= full * each
            if full < times and c:
                put(room - min(c, each) * n, (*pattern, (n, min(c, each))), 1)
                full += 1
                c -= min(c, each)
            if pattern:
                put(room, pattern, times - full)
    return [x for group in by_room.values() for x in group]


def plan(counts: np.ndarray, capacity: int, *, branches: int | None = BRANCHES, width: int | None = FILLINGS, passed: int | None = PASSED) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences have each: as few sequences as the search finds, never more than by best fit decreasing.

    Depth-first bin completion without recursion. A state (the counts left) is entered again only with fewer sequences than before.
    """
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    best = best_fit(counts, capacity)
    best_used, bound = sum(k for _, k in best), lower_bound(counts, capacity)
    sizes = np.arange(len(counts))
    made: list[tuple[Pattern, int]] = []
    seen: dict[bytes, int] = {}
    dived, left = False, branches
    stack: list[tuple[np.ndarray, int, Iterator[tuple[Pattern, int]]]] = []

    def ways(c: np.ndarray) -> Iterator[tuple[Pattern, int]]:
        """Fillings around the largest length left and how often to take them: as often as can be, then half as often, and so on."""
        largest = int(np.flatnonzero(c)[-1])
        c = c.copy()
        c[largest] -= 1
        for i, f in enumerate(fillings(c, capacity - largest, passed)):
            if width is not None and i >= width:
                return
            pattern = ((largest, f[0][1] + 1), *f[1:]) if f and f[0][0] == largest else ((largest, 1), *f)
            times = min((int(c[n]) + (n == largest)) // k for n, k in pattern)
            while times:
                yield pattern, times
                times //= 2

    stack.append((counts, 0, ways(counts) if counts.any() else iter(())))
    while stack and best_used > bound:
        if dived and left is not None and left <= 0:
            break
        c, used, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            if made:
                made.pop()
            continue
        if dived and left is not None:
            left -= 1
        pattern, times = step
        after = c.copy()
        for n, k in pattern:
            after[n] -= k * times
        now = used + times
        if not after.any():
            dived = True
            if now < best_used:
                best, best_used = [*made, step], now
            continue
        # waste bound: what is left needs its volume at least, and two lengths over one half never share a sequence
        if now + -(-int((after * sizes).sum()) // capacity) >= best_used or (dived or times == 1) and now + lower_bound(after, capacity) >= best_used:
            dived = True
            continue
        key = after.tobytes()
        if seen.get(key, now + 1) <= now:
            continue
        if dived:
            seen[key] = now
        made.append(step)
        stack.append((after, now, ways(after)))
    return best


def pack(pieces: DataFrame, *, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """``pieces`` (key, piece, length from 1 to capacity, and more) with sequence_id and offset: no sequence holds more than ``capacity``, offsets are gapless from 0.

    Equal lengths take their places in the order of a hash of key and piece; rows that are alike in
    both are interchangeable. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    # repeated rows of one key are told apart by the task that made them; the checkpoint keeps that number
    p = cut(pieces.withColumn("_task", F.spark_partition_id()))
    parts = max(1, -(-p.count() // RANKED_ROWS))
    p = p.withColumn("_part", F.pmod(F.xxhash64(key, "piece", "_task"), F.lit(parts)).cast("int"))
    by_part = cut(p.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")))
    histogram = by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    segments: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken, sequence = np.zeros(capacity + 1, np.int64), 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for n, k in pattern:
            segments.setdefault(n, []).append((int(taken[n]), sequence, k, offset, n))
            taken[n] += k * times
            offset += n * k
        sequence += times
    # bounded by `capacity` and `branches`, not by the input: each pattern of a dive leaves of some length fewer than it takes, and has at most 64 different lengths
    plan_of = spark.sparkContext.broadcast({n: tuple(np.array(x, np.int64) for x in zip(*s)) for n, s in segments.items()})

    from pyspark.sql import Window

    before = by_part.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy(F.xxhash64(key, "piece"), key, "piece"))
    ranked = p.withColumn("_rank", within).join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_rank") - 1)

    def make():
        held = plan_of.value

        def run(length, rank):
            length, rank = length.to_numpy(), rank.to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, k, start, size = held[int(n)]
                s = np.searchsorted(first, rank[at], side="right") - 1
                j = rank[at] - first[s]
                seq[at] = base[s] + j // k[s]
                off[at] = start[s] + (j % k[s]) * size[s]
            return pa.array(seq), pa.array(off)

        return run

    return map_columns(ranked, make, ["length", "_rank"], "sequence_id bigint, offset bigint", pieces.columns)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents."""
    return pack(token_pieces(docs, tokenizer, capacity=capacity), capacity=capacity)
