"""SimHash near-duplicates by a binary trie self-join within a Hamming budget.

Two fingerprints at most ``budget`` bits apart split into ``budget + 1`` blocks so that, from some
block on and around the ring of blocks, the first k blocks together differ in at most k - 1 bits.
So each fingerprint enters one trie for each block to start from, and a pair of nodes may have
differed in no bit of the first block, one of the first two, and so on: the traversal of node pairs
is cut as soon as it is over that. Tries are dealt out by their first bits; a node pair that still
holds too many rows is dealt out further down by the same rule. Within a task, subtrees that are
known to be of one component are not compared again, and a spanning forest is all that leaves it.

``near_duplicates`` links fingerprints of one word by their distance. ``similar_documents`` links
texts by the similarity of their shingle sets: sets meet in bands of their least hashes, as many rows
for each set however many sets there are, sketches tell likely pairs, the sets confirm them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, expand_rows, give_back, groups_of, map_batches, map_columns
from .components import roots

#: Lower-cases A-Z only.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits that name a trie task at first, and by which a task that is too large is dealt out further.
FIRST_BITS, MORE_BITS = 12, 6
#: Rows of a node pair above which it is dealt out, and rows of a task at about the most.
TASK_ROWS = 200_000
#: Leaf pairs compared at once.
_AT_ONCE = 1 << 20
SHINGLE, SEED = 4, 42
#: Words of a shingle of a set, and the least similarity of sets, as a fraction.
WIDE_SHINGLE, LEAST = 5, (4, 5)
#: Bands of a set, and the least hashes in each: sets meet that share a band; of similarity 0.8, all but 4 pairs in 10,000 do.
BANDS, PER_BAND = 20, 5
#: Least hashes of which a sketch has four bits, and how many of them may differ in likely pairs: 0.8 gives 18 on average, with a deviation of 4.
SKETCHED, FAR = 96, 32
#: Rows of bands in a task at about the most, elements hashed at once, and rows of a band of which all pairs are compared at once.
BAND_TASK_ROWS, _ELEMENTS, ALL_PAIRS = 50_000, 1 << 15, 512
#: Forests of likely pairs made of a band, and likely pairs for each node of the table above which one forest is confirmed before the others.
FORESTS, PAIRS_EACH = 8, 2
#: For bands of more rows, the differences up to which rows are linked, one after the other, so that the nearest are linked first.
_LEVELS = (8, 16, 24, FAR)
#: Multipliers of the hashes, and one that mixes.
_ODD = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(BANDS * PER_BAND)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Nodes whose sets are picked out by a broadcast (8 bytes each and some); beyond it by a shuffle join.
BROADCAST_NODES = 1_000_000


def _bounds(words: list[bytes], size: int) -> tuple[list[int], list[int]]:
    """Where each shingle begins and ends in the words joined by single spaces; fewer words than ``size`` are one."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return starts[: max(1, len(words) - size + 1)].tolist(), ends[min(size, len(words)) - 1 :].tolist()


def shingle_hashes(text: bytes | None, size: int, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each shingle of a text, repeats included; none, if it has no words."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    starts, ends = _bounds(words, size)
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of 64-bit words, the word of the bits that are set in over half the rows."""
    n, words = hashes.shape
    votes = np.zeros(64 * words, np.int64)
    for i in range(0, n, 1 << 13):
        bits = np.unpackbits(np.ascontiguousarray(hashes[i : i + (1 << 13)]).view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of 255 bits fit into a byte
            votes += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > n, bitorder="little").view("<u8")


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The bits set in over half the XXH64 of the text's shingles, as a signed 64-bit integer."""
    hashes = shingle_hashes(text, size, seed)
    return int(majority(hashes[:, None]).view("<i8")[0]) if len(hashes) else 0


def shingle_sets(texts: pa.Array, size: int = WIDE_SHINGLE) -> list[np.ndarray]:
    """Of each text the distinct hashes of its shingles, sorted: each mixes the XXH64 of its words by their places.

    A text of fewer words is one shingle; a null text, and one without words, has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = as_bytes(coded.dictionary)
    of_word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    own = coded.indices.to_numpy(zero_copy_only=False)
    # a text that begins or ends with white space has an empty word there
    full = np.fromiter(map(bool, words), bool, len(words))[own] if len(own) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(full)])
    at = before[lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)].tolist() if len(lists) else [0]
    h = of_word[own[full]] if len(own) else np.zeros(0, np.uint64)
    mixed: dict[int, np.ndarray] = {}
    out = []
    for i, j in zip(at, at[1:]):
        if i == j:
            out.append(np.zeros(0, np.uint64))
            continue
        n = min(size, j - i)
        if n not in mixed:
            x = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                x = (x ^ h[k : k + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
            mixed[n] = x
        x = np.sort(mixed[n][i : j - n + 1])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
    return out


def shingle_set(text: bytes | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    return shingle_sets(pa.array([text and text.decode()], pa.string()), size)[0]


def node_of(s: np.ndarray) -> int:
    """The number of a set: equal sets have the same."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """[set, hash]: the least of each of the hashes of a set's elements; of two sets, each is equal with a chance of their similarity."""
    out = np.zeros((len(sets), len(_ODD)), np.uint64)
    full = np.flatnonzero([len(s) for s in sets])
    for i, j in groups_of([len(sets[k]) for k in full], _ELEMENTS):
        some = [sets[k] for k in full[i:j]]
        x, first = np.concatenate(some), np.cumsum([0, *map(len, some[:-1])])
        for k, odd in enumerate(_ODD):
            out[full[i:j], k] = np.minimum.reduceat(x * odd, first)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """[set, band]: the numbers of the bands of least hashes."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), 1))
    for k in range(PER_BAND):
        key = (key ^ least[:, k::PER_BAND]) * _MIX
        key ^= key >> np.uint64(32)
    return key


def sketches(least: np.ndarray) -> np.ndarray:
    """[set, byte]: four bits of each of the first least hashes."""
    bits = ((least[:, :SKETCHED] * _MIX) >> np.uint64(60)).astype(np.uint8)
    return bits[:, ::2] | bits[:, 1::2] << 4


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of their hashes sketches (as 64-bit words, on the last axis) differ."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of ``LEAST`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, size: int = SHINGLE) -> DataFrame:
    """``carry`` columns (doc_id, unless named) and fp; a null or empty text has fingerprint zero."""

    def make():
        return lambda texts: [pa.array([fingerprint(t, size) for t in as_bytes(texts)], pa.int64())]

    return map_columns(docs, make, [text], "fp bigint", carry or ["doc_id"])


def ring_blocks(budget: int) -> list[int]:
    """Sizes of the blocks of 64 bits."""
    n = budget + 1
    return [64 // n + (i < 64 % n) for i in range(n)]


def budgets(budget: int) -> np.ndarray:
    """[start block, depth]: bits in which the first ``depth`` bits may differ."""
    sizes = ring_blocks(budget)
    out = np.zeros((len(sizes), 65), np.int64)
    for r in range(len(sizes)):
        depth = 0
        for k in range(len(sizes)):
            n = sizes[(r + k) % len(sizes)]
            out[r, depth : depth + n + 1] = np.maximum(out[r, depth : depth + n + 1], k)
            out[r, depth] = max(k - 1, 0)
            depth += n
        out[r, 64] = budget
    return out


def rotated(v: np.ndarray, r: np.ndarray, budget: int, back: bool = False) -> np.ndarray:
    """Bits rotated so that block ``r`` comes first (or back)."""
    before = np.concatenate([[0], np.cumsum(ring_blocks(budget))])[r].astype(np.uint64)
    a = (np.uint64(64) - before) % np.uint64(64) if back else before % np.uint64(64)
    return (v << a) | np.where(a > 0, v >> ((np.uint64(64) - a) % np.uint64(64)), np.uint64(0))


class Forest:
    """Components of rows, and the pairs that joined them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        """Join rows pairwise; of the pairs, only those that join two components are kept."""
        while len(u):
            a, b = self.label[u], self.label[v]
            new = a != b
            u, v, a, b = u[new], v[new], a[new], b[new]
            if not len(u):
                return
            # each component hangs itself, by one pair, on one of a smaller label
            high, at = np.unique(np.maximum(a, b), return_index=True)
            self.pairs.append((u[at], v[at]))
            to = np.arange(len(self.label))
            to[high] = np.minimum(a, b)[at]
            while not np.array_equal(far := to[to], to):
                to = far
            self.label = to[self.label]


def trie_join(value: np.ndarray, r: np.ndarray, tasks: list[np.ndarray], budget: int) -> Forest:
    """The components of rows, from all pairs of the tasks within the budget.

    ``value``: rotated bits, sorted within each node. ``r``: the start block (a trie each). ``tasks``: arrays
    a_lo, a_hi, b_lo, b_hi, err, depth; a node pair each, with a = b for a node and itself.
    """
    n = len(value)
    forest = Forest(n)
    allowed, r = budgets(budget), r.astype(np.int64)
    near = np.flatnonzero((np.bitwise_count(value[1:] ^ value[:-1]) <= budget) & (r[1:] == r[:-1]))
    forest.join(near, near + 1)
    t_depth = tasks[5]
    front = [np.zeros(0, np.int64)] * 5

    def settle(pairs: list[np.ndarray]) -> None:
        """Compare all leaves of the pairs."""
        al, ah, bl, bh, _ = pairs
        product = (ah - al) * (bh - bl)
        order = np.argsort(product, kind="stable")
        sums = np.cumsum(product[order])
        at = 0
        while at < len(order):
            upto = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _AT_ONCE, "right")))
            k = order[at:upto]
            at = upto
            p = product[k]
            first = np.cumsum(p) - p
            j = np.arange(int(p.sum())) - np.repeat(first, p)
            w = np.repeat(bh[k] - bl[k], p)
            u, v = np.repeat(al[k], p) + j // w, np.repeat(bl[k], p) + j % w
            hit = (u != v) & (np.bitwise_count(value[u] ^ value[v]) <= budget)
            if hit.any():
                forest.join(u[hit], v[hit])

    for depth in range(int(t_depth.min()) if len(t_depth) else 64, 65):
        own = t_depth == depth
        front = [np.concatenate([f, t[own]]) for f, t in zip(front, tasks[:5])]
        if not len(front[0]):
            continue
        label = forest.label
        changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]) if n else label
        al, ah, bl, bh, err = front
        one = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (label[al] == label[bl])
        front = [f[~one] for f in front]
        al, ah, bl, bh, err = front
        small = ((ah - al) * (bh - bl) <= 64) | (depth == 64)
        if small.any():
            settle([f[small] for f in front])
            front = [f[~small] for f in front]
            al, ah, bl, bh, err = front
        if depth == 64 or not len(al):
            continue
        ones = np.concatenate([[0], np.cumsum((value >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        cross = ~same
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), (am[cross], ah[cross], bl[cross], bm[cross], err[cross] + 1)]
        front = [np.concatenate(x) for x in zip(*parts)]
        al, ah, bl, bh, err = front
        keep = (ah > al) & (bh > bl)
        front = [f[keep] for f in front]
        keep = front[4] <= allowed[r[front[0]], depth + 1]
        front = [f[keep] for f in front]
    return forest


_TASK = ["r", "depth", "a", "b", "err"]


def trie_tasks(prints: DataFrame, budget: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """r, depth, a, b (prefixes of the node pair, a <= b), err, side, v (rotated): each fingerprint in each task that it has a part in.

    ``prints``: distinct fp.
    """
    first_bits = min(FIRST_BITS, *ring_blocks(budget))

    def first():
        def run(fp):
            n = len(fp)
            at = np.repeat(np.arange(n), budget + 1)
            r = np.tile(np.arange(budget + 1), n)
            v = rotated(fp.to_numpy().view(np.uint64)[at], r, budget)
            top = pa.array((v >> np.uint64(64 - first_bits)).astype(np.int64))
            none = pa.array(np.zeros(len(at), np.int64))
            yield at, [pa.array(r), pa.array(np.full(len(at), first_bits)), top, top, none, none, pa.array(v.view(np.int64))]

        return run

    made = "r bigint, depth bigint, a bigint, b bigint, err bigint, side bigint, v bigint"
    rows = expand_rows(prints, first, ["fp"], made)
    allowed = budgets(budget)
    done = None
    depth = first_bits
    while depth + MORE_BITS <= 64 - 4:
        large = cut(rows.groupBy(*_TASK).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_rows).drop("n"))
        if not large.limit(1).count():
            break
        small = rows.join(large, _TASK, "left_anti")
        done = small if done is None else done.unionByName(small)
        depth += MORE_BITS

        def deeper(depth=depth):
            def run(r, a, b, err, side, v):
                r, a, b, err, side, v = (x.to_numpy() for x in (r, a, b, err, side, v))
                own = ((v.view(np.uint64) >> np.uint64(64 - depth)) & np.uint64((1 << MORE_BITS) - 1)).astype(np.int64)
                most = allowed[r, depth] - err
                for mask in range(1 << MORE_BITS):
                    at = np.flatnonzero(mask.bit_count() <= most)
                    if not len(at):
                        continue
                    left, right = np.where(side[at] == 0, own[at], own[at] ^ mask), np.where(side[at] == 0, own[at] ^ mask, own[at])
                    p, q = a[at] << MORE_BITS | left, b[at] << MORE_BITS | right
                    # a node and itself: its parts take their sides by their order
                    swap = (a[at] == b[at]) & (p > q)
                    new_side = np.where(a[at] == b[at], swap, side[at])
                    p, q = np.where(swap, q, p), np.where(swap, p, q)
                    yield at, [pa.array(x) for x in (r[at], np.full(len(at), depth), p, q, err[at] + mask.bit_count(), new_side.astype(np.int64), v[at])]

            return run

        big = rows.join(large, _TASK, "left_semi")
        rows = cut(expand_rows(big, deeper, ["r", "a", "b", "err", "side", "v"], made))
    return rows if done is None else done.unionByName(rows)


def links(prints: DataFrame, budget: int = 4, task_rows: int = TASK_ROWS) -> DataFrame:
    """u, v: a forest of links, in each task, that joins all pairs at most ``budget`` bits apart.

    ``prints``: distinct fp.
    """
    tasks = trie_tasks(prints, budget, task_rows)
    n = prints.count() * (budget + 1)
    parts = min(-(-n // 20_000), prints.sparkSession.sparkContext.defaultParallelism * 4)
    tasks = tasks.repartition(max(1, parts if n < task_rows * 64 else -(-n // task_rows)), *_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        r, depth, a, b, err, side = (t.column(k).to_numpy() for k in (*_TASK, "side"))
        v = t.column("v").to_numpy().view(np.uint64)
        order = np.lexsort((v, side, err, b, a, depth, r))
        r, depth, a, b, err, side, v = (x[order] for x in (r, depth, a, b, err, side, v))
        keys = np.stack([r, depth, a, b, err])
        new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        ends = np.append(new[1:], len(v))
        # rows of the second side come last; a node with itself has one side only
        ones = np.concatenate([[0], np.cumsum(side)])
        mids = ends - (ones[ends] - ones[new])
        itself = a[new] == b[new]
        al, ah, bl, bh = new, np.where(itself, ends, mids), np.where(itself, new, mids), ends
        live = (ah > al) & (bh > bl)
        pairs = [x[live] for x in (al, ah, bl, bh, err[new], depth[new])]
        name = rotated(v, r, budget, back=True).view(np.int64)
        for u, w in trie_join(v, r, pairs, budget).pairs:
            yield pa.RecordBatch.from_arrays([pa.array(name[u]), pa.array(name[w])], names=["u", "v"])

    return map_batches(tasks, run, "u bigint, v bigint")


def _components(d: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``d`` (doc_id, node and more) with component_id: the smallest doc_id that a row's node reaches over ``edges`` (u, v)."""
    # a node is named by its smallest doc_id, or by a number above all of them; so the smallest name of a component is its id
    beyond = F.lit(str(1 << 63)).cast("decimal(20,0)")
    first = d.groupBy(node).agg(F.min("doc_id").alias("first"))
    named = cut(first.select(node, F.coalesce(F.col("first").cast("decimal(20,0)"), beyond * 2 + F.col(node)).cast("decimal(20,0)").alias("name")))
    of = lambda x: named.select(F.col(node).alias(x), F.col("name").alias(f"{x}_name"))
    e = edges.select("u", "v").where("u != v").distinct().join(of("u"), "u").join(of("v"), "v").select(F.col("u_name").alias("u"), F.col("v_name").alias("v"))
    root = roots(e).withColumnRenamed("node", "name")
    own = named.join(root, "name", "left").select(node, F.coalesce("root", "name").alias("root"))
    own = own.select(node, F.when(F.col("root") < beyond, F.col("root").cast("long")).alias("component_id"))
    return d.join(own, node)


def near_duplicates(docs: DataFrame, *, budget: int = 4, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, fp, fingerprint, component_id: the smallest doc_id reachable over links, for every row.

    Equal fingerprints are one node. A null doc_id belongs to its component, and is its id only if no
    doc_id in it is known. Texts without words have fingerprint zero, linked like any other.
    """
    d = cut(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), size=size))
    edges = links(d.select("fp").distinct(), budget, task_rows)
    return _components(d, edges, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(k).to_pylist() for k in ("a", "b"))
            hit = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, c)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(hit)

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    return map_batches(both.select("u", "v", "a", "b"), run, "u bigint, v bigint")


def _all_pairs(sketch: np.ndarray, size: np.ndarray) -> Iterator[Forest]:
    """Forests of likely pairs that share no pair, from all pairs of rows of each band, the nearest first: the bands' rows follow each other, ``size`` in each."""
    n, square = len(sketch), size * size
    j = np.arange(int(square.sum())) - np.repeat(np.cumsum(square) - square, square)
    w, begin = np.repeat(size, square), np.repeat(np.cumsum(size) - size, square)
    u, v = begin + j // w, begin + j % w
    u, v = u[u < v], v[u < v]
    d = differing(sketch[u], sketch[v])
    u, v, d = (x[d <= FAR] for x in (u, v, d))
    for _ in range(FORESTS):
        if not len(u):
            return
        forest = Forest(n)
        for level in np.unique(d):
            forest.join(u[d == level], v[d == level])
        yield forest
        left = ~np.isin(u * n + v, np.concatenate([x * n + y for x, y in forest.pairs]))
        u, v, d = u[left], v[left], d[left]


def _met(sketch: np.ndarray) -> Forest:
    """Links of the rows of one band without all pairs at once: rows are compared with those that none has met yet."""
    forest = Forest(len(sketch))
    for most in _LEVELS:
        _, part, n = np.unique(forest.label, return_inverse=True, return_counts=True)
        rows, begin = np.argsort(part, kind="stable"), np.cumsum(n) - n
        unmet, us, vs = np.arange(len(sketch)), [], []
        met = np.zeros(len(n), bool)
        for p in np.argsort(-n, kind="stable"):
            if met[p]:
                continue
            met[p] = True
            unmet = unmet[part[unmet] != p]
            queue = [rows[begin[p] : begin[p] + n[p]]]
            while queue and len(unmet):
                q, step = queue.pop(), max(1, (1 << 17) // len(unmet))
                if len(q) > step:
                    queue.append(q[step:])
                    q = q[:step]
                d = differing(sketch[q][:, None], sketch[unmet][None])
                least = d.argmin(axis=0)
                hit = np.flatnonzero(d[least, np.arange(len(unmet))] <= most)
                if len(hit):
                    us.append(q[least[hit]])
                    vs.append(unmet[hit])
                    met[new := np.unique(part[vs[-1]])] = True
                    unmet = unmet[~met[part[unmet]]]
                    queue.append(np.concatenate([rows[begin[k] : begin[k] + n[k]] for k in new]))
            if not len(unmet):
                break
        if us:
            forest.join(np.concatenate(us), np.concatenate(vs))
    return forest


def band_links(nodes: DataFrame, task_rows: int = BAND_TASK_ROWS) -> DataFrame:
    """u, v, forest: likely pairs of nodes that share a band, as their sketches differ in at most ``FAR`` hashes.

    Of a band of up to ``FORESTS`` + 1 nodes, all of them; of a larger one so many forests (forest 0 joins all that
    likely pairs join), so that what a wrong pair seems to join is joined by others.

    ``nodes``: node (each once), sketch and bands, as bytes.
    """

    def split():
        def run(keys):
            k = np.frombuffer(b"".join(keys.to_pylist()), np.int64)
            yield np.repeat(np.arange(len(keys)), BANDS), [pa.array(k)]

        return run

    rows = expand_rows(nodes.select("node", "sketch", "bands"), split, ["bands"], "band bigint", ["node", "sketch"])
    rows = rows.repartition(max(1, -(-nodes.count() * BANDS // task_rows)), "band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        band, node = t.column("band").to_numpy(), t.column("node").to_numpy()
        order = np.lexsort((node, band))
        new = np.flatnonzero(np.concatenate([[True], np.diff(band[order]) != 0]))
        size = np.diff(np.append(new, len(order)))
        order, size = order[np.repeat(size > 1, size)], size[size > 1]
        node = node[order]
        sketch = np.frombuffer(b"".join(t.column("sketch").take(pa.array(order)).to_pylist()), np.uint64).reshape(-1, SKETCHED // 16)
        begin = np.cumsum(size) - size
        for i, j in groups_of((size * size).tolist(), ALL_PAIRS * ALL_PAIRS):
            lo, hi = int(begin[i]), int(begin[j - 1] + size[j - 1])
            if size[i] > ALL_PAIRS:
                orders = [np.random.default_rng(k).permutation(hi - lo) for k in range(FORESTS)]
                forests = ((x, _met(sketch[lo:hi][x])) for x in orders)
            else:
                forests = ((np.arange(hi - lo), x) for x in _all_pairs(sketch[lo:hi], size[i:j]))
            for k, (at, forest) in enumerate(forests):
                if forest.pairs:
                    u, v = (node[lo + at[np.concatenate(x)]] for x in zip(*forest.pairs))
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), k))], names=["u", "v", "forest"])
        give_back()

    return map_batches(rows, run, "u bigint, v bigint, forest bigint")


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", task_rows: int = BAND_TASK_ROWS) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over pairs of texts whose sets of five-word shingles are 0.8 similar or more, for every row.

    Pairs are found by bands of least hashes, so a few of similarity near 0.8 may be missed (of similarity 0.8
    exactly, a pair alone is met with a chance of 0.999, nearer ones surely); no pair of a lower similarity is a link.
    Equal sets are one node. A null doc_id belongs to its component, and is its id only if no doc_id in it is
    known. Texts without words are equal. Repeated rows count once; an empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))))

    def prints():
        def run(texts):
            sets = shingle_sets(texts)
            least = least_hashes(sets)
            return pa.array([node_of(s) for s in sets], pa.int64()), *(pa.array([x.tobytes() for x in f(least)], pa.binary()) for f in (sketches, bands))

        return run

    def whole():
        def run(texts):
            sets = shingle_sets(texts)
            return pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())

        return run

    d = cut(map_columns(docs, prints, ["text"], "node bigint, sketch binary, bands binary", ["doc_id", "row"]))
    nodes = cut(d.groupBy("node").agg(F.min("row").alias("row"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))

    pairs = cut(band_links(nodes, task_rows).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "forest").where("u != v").groupBy("u", "v").agg(F.min("forest").alias("forest")))
    wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "row"), "node").select("row").distinct())
    if n := wanted.count():
        some = docs.join(F.broadcast(wanted) if n <= BROADCAST_NODES else wanted, "row", "left_semi")
        sets = cut(map_columns(some, whole, ["text"], "node bigint, s binary").dropDuplicates(["node"]))
        if pairs.count() <= PAIRS_EACH * nodes.count():
            pairs = cut(_confirmed(pairs, sets))
        else:
            # what one forest has joined is not compared again
            found = cut(_confirmed(pairs.where("forest = 0"), sets))
            root = roots(found)
            of = lambda x: root.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
            rest = cut(pairs.where("forest > 0").join(of("u"), "u", "left").join(of("v"), "v", "left").where("coalesce(u_root, u) != coalesce(v_root, v)").select("u", "v"))
            pairs = found.unionByName(cut(_confirmed(rest, sets)))
    return _components(d.select("doc_id", "node"), pairs, "node")
