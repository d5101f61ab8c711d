"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A hash turns unit vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and gives the signed axis that each is nearest to. A table joins several hashes; with the
vectors their number grows, and of the last the axes that it tells apart, so that buckets keep to a few
vectors each. A query looks into the buckets whose axes lie nearest to it (``probes`` in each table), and
what it finds is ranked by the exact cosine.

Rows are dealt out by cells, the buckets of all hashes but the last: a query goes once to each cell that
it probes, with the last axes that it asks for there. Cells are joined with their queries in blocks of
bounded size, so a cell of any size is split; equal vectors are one candidate that carries its smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches

#: Tables, and a query's probes in each for every bucket that the first hash has; more tables or probes find more.
TABLES, PROBES = 10, 12 / 128
#: How the probes grow with the buckets of a table, measured on independent vectors.
GROWTH = 0.57
#: Distinct vectors below which a table is so sparse that probes are added (as many again at this number).
SPARSE = 1000
#: Vectors of a cell, and queries, that one task compares at once.
BLOCK = 4096
SEED = 20_240_607


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The pseudo-rotation of a table on rows of ``x``, padded to a power of two."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    v = np.zeros((len(x), n))
    v[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table, n])
    for _ in range(3):
        v = v * rng.choice([-1.0, 1.0], n)
        h = 1
        while h < n:  # fast Walsh-Hadamard transform
            v = v.reshape(-1, n // (2 * h), 2, h)
            v = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(-1, n)
            h *= 2
        v /= np.sqrt(n)
    return v


@dataclass(frozen=True)
class Shape:
    """The hashes of a table: how many tell cells apart, the axes of the last, and the probes."""

    cells: int
    last: int
    probes: int


def shape_of(n: int, dimension: int, probes: float = PROBES) -> Shape:
    """The shape for ``n`` distinct vectors: cells of at most about ``BLOCK`` of them, buckets of about four."""
    first = 2 << max(0, dimension - 1).bit_length()
    cells = 1
    while n > BLOCK * first**cells:
        cells += 1
    last = 1 << max(0, math.floor(math.log2(max(1.0, n / 4 / first**cells))))
    last = min(first, last)
    buckets = first**cells * last
    wanted = probes * first * (buckets / first) ** GROWTH * (1 + SPARSE / max(n, 1))
    return Shape(cells, last, max(1, min(buckets, math.ceil(wanted))))


def _values(x: np.ndarray, table: int, hash_: int, axes: int) -> np.ndarray:
    """How near each row is to each of the first signed axes of a hash: 2 i for +i, 2 i + 1 for -i. One axis: all the same."""
    if axes == 1:
        return np.zeros((len(x), 1))
    v = rotate(x, table * 64 + hash_)[:, : axes // 2]
    return np.stack([v, -v], axis=2).reshape(len(v), -1)


def buckets_of(x: np.ndarray, table: int, shape: Shape) -> np.ndarray:
    """The bucket of each row: the nearest axes of all hashes as one number, the last hash in its lowest digit."""
    first = 2 << max(0, x.shape[1] - 1).bit_length()
    code = np.zeros(len(x), np.int64)
    for h in range(shape.cells + 1):
        axes = first if h < shape.cells else shape.last
        code = code * axes + _values(x, table, h, axes).argmax(axis=1)
    return code


def probes_of(x: np.ndarray, table: int, shape: Shape) -> np.ndarray:
    """The buckets whose axes lie nearest to each row, by the sum over hashes of what they lie farther off than the nearest."""
    first = 2 << max(0, x.shape[1] - 1).bit_length()
    out = []
    for i in range(0, len(x), 32):
        part = x[i : i + 32]
        code, far = np.zeros((len(part), 1), np.int64), np.zeros((len(part), 1))
        for h in range(shape.cells + 1):
            axes = first if h < shape.cells else shape.last
            near = _values(part, table, h, axes)
            off = near.max(axis=1, keepdims=True) - near
            both = (far[:, :, None] + off[:, None, :]).reshape(len(part), -1)
            codes = (code[:, :, None] * axes + np.arange(axes)).reshape(len(part), -1)
            keep = min(shape.probes, both.shape[1])
            at = np.argpartition(both, keep - 1, axis=1)[:, :keep]
            far, code = np.take_along_axis(both, at, 1), np.take_along_axis(codes, at, 1)
        out.append(code)
    return np.concatenate(out) if out else np.zeros((0, 1), np.int64)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x: vectors that are not null or zero and have finite components only. Components stay floats if they are."""
    kind = vectors.schema[embedding].dataType
    exact = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{exact}>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda e: e != 0))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of vectors by their number of components, and those vectors."""
    lengths = np.diff(column.offsets.to_numpy())
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield at, flat.reshape(len(at), n)


def _filed(rows: DataFrame, tables: int, shape: Shape | None, block: int) -> DataFrame:
    """rows (pid, x, ids, query) in each cell that they lie in or probe: n (components), cell, last (axes).

    Without a shape vectors are dealt to cells by their numbers, and queries to all of them.
    """
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("n int, cell bigint, last array<int>")])
    names = schema.names

    def files(x: np.ndarray, query: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Row, cell, and where the row's axes begin in the list of axes."""
        for t in range(tables):
            code = probes_of(x, t, shape) if query else buckets_of(x, t, shape)[:, None]
            code = np.sort(code, axis=1)
            row = np.repeat(np.arange(len(x)), code.shape[1])
            cell, last = code.ravel() // shape.last, code.ravel() % shape.last
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])) if len(row) else row
            yield row[new], cell[new] * tables + t, np.append(new, len(row)), last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            query = b.column("query").to_numpy(zero_copy_only=False) if b.num_rows else ()
            for q in (True, False):
                own = np.flatnonzero(np.array(query, bool) == q)
                part = b.take(pa.array(own))
                for at, x in _by_length(part.column("x")) if len(own) else ():
                    for i in range(0, len(x), 512):
                        for row, cell, begins, last in files(x[i : i + 512], q):
                            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(last.astype(np.int32)))
                            yield pa.RecordBatch.from_arrays([*part.take(pa.array(at[i + row])).columns, pa.array(np.full(len(row), x.shape[1], np.int32)), pa.array(cell), lists], names=names)

    if shape is None:
        parts = max(1, -(-rows.where("not query").count() // block))
        every = F.sequence(F.lit(0), F.lit(parts - 1))
        own = F.array(F.pmod(F.col("pid"), F.lit(parts)).cast("int"))
        spread = rows.withColumn("part", F.explode(F.when(F.col("query"), every).otherwise(own)))
        return spread.select(*rows.columns, F.size("x").alias("n"), F.col("part").cast("long").alias("cell"), F.array(F.lit(0)).alias("last"))
    return map_batches(rows, run, schema)


def _search(points: DataFrame, queries: DataFrame, tables: int, shape: Shape | None, k: int, block: int) -> DataFrame:
    """query_id, qid, pid, ids, score: the best ``k + 1`` distinct vectors of each block of a cell for each query."""
    filed = _filed(points.unionByName(queries), tables, shape, block)
    key = ["n", "cell"]
    sizes = filed.groupBy(*key).agg(F.sum((~F.col("query")).cast("int")).alias("p"), F.sum(F.col("query").cast("int")).alias("q")).where("p > 0 and q > 0")
    sizes = cut(sizes.select(*key, F.ceil(F.col("p") / block).cast("int").alias("pb"), F.ceil(F.col("q") / block).cast("int").alias("qb")))
    both = filed.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, key)
    # a row of one side goes to one block of its own and to all of the other side's
    own = F.pmod(F.xxhash64("pid", "cell"), F.when(F.col("query"), F.col("qb")).otherwise(F.col("pb")).cast("long")).cast("int")
    both = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("pb")).otherwise(F.col("qb")) - 1)))
    both = both.select(*key, F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("j"), "id", "pid", "x", "ids", "query", "last")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        _, x = next(_by_length(t.column("x").combine_chunks()))
        ids, query, pid = t.column("id").to_numpy(), t.column("query").to_numpy(zero_copy_only=False), t.column("pid").to_numpy()
        lists = t.column("last").combine_chunks()
        last, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
        asks = query[row]
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for f in np.unique(last[~asks]):
            at = last == f
            pa_, qa = row[at & ~asks], row[at & asks]
            for i in range(0, len(qa), 256):
                near = unit[qa[i : i + 256]] @ unit[pa_].T
                if near.shape[1] > k + 1:
                    least = np.partition(near, near.shape[1] - k - 1, axis=1)[:, near.shape[1] - k - 1] - 1e-9
                    u, v = np.nonzero(near >= least[:, None])
                else:
                    u, v = np.nonzero(np.ones_like(near, bool))
                found.append((qa[i : i + 256][u], pa_[v]))
        u, v = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        score = cosine(x[u], x[v])
        order = np.lexsort((ids[v], -score, u))
        u, v, score = u[order], v[order], score[order]
        begins = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else u
        nth = np.arange(len(u)) - np.repeat(begins, np.diff(np.append(begins, len(u))))
        u, v, score = (z[nth <= k] for z in (u, v, score))
        return pa.table({"query_id": pa.array(ids[u]), "qid": pa.array(pid[u]), "pid": pa.array(pid[v]), "ids": t.column("ids").combine_chunks().take(pa.array(v)), "score": pa.array(score)})

    return both.groupBy(*key, "i", "j").applyInArrow(compare, "query_id bigint, qid bigint, pid bigint, ids array<bigint>, score double")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; a row's result does not depend on its place."""
    dot = lambda x, y: (x * y).sum(axis=1)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.dropDuplicates(["qid", "pid"])
    each = one.select("query_id", "qid", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "qid")


def nearest(vectors: DataFrame, *, every: int = 50, k: int = 5, tables: int = TABLES, probes: float = PROBES, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose id is divisible by ``every``.

    Vectors that are null, zero or not finite, or have no id, take no part. Repeated rows (same id and vector)
    count once; one id with several vectors is several candidates, and several queries, none of which finds
    another; ties go to the smaller vec_id. Vectors are compared with those of as many components. A query for
    which the buckets hold fewer than ``k`` others is searched again over all vectors. An empty table gives an
    empty result. Other columns are not read.
    """
    v = usable(vectors, vec_id, embedding).distinct()
    # of equal vectors only the smallest ids can be among the k nearest, and the query's own
    nth = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    points = v.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = cut(points.select(F.element_at("ids", 1).alias("id"), F.xxhash64("x").alias("pid"), "x", "ids", F.lit(False).alias("query")))
    queries = cut(v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("id"), F.xxhash64("vec_id", "x").alias("pid"), "x", F.array().cast("array<bigint>").alias("ids"), F.lit(True).alias("query")))
    n, longest = points.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    shape = shape_of(n, longest or 1, probes)
    best = cut(_best(_search(points, queries, tables, shape, k, block), k))
    out = ["query_id", "rank", "vec_id", "score"]
    short = cut(queries.join(best.groupBy(F.col("qid").alias("pid")).agg(F.count(F.lit(1)).alias("got")).where(F.col("got") >= k), "pid", "left_anti").select(*queries.columns))
    if not short.limit(1).count():
        return best.select(*out)
    rest = _best(_search(points, short, 1, None, k, block), k)
    return best.join(short.select(F.col("pid").alias("qid")), "qid", "left_anti").unionByName(rest.select(*best.columns)).select(*out)
