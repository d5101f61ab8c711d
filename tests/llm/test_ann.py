import numpy as np
import pytest

from corpuslens.llm import ann, queries
from corpuslens.llm.common import bounded_batches


def brute(rows, every=50, k=5):
    rows = sorted({(i, tuple(x)) for i, x in rows if i is not None and x is not None and all(e is not None and np.isfinite(e) for e in x) and any(x)})
    out = {}
    for q, x in rows:
        if q % every:
            continue
        scored = sorted((-float(ann.cosine(np.array([x]), np.array([y]))[0]), i) for i, y in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_small_table_is_searched_exactly(spark):
    bounded_batches(spark)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)] + [(7, rows[7][1])]
    rows += [(300, None), (350, [0.0] * 6), (400, [float("nan")] * 6), (450, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    for block in (4096, 16):
        got, want = collected(ann.nearest(df, block=block)), brute(rows)
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    assert ann.nearest(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert {q: len(v) for q, v in collected(ann.nearest(few)).items()} == {0: 2}
    # buckets that hold too few others are made up for
    scarce, want = collected(ann.nearest(df, tables=1, probes=1e-9)), brute(rows)
    assert {q: len(v) for q, v in scarce.items()} == {q: len(v) for q, v in want.items()}


def test_ids_with_several_vectors_and_vectors_of_several_lengths(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.9, 0.1]), (7, [0.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0]), (50, [5.0, 0.0, 0.0]), (50, [0.0, 2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 3)) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 7, 0.994), (0, 2, 7, 0.0), (50, 1, 8, 0.0), (50, 1, 8, 1.0)]


def recall(got, want):
    assert got.keys() == want.keys()
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got, want = collected(queries.op2_cross_polytope_ann(spark, f"/root/testdata/{sf}")), brute(rows)
    assert recall(got, want) >= 0.9
    exact = {(i, tuple(x)) for i, x in rows if x is not None}
    assert all(any(j == i for j, _ in exact) for v in got.values() for i, _ in v)


def test_recall_and_pairs_at_many_vectors():
    """Independent vectors, the hardest: recall stays over 0.9 while the share of pairs compared falls."""
    rng = np.random.default_rng(4)
    shares = []
    for n in (3000, 20_000, 100_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        shape = ann.shape_of(n, 64)
        near = x[:200] @ x.T
        top = np.argsort(-near, axis=1)[:, 1:6]
        seen = np.zeros((200, n), bool)
        for t in range(ann.TABLES):
            own, asked = ann.buckets_of(x, t, shape), ann.probes_of(x[:200], t, shape)
            for q in range(200):
                seen[q] |= np.isin(own, asked[q])
        assert np.take_along_axis(seen, top, 1).mean() >= 0.92
        shares.append(seen.mean())
    assert shares[0] > 1.5 * shares[1] > 2 * shares[2]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(20, 48))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 1), axis=1), np.linalg.norm(x, axis=1))
    assert not np.allclose(ann.rotate(x, 1), ann.rotate(x, 2))
