import random
import re
import unicodedata
from pathlib import Path

import numpy as np
import pytest

import corpuslens
from corpuslens.functions.text import nfkc, plain_tokens
from corpuslens.operators import adaptive, graph, latent
from corpuslens.plans.queries import QUERIES
from corpuslens.sources import sinks
from corpuslens.streaming import stateful


def test_components_and_hubs(spark):
    rnd = random.Random(3)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [(f"m{rnd.randrange(40)}", f"m{rnd.randrange(40)}") for _ in range(25)]
    root = {v: v for e in edges for v in e}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = graph.components(spark.createDataFrame(edges, "a string, b string"))
    assert {r.node: r.root for r in got.collect()} == root
    pairs = spark.createDataFrame([("a", "b", 5), ("b", "c", 2), ("x", "y", 1)], "a string, b string, c long")
    assert {tuple(r) for r in graph.clusters(pairs).collect()} == {("a", "a", "b"), ("b", "a", "b"), ("c", "a", "b"), ("x", "x", "x"), ("y", "x", "x")}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_shortest_paths(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(12), rnd.randrange(12), rnd.randrange(1, 9)) for _ in range(20)]
    far = {}
    for a, b, w in edges:
        if a != b:
            far[a, b] = far[b, a] = min(w, far.get((a, b), 99))
    for k in range(12):
        for a in range(12):
            for b in range(12):
                if a != b and (a, k) in far and (k, b) in far:
                    far[a, b] = min(far.get((a, b), 999), far[a, k] + far[k, b])
    got = graph.shortest_paths(spark.createDataFrame(edges, "a long, b long, w long"))
    assert {(r.a, r.b): r.w for r in got.collect()} == far


def colours(nodes, edges):
    out = {}
    for n in sorted(nodes):
        used = {out[m] for e in edges if n in e for m in e if m < n}
        out[n] = next(c for c in range(99) if c not in used)
    return out


def test_greedy_colours(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(45)]
    edges = [e for e in edges if e[0] != e[1]]
    got = graph.greedy_colours(spark.range(20).toDF("node"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.colour for r in got.collect()} == colours(range(20), edges)


def test_conflict_schedule(spark, small):
    items = {r.item_id: set(re.findall("[a-z0-9]+", r.text.lower())) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    n = {}
    for w in items.values():
        for t in w:
            n[t] = n.get(t, 0) + 1
    edges = [(a, b) for a in items for b in items if a < b and any(2 <= n[t] <= 4 for t in items[a] & items[b])]
    assert {r.item_id: r.slot for r in QUERIES["g12_conflict_schedule"](spark, small).collect()} == colours(items, edges)


def folded(rows, **settings):
    out, state = [], {}
    for u, at, x in sorted(r for r in rows if r[2] is not None):
        state[u], flag = adaptive.step(state.get(u, adaptive.FRESH), x, **settings)
        out.append((u, at, round(state[u][0], 9), flag))
    return sorted(out)


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(11)
    return [(u, t, None if t % 37 == 0 else rnd.gauss(0, 0.1) + (5 if 60 < t < 90 else 0)) for u in range(3) for t in range(120)]


def test_adaptive_alarms_in_batch(spark, values):
    mixed = random.Random(1).sample(values, len(values))
    got = adaptive.alarms(spark.createDataFrame(mixed, "unit long, at long, value double"), patience=20)
    got = sorted((r.unit, r.at, round(r.fast, 9), r.alarm) for r in got.collect())
    assert got == folded(values, patience=20)
    assert any(r[3] for r in got)


def test_whole_table_of_control_charts(spark, small):
    ev = [(r.user_id, (r.ts, r.event_id), r.value) for r in spark.read.parquet(f"{small}/events.parquet").collect() if r.user_id is not None]
    want = sorted((u, at[1], round(f, 5), a) for u, at, f, a in folded(ev, k=1.0))
    got = sorted((r.user_id, r.event_id, round(r.fast, 5), r.alarm) for r in QUERIES["w17_adaptive_threshold"](spark, small).collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want))


def test_adaptive_alarms_go_on_after_a_stop(spark, values, tmp_path):
    schema = "unit long, at long, value double"
    for lo, hi in ((0, 70), (70, 120)):
        spark.createDataFrame([v for v in values if lo <= v[1] < hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        out = stateful.adaptive_alarms(spark.readStream.schema(schema).parquet(str(tmp_path / "src")), patience=20)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.unit, r.at, round(r.fast, 9), r.alarm) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == folded(values, patience=20)


def test_counts_only_grow_and_clusters_are_rebuilt(spark, tmp_path):
    schema, seen, built = "doc_id long, text string", {}, []

    def take(part, n):
        for r in part.collect():
            assert r.n >= seen.get(r.token, 0)
            seen[r.token] = r.n

    for k, text in enumerate(["a b a", "b c", "a d"]):
        spark.createDataFrame([(k, text)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        docs = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
        stateful.growing_counts(docs).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        stateful.rebuild_every(docs, built.append, 2, str(tmp_path / "all"), str(tmp_path / "cp2")).awaitTermination()
    assert seen == {"a": 3, "b": 2, "c": 1, "d": 1}
    assert built == [1]
    assert spark.read.parquet(str(tmp_path / "all")).count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "k long, t string, xs array<long>")
    sinks.save_registry(rows, str(tmp_path / "r"))
    assert sorted(map(tuple, sinks.load_registry(spark, str(tmp_path / "r"), "k long, t string, xs array<long>").collect())) == [(1, "a", [1, 2]), (2, None, None)]
    sinks.export_trace(rows, str(tmp_path / "t"))
    assert {r.xs for r in spark.read.option("header", True).csv(str(tmp_path / "t")).collect()} == {"[1,2]", None}
    sinks.save_evaluation(rows.select("k"), str(tmp_path / "e"), k1="0.9")
    metrics, settings = sinks.load_evaluation(spark, str(tmp_path / "e"))
    assert (metrics.count(), settings) == (2, {"k1": "0.9"})
    calls = []

    def encode(part):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return part

    many = spark.range(50).toDF("k")
    with pytest.raises(RuntimeError):
        sinks.encode_chunks(many, "k", 4, encode, str(tmp_path / "c"))
    assert sinks.encode_chunks(many, "k", 4, encode, str(tmp_path / "c")) == 3
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "c")).collect()) == list(range(50))


def test_reach_ends_when_nothing_is_new(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (8, 9)], "a long, b long")
    got = graph.reach(spark.createDataFrame([(1,), (None,)], "node long"), edges)
    assert {tuple(r) for r in got.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}


def test_latent_vectors(spark):
    """Inner products in the latent space are those on the leading axes of the covariance, by an eigendecomposition."""
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices("abcdefgh", k=12)) if i else None) for i in range(40)], "doc_id long, text string")
    x, y = latent.vectors(docs, docs.limit(5).withColumnRenamed("doc_id", "qid"), plain_tokens, features=32, axes=3)
    full, _ = latent.vectors(docs, docs.limit(1).withColumnRenamed("doc_id", "qid"), plain_tokens, features=32, axes=32)
    a = np.array([r.x for r in full.orderBy("doc_id").collect()])
    values, axes = np.linalg.eigh(np.cov(a.T))
    top = a @ axes[:, np.argsort(values)[::-1][:3]]
    got = np.array([r.x for r in x.orderBy("doc_id").collect()])
    assert np.allclose(got @ got.T, top @ top.T, atol=1e-8)
    assert not got[0].any() and y.count() == 5
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "x array<double>, y array<double>").select(latent.cosine("x", "y").alias("c")).collect()
    assert [round(r.c, 6) for r in row] == [0.707107, 0.0]


def test_normalised_text(spark):
    texts = ["ﬁne ２ café", None, ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(nfkc("t").alias("x")).collect()
    assert [r.x for r in got] == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_nothing_outside_imports_the_training_data_part():
    root = Path(corpuslens.__file__).parent
    assert not [f for f in root.rglob("*.py") if "llm" not in f.relative_to(root).parts and re.search(r"^\s*(from|import) .*\bllm\b", f.read_text(), re.M)]
