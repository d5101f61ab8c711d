import re

import numpy as np
import pytest
import xxhash

from corpuslens.llm import queries, simhash
from corpuslens.llm.common import bounded_batches


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], f"{rows[i][1]:016x}", min((d for d in groups[find(i)] if d is not None), default=None)) for i in range(len(rows))]


key = lambda t: tuple((x is None, x) for x in t)


def test_query_matches_brute_force(spark, small):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op7_simhash_trie_join(spark, small).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_odd_rows(spark):
    bounded_batches(spark)
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "É é É é", "a b c d e", "A B\tc\nd e", "long word " * 4000, "same", "same", " x y"]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)] + [(None, "same", 1, 1), (None, "lonely null id", 1, 1), (3, "one", 1, 1)], "doc_id long, text string, fp int, component_id int")
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    got = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("task_rows", [200_000, 20])
def test_trie_join_finds_all_components(spark, task_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    values = set(base.tolist())
    for b in base[:30].tolist():
        for _ in range(12):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 8)).tolist():
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    signed = [x - 2**64 if x >= 2**63 else x for x in values]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    parent = dict(zip(signed, signed))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in simhash.links(prints, 4, task_rows).collect():
        assert r.u in parent and r.v in parent
        parent[find(r.u)] = find(r.v)
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                assert find(signed[i]) == find(signed[j])
    true = brute_components(list(zip(range(len(values)), values)))
    assert len({c for _, _, c in true}) == len({find(s) for s in signed})
