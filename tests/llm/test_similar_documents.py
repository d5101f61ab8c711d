import re

import corpus_pipeline as cp
import numpy as np
import pytest

from corpuslens.llm import simhash


def jaccard(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_stage_drops_planted_near_copies(spark, small):
    """Copies with words changed here and there, of similarity 0.8 to 0.95, go; of lower similarity they stay."""
    rng = np.random.default_rng(8)
    rows, near, far = [], set(), set()
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((10 * k, " ".join(base), "en", "s", 1))
        for j, changes in enumerate((2, 4, 5, 6, 9), 1):
            copy = list(base)
            for at in rng.choice(300, changes, replace=False):
                copy[at] = f"x{rng.integers(10**9)}"
            rows.append((10 * k + j, " ".join(copy), "en", "s", 1))
            (near if jaccard(rows[-1][1], rows[-1 - j][1]) >= 0.8 else far).add(10 * k + j)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(near) >= 180 and len(far) >= 50
    kept = {r.doc_id for r in cp.near_duplicate_stage(spark, docs, small).collect()}
    assert kept == {10 * k for k in range(60)} | far


def brute_components(rows):
    """(doc_id, smallest doc_id reachable) by all pairs of sets of five-word shingles of similarity 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return {(doc, least.get(find(i))) for i, (doc, _) in enumerate(rows)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("task_rows", [200_000, 500])
def test_components_match_all_pairs(spark, task_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.component_id) for r in simhash.similar_documents(docs, task_rows=task_rows).collect()}
    assert got == brute_components([tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "ONE ", "one two three", "\vone\ttwo  three", "a b c d e", "A B\tc\nd e f", "long word " * 4000, "same", "same", "É é x y z"]
    rows = [*enumerate(texts), (None, "same"), (None, "lonely null id"), (3, "one"), (-(2**63), "a b c d e"), (2**63 - 1, "the last id")]
    docs = spark.createDataFrame([(*r, 1, 1, "w") for r in rows], "doc_id long, text string, node int, row int, words string")
    got = simhash.similar_documents(docs)
    assert got.count() == len(rows)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == brute_components(rows)
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def files_of(spark, folder):
    """Bytes of the files in a folder of the shared one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(conf).getContentSummary(path).getLength()


def test_disk_does_not_grow_as_tasks_get_smaller(spark):
    """A table that is large for its tasks leaves no more rows on disk: no row is copied to deal it out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    simhash.similar_documents(docs.limit(0)).count()  # sets the folder
    folder, sizes = spark.sparkContext.getCheckpointDir(), []
    for task_rows in (200_000, 40):
        before = files_of(spark, folder)
        simhash.similar_documents(docs, task_rows=task_rows).count()
        sizes.append(files_of(spark, folder) - before)
    assert 0 < sizes[1] < 1.3 * sizes[0]


def test_short_texts(spark):
    """Of sets of four and five shingles that share four, all pairs are found."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(200):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i - i % 2) for i in range(400)}


def test_large_bands_by_steps_as_by_all_pairs():
    """Rows of one band that are compared with those not met yet are joined as by all pairs; forests share no pair."""
    rng = np.random.default_rng(5)
    sketch = rng.integers(0, 2**63, (600, 6), dtype=np.uint64)
    for i in range(0, 600, 3):
        sketch[i + 1] = sketch[i] ^ np.array([0x1111111, 0, 0, 0, 0, 0], np.uint64)
        sketch[i + 2] = sketch[i + 1] ^ np.array([0, 0, 0, 0x1111111111111111, 0x11111, 0], np.uint64)
    forests = list(simhash._all_pairs(sketch, np.array([len(sketch)])))
    assert np.array_equal(simhash._met(sketch).label, forests[0].label) and len(np.unique(forests[0].label)) == 200
    pairs = [(a, b) for f in forests for x, y in f.pairs for a, b in zip(x.tolist(), y.tolist())]
    assert len(pairs) == len(set(pairs)) == 600


def test_one_forest_first_finds_the_same(spark, monkeypatch):
    """Confirming one forest of pairs, and of the others what it has not joined, gives all components."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(simhash, "PAIRS_EACH", 0)
    got = {(r.doc_id, r.component_id) for r in simhash.similar_documents(docs).collect()}
    assert got == brute_components([tuple(r) for r in docs.collect()])
