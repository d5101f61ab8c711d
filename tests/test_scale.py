"""Plans over documents must not shuffle their tokens, scores or pairs row by row, and must not cut what they look at."""

import random

import pytest

from corpuslens.operators.scoring import tokenised
from corpuslens.plans.queries import QUERIES
from corpuslens.plans.scored import STEPS


def shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """1,600 texts of 240 words, and 30 passages of them; the bytes of all texts."""
    path, rng = tmp_path_factory.mktemp("corpus"), random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}" for i in range(900)]
    texts = [" ".join(rng.choices(words, [1 / (k + 3) for k in range(900)], k=240)) for _ in range(1600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{path}/documents.parquet")
    passages = [(i, " ".join(texts[50 * i].split()[20:45])) for i in range(30)]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(50 * i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), sum(map(len, texts))


@pytest.mark.parametrize("name", ["r3_bm25_plus", "r10_routed_bm25", "fu13_phrase_bonus", "tp21_tuned_engine", "e8_failure_patterns", "k4_gold_rank", "fu1_additive_fusion", "fu3_fusion_modes", "tp20_routed_corridors", "fu12_gravity_cascade"])
def test_tokens_and_scores_stay_where_they_are(spark, corpus, name):
    path, size = corpus
    before = shuffled(spark)
    assert QUERIES[name](spark, path).collect()
    assert shuffled(spark) - before < size


def test_ids_that_repeat(spark, tmp_path):
    """Rows of one doc_id are one document, as in the SQL."""
    spark.createDataFrame([(1, "alpha beta"), (1, "beta gamma"), (2, "gamma"), (3, "delta"), (4, "eps"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r["rank"]) for r in sorted(QUERIES["r17_bounded_pool"](spark, str(tmp_path)).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert "r17_bounded_pool" in STEPS


def test_tokens_of_bytes():
    import re

    import pyarrow as pa

    texts = [None, "", "a", "ab9 ñc", "éx", "z" * 30, "-", None, "q"]
    for a, t in ((pa.array(texts), texts), (pa.array(texts).slice(3), texts[3:])):
        assert tokenised(a).to_pylist() == [re.findall("[a-z0-9]+", x or "") for x in t]


def test_recall_pool_takes_terms_of_many_documents(spark, tmp_path):
    """A query all of whose terms are in over 200 documents has a pool too."""
    spark.createDataFrame([(i, "alpha beta" if i < 260 else f"other{i}") for i in range(900)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r["rank"], r.doc_id) for r in QUERIES["r32_recall_first_pool"](spark, str(tmp_path)).collect()) == [(i + 1, i) for i in range(10)]


def test_manifold_links_by_all_shared_terms(spark, tmp_path):
    """Documents are partners by terms of over 20 documents too: all but the first share one with the rest of the pool."""
    texts = ["alpha solo"] + ["alpha common"] * 30 + [f"other{i}" for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["rank"]: r.doc_id for r in QUERIES["r8_manifold_rerank"](spark, str(tmp_path)).collect()}
    assert got[1] == 1


@pytest.mark.parametrize("name", ["ag6_cooccurrence", "ag8_ppmi", "j5_pair_counts", "tp19_hub_signatures", "ag26_heavy_anchors", "ag10_pmi_graph", "g7_knowledge_graph"])
def test_meetings_are_not_shuffled_as_rows(spark, corpus, name):
    """A text of 240 words has 5,640 meetings; the runs of all must be smaller than three bytes each."""
    path, size = corpus
    before = shuffled(spark)
    QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < min(3 * 1600 * 5640, 8 * size)


def test_pairs_by_brute_force(spark, tmp_path):
    """Long texts over several windows, rare words, digits before words and stop words, by plain loops."""
    import re
    from collections import Counter

    from corpuslens.functions.text import STOP_WORDS

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "9abc", "Abc", "xy", f"v{rng.randrange(70)}", f"v{rng.randrange(9)}q"]) for _ in range(rng.randrange(1, 400))) for _ in range(40)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    met = Counter()
    for t in texts:
        w = [x for x in re.findall("[a-z][a-z0-9]+", (t or "").lower()) if len(x) > 2 and x not in STOP_WORDS]
        for i in range(0, len(w), 48):
            own = sorted(set(w[i : i + 48]))
            met.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    got = {(r.a, r.b): r.c for r in QUERIES["ag6_cooccurrence"](spark, str(tmp_path)).collect()}
    assert got == {p: c for p, c in met.items() if c >= 4}
    tally = {r.c: r.pairs for r in QUERIES["j5_pair_counts"](spark, str(tmp_path)).collect()}
    assert tally == Counter(met.values())


def test_sub_words_are_summed_where_they_are(spark, corpus):
    path, size = corpus
    for name in ("tp1_subword_index", "r2_multi_view_bm25"):
        before = shuffled(spark)
        assert QUERIES[name](spark, path).collect()
        assert shuffled(spark) - before < size / 2


def test_word_sets_are_one_row_each(spark, corpus):
    path, size = corpus
    before = shuffled(spark)
    QUERIES["r43_shared_rare_jaccard"](spark, path).collect()
    assert shuffled(spark) - before < 2 * size


def test_audit_of_a_long_text_reads_it_once(spark, tmp_path):
    """120,000 tokens of which each stands only where it comes from: the text must not be read from the beginning for each."""
    import time

    spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(120_000))), (2, None), (3, "Ab ab")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    began = time.time()
    assert not QUERIES["r44_completeness_audit"](spark, str(tmp_path)).collect()
    assert time.time() - began < 20


def test_dense_similarity_of_many_vectors(spark, tmp_path):
    """8,000 vectors against a matrix product; equal vectors go by their ids."""
    import numpy as np

    x = np.random.default_rng(4).normal(size=(8000, 16)).astype(np.float32)
    x[7] = x[3]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in QUERIES["j19_dense_similarity"](spark, str(tmp_path)).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.vec_id))
    y = x.astype(np.float64)
    for q in range(0, 8000, 50):
        score = np.round(y @ y[q], 9)
        score[q] = -np.inf
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(8000), -score))[:5].tolist()
