import corpus_pipeline as cp
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate

from test_similar_documents import brute_components


def test_stages_follow_their_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, small).cache()
        assert docs.columns == cp.COLUMNS
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= before
    base = spark.read.parquet(f"{small}/documents.parquet").where(F.col('doc_id').isin(list(kept["language"]))).cache()
    assert kept["near_duplicates"] == {least for _, least in brute_components([(r.doc_id, r.text) for r in base.collect()])}
    items = [decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    runs = {w for i in items for w in decontaminate.windows_of(i)}
    for r in base.where(F.col('doc_id').isin(list(kept["near_duplicates"]))).collect():
        w = decontaminate.words_of(r.text.encode())
        hit = any(tuple(w[i : i + n]) in runs for n in {len(x) for x in runs} for i in range(len(w) - n + 1))
        assert (r.doc_id in kept["decontamination"]) == (not hit)
    out = cp.run(spark, small).collect()
    assert {r.doc_id for r in out} == kept["decontamination"]


def test_odd_rows_pass_through(spark, small):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "", 0, "x"), (3, "the house of the other one", "en", "s", 3, "x"), (3, "the house of the other one", "en", "s", 3, "x"), (None, "no id but the words", None, "s", 3, "x")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    near = cp.near_duplicate_stage(spark, docs, small).collect()
    assert sorted(r.doc_id or 0 for r in near) == [0, 1, 3]
    for _, stage in cp.STAGES:
        stage(spark, docs, small).collect()
        assert stage(spark, docs.limit(0), small).count() == 0
