from pyspark.sql import functions as F

from corpuslens.functions.text import STOP_WORDS, content_words, crude_stem, stem
from corpuslens.operators.retrieval import Retriever
from corpuslens.plans import queries


def test_stems_of_known_words(spark):
    want = {"meetings": "meet", "physics": "physics", "cats": "cats", "cases": "case", "houses": "house", "studies": "study", "addresses": "address", "dishes": "dish", "drugs": "drug", "glass": "glass", "virus": "virus", "analysis": "analysis", "running": "run", "united": "unit", "organization": "organization", "press": "press", "ties": "ties", "dies": "dies", "flies": "flie", "xxed": "xxed"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in want], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert got == want


def test_crude_stems_take_the_first_ending_that_fits(spark):
    want = {"organization": "organ", "nation": "nation", "quickly": "quick", "treatments": "treatment", "boxes": "boxe", "watches": "watch", "educational": "educ", "cats": "cats", "kindness": "kind"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in want], "w string").select("w", crude_stem(F.col("w")).alias("s")).collect()}
    assert got == want


def test_stop_words(spark):
    assert {"all", "any", "some", "more"} <= set(STOP_WORDS) and not {"use", "one", "two", "should"} & set(STOP_WORDS)
    row = spark.createDataFrame([("All of the two Cats use an x1 ray",)], "t string").select(content_words(F.col("t")).alias("w")).first()
    assert row.w == ["two", "cats", "use", "ray"]


def test_retriever_gives_texts_scores_and_metadata(spark):
    r = Retriever(spark, min_idf=0.0)
    assert r.retrieve("anything") == []
    r.add_documents(["the red fox", "a blue whale swims", "red whales"], [{"k": 1}, {"k": 2}, {"k": 3}]).add_documents(["one more fox, a red fox"])
    hits = r.retrieve("red fox", top_k=3)
    assert [h[0] for h in hits] == ["one more fox, a red fox", "the red fox", "red whales"]
    assert [h[2] for h in hits] == [{}, {"k": 1}, {"k": 3}] and hits[0][1] >= hits[1][1] > hits[2][1]
    assert r.retrieve("nothing of it") == []


def test_relevant_pairs_match_a_search_of_every_text(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is not None]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text is not None]
    got = sorted(tuple(r) for r in queries._relevant(spark, sf).select("qid", "doc_id").collect())
    assert got == sorted((i, d) for i, t in items for d, text in docs if t in text) and got
