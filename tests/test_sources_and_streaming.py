import json

from corpuslens.operators import retrieval
from corpuslens.sources import readers
from corpuslens.streaming import append


def test_corpus_queries_and_judgements(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in [{"_id": "d1", "title": " A ", "text": "b c"}, {"_id": "d2", "title": "", "text": "x"}]))
    assert {tuple(r) for r in readers.corpus_jsonl(spark, str(tmp_path / "c.jsonl")).collect()} == {("d1", "A b c"), ("d2", "x")}
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\n")
    rel = readers.qrels_tsv(spark, str(tmp_path / "q.tsv"))
    assert [tuple(r) for r in rel.collect()] == [("q1", "d1", 1)]
    later = spark.createDataFrame([("q1", "d1", 2)], "qid string, doc_id string, grade int")
    assert [tuple(r) for r in readers.merge_qrels(rel, later).collect()] == [("q1", "d1", 2)]


def test_sensor_snapshots(spark, tmp_path):
    (tmp_path / "2004.02.12.10.32.39").write_text("1.5\t-2.0\n0.5\t3.0\n")
    rows = readers.sensor_snapshots(spark, str(tmp_path)).collect()
    assert sorted(r.channels for r in rows) == [[0.5, 3.0], [1.5, -2.0]]
    assert {str(r.ts) for r in rows} == {"2004-02-12 10:32:39"}


def test_index_append_and_remove(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "doc_id long, text string")
    readers.save_index(retrieval.postings(docs), str(tmp_path / "i"))
    new = retrieval.postings(spark.createDataFrame([(2, "z"), (4, "a")], "doc_id long, text string"))
    gone = spark.createDataFrame([(3,)], "doc_id long")
    got = readers.load_index(spark, str(tmp_path / "i"), new, gone)
    want = retrieval.postings(spark.createDataFrame([(1, "a b"), (2, "z"), (4, "a")], "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "token", "tf").collect())) == sorted(map(tuple, want.collect()))


def test_streamed_ingest_goes_on_where_it_stopped(spark, tmp_path):
    src = tmp_path / "src"
    schema = "doc_id long, text string"
    all_docs = [(1, "a b a"), (2, "b"), (3, "c a")]
    for k, part in enumerate([all_docs[:2], all_docs[2:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        append.ingest(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = retrieval.postings(spark.createDataFrame(all_docs, schema))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
