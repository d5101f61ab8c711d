"""Readers and sinks: corpora (JSON lines), relevance judgements (TSV), sensor snapshots, index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and text (title and body) of a corpus of {_id, title, text} lines."""
    raw = spark.read.schema("_id string, title string, text string").json(path)
    return raw.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", F.trim("title"), F.trim("text"))).alias("text"))


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("qid"), "text")


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, grade of a TSV with a header, grades above zero only."""
    raw = spark.read.option("sep", "\t").option("header", True).schema("qid string, doc_id string, grade int").csv(path)
    return raw.where("grade > 0")


def passages_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").schema("doc_id long, text string").csv(path)


def merge_qrels(*tables: DataFrame) -> DataFrame:
    """Union in which the last table that judges a pair wins."""
    parts = [t.select("qid", "doc_id", "grade", F.lit(i).alias("_at")) for i, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("qid", "doc_id").agg(F.max_by("grade", "_at").alias("grade"))


def sensor_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """ts (from the file's name), line and channels of a folder of text matrices."""
    raw = spark.read.text(folder).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    values = F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.cast("double"))
    return raw.select(F.to_timestamp("name", "yyyy.MM.dd.HH.mm.ss").alias("ts"), values.alias("channels"))


def save_index(postings: DataFrame, path: str) -> None:
    """Postings ordered by token and document within files: Parquet packs the runs."""
    postings.repartitionByRange("token").sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Postings of an index with documents added and removed; a document added again replaces its old postings."""
    old = spark.read.parquet(path)
    for gone in (removed, added):
        if gone is not None:
            old = old.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    return old if added is None else old.unionByName(added.select(*old.columns))
