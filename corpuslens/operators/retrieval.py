"""Retrieval over a table of weighted postings: DataFrame in, DataFrame out.

Postings are (doc_id, token, tf). Scoring joins the (small) query terms to them on the token, so the
shuffle is one of matched postings, and partial sums are taken before the sum per (qid, doc_id).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import plain_tokens

from .graph import materialised

#: Query terms that are broadcast at most.
BROADCAST_TERMS = 200_000


def postings(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens=plain_tokens) -> DataFrame:
    return corpus.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(post: DataFrame, stats: DataFrame) -> DataFrame:
    df = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("token", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def small(df: DataFrame, rows: int = BROADCAST_TERMS) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bm25(post: DataFrame, queries: DataFrame, k1: float = 0.9, b: float = 0.4, min_idf: float = 0.0) -> DataFrame:
    """qid, doc_id, score; ``queries``: (qid, token, qw)."""
    lengths = doc_lengths(post)
    stats = corpus_stats(lengths)
    terms = queries.join(idf(post, stats), "token").where(F.col("idf") >= min_idf)
    hit = post.join(small(terms), "token").join(lengths, "doc_id").crossJoin(F.broadcast(stats))
    tf = F.col("tf")
    part = F.col("idf") * F.col("qw") * (k1 + 1) * tf / (tf + k1 * (1 - b) + k1 * b * F.col("dl") / F.col("avgdl"))
    return hit.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The best ``k`` of each query, ties to the smaller doc_id; ``rank`` from 1."""
    order = Window.partitionBy("qid").orderBy(F.round(by, 9).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def reciprocal_rank_fusion(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """qid, doc_id, score from rankings (qid, doc_id, rank from 1); ranks count from 0 in the sum."""
    out = rankings[0].select("qid", "doc_id", "rank")
    for r in rankings[1:]:
        out = out.unionByName(r.select("qid", "doc_id", "rank"))
    return out.groupBy("qid", "doc_id").agg(F.sum(1 / (k + F.col("rank") - 1)).alias("score"))


def additive_fusion(lex: DataFrame, exp: DataFrame, weight: float = 0.25) -> DataFrame:
    """qid, doc_id, score: each side divided by its largest score of the query, added with ``weight``."""
    most = lambda d: d.withColumn("s", F.col("score") / F.max("score").over(Window.partitionBy("qid")))
    a, b = most(lex).select("qid", "doc_id", F.col("s").alias("a")), most(exp).select("qid", "doc_id", F.col("s").alias("b"))
    return a.join(b, ["qid", "doc_id"], "full").select("qid", "doc_id", (F.coalesce("a", F.lit(0.0)) + weight * F.coalesce("b", F.lit(0.0))).alias("score"))


class Retriever:
    """Documents in, ranked hits out: texts with BM25 scores and the metadata that they came with."""

    def __init__(self, spark: SparkSession, min_idf: float = 0.3):
        self.spark, self.min_idf = spark, min_idf
        self.corpus: DataFrame | None = None
        self.index: DataFrame | None = None

    def add_documents(self, documents: list[str] | DataFrame, metadata: list[dict] | None = None) -> "Retriever":
        """Texts in order (numbered on from those held), or a table of doc_id, text and perhaps meta (a string)."""
        if isinstance(documents, DataFrame):
            meta = F.col("meta") if "meta" in documents.columns else F.lit(None).cast("string")
            more = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", meta.alias("meta"))
        else:
            first = (self.corpus.agg(F.max("doc_id")).first()[0] + 1) if self.corpus is not None and self.corpus.limit(1).count() else 0
            metas = metadata if metadata is not None else [{} for _ in documents]
            rows = [(first + i, t, json.dumps(m)) for i, (t, m) in enumerate(zip(documents, metas, strict=True))]
            more = self.spark.createDataFrame(rows, "doc_id bigint, text string, meta string")
        self.corpus = more if self.corpus is None else self.corpus.unionByName(more)
        self.index = None
        return self

    def retrieve_all(self, queries: DataFrame, top_k_: int = 10) -> DataFrame:
        """qid, rank, doc_id, text, score, meta of the best documents of each query (qid, text)."""
        if self.index is None:
            self.index = materialised(postings(self.corpus))
        terms = queries.select("qid", F.explode(plain_tokens(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qw"))
        best = top_k(bm25(self.index, terms, min_idf=self.min_idf), top_k_)
        return self.corpus.join(small(best), "doc_id").select("qid", "rank", "doc_id", "text", "score", "meta")

    def retrieve(self, query: str, top_k: int = 10) -> list[tuple[str, float, dict]]:
        """(text, score, metadata) of the best documents, the best first."""
        if self.corpus is None:
            return []
        one = self.spark.createDataFrame([(0, query)], "qid bigint, text string")
        rows = sorted(self.retrieve_all(one, top_k).collect(), key=lambda r: r["rank"])  # at most ``top_k``
        return [(r.text, r.score, json.loads(r.meta) if r.meta else {}) for r in rows]
