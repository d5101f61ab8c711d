"""Latent semantic vectors: hashed tf-idf, principal axes, cosines."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vectors(corpus: DataFrame, queries: DataFrame, tokens, *, features: int = 256, axes: int = 16) -> tuple[DataFrame, DataFrame]:
    """(doc_id, x) and (qid, y): texts on the ``axes`` that hold most of the corpus's variance.

    The covariance has features x features entries, whatever the corpus; null texts have no words.
    """
    docs = corpus.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    model = Pipeline(stages=[HashingTF(numFeatures=features, inputCol="words", outputCol="tf"), IDF(inputCol="tf", outputCol="tfidf"), PCA(k=axes, inputCol="tfidf", outputCol="latent")]).fit(docs)
    asked = queries.select("qid", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    return model.transform(docs).select("doc_id", vector_to_array("latent").alias("x")), model.transform(asked).select("qid", vector_to_array("latent").alias("y"))


def cosine(x: str, y: str) -> Column:
    """Cosine of two arrays; zero if either is zero."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(size > 0, dot(x, y) / size).otherwise(0.0)


def rerank(pool: DataFrame, docs: DataFrame, queries: DataFrame, weight: float = 0.3) -> DataFrame:
    """qid, doc_id, score: the pool's score as a share of the query's best, plus ``weight`` times the latent cosine."""
    best = pool.groupBy("qid").agg(F.max("score").alias("best"))
    both = pool.join(best, "qid").join(queries, "qid").join(docs, "doc_id")
    return both.select("qid", "doc_id", (F.col("score") / F.col("best") + weight * cosine("x", "y")).alias("score"))
