"""Ranking metrics per query; ``ranked``: (qid, doc_id, rank from 1), ``rel``: (qid, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, rel: DataFrame, k: int = 10) -> DataFrame:
    """qid, ndcg (binary gain), recall, mrr, first_hit at ``k`` of every query with relevant documents."""
    n = rel.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    hit = ranked.where(F.col("rank") <= k).join(rel, ["qid", "doc_id"])
    got = hit.groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_hit"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = n.join(got, "qid", "left")
    return out.select("qid", F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"), F.coalesce(F.col("hits") / F.col("n_rel"), F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"), "first_hit")
