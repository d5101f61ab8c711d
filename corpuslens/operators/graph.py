"""Graphs as edge tables: components, clusters with hubs, shortest paths, colourings.

Each is a loop of joins whose lineage is cut in the shared checkpoint folder; no edge list reaches the driver.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """Compute ``df`` and cut its lineage, in spark.checkpoint.dir where the session names one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="corpuslens-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b) reaches. Labels spread along edges, then jump to the label's own label, so that rounds grow with the logarithm of paths in practice."""
    both = materialised(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    label = materialised(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        spread = label.join(near, "node").select("node", F.least("root", "seen").alias("root"), F.col("root").alias("old"))
        own = spread.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = materialised(spread.join(own, "root").select("node", F.least("root", "next").alias("root"), (F.least("root", "next") != F.col("old")).alias("moved")))
        label = after.select("node", "root")
        if not after.where("moved").limit(1).count():
            return label


def clusters(pairs: DataFrame) -> DataFrame:
    """word, root, hub of weighted ``pairs`` (a, b, c); a cluster's hub has the largest weight inside it, ties to the smaller word."""
    label = components(pairs.select("a", "b")).withColumnRenamed("node", "word")
    ends = pairs.select("a", "c").union(pairs.select("b", "c")).toDF("word", "c").groupBy("word").agg(F.sum("c").alias("w"))
    hubs = label.join(ends, "word").groupBy("root").agg(F.min(F.struct((-F.col("w")).alias("w"), "word"))["word"].alias("hub"))
    return label.join(hubs, "root").select("word", "root", "hub")


def shortest_paths(edges: DataFrame) -> DataFrame:
    """a, b, w: the least weight between all pairs that ``edges`` (a, b, w; both ways; weights >= 0) connect. Path lengths double each round."""
    best = materialised(edges.select("a", "b", "w").union(edges.select("b", "a", "w")).where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")))
    while True:
        on = best.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("v"))
        two = best.join(on, "b").where("a <> c").select("a", F.col("c").alias("b"), (F.col("w") + F.col("v")).alias("w"))
        after = materialised(best.union(two).groupBy("a", "b").agg(F.min("w").alias("w")))
        if not after.exceptAll(best).limit(1).count():
            return after
        best = after


def greedy_colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, colour: the least colour that no smaller neighbour has, as a walk over the nodes in order gives.

    A round colours all nodes whose smaller neighbours have a colour; rounds are as many as the longest ascending path.
    """
    before = materialised(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct())
    todo = materialised(nodes.select("node").distinct())
    done = materialised(todo.join(before, "node", "left_anti").select("node", F.lit(0).alias("colour")))
    while True:
        left = todo.join(done, "node", "left_anti")
        seen = left.join(before, "node").join(done.select(F.col("node").alias("other"), "colour"), "other", "left")
        ready = seen.groupBy("node").agg(F.count(F.when(F.col("colour").isNull(), 1)).alias("open"), F.collect_set("colour").alias("used")).where("open = 0")
        fresh = materialised(ready.select("node", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used")).alias("colour")))
        if not fresh.limit(1).count():
            return done
        done = materialised(done.union(fresh))


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """node, round: all that can be learned from ``seeds`` (node) along ``edges`` (a, b; both ways) and the round that first brought it; ends when a round brings nothing new."""
    both = materialised(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    fresh = materialised(seeds.select("node").where("node is not null").distinct().withColumn("round", F.lit(0)))
    known, n = fresh, 0
    while fresh.limit(1).count():
        n += 1
        found = fresh.select(F.col("node").alias("a")).join(both, "a").select(F.col("b").alias("node")).distinct()
        fresh = materialised(found.join(known, "node", "left_anti").withColumn("round", F.lit(n)))
        known = materialised(known.union(fresh))
    return known
