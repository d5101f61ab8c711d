"""Append-only ingest and sensor windows as Structured Streaming plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslens.functions.text import plain_tokens


def stream_postings(documents: DataFrame) -> DataFrame:
    """(doc_id, token, tf) of each document as it arrives; stateless, as a document arrives whole."""
    words = plain_tokens(F.col("text"))
    counts = F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("token"), F.size(F.filter(words, lambda w: w == t)).cast("long").alias("tf")))
    return documents.select("doc_id", F.explode(counts).alias("x")).select("doc_id", "x.token", "x.tf")


def ingest(documents: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append postings to ``path``; the checkpoint makes a halted ingest go on where it stopped."""
    return stream_postings(documents).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def windowed_levels(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Mean, peak and count of each unit and window; late events count until the watermark has passed."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.avg("value").alias("level"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "user_id", "level", "peak", "n")
