"""Sinks: registries as JSON lines, traces as CSV, evaluation bundles, chunked work that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_registry(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").json(path)


def load_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_trace(trace: DataFrame, path: str) -> None:
    """CSV with a header; arrays and structs as JSON text."""
    flat = [F.to_json(F.col(f"`{n}`")).alias(n) if t.startswith(("array", "struct", "map")) else F.col(f"`{n}`") for n, t in trace.dtypes]
    trace.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def save_evaluation(metrics: DataFrame, path: str, **settings: str) -> None:
    """Metrics with the settings that they were measured under, as one bundle."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    metrics.sparkSession.createDataFrame([(dict(settings),)], "settings map<string,string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    return spark.read.parquet(f"{path}/metrics"), spark.read.parquet(f"{path}/settings").first()["settings"]


def encode_chunks(rows: DataFrame, key: str, chunks: int, encode: Callable[[DataFrame], DataFrame], path: str) -> int:
    """Encode ``rows`` chunk by chunk (by hash of ``key``) into ``path``; chunks that are whole stay. Returns how many were made."""
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    made = 0
    for i in range(chunks):
        out = f"{path}/chunk={i}"
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")):
            continue
        encode(rows.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == i)).write.mode("overwrite").parquet(out)
        made += 1
    return made
