"""What the operators of this subpackage share: table access, Arrow maps, checkpoints, shared files."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import ship_package

#: Rows and bytes that one Arrow batch holds at most, so that a Python worker's memory is bounded.
BATCH_ROWS, BATCH_BYTES = 3000, 16 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small: long texts must not pile up in a Python worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (as in local tests) a new temporary one."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="corpuslens-")
        sc.setCheckpointDir(known)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def new_folder(spark: SparkSession, what: str) -> str:
    """The URI of a folder of its own below the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage, with files that outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return what a task has freed to the machine: workers live on, and an executor's memory is counted with theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_columns(
    df: DataFrame,
    make: Callable[[], Callable[..., Sequence]],
    inputs: Sequence[str],
    schema: str | T.StructType,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Columns made from Arrow columns, without a shuffle.

    ``make()`` runs once a task and gives the function of the input columns (as Arrow arrays)
    that returns the new columns. ``carry`` columns pass unchanged; one with the name of a new
    column is replaced by it.
    """
    ship_package(df.sparkSession)
    new = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    carry = [c for c in carry if c not in new.names]
    src = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], *[F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)])
    out = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new)])
    n, names = len(carry), out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if b.num_rows:
                made = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in fn(*b.columns[n:])]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=names)
        give_back()

    mapped = src.mapInArrow(run, out)
    return mapped.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(f"n{i}").alias(f.name) for i, f in enumerate(new)])


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with this package's code at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def expand_rows(
    df: DataFrame,
    make: Callable[[], Callable[..., Iterator[tuple[np.ndarray, Sequence]]]],
    inputs: Sequence[str],
    schema: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Any number of rows made from each row, without a shuffle.

    ``make()`` runs once a task and gives the function of the input columns (as Arrow arrays) that
    yields, part by part, the numbers of the rows that new ones are made from and the new columns.
    """
    new = T.StructType.fromDDL(schema)
    out = T.StructType([*(df.schema[c] for c in carry), *new])
    src = df.select(*carry, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    n, names = len(carry), out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if b.num_rows:
                for at, made in fn(*b.columns[n:]):
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns[:n]), *made], names=names)

    return map_batches(src, run, out)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def groups_of(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to about ``most``; each has one at least."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
