"""Token ids in independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is a run of frames, each of whole documents, then two skippable frames: an index (first and
last doc_id and number of documents of each frame) and the public zstandard seek table (compressed
size, uncompressed size and the low 32 bits of XXH64 of each frame, then the footer). A reader of
some documents reads the two tables from the end and decompresses the frames it needs alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_folder
from .files import reading, written
from .tokens import encoder

# Fixed values of the public zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Ids after which a frame is closed; a longer document has a frame of its own.
FRAME_IDS = 1 << 18
_HEAD = struct.Struct("<4sIQB")  # kind, documents, ids, bytes of an id
_NULL = -(1 << 63)  # stands for a null doc_id, which a bit of its frame tells from this very number


def frame(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    narrow = "<u2" if not len(ids) or int(ids.max()) < 1 << 16 else "<u4"
    keys = np.array([_NULL if d is None else d for d in doc_ids], "<i8")
    return _HEAD.pack(b"TOKS", len(keys), len(ids), int(narrow[2])) + keys.tobytes() + np.array(lengths, "<u4").tobytes() + np.packbits([d is None for d in doc_ids]).tobytes() + ids.astype(narrow).tobytes()


def unframe(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    kind, n, total, width = _HEAD.unpack_from(raw)
    if kind != b"TOKS":
        raise ValueError("not a frame of token ids")
    at = _HEAD.size
    keys = np.frombuffer(raw, "<i8", n, at)
    lengths = np.frombuffer(raw, "<u4", n, at + 8 * n)
    nulls = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at + 12 * n), count=n)
    ids = np.frombuffer(raw, f"<u{width}", total, at + 12 * n + -(-n // 8))
    return [None if x else k for k, x in zip(keys.tolist(), nulls.tolist())], lengths, ids.astype("<u4")


class ArchiveWriter:
    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.most = out, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=1)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.docs and self.held + len(ids) > self.most:
            self.flush()
        self.docs.append(doc_id)
        self.parts.append(ids)
        self.held += len(ids)

    def flush(self) -> None:
        if not self.docs:
            return
        raw = frame(self.docs, [len(p) for p in self.parts], np.concatenate(self.parts))
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        keys = [_NULL if d is None else d for d in self.docs]
        self.index.append((keys[0], keys[-1], len(keys)))
        self.docs, self.parts, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<qqI", *x) for x in self.index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class ArchiveReader:
    """Documents of one file; ``read`` counts the frames decompressed."""

    def __init__(self, file):
        self.file, self.read = file, 0
        end = file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        size = 12 * frames + 9
        table = self._at(end - size - 8, size + 8)
        if struct.unpack_from("<II", table) != (SKIPPABLE_SEEK, size):
            raise ValueError("broken seek table")
        self.table = [struct.unpack_from("<III", table, 8 + 12 * i) for i in range(frames)]
        size_index = 20 * frames
        index = self._at(end - size - 8 - size_index - 8, size_index + 8)
        self.index = [struct.unpack_from("<qqI", index, 8 + 20 * i) for i in range(frames)]
        self.starts = np.cumsum([0, *(t[0] for t in self.table)]).tolist()

    def _at(self, where: int, size: int) -> bytes:
        self.file.seek(where)
        return self.file.read(size)

    def frame(self, i: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        packed, size, check = self.table[i]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.starts[i], packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} does not match its checksum")
        self.read += 1
        return unframe(raw)

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, or those of the doc_ids wanted."""
        for i, (first, last, _) in enumerate(self.index):
            if wanted is None or any(first <= w <= last for w in wanted):
                docs, lengths, ids = self.frame(i)
                at = 0
                for d, n in zip(docs, lengths.tolist()):
                    if wanted is None or d in wanted:
                        yield d, ids[at : at + n]
                    at += n


def write_archives(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, str, int, int]]:
    """Write all documents in ascending doc_id order (null first; ties in the order of a hash of the text).

    One file for each range of doc_ids; returns (range, file name, documents, ids), a row a file.
    A null or empty text has the end id alone; repeated rows are written as often as they come.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, n, total = f"tokens-{part:06d}.zst", 0, 0
        enc = encoder(tokenizer)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with written(folder, name) as out:
            w = ArchiveWriter(out)
            batch: pa.RecordBatch | None = first
            while batch is not None:
                ids, at = enc.encode(batch.column(1))
                for k, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    w.add(k, np.append(ids[a:b], np.uint32(end_id)))
                    total += b - a + 1
                n += batch.num_rows
                batch = next(batches, None)
            w.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["part", "name", "n_docs", "n_ids"])

    made = map_batches(d, run, "part int, name string, n_docs bigint, n_ids bigint").collect()  # a row a file
    return sorted(tuple(r) for r in made)


def read_archives(spark: SparkSession, folder: str, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    rows, start = [], 0
    for _, name, _, ids in files:
        rows.append((name, start))
        start += ids
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not rows:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(rows, "name string, start bigint").repartition(len(rows), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with reading(folder, name) as f:
                    r = ArchiveReader(f)
                    for i in range(len(r.table)):
                        docs, lengths, ids = r.frame(i)
                        raw, ends = memoryview(ids.tobytes()), np.cumsum(lengths, dtype=np.int64)
                        begins = ends - lengths
                        crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(begins.tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at + begins), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        at += int(ends[-1])

    return map_batches(todo, run, schema)


def archive_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 0) -> DataFrame:
    """Write ``docs`` into a new folder below the shared one and read every document back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    return read_archives(spark, folder, write_archives(docs, tokenizer, folder, end_id=end_id))
