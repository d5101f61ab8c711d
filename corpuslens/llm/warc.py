"""WARC archives by way of a chunked record table.

Payloads become rows of (record, chunk number, data); the writer takes a record chunk by chunk,
with a running digest, and the reader gives it back in the same way, so neither holds a record whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_folder
from .files import reading, written

#: Bytes of a chunk, and of what the reader takes from a file at once.
CHUNK_BYTES = 1 << 20
#: Smaller payloads are never revisits.
LEAST_SHARED = 100
#: Parts that the pages of one digest are dealt out to.
SALTS = 32
_SPACE = uuid.UUID("8f0f0f5e-3d0c-5f7b-9d6e-6f2f8a1c2b3d")
_COLUMNS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, chunk int, chunks int, data binary"


def records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of each page.

    A null html has an empty payload. Of equal payloads of ``least`` bytes or more the smallest
    page_id is the response (all rows that repeat it are), the others, those of a null page_id among
    them, revisit it; if no page_id is known, all are responses. Only ids and digests are shuffled to
    find them; a page then gets its decision by page_id.
    """
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = p.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    # a third of all pages may be one error page: its digest is dealt out
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    large = large.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = large.join(first, ["payload_digest", "_salt"]).drop("_salt").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    known, unknown = again.where("page_id is not null").alias("r"), again.where("page_id is null").alias("r")
    revisits = known.unionByName(unknown).withColumnsRenamed({"page_id": "_page", "payload_digest": "_digest"})
    out = p.join(revisits, p.page_id.eqNullSafe(F.col("_page")) & (p.payload_digest == F.col("_digest")), "left").drop("_page", "_digest")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def chunk_table(recs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of each record, a record's rows one after another; a revisit or an empty payload has one of no data."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    r = recs.withColumn("_body", body).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.octet_length("_body") / chunk_bytes)).cast("int"))
    r = r.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("chunks") == 1, F.col("_body")).otherwise(F.expr(f"substring(_body, chunk * {chunk_bytes} + 1, {chunk_bytes})"))
    return r.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", F.col("chunk").cast("int").alias("chunk"), "chunks", data.alias("data"))


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """The id of the response of a payload; ``place`` tells revisits, and pages without an id, apart."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}:{place}')}>"


def _clean(value: str | None) -> str:
    """A header value cannot hold line ends."""
    return "" if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def head_of(page_id: int | None, url: str | None, kind: str, refers_to: int | None, size: int, digest: str, place: str = "") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, place if kind == 'revisit' or page_id is None else '')}", f"WARC-Target-URI: {_clean(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str) -> list[str]:
    """Write the rows of chunk_table into one gzip file a partition, a member a record; the names of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        n, packer, digest = 0, None, None
        with written(folder, name) as out:
            while batch is not None:
                for page, url, kind, to, size, want, chunk, chunks_of, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if chunk == 0:
                        packer, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                        out.write(packer.compress(head_of(page, url, kind, to, size, want, f"{name}/{n}")))
                    if data:
                        digest.update(data)
                        out.write(packer.compress(data))
                    if chunk == chunks_of - 1:
                        if kind == "response" and digest.hexdigest() != want:
                            raise ValueError(f"page {page}: the chunks do not make up the payload")
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        n += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

    return sorted(r["name"] for r in map_batches(chunks, run, "name string, n bigint").collect())  # a row a file


def members(file, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Iterator[bytes]]:
    """The members of a gzip file, each as a stream of pieces of bounded size."""
    held = b""
    while held or (held := file.read(chunk_bytes)):
        unpacker = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal held
            while not unpacker.eof:
                raw = held or file.read(chunk_bytes)
                if not raw:
                    raise EOFError("a member is cut off")
                piece = unpacker.decompress(raw, chunk_bytes)
                held = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
                if piece:
                    yield piece

        stream = pieces()
        yield stream
        for _ in stream:  # what the caller left
            pass


def parsed(stream: Iterator[bytes]) -> dict:
    """What a record's headers say, and the digest and size of its payload as it streams by."""
    head = b""
    while (end := head.find(b"\r\n\r\n")) < 0 or (http := head.find(b"\r\n\r\n", end + 4)) < 0:
        head += next(stream)
    fields = dict(x.split(": ", 1) for x in head[:end].decode().split("\r\n")[1:])
    inner = dict(x.split(": ", 1) for x in head[end + 4 : http].decode().split("\r\n")[1:])
    left = int(fields["Content-Length"]) - (http + 4 - (end + 4))
    digest, size = hashlib.sha256(), 0
    rest = head[http + 4 :]
    while left:
        piece = (rest or next(stream))[:left]
        rest = b""
        digest.update(piece)
        size += len(piece)
        left -= len(piece)
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (digest.hexdigest() != stated or size != int(inner["Content-Length"])):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": int(inner["Content-Length"]), "payload_digest": stated, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id")}


def read_archives(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the files."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if not names:
        return spark.createDataFrame([], schema)
    types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with reading(folder, name) as f:
                    rows = []
                    for stream in members(f):
                        rows.append(parsed(stream))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, types)

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names), "name")
    return map_batches(files, run, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into archives in a new folder below the shared one, and read every record back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    return read_archives(spark, folder, write_archives(chunk_table(records(pages)), folder))


ORACLE = """
with p as (select page_id, coalesce(html, '') h, cast(strlen(coalesce(html, '')) as bigint) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) m from p where payload_bytes >= 100 group by 1)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when p.payload_bytes >= 100 and p.page_id is distinct from f.m and f.m is not null then 'revisit' else 'response' end record_type,
  case when p.payload_bytes >= 100 and p.page_id is distinct from f.m then f.m end refers_to
from p left join f using (payload_digest)
"""
