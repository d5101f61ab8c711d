"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_columns

#: Lower-cases A-Z and turns every ASCII sign that is neither letter nor digit into a space; other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of benchmark text whose patterns are sent to the executors at once; a larger benchmark is searched for block by block.
#: A matcher takes up to 50 times its text (numbers of words, shifts and buckets; tests measure it), so about 100 MB.
BLOCK_BYTES = 2 << 20
SHINGLE = 8
#: Windows of one last block above which the first block selects those to compare.
LARGE_BUCKET = 16


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], size: int = SHINGLE) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``size`` words; the whole, if it has fewer but not none."""
    n = min(size, len(words))
    for i in range(len(words) - n + 1 if n else 0):
        yield tuple(words[i : i + n])


class WuManber:
    """All windows of one number of words of some items, found by shift tables over blocks of words.

    Words are numbers, items one row of them, windows places in that row. A block is the last two words of a
    window (one, if windows have one word). A block that no window holds lets the search move by all words but
    one of it; a block that ends a window names a bucket, in which the first block selects the windows to
    compare word by word.
    """

    def __init__(self, size: int, items: list[tuple[int, list[int]]], words: int):
        self.size, self.words = size, words
        self.block = b = min(2, size)
        self.far = size - b + 1
        self.row = array("i")
        self.shift: dict[int, int] = {}
        #: last block: places of its windows, each once, in a large bucket by their first block; place: its items, if not just one
        self.buckets: dict[int, list[int] | dict[int, list[int]]] = {}
        self.owner = array("i")
        self.owners: dict[int, set[int]] = {}
        seen: dict[bytes, int] = {}
        for k, own in items:
            at = len(self.row)
            self.row.extend(own)
            self.owner.extend([k] * len(own))
            blocks = own if b == 1 else [x * words + y for x, y in zip(own, own[1:])]
            n = len(own)
            for end, block in enumerate(blocks, b):  # ``end``: words up to and with the block
                # the first window that holds the block ends so many words on
                step = max(0, size - end)
                if self.shift.get(block, self.far) > step:
                    self.shift[block] = step
            for first in range(n - size + 1):
                self._add(k, at + first, blocks[first + size - b], seen)
        for block, places in self.buckets.items():
            if len(places) > LARGE_BUCKET:
                by_first: dict[int, list[int]] = {}
                for p in places:
                    by_first.setdefault(self._first(p), []).append(p)
                self.buckets[block] = by_first

    def _add(self, k: int, place: int, block: int, seen: dict[bytes, int]) -> None:
        own = self.row[place : place + self.size].tobytes()
        p = seen.setdefault(own, place)
        if p == place:
            self.buckets.setdefault(block, []).append(place)
        elif self.owner[p] != k:
            self.owners.setdefault(p, {self.owner[p]}).add(k)

    def _first(self, place: int) -> int:
        return self.row[place] * self.words + self.row[place + 1] if self.block == 2 else self.row[place]

    def find(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """The first word of each occurrence, in order, and the place of the window found; words that no item has are -1."""
        m, n, far, row = self.size, len(words), self.far, self.row
        shift, buckets, base, pairs = self.shift.get, self.buckets, self.words, self.block == 2
        i = m - 1
        while i < n:
            last = words[i]
            if last < 0:
                i += m
                continue
            if pairs:
                before = words[i - 1]
                if before < 0:
                    i += m - 1
                    continue
                last += before * base
            step = shift(last, far)
            if step:
                i += step
                continue
            first = i - m + 1
            a = words[first]
            bucket = buckets.get(last, ())
            if type(bucket) is dict:
                bucket = bucket.get(a * base + words[first + 1] if pairs else a, ())
            for p in bucket:
                if row[p] == a and (not pairs or row[p + 1] == words[first + 1]) and row[p : p + m] == array("i", words[first : i + 1]):
                    yield first, p
            i += 1

    def items_at(self, place: int):
        return self.owners.get(place) or (self.owner[place],)


class Matcher:
    """One search for each number of words that windows of the items have."""

    def __init__(self, items: list[list[bytes]], size: int = SHINGLE):
        self.number: dict[bytes, int] = {}
        by_size: dict[int, list[tuple[int, list[int]]]] = {}
        for k, words in enumerate(items):
            if words:
                own = [self.number.setdefault(w, len(self.number)) for w in words]
                by_size.setdefault(min(size, len(own)), []).append((k, own))
        self.found = [WuManber(m, own, len(self.number)) for m, own in sorted(by_size.items())]

    def spans_and_items(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Disjoint ranges of words hit, in order, and the items."""
        spans, items = [], set()
        number = self.number.get
        own = [number(w, -1) for w in words]
        for m in self.found:
            for at, place in m.find(own):
                items.update(m.items_at(place))
                if spans and spans[-1][0] <= at <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], at + m.size)
                else:
                    spans.append([at, at + m.size])
        return merged(spans), items


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SHINGLE, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` columns (all, unless named) of every document with what it shares with the benchmark:
    n_words, n_hit, n_items, item_ids (as strings, sorted), spans (word ranges hit) and items_sha256.

    Null or empty texts have no words and hit nothing. Items with a null id take no part; items of the
    same id count once. An empty benchmark hits nothing. Repeated documents have a row each. Columns of
    the names made here are replaced. The benchmark goes to the executors in blocks of bounded size,
    whatever it has (an item larger than a block is one of its own).
    """
    made = ["n_words", "n_hit", "n_items", "item_ids", "spans", "items_sha256"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # the carried columns are one struct on the way, so that no name can clash
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    out = docs.select(kept.alias("kept"), F.col(f"`{text}`").alias("text"), F.lit(None).cast("array<array<bigint>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n"))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about ``block_bytes``
        found = spark.sparkContext.broadcast(([r.item_id for r in rows], Matcher([words_of(r.text.encode()) for r in rows], size)))

        def make(found=found):
            names, own = found.value

            def run(texts, spans, ids):
                new_spans, new_ids, n = [], [], []
                for t, s, i in zip(as_bytes(texts), spans.to_pylist(), ids.to_pylist()):
                    w = words_of(t)
                    hit, got = own.spans_and_items(w)
                    n.append(len(w))
                    new_spans.append(merged([*(s or []), *hit]) if s else hit)
                    new_ids.append(sorted({*(i or []), *(names[x] for x in got)}) if got or i else [])
                return pa.array(new_spans, pa.list_(pa.list_(pa.int64()))), pa.array(new_ids, pa.list_(pa.string())), pa.array(n, pa.int64())

            return run

        out = map_columns(out, make, ["text", "spans", "items"], "spans array<array<bigint>>, items array<string>, n bigint", ["kept", *(["text"] if k < blocks - 1 else [])])
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]), F.lit(0).cast("long"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    columns = [F.col("n"), hit, F.size("items").cast("long"), F.col("items"), F.col("spans"), digest]
    return out.select(*[F.col("kept").getField(c).alias(c) for c in carry], *[c.alias(name) for name, c in zip(made, columns)])


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
