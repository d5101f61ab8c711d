"""Scores of all documents for all queries in one pass over the texts, without a shuffle of tokens or scores.

A document's tokens stand in one row, so all that a score needs of them is summed where the row is read: the terms of
the queries go to the executors, the texts stay. Only rows that a later step asks for (ranks, maxima) are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import STOP_WORDS
from corpuslens.session import ship_package

#: Rows and bytes of an Arrow batch, tokens of a slice of it, and (document, query) cells that are summed at once.
BATCH_ROWS, BATCH_BYTES, SLICE_TOKENS, CELLS = 3000, 16 << 20, 1_000_000, 2_000_000


def ready(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keyed(df: DataFrame, key: str) -> bool:
    """Whether each row has a key of its own, so that what belongs to a key stands in one row."""
    n, distinct = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    return n == distinct


def tokenised(texts: pa.Array, words: bool = False) -> pa.Array:
    """The tokens of lower-case texts, as ``plain_tokens`` gives them: lists of runs of ASCII letters and digits. Null: none.

    ``words``: as ``content_words`` gives them, from the first letter of a run on, of three signs or more, without stop words.
    """
    texts = texts.cast(pa.string())
    places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[places[0] : places[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    places = places - places[0]
    inside = _INSIDE[data]
    begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[:-1], ends[1:] = inside, inside
    begins[1:-1] &= ~inside[:-1]
    ends[1:-1] &= ~inside[1:]
    edge = places[(places > 0) & (places < len(data))]  # a token ends with its text
    edge = edge[inside[edge] & inside[edge - 1]]
    begins[edge] = ends[edge] = True
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    if words:
        letters = np.flatnonzero(inside & (data >= 97))
        at = np.searchsorted(letters, first)
        first = np.append(letters, len(data))[at]
        long = last - first > 2
        first, last = first[long], last[long]
        step = np.zeros(len(data) + 1, np.int8)
        step[first] += 1
        step[last] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first, out=offsets[1:])
    tokens = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    if words:
        kept = pc.is_null(pc.index_in(tokens, value_set=pa.array(STOP_WORDS))).to_numpy(zero_copy_only=False)
        first, tokens = first[kept], tokens.filter(pa.array(kept))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, places).astype(np.int32)), tokens)


_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123)]] = True


def vocabulary(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """token, df of all tokens, or of those of ``only`` (small). The row of the empty token counts the documents and, as ``dl``, their tokens."""
    ready(docs.sparkSession)
    kept = None if only is None else docs.sparkSession.sparkContext.broadcast(sorted({r.token for r in only.select("token").collect()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if kept is None else pa.array(kept.value, pa.string())
        for b in batches:
            lists = tokenised(b.column(0))
            for lo, hi in slices(lists):
                part = lists.slice(lo, hi - lo)
                if known is None:
                    tokens = pc.unique(part.flatten())
                    size, _, code, _ = held(part, tokens)
                else:
                    tokens = known
                    size, _, code, _ = held(part, tokens)
                df = np.bincount(code, minlength=len(tokens))
                found = np.flatnonzero(df)
                names = pa.concat_arrays([pa.array([""]), tokens.take(pa.array(found))])
                dl = pa.array(np.concatenate([[size.sum()], np.zeros(len(found), np.int64)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([[(size > 0).sum()], df[found]]).astype(np.int64)), dl], names=["token", "df", "dl"])

    parts = docs.select(F.lower("text").alias("text")).mapInArrow(run, "token string, df bigint, dl bigint")
    return parts.groupBy("token").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).where("df > 0")


class Terms:
    """Query terms by token: the queries that hold a token and, by name, a number for each of these pairs."""

    def __init__(self, rows: list, **columns: Callable):
        rows = sorted(rows, key=lambda r: (r.token, r.qid))
        self.qids = sorted({r.qid for r in rows})
        place = {q: i for i, q in enumerate(self.qids)}
        self.tokens = sorted({r.token for r in rows})
        at = {t: i for i, t in enumerate(self.tokens)}
        self.query = np.array([place[r.qid] for r in rows], np.int64)
        self.first = np.searchsorted(np.array([at[r.token] for r in rows], np.int64), np.arange(len(self.tokens) + 1))
        self.of = {k: np.array([f(r) for r in rows], np.float64) for k, f in columns.items()}


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a list column that hold about SLICE_TOKENS values; each has one row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_TOKENS, "right")))
        yield a, b
        a = b


def held(lists: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the lists that are not empty: lengths of all; row, place in ``tokens`` and number of each distinct token held."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = pc.fill_null(pc.index_in(lists.flatten(), value_set=tokens), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    hit = code >= 0
    key, n = np.unique(row[hit] * max(len(tokens), 1) + code[hit], return_counts=True)
    return size, key // max(len(tokens), 1), key % max(len(tokens), 1), n


def distinct(lists: pa.Array) -> np.ndarray:
    """How many distinct tokens each list has."""
    out = np.zeros(len(lists), np.int64)
    for lo, hi in slices(lists):
        part = lists.slice(lo, hi - lo)
        out[lo:hi] = np.bincount(held(part, pc.unique(part.flatten()))[1], minlength=hi - lo)
    return out


def pairs_of(first: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hit with each entry of its token: the number of the hit and of the entry."""
    n = first[code + 1] - first[code]
    hit = np.repeat(np.arange(len(code)), n)
    return hit, np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + first[code][hit]


def scored(docs: DataFrame, terms: Terms, sums: Callable, names: list[str], avgdl: float, more: dict[str, Callable] | None = None, carry: tuple[str, ...] = (), keep: Callable | None = None, bag: Callable | None = None) -> DataFrame:
    """doc_id, qid, hits and the ``names``d sums over the query terms that a document holds, for all pairs with one at least.

    ``sums(of, tf, dl, avgdl)`` gives the addends of each name for arrays of hits: ``of`` has the columns of the terms.
    ``more`` gives, by name, functions of a list column that return rows, queries (places in ``terms.qids``) and addends of
    what no single token tells; ``carry``: dl or u, a document's tokens and distinct tokens. ``keep(ids, q, cols, row, many)``
    tells which pairs can matter to what follows (``q``: places in ``terms.qids``), so that the others need not leave the worker.
    ``bag(words)``: another measure of lengths, rows, terms and their frequencies, from content words.
    """
    ready(docs.sparkSession)
    more = more or {}
    columns = ["doc_id", *carry, "qid", "hits", *names, *more]
    sent = docs.sparkSession.sparkContext.broadcast((terms, more))
    schema = "doc_id {}, {}qid bigint, hits bigint, {}".format(docs.schema["doc_id"].dataType.simpleString(), "".join(f"{n} bigint, " for n in carry), ", ".join(f"{n} double" for n in [*names, *more]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, further = sent.value
        tokens, qids, many = pa.array(t.tokens, pa.string()), np.array(t.qids, np.int64), max(len(t.qids), 1)
        for b in batches:
            ids, lists = b.column(0), tokenised(b.column(1), words=bag is not None)
            told = {"dl": lambda: pc.list_value_length(lists), "u": lambda: pa.array(distinct(lists))}
            own_columns = [told[n]().cast(pa.int64()) for n in carry]
            for lo, hi in slices(lists):
                part = lists.slice(lo, hi - lo)
                size, row, code, tf = bag(part) if bag is not None else held(part, tokens)
                besides = [f(part) for f in further.values()]
                step = max(1, CELLS // many)
                for r0 in range(0, hi - lo, step):
                    own = slice(*np.searchsorted(row, (r0, r0 + step)))
                    hit, entry = pairs_of(t.first, code[own])
                    cell = (row[own][hit] - r0) * many + t.query[entry]
                    wide = min(step, hi - lo - r0) * many
                    found = np.bincount(cell, minlength=wide)
                    at = np.flatnonzero(found)
                    if not len(at):
                        continue
                    made = sums({k: v[entry] for k, v in t.of.items()}, tf[own][hit], size[row[own][hit]], avgdl)
                    made = [np.bincount(cell, x, wide)[at] for x in made]
                    for r, q, x in besides:
                        in_step = (r >= r0) & (r < r0 + step)
                        made.append(np.bincount((r[in_step] - r0) * many + q[in_step], x[in_step], wide)[at])
                    from_row, q = at // many + lo + r0, at % many
                    cols = [ids.take(pa.array(from_row)), *(c.take(pa.array(from_row)) for c in own_columns), qids[q], found[at], *(np.asarray(x, np.float64) for x in made)]
                    if keep is not None:
                        kept = np.flatnonzero(keep(cols[0], q, {n: np.asarray(c) for n, c in zip(columns[1:], cols[1:], strict=True)}, at // many, many))
                        cols = [c.take(pa.array(kept)) if isinstance(c, pa.Array) else c[kept] for c in cols]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=columns)

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, schema)


def first_of(k: int, key: Callable) -> Callable:
    """Keeps the pairs that can be among the ``k`` of a query with the largest ``key(q, cols)``, ties and what rounding may make one included; never those of -inf."""

    def keep(ids, q, cols, row, many):
        x = np.asarray(key(q, cols), np.float64)
        x = np.where(np.isnan(x), -np.inf, x)
        table = np.full((int(row.max()) + 1) * many, -np.inf)
        table[row * many + q] = x
        table = table.reshape(-1, many)
        least = np.partition(table, len(table) - k, axis=0)[len(table) - k] if len(table) > k else np.full(many, -np.inf)
        with np.errstate(invalid="ignore"):
            return (x > -np.inf) & (x >= (least - 1e-6 * (1 + np.abs(least)))[q])

    return keep


def among(pairs: list) -> Callable:
    """Keeps the pairs (qid, doc_id) of a list."""
    by_query: dict = {}
    for q, d in pairs:
        by_query.setdefault(q, set()).add(d)
    known = {d for v in by_query.values() for d in v}

    def keep(ids, q, cols, row, many):
        out = pc.is_in(ids, value_set=pa.array(sorted(known), ids.type)).to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(out):
            out[i] = ids[int(i)].as_py() in by_query.get(int(cols["qid"][i]), ())
        return out

    return keep


class Phrases:
    """How often pairs of neighbouring tokens of a query stand next to each other in a document."""

    def __init__(self, pairs: list, qids: list):
        at = {q: i for i, q in enumerate(qids)}
        known = sorted({(r.a, r.b) for r in pairs})
        self.tokens = sorted({t for p in known for t in p})
        place = {t: i for i, t in enumerate(self.tokens)}
        self.keys = np.array([place[a] * len(self.tokens) + place[b] for a, b in known], np.int64)
        code = {p: i for i, p in enumerate(known)}
        rows = sorted((code[r.a, r.b], at[r.qid]) for r in pairs if r.qid in at)
        self.query = np.array([q for _, q in rows], np.int64)
        self.first = np.searchsorted(np.array([c for c, _ in rows], np.int64), np.arange(len(known) + 1))

    def __call__(self, lists: pa.Array):
        flat = lists.flatten()
        code = pc.fill_null(pc.index_in(flat, value_set=pa.array(self.tokens, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:]))
        key = code[both] * len(self.tokens) + code[both + 1]
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        hit, entry = pairs_of(self.first, at[known])
        return row[both[known]][hit], self.query[entry], np.ones(len(hit))


class Prefixes:
    """How many distinct tokens of a document begin as some token of a query, of more than ``n`` signs, does in its first ``n``."""

    def __init__(self, rows: list, qids: list, n: int = 5):
        at = {q: i for i, q in enumerate(qids)}
        held_by = sorted({(r.token[:n], at[r.qid]) for r in rows if len(r.token) > n and r.qid in at})
        self.n, self.heads = n, sorted({h for h, _ in held_by})
        place = {h: i for i, h in enumerate(self.heads)}
        self.query = np.array([q for _, q in held_by], np.int64)
        self.first = np.searchsorted(np.array([place[h] for h, _ in held_by], np.int64), np.arange(len(self.heads) + 1))

    def __call__(self, lists: pa.Array):
        coded = lists.flatten().dictionary_encode()
        head = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(coded.dictionary, 0, self.n), value_set=pa.array(self.heads, coded.dictionary.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kept = head[token] >= 0
        key = np.unique(row[kept] * max(len(head), 1) + token[kept])
        row, token = key // max(len(head), 1), key % max(len(head), 1)
        hit, entry = pairs_of(self.first, head[token])
        return row[hit], self.query[entry], np.ones(len(hit))


class Agreement:
    """How many tokens of a query have one of the tokens they lead to (qid, qt, dt) in a document."""

    def __init__(self, rows: list, qids: list):
        at = {q: i for i, q in enumerate(qids)}
        told = sorted({(r.qid, r.qt) for r in rows})
        self.query = np.array([at[q] for q, _ in told], np.int64)
        place = {p: i for i, p in enumerate(told)}
        self.tokens = sorted({r.dt for r in rows})
        code = {t: i for i, t in enumerate(self.tokens)}
        pairs = sorted((code[r.dt], place[r.qid, r.qt]) for r in rows)
        self.pair = np.array([p for _, p in pairs], np.int64)
        self.first = np.searchsorted(np.array([c for c, _ in pairs], np.int64), np.arange(len(self.tokens) + 1))

    def __call__(self, lists: pa.Array):
        _, row, code, _ = held(lists, pa.array(self.tokens, lists.type.value_type))
        hit, entry = pairs_of(self.first, code)
        key = np.unique(row[hit] * max(len(self.query), 1) + self.pair[entry])
        return key // max(len(self.query), 1), self.query[key % max(len(self.query), 1)], np.ones(len(key))


def containing(docs: DataFrame, items: list) -> DataFrame:
    """qid, doc_id of the documents that hold the text of an item (qid, text, tokens) whole.

    All tokens of a text but its first and last are then tokens of the document: only documents that hold them all are
    searched. A text of fewer than three tokens is looked for in every document.
    """
    ready(docs.sparkSession)
    items = [(r.qid, r.text, sorted(set(r.tokens[1:-1]))) for r in items if r.text is not None]
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = [i for i in sent.value if i[2]]
        short = [i for i in sent.value if not i[2]]
        at: dict[str, list[int]] = {}
        for i, (_, _, words) in enumerate(inner):
            for w in words:
                at.setdefault(w, []).append(i)
        tokens = pa.array(list(at), pa.string())
        flat = np.array([i for v in at.values() for i in v], np.int64)
        first = np.cumsum([0, *map(len, at.values())])
        needs, many = np.array([len(i[2]) for i in inner], np.int64), max(len(inner), 1)
        for b in batches:
            ids, texts, lists = b.column(0), b.column(1), tokenised(b.column(2))
            out = []
            for lo, hi in slices(lists):
                part = lists.slice(lo, hi - lo)
                _, row, code, _ = held(part, tokens.cast(part.type.value_type))
                step = max(1, CELLS // many)
                for r0 in range(0, hi - lo, step):
                    own = slice(*np.searchsorted(row, (r0, r0 + step)))
                    hit, entry = pairs_of(first, code[own])
                    cell, n = np.unique((row[own][hit] - r0) * many + flat[entry], return_counts=True)
                    full = cell[n == needs[cell % many]] if len(cell) else cell
                    out += [(lo + r0 + int(c) // many, inner[int(c) % many][0]) for c in full if inner[int(c) % many][1] in texts[lo + r0 + int(c) // many].as_py()]
            if short:
                out += [(i, q) for i, text in enumerate(texts.to_pylist()) if text is not None for q, s, _ in short if s in text]
            yield pa.RecordBatch.from_arrays([pa.array([q for _, q in out], pa.int64()), ids.take(pa.array([i for i, _ in out], pa.int64()))], names=["qid", "doc_id"])

    return docs.select("doc_id", "text", F.lower("text").alias("t")).mapInArrow(run, f"qid bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
