"""Counts over the signs of texts, summed where the texts are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import ready, slices, tokenised

#: Signs of words as numbers from 1; grams of up to three are numbers to this base.
BASE = 37
_SIGN = np.zeros(256, np.int64)
_SIGN[[*range(48, 58), *range(97, 123)]] = np.arange(1, BASE)
#: (row, gram) cells that are marked at once.
CELLS = 32_000_000


def signs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all signs of the words of lists, one after the other: their numbers, their words' places, and how many follow in the word."""
    flat = lists.flatten()
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    offset = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset] if len(flat) else 0
    code = _SIGN[np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offset : offset + size.sum()]] if len(flat) else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(size)), size)
    return code, word, np.cumsum(size)[word] - 1 - np.arange(len(code)) if len(code) else code


def grams_at(code: np.ndarray, after: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``n`` signs of a word begin, and their numbers."""
    at = np.flatnonzero(after >= n - 1)
    out = code[at]
    for k in range(1, n):
        out = out * BASE + code[at + k]
    return at, out


def spelled(number: int) -> str:
    out = ""
    while number:
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[number % BASE - 1] + out
        number //= BASE
    return out


def frequencies(docs: DataFrame) -> DataFrame:
    """g, frequency, docs: runs of one to three signs of content words, how often they occur and in how many rows."""
    ready(docs.sparkSession)
    many = BASE**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, held = np.zeros(many, np.int64), np.zeros(many, np.int64)
        for b in batches:
            lists = tokenised(b.column(0), words=True)
            for lo, hi in slices(lists):
                step = CELLS // many
                for r0 in range(lo, hi, step):
                    part = lists.slice(r0, min(step, hi - r0))
                    row = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
                    code, word, after = signs(part)
                    seen = np.zeros((len(part), many), bool)
                    for n in (1, 2, 3):
                        at, gram = grams_at(code, after, n)
                        often += np.bincount(gram, minlength=many)
                        seen[row[word[at]], gram] = True
                    held += np.count_nonzero(seen, axis=0)
        found = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array([spelled(int(g)) for g in found], pa.string()), pa.array(often[found]), pa.array(held[found])], names=["g", "frequency", "docs"])

    parts = docs.select(F.lower("text").alias("text")).mapInArrow(run, "g string, frequency bigint, docs bigint")
    return parts.groupBy("g").agg(F.sum("frequency").alias("frequency"), F.sum("docs").alias("docs"))


def unheld(docs: DataFrame, tokens) -> DataFrame:
    """token, doc_id of the tokens that a row's lower-case text does not contain. A text is read once: each token is looked for behind the one before, and in the whole text only if it is not there."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, lists = b.columns
            out = []
            for i in range(len(ids)):
                low = texts[i].as_py()
                if low is None:
                    continue
                at = 0
                for t in lists[i].as_py() or ():
                    place = low.find(t, at)
                    if place >= 0:
                        at = place + len(t)
                    elif t not in low:
                        out.append((t, i))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), ids.take(pa.array([i for _, i in out], pa.int64()))], names=["token", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.lower("text").alias("low"), tokens.alias("t")).mapInArrow(run, f"token string, doc_id {kind}").distinct()


def nearest(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """qid, doc_id, score: for each query (qid, y) the rows (doc_id, x) that can be among the ``k`` of the largest inner product, itself left out."""
    ready(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((np.array([q.qid for q in queries], np.int64), np.array([q.y for q in queries], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, y = sent.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            step = max(1, 4_000_000 // max(len(ids), 1))
            for q0 in range(0, len(qid), step):
                score = x @ y[q0 : q0 + step].T
                own = ids[:, None] == qid[None, q0 : q0 + step]
                score[own] = -np.inf
                least = np.partition(score, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.full(score.shape[1], -np.inf)
                row, q = np.nonzero(~own & (score >= np.where(np.isinf(least), least, least - 1e-6 * (1 + np.abs(least)))))
                yield pa.RecordBatch.from_arrays([pa.array(qid[q0 + q]), pa.array(ids[row]), pa.array(score[row, q])], names=["qid", "doc_id", "score"])

    return rows.mapInArrow(run, "qid bigint, doc_id bigint, score double")


class Views:
    """Terms of a bag of words ("w..."), their first four signs ("p...") and their trigrams ("t...") in lists of content words.

    Gives lengths of all rows, and row, place in ``terms`` and weight of each term held.
    """

    def __init__(self, terms: list[str]):
        self.many = max(len(terms), 1)
        place = {t: i for i, t in enumerate(terms)}
        self.words, self.heads = ({t[1:]: i for t, i in place.items() if t[0] == kind} for kind in "wp")
        self.grams = np.full(BASE**3, -1, np.int64)
        for t, i in place.items():
            if t[0] == "t":
                self.grams[int(np.dot(_SIGN[np.frombuffer(t[1:].encode(), np.uint8)], [BASE * BASE, BASE, 1]))] = i

    def __call__(self, part: pa.Array):
        flat = part.flatten()
        size = pc.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        signs_of = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        weight = np.where(pos < 14, 1.6, 1.0)
        dl = np.bincount(row, weight + 0.2 * (signs_of >= 4) + 0.3 * (signs_of - 2), len(size))
        found = []
        for known, w, texts in ((self.words, weight, flat), (self.heads, np.where(signs_of >= 4, 0.2, 0.0), pc.utf8_slice_codeunits(flat, 0, 4))):
            at = pc.fill_null(pc.index_in(texts, value_set=pa.array(list(known), pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            on = np.flatnonzero((at >= 0) & (w > 0))
            found.append((row[on], np.array([*known.values(), 0], np.int64)[at[on]], w[on]))
        code, word, after = signs(part)
        at, gram = grams_at(code, after, 3)
        term = self.grams[gram]
        on = term >= 0
        found.append((row[word[at[on]]], term[on], np.full(np.count_nonzero(on), 0.3)))
        key, inverse = np.unique(np.concatenate([r * self.many + t for r, t, _ in found]), return_inverse=True)
        return dl, key // self.many, key % self.many, np.bincount(inverse, np.concatenate([w for *_, w in found]), len(key))


def view_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """token, df, dl of ``terms``; the row of the empty term counts the documents that have a word, and their lengths."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((terms, Views(terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, views = sent.value
        df, n, total = np.zeros(len(names), np.int64), 0, 0.0
        for b in batches:
            lists = tokenised(b.column(0), words=True)
            for lo, hi in slices(lists):
                dl, _, term, _ = views(lists.slice(lo, hi - lo))
                df += np.bincount(term, minlength=len(names))
                n, total = n + np.count_nonzero(dl), total + float(dl.sum())
        yield pa.RecordBatch.from_arrays([pa.array(["", *names]), pa.array([n, *df.tolist()], pa.int64()), pa.array([total] + [0.0] * len(names))], names=["token", "df", "dl"])

    return docs.select(F.lower("text").alias("text")).mapInArrow(run, "token string, df bigint, dl double").groupBy("token").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).where("df > 0")
