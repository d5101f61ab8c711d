"""Language identification by unigram piece models, summed over all segmentations.

The vocabulary is a public one; each language has a probability for every piece. A word's
probability is the sum over all ways to cut it into pieces (a forward pass), a text's the product
over its words. The piece probabilities are fitted by expectation and maximisation on a bounded
sample of the labelled documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns

#: Labelled documents of each language that the fit reads at most, and rounds of the fit.
FIT_DOCS, ROUNDS = 150, 3
#: Probability of a character that the vocabulary or the language does not have; pieces of a language have a tenth of it at least.
FLOOR = 1e-7
#: Words whose scores a task keeps, and the length up to which words are scored together without logarithms.
KEPT_WORDS, SHORT = 400_000, 36
#: Words whose scores are summed at once, so that a text of any length takes bounded memory.
WORDS_AT_ONCE = 1 << 18
#: Characters of longer words that the fit sums over at once.
LONG_AT_ONCE = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNDETERMINED = "und"


def vocabulary(path: str) -> list[str]:
    """All pieces of letters and their marks of a sentencepiece model, in lower case, with its mark for a word's start."""
    import unicodedata

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p.strip("▁") and "▁" not in p[1:] and all(unicodedata.category(c)[0] in "LM" for c in p.removeprefix("▁")))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's words begin (and the last ends), each word's number, and the distinct words: runs of letters and their marks, lower case, after a mark; empty for a run without letters."""
    t = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(t, " "), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    lettered = pc.match_substring_regex(coded.dictionary, r"\p{L}").to_pylist()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ["▁" + w if x else "" for w, x in zip(coded.dictionary.to_pylist(), lettered)]


class Pieces:
    """Finds pieces in words by rolling hashes."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.power = np.ones(self.longest + 1, np.uint64)
        for i in range(1, self.longest + 1):
            self.power[i] = int(self.power[i - 1]) * int(_BASE) & 0xFFFFFFFFFFFFFFFF

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def prefixes(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of the prefixes of rows of characters."""
        h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            h[:, i + 1] = h[:, i] * _BASE + codes[:, i] + np.uint64(1)
        return h

    def ending(self, h: np.ndarray, end: int, n: int) -> np.ndarray:
        """The piece of ``n`` characters that ends at ``end`` in each row; -1 if there is none."""
        x = h[:, end] - h[:, end - n] * self.power[n]
        at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        return np.where(self.hashes[at] == x, self.order[at], -1)

    def all_ending(self, h: np.ndarray, n: int) -> np.ndarray:
        """The pieces of ``n`` characters that end at n, n + 1, ... in each row; -1 where there is none."""
        x = h[:, n:] - h[:, :-n] * self.power[n]
        at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        return np.where(self.hashes[at] == x, self.order[at], -1)


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    return {int(lengths[g[0]]): g for g in np.split(order, edges) if len(g)}


def codes_of(words: list[str], own: np.ndarray, n: int) -> np.ndarray:
    return np.frombuffer("".join(words[i] for i in own).encode("utf-32-le"), "<u4").reshape(len(own), n).astype(np.uint64)


class Model:
    """``prob``: rows of pieces, a column a language, and a last row for an unknown character."""

    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray):
        self.find, self.langs, self.prob = Pieces(pieces), langs, prob

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """Log of the summed probability of all segmentations of each word, by language."""
        out = np.zeros((len(words), len(self.langs)))
        for n, own in by_length(words).items():
            for i in range(0, len(own), 20_000):
                part = own[i : i + 20_000]
                if n:
                    out[part] = self._forward(codes_of(words, part, n))
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        h, n = self.find.prefixes(codes), codes.shape[1]
        far = self.find.longest
        alpha = [np.ones((len(codes), len(self.langs)))]
        scale = np.zeros((len(codes), 1))
        for end in range(1, n + 1):
            now = np.zeros_like(alpha[0])
            for size in range(1, min(far, end) + 1):
                p = self.find.ending(h, end, size)
                hit = np.flatnonzero(p >= 0) if size > 1 else np.arange(len(p))
                if len(hit):
                    now[hit] += alpha[-size][hit] * self.prob[p[hit]]
            alpha = [*alpha[-far + 1 :], now] if far > 1 else [now]
            if n > SHORT:  # keep long words from underflow: all that is held takes one scale
                most = np.max([a.max(axis=1) for a in alpha], axis=0)[:, None]
                alpha = [a / most for a in alpha]
                scale += np.log(most)
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(alpha[-1]), -690.0) + scale


def expected(find: Pieces, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (and, last, of unknown characters) over all segmentations, for one language."""
    out = np.zeros(len(prob))
    for n, own in by_length(words).items():
        if not n:
            continue
        if n > SHORT:
            for i in range(0, len(own), step := max(1, LONG_AT_ONCE // n)):
                part = own[i : i + step]
                _expected_long(find, codes_of(words, part, n), weight[part], prob, out)
            continue
        h = find.prefixes(codes_of(words, own, n))
        w = weight[own]
        alpha, beta = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
        alpha[0], beta[n] = 1.0, 1.0
        arcs = {(end, size): find.ending(h, end, size) for end in range(1, n + 1) for size in range(1, min(find.longest, end) + 1)}
        use = {k: np.where((p >= 0) | (k[1] == 1), prob[p], 0.0) for k, p in arcs.items()}
        for end in range(1, n + 1):
            for size in range(1, min(find.longest, end) + 1):
                alpha[end] += alpha[end - size] * use[end, size]
        for start in range(n - 1, -1, -1):
            for size in range(1, min(find.longest, n - start) + 1):
                beta[start] += use[start + size, size] * beta[start + size]
        for (end, size), p in arcs.items():
            share = w * alpha[end - size] * use[end, size] * beta[end] / alpha[n]
            np.add.at(out, p, share)  # -1, an unknown character, is the last row
    return out


def _expected_long(find: Pieces, codes: np.ndarray, weight: np.ndarray, prob: np.ndarray, out: np.ndarray) -> None:
    """Add the expected uses of pieces in long words of one length, by logarithms of the sums, which would underflow."""
    h, n = find.prefixes(codes), codes.shape[1]
    far = min(find.longest, n)
    piece, use = np.full((n + 1, far, len(codes)), -1), np.zeros((n + 1, far, len(codes)))
    for size in range(1, far + 1):
        p = find.all_ending(h, size).T
        piece[size:, size - 1] = p
        use[size:, size - 1] = np.where((p >= 0) | (size == 1), prob[p], 0.0)
    alpha, beta = np.zeros((n + 1, len(codes))), np.zeros((n + 1, len(codes)))
    for end in range(1, n + 1):
        k = min(far, end)
        alpha[end] = alpha[end - 1] + np.log((use[end, :k] * np.exp(alpha[end - k : end][::-1] - alpha[end - 1])).sum(axis=0))
    for start in range(n - 1, -1, -1):
        k = min(far, n - start)
        beta[start] = beta[start + 1] + np.log((use[np.arange(start + 1, start + k + 1), np.arange(k)] * np.exp(beta[start + 1 : start + k + 1] - beta[start + 1])).sum(axis=0))
    for size in range(1, far + 1):
        share = weight * use[size:, size - 1] * np.exp(np.minimum(alpha[: n - size + 1] + beta[size:] - alpha[n], 700.0))
        np.add.at(out, piece[size:, size - 1], share)


def train(samples: dict[str, list[str]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from its sample texts."""
    find, langs = Pieces(pieces), sorted(samples)
    prob = np.zeros((len(pieces) + 1, len(langs)))
    lengths = np.array([len(p) for p in pieces] + [1])
    for k, lang in enumerate(langs):
        counts: Counter = Counter()
        for i in range(0, len(samples[lang]), 50):
            _, at, names = words_of(pa.array(samples[lang][i : i + 50], pa.string()))
            for w, n in zip(names, np.bincount(at, minlength=len(names)).tolist()):
                counts[w] += n
        counts.pop("", None)
        words, weight = list(counts), np.array(list(counts.values()), float)
        p = 0.01 ** (lengths - 1.0) / len(lengths)
        p[-1] = FLOOR
        for _ in range(rounds if words else 0):
            p = expected(find, words, weight, p)
            p = np.maximum(p / p.sum(), FLOOR / 10)
            p[lengths == 1] = np.maximum(p[lengths == 1], FLOOR)
            p[-1] = FLOOR
        prob[:, k] = p
    return Model(pieces, langs, prob)


def fit(docs: DataFrame, vocabulary_path: str, *, held_out: str = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2", fit_docs: int = FIT_DOCS) -> Model:
    """A model from at most ``fit_docs`` labelled documents of each language, the first by a hash of doc_id, none of them held out."""
    spark = docs.sparkSession
    ids = docs.where(f"not ({held_out}) and lang is not null and doc_id is not null").select("doc_id", "lang")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.withColumn("n", nth).where(F.col("n") <= fit_docs).select("doc_id", "lang").distinct()
    rows = docs.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").collect()
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r.lang, []).append(r.text)
    return train(samples, vocabulary(vocabulary_path))


def predict(docs: DataFrame, model: Model, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all, unless named) with lang_pred and score: the likeliest language and its posterior under equal priors.

    A text that is null or has no letter is ``und`` with score 0, as all are if nothing was learned.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.find.pieces, model.langs, model.prob))

    def make():
        pieces, langs, prob = held.value
        if not langs:
            return lambda t: (pa.array([UNDETERMINED] * len(t)), pa.array([0.0] * len(t)))
        m = Model(pieces, langs, prob)
        known: dict[str, int] = {"": 0}
        scores = np.zeros((1 << 12, len(langs)))

        def run(texts):
            nonlocal scores
            offsets, at, names = words_of(texts)
            if len(known) > KEPT_WORDS:
                known.clear()
                known[""] = 0
            rows = np.array([known.get(w, -1) for w in names], np.int64)
            if len(new := np.flatnonzero(rows < 0)):
                words = [names[i] for i in new.tolist()]
                rows[new] = np.arange(len(known), len(known) + len(new))
                while len(known) + len(new) > len(scores):
                    scores = np.concatenate([scores, np.zeros_like(scores)])
                scores[rows[new]] = m.log_likelihoods(words)
                known.update(zip(words, rows[new].tolist()))
            total, words, own = np.zeros((len(texts), len(langs))), np.zeros(len(texts), np.int64), scores[rows]
            real = np.array([bool(w) for w in names], bool)
            text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
            for i in range(0, len(at), WORDS_AT_ONCE):
                part, of = at[i : i + WORDS_AT_ONCE], text_of[i : i + WORDS_AT_ONCE]
                words += np.bincount(of, real[part], len(texts)).astype(np.int64)
                for k in range(len(langs)):
                    total[:, k] += np.bincount(of, own[part, k], len(texts))
            empty = words == 0
            best = total.argmax(axis=1)
            post = 1 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
            return pa.array([UNDETERMINED if e else langs[b] for e, b in zip(empty.tolist(), best.tolist())], pa.string()), pa.array(np.where(empty, 0.0, post))

        return run

    return map_columns(docs, make, [text], "lang_pred string, score double", docs.columns if carry is None else carry)
