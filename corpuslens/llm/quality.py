"""Quality classifier by positive-unlabelled learning.

A linear model of text statistics is fitted to trusted positives and unlabelled documents by the
non-negative unbiased risk: ``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))`` with sigmoid loss.
The prior is estimated from the scores that a first fit gives to both, not from any negative label: the share
of unlabelled documents over a threshold bounds the share of positives, at best where few negatives are over it.

The features are shares of kinds of bytes, words and lines, since junk differs from prose in these whatever
its language or subject, and they cost one pass over the text.
"""

from __future__ import annotations

import math
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_columns

#: Documents that the fit reads at most: trusted positives, and documents taken as unlabelled.
FIT_POSITIVE, FIT_UNLABELLED = 5000, 10000
STEPS, RATE, DECAY = 400, 0.05, 1e-4
_SIGNS = b"#$%&*|!?.,;:-_=+/\\<>@^~`\"'()[]{}"


def features(text: bytes | None) -> list[float]:
    """Statistics of a whole text: shares of kinds of bytes, and of repeated, distinct, short and upper-case words and lines."""
    b = text or b""
    n = len(b) or 1
    c = np.bincount(np.frombuffer(b, np.uint8), minlength=256) if b else np.zeros(256, np.int64)
    lower, upper, digit, high, space = int(c[97:123].sum()), int(c[65:91].sum()), int(c[48:58].sum()), int(c[128:].sum()), int(c[[9, 10, 13, 32]].sum())
    words = b.split()
    m = len(words) or 1
    distinct = len(set(words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    k = len(lines) or 1
    again = sum(map(eq, words, words[1:]))
    return [
        lower / n, upper / n, digit / n, high / n, space / n, (n - lower - upper - digit - high - space) / n,
        *(math.sqrt(int(c[x]) / n) for x in _SIGNS),
        upper / (lower + upper or 1), (n - space) / m / 10, again / m, distinct / m, math.log1p(m) / 10, math.sqrt(again / m),
        1 - len(set(lines)) / k, math.log1p(m / k) / 10, sum(len(w) <= 3 for w in words) / m, sum(len(w) > 20 for w in words) / m,
        sum(w.isupper() for w in words) / m, distinct / math.sqrt(m) / 10, math.sqrt(len({w.lower() for w in words}) / m), float(not words),
    ]


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weight: np.ndarray, bias: float):
        self.mean, self.spread, self.weight, self.bias = mean, spread, weight, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Minimise the non-negative risk by full-batch Adam; without positives or unlabelled rows every score is one half."""
    if not len(positive) or not len(unlabelled):
        n = len(features(None))
        return Model(np.zeros(n), np.ones(n), np.zeros(n), 0.0)
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / spread, -8, 8) for x in (positive, unlabelled))
    p, u = (np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (p, u))
    w = np.zeros(p.shape[1])
    a, b = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        dp, du = (sp * (1 - sp)) @ p / len(p), (su * (1 - su)) @ u / len(u)
        negative = su.mean() - prior * sp.mean()  # loss of -1 is the score, of +1 one less the score
        if negative >= 0:
            g = -prior * dp + du - prior * dp
        else:
            g = prior * dp - du  # step back until the negative part is no longer below zero
        g = g + DECAY * np.append(w[:-1], 0.0)
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        w = w - RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Model(mean, spread, w[:-1], float(w[-1]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of both that their model was not fitted to.

    Best-bin estimate: of all thresholds that with the least upper bound (by Dvoretzky, Kiefer and Wolfowitz) of
    the unlabelled share over it, divided by that of the positives.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    at = np.unique(np.concatenate([positive, unlabelled]))
    share = lambda x: 1 - np.searchsorted(np.sort(x), at, "left") / len(x)
    slack = lambda x: math.sqrt(math.log(4 / confidence) / (2 * len(x)))
    p, u = share(positive), share(unlabelled)
    bound = np.where(p > 0, (u + slack(unlabelled) + slack(positive)) / np.maximum(p, 1e-12), np.inf)
    best = int(bound.argmin())
    return min(0.98, max(0.05, float(u[best] / p[best])))


def train_with_estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Fit to every second row with a prior of one half, estimate the prior on the other rows, and fit to all rows with it."""
    first = train(positive[::2], unlabelled[::2], 0.5)
    return train(positive, unlabelled, estimated_prior(first.score(positive[1::2]), first.score(unlabelled[1::2])))


def _featured(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    return map_columns(docs, lambda: lambda t: [pa.array([features(x) for x in as_bytes(t)], pa.list_(pa.float64()))], [text], "x array<double>", carry)


def fit(docs: DataFrame, labels: DataFrame, *, held_out: str = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1", fit_positive: int = FIT_POSITIVE, fit_unlabelled: int = FIT_UNLABELLED) -> Model:
    """A model from a bounded sample, the first by a hash of doc_id: positives are rows of ``labels`` with quality 1 that are not
    held out, the unlabelled are documents whatever their label. Labels of quality 0 are not read.

    Null doc_ids and labels take no part; repeated rows of a document all count. Without positives or documents every score is one half.
    """
    use = labels.select("doc_id", "quality").where(f"doc_id is not null and quality = 1 and not ({held_out})")
    known = docs.select("doc_id").where("doc_id is not null").distinct()
    hashed = F.xxhash64("doc_id")
    good = use.select("doc_id").distinct().join(known, "doc_id", "left_semi").orderBy(hashed).limit(fit_positive).withColumn("part", F.lit(1))
    other = known.where(f"not ({held_out})").orderBy(F.xxhash64("doc_id", F.lit(1))).limit(fit_unlabelled).withColumn("part", F.lit(0))
    wanted = good.unionByName(other).groupBy("doc_id").agg(F.collect_set("part").alias("parts"))
    rows = _featured(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id"), "text", ["doc_id", "parts"]).collect()  # bounded by the two limits
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.x))  # whatever the order of the table
    get = lambda k: np.array([r.x for r in rows if k in r.parts]).reshape(-1, len(features(None)))
    return train_with_estimated_prior(get(1), get(0))


def score(docs: DataFrame, model: Model, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all, unless named) with score; a null text is scored as an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        return lambda t: [pa.array(m.score(np.array([features(x) for x in as_bytes(t)]).reshape(len(t), -1)))]

    return map_columns(docs, make, [text], "score double", docs.columns if carry is None else carry)
