import zlib

import numpy as np
import public_tokenizers
import pytest

from corpuslens.llm import langid, quality, queries
from corpuslens.llm.common import bounded_batches

SF = "/root/testdata/sf0.01"


def brute_likelihood(word, pieces, prob):
    """Sum over all segmentations, one by one."""
    at = {p: i for i, p in enumerate(pieces)}

    def total(i):
        if i == len(word):
            return 1.0
        s = 0.0
        for j in range(i + 1, len(word) + 1):
            p = at.get(word[i:j])
            if p is not None:
                s += prob[p] * total(j)
            elif j == i + 1:
                s += prob[-1] * total(j)
        return s

    return total(0)


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "abc", "b", "bc", "c", "▁", "▁a", "ca"]
    prob = np.random.default_rng(2).random((len(pieces) + 1, 2))
    m = langid.Model(pieces, ["x", "y"], prob)
    words = ["", "▁a", "▁abcab", "▁zzabz", "▁" + "abc" * 4]
    got = m.log_likelihoods(words)
    for w, g in zip(words, got):
        want = [np.log(brute_likelihood(w, pieces, prob[:, k])) for k in (0, 1)]
        assert np.allclose(g, want)
    tiny = langid.Model(pieces, ["x", "y"], prob * 1e-6)
    long = "▁" + "abcz" * 2000  # far below the smallest double
    assert np.isfinite(tiny.log_likelihoods([long])).all()
    whole = tiny.log_likelihoods(["▁" + "abcz" * 12])
    assert np.allclose(whole, [[np.log(brute_likelihood_dp("▁" + "abcz" * 12, pieces, prob[:, k] * 1e-6)) for k in (0, 1)]])


def brute_likelihood_dp(word, pieces, prob):
    from fractions import Fraction
    from math import log

    at = {p: i for i, p in enumerate(pieces)}
    a = [Fraction(1)] + [Fraction(0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 3), j):
            p = at.get(word[i:j], -1 if j == i + 1 else None)
            if p is not None:
                a[j] += a[i] * Fraction(float(prob[p]))
    return np.exp(np.longdouble(log(a[-1].numerator) - log(a[-1].denominator)))


def test_expectations_match_enumeration():
    pieces = ["a", "ab", "b", "▁", "▁a"]
    prob = np.random.default_rng(4).random(len(pieces) + 1)
    got = langid.expected(langid.Pieces(pieces), ["▁aab", "▁bz"], np.array([2.0, 3.0]), prob)
    assert np.isclose(got[-1], 3.0)
    eps = 1e-6
    for i in range(len(pieces)):  # d log P / d log p is the expected use
        up = prob.copy()
        up[i] *= 1 + eps
        d = sum(n * (np.log(brute_likelihood(w, pieces, up)) - np.log(brute_likelihood(w, pieces, prob))) / eps for w, n in (("▁aab", 2), ("▁bz", 3)))
        assert np.isclose(got[i], d, rtol=1e-3, atol=1e-5)


def test_language_query(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op4_segmentation_langid(spark, SF).collect()
    assert len(out) == len(lang) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "la casa de la mujer", "es", 1), (2, "the house of the woman", "en", 1), (3, None, "en", 1), (4, "", "en", 1), (5, "123 $$$ --", None, 1), (None, "the end", None, 1), (7, "中文字", None, 1), (8, "the " * 30000, "en", 1), (9, "x" * 5000, None, 1), (1, "la casa", "es", 1)], "doc_id long, text string, lang string, score int")
    m = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    out = langid.predict(docs, m).collect()
    assert len(out) == 10
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0 and by[8].lang_pred == "en" and by[None].lang_pred == "en"
    empty = langid.fit(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), m).count() == 0


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = queries.op5_pu_quality(spark, "/root/testdata/sf0.1").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_quality_of_odd_rows(spark):
    bounded_batches(spark)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, "", "a", "word " * 40000, "é" * 10, "a", "a"])] + [(None, "x", 1), (2, "a", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (2, 1), (3, 0), (4, None), (None, 1), (99, 1), (5, 1), (6, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 for r in out)
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_risk_is_kept_from_going_below_zero():
    rng = np.random.default_rng(0)
    n = len(quality.features(None))
    good, bad = rng.normal(1, 1, (300, n)), rng.normal(-1, 1, (300, n))
    m = quality.train(good[:150], np.concatenate([good[150:], bad]), 1 / 3)
    assert (m.score(good) > 0.5).mean() > 0.95 and (m.score(bad) < 0.5).mean() > 0.95


@pytest.mark.parametrize("text", [None, b"", b"a", b" \n", "é".encode() * 9])
def test_features_are_finite(text):
    assert np.isfinite(quality.features(text)).all()


def test_features_cover_whole_text():
    head = [f"w{i}" for i in range(4096)]
    same, other = (quality.features(" ".join(head + tail).encode()) for tail in (["The", "the"] * 4096, ["The", "tha"] * 4096))
    assert np.isclose(same[-2] ** 2, 4097 / 12288) and np.isclose(other[-2] ** 2, 4098 / 12288)


def test_expectations_take_long_words():
    pieces = ["a", "ab", "abc", "b", "c", "▁", "▁a"]
    prob = np.random.default_rng(5).random(len(pieces) + 1) * 1e-3
    find = langid.Pieces(pieces)
    words, weight = ["▁" + "abcz" * 12, "▁" + "abcz" * 2000, "▁" + "cabz" * 12], np.array([2.0, 1.0, 3.0])
    got = langid.expected(find, words, weight, prob)
    lengths = np.array([len(p) for p in pieces] + [1])
    assert np.isclose((got * lengths).sum(), sum(n * len(w) for w, n in zip(words, weight)))
    eps = 1e-6
    for i in range(len(pieces)):
        up = prob.copy()
        up[i] *= 1 + eps
        d = sum(n * (langid.Model(pieces, ["x"], up[:, None]).log_likelihoods([w])[0, 0] - langid.Model(pieces, ["x"], prob[:, None]).log_likelihoods([w])[0, 0]) / eps for w, n in zip(words, weight))
        assert np.isclose(got[i], d, rtol=1e-3, atol=1e-2)
    short = ["▁aabcab", "▁abzcab"]
    want, out = langid.expected(find, short, np.array([2.0, 3.0]), prob), np.zeros(len(prob))
    langid._expected_long(find, langid.codes_of(short, np.arange(2), 7), np.array([2.0, 3.0]), prob, out)
    assert np.allclose(out, want)


def test_marks_alone_are_no_language_and_scripts_without_spaces_are_learned(spark):
    bounded_batches(spark)
    chinese = ["我们今天去学校学习新的知识", "他们明天去公园看花和树木", "老师说学生要认真学习和思考"]
    english = ["we go to school today to learn new things", "they will see flowers and trees in the park", "the teacher says that students think"]
    rows = [(i, t * 30, lang) for i, (t, lang) in enumerate([(c, "zh") for c in chinese * 2] + [(e, "en") for e in english * 2])]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["́̈ ि", "1́", "我们学习知识" * 900, "students learn", "a", "́a", "12 3 a 4"]
    out = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), m).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 3)] == ["und", "und", "zh", "en"]
    assert all(out[i].lang_pred != "und" for i in (4, 5, 6))
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(pieces) == len(set(pieces)) and all(p.count("▁") == p.startswith("▁") for p in pieces)


def test_scores_of_texts_match_sums_over_their_words(spark):
    """The posterior of a text, from the summed segmentations of each of its words one by one."""
    bounded_batches(spark)
    pieces = ["a", "ab", "b", "▁", "▁a", "c"]
    prob = np.random.default_rng(7).random((len(pieces) + 1, 3)) / 3
    m = langid.Model(pieces, ["x", "y", "z"], prob)
    texts = ["ab a", "AB, ab; cab", "c" * 9 + " b", "abz zab", "ab " * 50]
    out = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for i, t in enumerate(texts):
        words = ["▁" + w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
        total = np.array([sum(np.log(brute_likelihood(w, pieces, prob[:, k])) for w in words) for k in range(3)])
        post = np.exp(total - total.max())
        assert out[i].lang_pred == "xyz"[total.argmax()] and np.isclose(out[i].score, post.max() / post.sum())


def test_prior_is_estimated_without_negative_labels():
    rng = np.random.default_rng(1)
    n = len(quality.features(None))
    for share in (0.2, 0.5, 0.8):
        good, some, bad = rng.normal(1, 1, (2000, n)), rng.normal(1, 1, (int(4000 * share), n)), rng.normal(-1, 1, (4000 - int(4000 * share), n))
        unlabelled = rng.permutation(np.concatenate([some, bad]))
        first = quality.train(good[::2], unlabelled[::2], 0.5)
        assert abs(quality.estimated_prior(first.score(good[1::2]), first.score(unlabelled[1::2])) - share) < 0.06
        m = quality.train_with_estimated_prior(good, unlabelled)
        assert (m.score(some) >= 0.5).mean() > 0.95 and (m.score(bad) < 0.5).mean() > 0.95


def test_risk_is_the_non_negative_one():
    """The gradient steps lower the risk as written down row by row."""
    rng = np.random.default_rng(2)
    n = len(quality.features(None))
    p, u = rng.normal(0.3, 1, (80, n)), rng.normal(-0.3, 1, (160, n))

    def risk(m, prior):
        loss = lambda x, y: np.mean([1 / (1 + np.exp(y * z)) for z in np.log(m.score(x) / (1 - m.score(x)))])
        return prior * loss(p, 1) + max(0.0, loss(u, -1) - prior * loss(p, -1))

    for prior in (0.3, 0.6):
        assert risk(quality.train(p, u, prior), prior) < risk(quality.train(p, u, prior, steps=3), prior) - 0.02


def test_quality_reads_no_negative_labels(spark):
    bounded_batches(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    a, b = (quality.fit(docs, x) for x in (labels, labels.where("quality = 1")))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias
