import math
import re

import duckdb
import pytest

from corpuslens.plans.dialect import TABLES
from corpuslens.plans.queries import QUERIES, WITHOUT_SQL, oracle_sql

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as from '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    try:
        return None if math.isnan(float(v)) else round(float(v), 5) + 0.0
    except TypeError:
        return str(v)


def test_every_query_has_sql():
    assert SQL.keys() == QUERIES.keys() - set(WITHOUT_SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in cols]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_pair_canon_known_addresses(spark, small):
    r = QUERIES["m10_pair_canon"](spark, small).where("a = 3 and p = 11 and n = 5").first()
    assert [(r[f"x{i}"], r[f"y{i}"], r["z"]) for i in (1, 2, 3, 4)] == [(16, 5, 19), (22, -5, 19), (14, -3, 19), (24, 3, 19)]


def test_capped_pool_falls_back_to_rarest_terms(spark, tmp_path):
    """A query all of whose terms are over the cap still has results; one with a rare term is held to the cap."""
    texts = ["alpha beta" if i < 60 else "beta gamma" if i < 90 else "rare gamma" if i < 93 else f"other{i}" for i in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta"), (2, "rare alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in QUERIES["r36_capped_bm25"](spark, str(tmp_path)).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc_id))
    assert sorted(got[1]) == [(i + 1, i) for i in range(10)]
    assert sorted(got[2]) == [(1, 90), (2, 91), (3, 92)]


def _documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_word_pairs_are_counted_by_windows_of_all_words(spark, tmp_path):
    """Every window of 48 words of a long text counts, common words and the last ones too; words of two windows do not meet."""
    words = [f"zq{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(96)]
    _documents(spark, tmp_path, [" ".join(words)] * 5 + [None, "", "lone"])
    got = {(r.a, r.b): r.c for r in QUERIES["ag6_cooccurrence"](spark, str(tmp_path)).collect()}
    halves = words[:48], words[48:]
    assert got == {(min(x, y), max(x, y)): 5 for h in halves for i, x in enumerate(h) for y in h[i + 1 :]}


def test_near_copies_by_all_pairs(spark, tmp_path):
    """Pairs of classes of equal word sets against all pairs, and the classes themselves."""
    import random

    rng = random.Random(5)
    texts = []
    for _ in range(30):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.randrange(5, 40))]
        texts.append(" ".join(base))
        for drop in range(3):
            texts.append(" ".join(base[drop:] + [f"n{rng.randrange(9)}"] * (drop % 2)))
    texts += [None, "", texts[0], texts[0].upper(), "one two three four five", "one two three four five six"]
    _documents(spark, tmp_path, texts)
    sets = {i: frozenset(t.lower().split()) for i, t in enumerate(texts) if t}
    first = {}
    want = {}
    for i, s in sets.items():
        if s in first:
            want[first[s], i] = 1.0
        first.setdefault(s, i)
    reps = sorted(first.values())
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            k, n = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * k >= 4 * n:
                want[a, b] = k / n
    rows = QUERIES["r43_shared_rare_jaccard"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.a, r.b): pytest.approx(r.jaccard, abs=1e-8) for r in rows} == want


def test_greedy_chunks_by_a_loop(spark, small):
    """Each word cut again by a loop over its places, with the pieces counted anew."""
    rows = {r.token: r.chunks for r in QUERIES["tx12_greedy_chunks"](spark, small).collect()}
    texts = [set(re.findall("[a-z][a-z0-9]+", (r.text or "").lower())) & rows.keys() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts = [t for t in texts if t]
    held, docs = {}, {}
    pieces = {w: {w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1) if w[i].isalpha()} for w in rows}
    for w in rows:
        for g in pieces[w]:
            held[g] = held.get(g, 0) + 1
    for t in texts:
        for g in set().union(*(pieces[w] for w in t)):
            docs[g] = docs.get(g, 0) + 1
    score = {g: round(math.log(1 + n) * math.log((len(texts) + 1) / (docs[g] + 1)), 9) for g, n in held.items() if n >= 5 and docs[g] <= 0.5 * len(texts)}
    best = set(sorted(score, key=lambda g: (-score[g], g))[:800])
    assert best
    for w, chunks in rows.items():
        out, i = [], 0
        while i < len(w):
            n = next((n for n in (4, 3) if w[i : i + n] in best), 1)
            out += [w[i : i + n]] * w[i].isalpha()
            i += n
        assert chunks == " ".join(out)
