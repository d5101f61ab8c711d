"""Plans over BASE in steps that do not grow faster than the texts: each row of documents is scored where it is read.

The SQL of the plans stays the statement of what they compute. Its common parts, which Spark would put in line at each
use and shuffle token by token, are made once (``Base``); what a plan asks of all documents comes from ``Base.scores``,
and what it asks of a few (best ranks, relevant pairs) runs as the plan's own SQL over tables of these alone. Where a
document or an item has no id of its own the SQL runs as it stands.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import plain_tokens
from corpuslens.operators import retrieval, scoring
from corpuslens.operators.graph import materialised

from .catalog import BASE, sql_of
from .catalog import PLANS as CATALOG
from .extra import BRIDGES, POOL, POOL_ALL
from .extra import PLANS as EXTRA
from .more import PLANS as MORE

PLANS = CATALOG | EXTRA | MORE
#: Query terms beyond which the plans run as SQL: the terms go to all executors.
MOST_TERMS = 200_000


class Base:
    """The common parts of BASE. ``full``: statistics of all tokens, not only of those of the queries."""

    def __init__(self, spark: SparkSession, sf_dir: str, full: bool = False):
        self.spark, self.sf_dir = spark, sf_dir
        self.docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        self.items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("qid"), "text")
        qt = self.items.select("qid", F.explode(plain_tokens(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qw"))
        self.qt = materialised(qt)
        self.words = materialised(scoring.vocabulary(self.docs, None if full else self.qt))
        all_ = self.words.where("token = ''").first()
        self.n, self.avgdl = (all_.df, all_.dl / all_.df) if all_ else (0, None)
        self.st = spark.createDataFrame([(self.n, self.avgdl)], "n bigint, avgdl double")
        n, df = F.lit(self.n), F.col("df")
        self.idf = self.words.where("token <> ''").select("token", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
        terms = self.qt.join(self.idf, "token").collect()  # MOST_TERMS at most, see ``bounded``
        rank: dict[int, int] = {}
        self.terms = []
        for r in sorted(terms, key=lambda r: (r.qid, r.df, r.token)):
            rank[r.qid] = rank.get(r.qid, 0) + 1
            self.terms.append(Row(qid=r.qid, token=r.token, qw=r.qw, df=r.df, idf=r.idf, k=rank[r.qid]))
        self._rel: DataFrame | None = None
        self._led: tuple[list, list] | None = None
        self.qids = sorted({r.qid for r in self.terms})
        self._ranked: dict[int, DataFrame] = {}

    @staticmethod
    def bounded(spark: SparkSession, sf_dir: str) -> bool:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        return scoring.keyed(items, "item_id") and scoring.keyed(docs, "doc_id") and (items.agg(F.sum(F.size(plain_tokens(F.col("text"))))).first()[0] or 0) <= MOST_TERMS

    def scores(self, adds: dict[str, tuple] | None = None, more: dict | None = None, carry: tuple = (), bridges: list | None = None, every: bool = False, keep: Callable | None = None) -> DataFrame:
        """``bm`` (score, m, s), with further sums: ``adds`` gives by name a number for each term and the share of tf that it is taken times.

        ``bridges``: rows (qid, dt, w) of terms that queries lead to, summed as ``ex``. ``every``: also pairs that ``bm`` leaves out.
        ``keep``: see ``scoring.scored``; or a number and a key, for the pairs of the largest keys of each query.
        """
        adds = adds or {}
        rows = self.terms
        if bridges is not None:
            led = {(r.qid, r.dt): r.w for r in bridges}
            own = {(r.qid, r.token) for r in rows}
            rows = [Row(**r.asDict(), bw=led.get((r.qid, r.token), 0.0)) for r in rows]
            rows += [Row(qid=q, token=t, qw=0, df=0, idf=0.0, k=0, bw=w) for (q, t), w in led.items() if (q, t) not in own]
        columns = {"idf": lambda r: r.idf if r.idf >= 0.3 else 0.0, "qw": lambda r: r.qw, "on": lambda r: float(r.idf >= 0.3)}
        columns |= {f"_{name}": lambda r, f=f: f(r) if r.k else 0.0 for name, (f, _) in adds.items()}
        if bridges is not None:
            columns["bw"] = lambda r: r.bw
        shares = {f"_{name}": half for name, (_, half) in adds.items()}

        def sums(of, tf, dl, avgdl):
            out = [of["idf"] * of["qw"] * 1.9 * tf / (tf + 0.9 * 0.6 + 0.9 * 0.4 * dl / avgdl), of["on"], of["idf"]]
            out += [of[c] if half is None else of[c] * tf / (tf + half) for c, half in shares.items()]
            return out + ([of["bw"] * tf / (tf + 1.0), (of["bw"] > 0) * 1.0] if "bw" in of else [])

        names = ["score", "m", "s", *adds, *(["ex", "led"] if bridges is not None else [])]
        terms = scoring.Terms(rows, **columns)
        if isinstance(keep, tuple):
            k, key = keep
            keep = scoring.first_of(k, key if every else lambda q, c: np.where(c["m"] > 0, key(q, c), -np.inf))
        found = scoring.scored(self.docs, terms, sums, names, self.avgdl or 1.0, {n: f(terms.qids) for n, f in (more or {}).items()}, carry, keep)
        found = found.withColumn("m", F.col("m").cast("long"))
        return found if every else found.where("m > 0")

    def ranked(self, k: int) -> DataFrame:
        """``rk`` as far as rank ``k``."""
        if k not in self._ranked:
            self._ranked[k] = materialised(retrieval.top_k(self.scores(keep=(k, _score)).select("qid", "doc_id", "score", "m", "s"), k))
        return self._ranked[k]

    @property
    def rel(self) -> DataFrame:
        if self._rel is None:
            items = self.items.select("qid", "text", plain_tokens(F.col("text")).alias("tokens")).collect()
            self._rel = materialised(scoring.containing(self.docs, items))
        return self._rel

    def tf(self, ids: DataFrame) -> DataFrame:
        """``tf`` of the documents of ``ids``."""
        few = self.docs.join(retrieval.small(ids.select("doc_id").distinct()), "doc_id", "left_semi")
        return materialised(retrieval.postings(few))

    def idf_of(self, *tables: DataFrame) -> DataFrame:
        """``idf`` of the tokens of these tables."""
        tokens = tables[0].select("token")
        for t in tables[1:]:
            tokens = tokens.union(t.select("token"))
        return materialised(self.idf.join(tokens.distinct(), "token", "left_semi"))

    def run(self, body: str, **views: DataFrame) -> DataFrame:
        """The rest of a plan's SQL over these tables in place of its common parts."""
        rest = sql_of(body, "spark", self.sf_dir).lstrip()
        heads = ", ".join(f"{name} as (select * from {{{name}}})" for name in views)
        return self.spark.sql(f"with {heads} {rest}", **views)

    # what the queries lead to
    def bridges(self) -> DataFrame:
        """``br``: qt, dt, w. Pairs are counted where the rows of a document term are, and only the twelve best of each part move on."""
        rel, idf = self.rel, self.idf
        near = rel.join(self.tf(rel), "doc_id").select("qid", F.col("token").alias("dt")).distinct()
        near = near.join(idf.where("idf >= 3").select(F.col("token").alias("dt"), "idf"), "dt").repartition("dt")
        asked = self.qt.join(retrieval.small(rel.select("qid").distinct()), "qid", "left_semi").select("qid", F.col("token").alias("qt"))
        n = asked.groupBy("qt").agg(F.count(F.lit(1)).alias("n"))
        pairs = near.join(F.broadcast(asked), "qid").where("qt <> dt").groupBy("qt", "dt").agg(F.count(F.lit(1)).alias("c"), F.first("idf").alias("idf"))
        weighed = pairs.join(F.broadcast(n), "qt").select("qt", "dt", (F.col("c") * 1.0 / F.col("n") * F.col("idf")).alias("w"))
        best = retrieval.top_k(weighed.select(F.col("qt").alias("qid"), F.col("dt").alias("doc_id"), F.col("w").alias("score")), 12)
        return materialised(best.select(F.col("qid").alias("qt"), F.col("doc_id").alias("dt"), F.col("score").alias("w")))

    def led(self) -> tuple[list, list]:
        """Rows (qid, dt, w) and (qid, qt, dt) of the terms that the queries lead to: twelve a query term at most."""
        pairs = self.qt.join(self.bridges().withColumnRenamed("qt", "token"), "token")
        rows = [Row(qid=r.qid, qt=r.token, dt=r.dt, w=r.w) for r in pairs.collect()]
        w: dict = {}
        for r in rows:
            w[r.qid, r.dt] = w.get((r.qid, r.dt), 0.0) + r.w
        return [Row(qid=q, dt=t, w=x) for (q, t), x in w.items()], rows

    def ex(self, agree: bool = False, keep: Callable | tuple | None = None) -> DataFrame:
        """``ex``: qid, doc_id, score and perhaps agree."""
        if self._led is None:
            self._led = self.led()
        led, rows = self._led
        more = {"agree": lambda qids: scoring.Agreement(rows, qids)} if agree else None
        if keep is None:
            keep = (lambda ids, q, c, row, many: c["agree"] >= 2) if agree else lambda ids, q, c, row, many: c["led"] > 0
        found = self.scores(bridges=led, more=more, every=True, keep=keep).where("led > 0")
        return found.select("qid", "doc_id", F.col("ex").alias("score"), *([F.col("agree").cast("long").alias("agree")] if agree else []))


def _score(q, c):
    return c["score"]


def _led_to(q, c):
    return np.where(c["led"] > 0, c["ex"], -np.inf)


def _pairs(df: DataFrame) -> Callable:
    """Keeps the pairs of a small table."""
    return scoring.among([(r.qid, r.doc_id) for r in df.select("qid", "doc_id").collect()])


def _by_query(values: dict, qids: list) -> np.ndarray:
    return np.array([values.get(q, np.nan) for q in qids], np.float64)


def _best(found: DataFrame, k: int = 10) -> DataFrame:
    return retrieval.top_k(found, k).select("qid", "doc_id", "rank")


def _rest(name: str, prefix: str = BASE) -> str:
    assert PLANS[name].startswith(prefix)
    return PLANS[name][len(prefix) :]


def _most(scores: DataFrame, by: str = "score") -> DataFrame:
    """qid and the largest score of each query."""
    return F.broadcast(materialised(scores.groupBy("qid").agg(F.max(by).alias("most"))))


def _listed(b: Base, name: str, k: int, rel: bool = False) -> DataFrame:
    """A plan over the best ``k`` documents of each query and their terms."""
    rk = b.ranked(k)
    tf = b.tf(rk)
    views = {"rk": rk, "tf": tf, "qt": b.qt, "idf": b.idf_of(tf, b.qt), "st": b.st}
    return b.run(_rest(name), **views, **({"rel": b.rel} if rel else {}))


def _pooled(b: Base, name: str) -> DataFrame:
    """A plan over the links of pools of 60 documents; the links are made once."""
    rk = b.ranked(60)
    tf = b.tf(rk)
    idf = b.idf_of(tf, b.qt)
    prefix = POOL_ALL if PLANS[name].startswith(POOL_ALL) else POOL
    common = prefix[len(BASE) :]
    pool = materialised(b.run(common + "select * from pool", rk=rk, tf=tf, idf=idf))
    link = materialised(b.run(common + "select * from link", rk=rk, tf=tf, idf=idf))
    return b.run(_rest(name, prefix), pool=pool, link=link, tf=tf, idf=idf, qt=b.qt)


def _bridged(b: Base, name: str, k: int, most_ex: int = 0) -> DataFrame:
    """A plan that asks for what the queries lead to only among the best ``k``, or for the best ``most_ex`` of it."""
    rk = b.ranked(k)
    ex = retrieval.top_k(b.ex(keep=(most_ex, _led_to)), most_ex).drop("rank") if most_ex else b.ex(keep=_pairs(rk))
    return b.run(_rest(name, BRIDGES), rk=rk, ex=materialised(ex))


def _sizes(b: Base) -> tuple[DataFrame, np.ndarray]:
    """How many distinct tokens each query has: as a table, and in the order of ``b.qids``."""
    k = materialised(b.qt.groupBy("qid").agg(F.count(F.lit(1)).alias("k"), F.avg(F.length("token")).alias("wl")))
    return F.broadcast(k), _by_query({r.qid: r.k for r in k.collect()}, b.qids)


def _r3(b):
    k, n = _sizes(b)
    found = b.scores(keep=(10, lambda q, c: c["score"] + 0.5 * c["s"] + 0.2 * c["score"] * c["m"] / n[q]))
    return _best(found.join(k, "qid").select("qid", "doc_id", (F.col("score") + 0.5 * F.col("s") + 0.2 * F.col("score") * F.col("m") / F.col("k")).alias("score")))


def _r10(b):
    k, n = _sizes(b)
    asked = b.qt.collect()
    heads: dict = {}
    for r in asked:
        if len(r.token) > 5:
            heads.setdefault((r.qid, r.token[:5]), []).append(r.token)
    sole = {(q, t[0]) for (q, _), t in heads.items() if len(t) == 1}
    found = b.scores(
        {"itself": (lambda r: float((r.qid, r.token) in sole), None)},
        more={"alike": lambda qids: scoring.Prefixes(asked, qids)},
        keep=(10, lambda q, c: (c["score"] + 0.6 * (c["alike"] - c["itself"])) * (1 + 0.15 * c["m"] / n[q])),
    )
    return _best(found.join(k, "qid").select("qid", "doc_id", ((F.col("score") + 0.6 * (F.col("alike") - F.col("itself"))) * (1 + 0.15 * F.col("m") / F.col("k"))).alias("score")))


def _pool(b, member: Callable) -> DataFrame:
    """The best of the documents that have one of the terms that ``member`` tells."""
    found = b.scores({"p": (lambda r: float(member(r)), None)}, keep=(10, lambda q, c: np.where(c["p"] > 0, c["score"], -np.inf)))
    return _best(found.where("p > 0"))


def _r17(b):
    return _pool(b, lambda r: r.df <= 256)


def _least(b) -> dict:
    least: dict = {}
    for r in b.terms:
        least[r.qid] = min(least.get(r.qid, r.df), r.df)
    return least


def _r36(b):
    least = _least(b)
    return _pool(b, lambda r: r.df <= max(50, 0.05 * b.n, least[r.qid]))


def _r37(b):
    named = {r.qid for r in b.terms if r.idf >= 3}
    return _pool(b, lambda r: r.idf >= 3 or r.qid not in named)


def _r49(b):
    def boost(q, c):
        return c["score"] + np.where(c["c"] == 3, c["w"], np.where(c["c"] == 2, 0.5 * c["w"], 0.0))

    found = b.scores({"c": (lambda r: float(r.k <= 3), None), "w": (lambda r: r.idf if r.k <= 3 else 0.0, None)}, keep=(10, boost))
    return _best(found.select("qid", "doc_id", (F.col("score") + F.when(F.col("c") == 3, F.col("w")).when(F.col("c") == 2, 0.5 * F.col("w")).otherwise(0.0)).alias("score")))


def _fu13(b):
    pairs = b.spark.sql(sql_of("select distinct qid, a, b from (select item_id qid, token a, lead(token) over (partition by item_id order by pos) b from {tok:benchmark,item_id,text} t) x where b is not null", "spark", b.sf_dir)).collect()
    found = b.scores(more={"c": lambda qids: scoring.Phrases(pairs, qids)}, keep=(10, lambda q, c: c["score"] + 0.5 * np.log(1.0 + c["c"])))
    return _best(found.select("qid", "doc_id", (F.col("score") + 0.5 * F.log(1.0 + F.col("c"))).alias("score")))


def _fu15(b):
    held = scoring.first_of(50, lambda q, c: np.where((c["p"] > 0) & (c["m"] > 0), c["score"], -np.inf))
    other = scoring.first_of(50, lambda q, c: np.where((c["p"] == 0) & (c["m"] > 0), c["score"], -np.inf))
    both = b.scores({"p": (lambda r: float(r.k == 1), None)}, keep=lambda *a: held(*a) | other(*a))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("p") > 0, 0).otherwise(1), F.round("score", 9).desc(), "doc_id")
    return both.withColumn("k", F.row_number().over(order)).where("k <= 50").select("qid", "doc_id")


def _tp21(b):
    k, n = _sizes(b)
    wl = _by_query({r.qid: r.wl for r in k.collect()}, b.qids)
    power = np.where(n >= 12, -0.05, np.where(wl >= 6, -0.1, 0.0))
    found = b.scores(
        carry=("dl", "u"),
        keep=(10, lambda q, c: c["score"] * c["dl"] ** power[q] * (1 + 0.5 * c["m"] / (n[q] + c["u"] - c["m"]))),
    ).join(k, "qid")
    exponent = F.when(F.col("k") >= 12, -0.05).when(F.col("wl") >= 6, -0.1).otherwise(0.0)
    return _best(found.select("qid", "doc_id", (F.col("score") * F.pow("dl", exponent) * (1 + 0.5 * F.col("m") / (F.col("k") + F.col("u") - F.col("m")))).alias("score")))


def _r32(b):
    """Every document that shares a token with the query is in the pool; what the query leads to besides has no part of the score."""
    return _best(b.scores({"sat": (lambda r: 1.0, 1.2)}, every=True, keep=(10, lambda q, c: c["sat"])).select("qid", "doc_id", F.col("sat").alias("score")))


def _e2(b):
    return b.run(_rest("e2_graded_ndcg"), rk=b.ranked(10), rel=b.rel)


def _e8(b):
    reached = materialised(b.scores(keep=_pairs(b.rel)).select("qid", "doc_id"))
    return b.run(_rest("e8_failure_patterns"), rk=b.ranked(100), rel=b.rel, bm=reached)


def _e10(b):
    tf = b.idf.agg(F.sum("df").alias("postings"))
    return b.run(_rest("e10_acceptance_gates").replace("select count(*) postings from tf", "select postings from tf"), rk=b.ranked(100), rel=b.rel, tf=tf, st=b.st)


def _k4(b):
    """The rank of a query's best relevant document is one more than the documents before it."""
    rel = b.rel
    score = F.round("score", 9)
    first = materialised(b.scores(keep=_pairs(rel)).groupBy("qid").agg(F.min(F.struct((-score).alias("at"), "doc_id")).alias("best")))
    least = _by_query({r.qid: -r.best["at"] - 1e-6 for r in first.collect()}, b.qids)
    bm = b.scores(keep=lambda ids, q, c, row, many: (c["m"] > 0) & (c["score"] >= least[q]))
    before = bm.join(F.broadcast(first), "qid").where((-score < F.col("best.at")) | ((-score == F.col("best.at")) & (F.col("doc_id") <= F.col("best.doc_id"))))
    ranks = before.groupBy("qid").agg(F.count(F.lit(1)).alias("best"))
    return rel.select("qid").distinct().join(ranks, "qid", "left")


def _fu8(b):
    return b.ex(agree=True).where("agree >= 2").select("qid", "doc_id", "agree")


def _j9(b):
    return b.ex().join(F.broadcast(b.ranked(100).select("qid", "doc_id")), ["qid", "doc_id"], "left_anti").select("qid", "doc_id")


def _r20(b):
    rk = b.ranked(100)
    lx = materialised(rk.join(_most(rk), "qid").select("qid", "doc_id", (F.col("score") / F.col("most")).alias("l")))
    # beyond ``lx`` only the best ten of what the query leads to can be among the best ten
    listed = _pairs(lx)
    first = scoring.first_of(10, _led_to)
    ex = materialised(b.ex(keep=lambda *a: first(*a) | listed(*a)))
    bx = ex.join(_most(ex), "qid").select("qid", "doc_id", (F.col("score") / F.col("most")).alias("e"))
    zero = F.lit(0.0)
    return _best(lx.join(bx, ["qid", "doc_id"], "full").select("qid", "doc_id", (F.coalesce("l", zero) + 0.3 * F.coalesce("e", zero) - F.when(F.col("l").isNull(), 0.1).otherwise(0.0)).alias("score")))


def _tp20(b):
    led, _ = b.led()
    least = _least(b)
    route = {q: 0.1 if d <= 20 else 0.3 for q, d in least.items()}
    one, other = scoring.first_of(1, lambda q, c: np.where(c["m"] > 0, c["score"], -np.inf)), scoring.first_of(1, _led_to)
    lex, exp = F.when(F.col("m") > 0, F.col("score")), F.when(F.col("led") > 0, F.col("ex"))
    most = b.scores(bridges=led, every=True, keep=lambda *a: one(*a) | other(*a)).groupBy("qid").agg(F.max(lex).alias("ml"), F.max(exp).alias("me"))
    rows = most.collect()
    known = b.spark.createDataFrame([(r.qid, r.ml, r.me, route[r.qid]) for r in rows if r.qid in route], "qid bigint, ml double, me double, route double")
    order = sorted({*b.qids, *(r.qid for r in led)})
    ml, me, way = (_by_query(v, order) for v in ({r.qid: r.ml for r in rows if r.ml}, {r.qid: r.me for r in rows if r.me}, route))
    found = b.scores(bridges=led, every=True, keep=(10, lambda q, c: np.where((c["m"] > 0) | (c["led"] > 0), np.nan_to_num(c["score"] / ml[q]) + way[q] * np.nan_to_num(c["ex"] / me[q]), -np.inf)))
    zero = F.lit(0.0)
    return _best(
        found.where("m > 0 or led > 0").join(F.broadcast(known), "qid").select("qid", "doc_id", (F.coalesce(lex / F.col("ml"), zero) + F.col("route") * F.coalesce(exp / F.col("me"), zero)).alias("score"))
    )


def additive(b: Base) -> DataFrame:
    """As ``retrieval.additive_fusion``: the expansion has a score for all documents that share a token with the query."""
    rk = b.ranked(100)
    lex = materialised(rk.join(_most(rk), "qid").select("qid", "doc_id", (F.col("score") / F.col("most")).alias("l")))
    # beyond ``lex`` only the best by the expansion can be among the best ten
    listed = _pairs(lex)
    first = scoring.first_of(10, lambda q, c: c["sat"])
    exp = materialised(b.scores({"sat": (lambda r: 1.0, 1.0)}, every=True, keep=lambda *a: first(*a) | listed(*a)))
    fused = exp.join(_most(exp, "sat"), "qid").join(F.broadcast(lex), ["qid", "doc_id"], "left")
    fused = fused.select("qid", "doc_id", (F.coalesce("l", F.lit(0.0)) + 0.25 * F.col("sat") / F.col("most")).alias("score"))
    return retrieval.top_k(fused, 10).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


#: By plan: whether it needs statistics of all tokens, and its steps.
STEPS: dict[str, tuple[bool, Callable[[Base], DataFrame]]] = {
    "r3_bm25_plus": (False, _r3),
    "r10_routed_bm25": (False, _r10),
    "r17_bounded_pool": (False, _r17),
    "r32_recall_first_pool": (False, _r32),
    "r36_capped_bm25": (False, _r36),
    "r37_nomination_floor": (False, _r37),
    "r49_wing_cages": (False, _r49),
    "fu13_phrase_bonus": (False, _fu13),
    "fu15_protected_cap": (False, _fu15),
    "tp21_tuned_engine": (False, _tp21),
    "e2_graded_ndcg": (False, _e2),
    "e8_failure_patterns": (False, _e8),
    "e10_acceptance_gates": (True, _e10),
    "k4_gold_rank": (False, _k4),
    "fu8_consensus_gate": (True, _fu8),
    "j9_new_candidates": (True, _j9),
    "r20_glass_box_fusion": (True, _r20),
    "tp20_routed_corridors": (True, _tp20),
    "fu3_fusion_modes": (True, lambda b: _bridged(b, "fu3_fusion_modes", 20)),
    "fu6_company_rerank": (True, lambda b: _bridged(b, "fu6_company_rerank", 200)),
    "r13_bridge_search": (True, lambda b: _bridged(b, "r13_bridge_search", 100, 20)),
    "r48_hybrid_modes": (True, lambda b: _bridged(b, "r48_hybrid_modes", 100, 100)),
    "r12_pseudo_feedback": (True, lambda b: _listed(b, "r12_pseudo_feedback", 10)),
    "fu5_diversity": (False, lambda b: _listed(b, "fu5_diversity", 20)),
    "f7_entity_constraint": (False, lambda b: _listed(b, "f7_entity_constraint", 20)),
    "fu14_anchor_accuracy": (False, lambda b: _listed(b, "fu14_anchor_accuracy", 10, rel=True)),
} | {n: (True, lambda b, n=n: _pooled(b, n)) for n in ("fu12_gravity_cascade", "r8_manifold_rerank", "r22_hub_signature_ranker", "j21_pool_propagation", "fu10_missing_neighbours")}


def stepwise(name: str) -> Callable[[SparkSession, str], DataFrame]:
    full, steps = STEPS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not Base.bounded(spark, sf_dir):
            return spark.sql(sql_of(PLANS[name], "spark", sf_dir))
        return steps(Base(spark, sf_dir, full))

    return query
