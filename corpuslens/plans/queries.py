"""The queries of the engine: DataFrame compositions first, then the SQL plans of the catalogue."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import CRUDE_ENDINGS, content_words, crude_stem, nfkc, plain_tokens, stem
from corpuslens.operators import adaptive, copies, evaluation, grams, graph, latent, retrieval, scoring
from corpuslens.session import ship_package

from .catalog import BASE, CONTENT, sql_of
from .catalog import PLANS as CATALOG
from .dialect import render
from .extra import PLANS as EXTRA
from .more import PLANS as MORE
from .paired import STEPS as PAIRED
from .paired import content, paired
from .scored import STEPS, Base, additive, stepwise

PLANS = CATALOG | EXTRA | MORE


#: Query vectors that go to all executors; beyond, the join is left to Spark.
VECTORS = 50_000


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return docs, items


def _terms(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").alias("qid"), F.explode(plain_tokens(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qw"))


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    if Base.bounded(spark, sf_dir):
        return Base(spark, sf_dir).ranked(k).select("qid", "doc_id", "score", "rank")
    docs, items = _tables(spark, sf_dir)
    # lengths, statistics, weights and hits all read the postings: they are made once
    return retrieval.top_k(retrieval.bm25(graph.materialised(retrieval.postings(docs)), _terms(items), min_idf=0.3), k)


def r1_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, 10).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def r9_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _tables(spark, sf_dir)
    post = graph.materialised(retrieval.postings(docs))
    n = post.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    weight = post.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("w"))
    terms = _terms(items).join(weight, "token")
    scores = post.join(retrieval.small(terms), "token").groupBy("qid", "doc_id").agg(F.sum(F.col("tf") * F.col("w")).alias("score"))
    return retrieval.top_k(scores, 10).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, doc_id of documents that hold a benchmark text whole.

    All tokens of a text but its first and last are then tokens of the document, so texts meet documents by the
    rarest of these. Texts of fewer than three tokens have none, and are looked for in every document.
    """
    if Base.bounded(spark, sf_dir):
        return Base(spark, sf_dir).rel
    docs, items = _tables(spark, sf_dir)
    inner = items.withColumn("tokens", plain_tokens(F.col("text"))).withColumn("tokens", F.when(F.size("tokens") > 2, F.array_distinct(F.slice("tokens", F.lit(2), F.size("tokens") - 2))))
    own = docs.select("doc_id", F.explode(F.array_distinct(plain_tokens(F.col("text")))).alias("token"))
    asked = inner.where("tokens is not null").select("item_id", F.explode("tokens").alias("token"))
    df = own.join(retrieval.small(asked.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(df, "token").groupBy("item_id").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    pairs = own.join(retrieval.small(rarest), "token").select("item_id", "doc_id")
    short = docs.join(retrieval.small(inner.where("tokens is null")).select("item_id", F.col("text").alias("t")), F.contains(F.col("text"), F.col("t"))).select("item_id", "doc_id")
    found = docs.join(pairs, "doc_id").join(retrieval.small(items.withColumnRenamed("text", "t")), "item_id").where(F.contains(F.col("text"), F.col("t")))
    return found.select(F.col("item_id").alias("qid"), "doc_id").unionByName(short.select(F.col("item_id").alias("qid"), "doc_id"))


def e1_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.metrics(_ranked(spark, sf_dir, 10), _relevant(spark, sf_dir))
    return m.select("qid", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "first_hit")


def fu2_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _tables(spark, sf_dir)
    hits = retrieval.postings(docs).join(retrieval.small(_terms(items)), "token").groupBy("qid", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    fused = retrieval.reciprocal_rank_fusion(_ranked(spark, sf_dir, 50), retrieval.top_k(hits, 50))
    return retrieval.top_k(fused, 10).select("qid", "doc_id", "rank", F.round("score", 9).alias("score"))


def fu1_additive_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    if Base.bounded(spark, sf_dir):
        return additive(Base(spark, sf_dir))
    docs, items = _tables(spark, sf_dir)
    sat = F.sum(F.col("tf") / (F.col("tf") + 1))
    exp = retrieval.postings(docs).join(retrieval.small(_terms(items)), "token").groupBy("qid", "doc_id").agg(sat.alias("score"))
    fused = retrieval.additive_fusion(_ranked(spark, sf_dir, 100), exp)
    return retrieval.top_k(fused, 10).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def tx7_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _tables(spark, sf_dir)
    words = docs.select(F.explode(plain_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(stem(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"))


def tx6_crude_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _tables(spark, sf_dir)
    words = docs.select(F.explode(plain_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(crude_stem(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))


def d4_ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens of each document in the order in which they come first."""
    docs, _ = _tables(spark, sf_dir)
    return docs.select("doc_id", F.array_distinct(plain_tokens(F.col("text"))).alias("w")).where("size(w) > 0").select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))


def r50_retriever(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _tables(spark, sf_dir)
    hits = retrieval.Retriever(spark).add_documents(docs.where("text is not null")).retrieve_all(items.withColumnRenamed("item_id", "qid"))
    return hits.select("qid", "rank", "doc_id", F.md5("text").alias("text_md5"), F.round("score", 6).alias("score"))


def j19_dense_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all, the nearest five by inner product."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("x").alias("y"))
    whole = e.agg(F.count_distinct(F.size("x")).alias("sizes"), F.count(F.when(F.col("vec_id").isNull() | F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v)), 1)).alias("gaps")).first()
    if whole.sizes == 1 and not whole.gaps and q.limit(VECTORS + 1).count() <= VECTORS:
        near = grams.nearest(e.select(F.col("vec_id").cast("long").alias("doc_id"), "x"), q.collect(), 5)
        return retrieval.top_k(near, 5).select("qid", F.col("doc_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    pairs = e.join(retrieval.small(q, 20_000), F.col("vec_id") != F.col("qid")).select("qid", F.col("vec_id").alias("doc_id"), dot.alias("score"))
    return retrieval.top_k(pairs, 5).select("qid", F.col("doc_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def _word_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = content(spark, sf_dir)
    if c is not None:
        return c.links().select("a", "b", "c")
    return spark.sql(sql_of(CONTENT + "select a, b, c from links", "spark", sf_dir))


def g1_theme_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_word_links(spark, sf_dir).select("a", "b")).select(F.col("node").alias("word"), "root")


def g3_cluster_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clusters(_word_links(spark, sf_dir)).groupBy("root", "hub").agg(F.count(F.lit(1)).alias("words"))


def tp28_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between all regions and nations, over the tree that a root above the regions closes."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    up = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"), (F.col("n_nationkey") % 3 + 1).cast("long").alias("w"))
    top = region.select(F.concat(F.lit("r"), "r_regionkey").alias("a"), F.lit("root").alias("b"), (F.col("r_regionkey") + 1).cast("long").alias("w"))
    return graph.shortest_paths(up.union(top))


def g12_conflict_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot for each benchmark item, so that no two in one slot share a word of the rarest hundredth."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("node"), "text")
    words = items.select("node", F.explode(F.array_distinct(plain_tokens(F.col("text")))).alias("token"))
    rare = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 4").select("token")
    held = words.join(rare, "token")
    clash = held.select("token", F.col("node").alias("a")).join(held.select("token", F.col("node").alias("b")), "token").where("a < b").select("a", "b")
    return graph.greedy_colours(items.select("node"), clash).select(F.col("node").alias("item_id"), F.col("colour").alias("slot"))


def w17_adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control charts of all users' values, in the order of time and event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("unit"), F.struct("ts", "event_id").alias("at"), "value")
    return adaptive.alarms(events, k=1.0).select(F.col("unit").alias("user_id"), "at.event_id", F.round("fast", 6).alias("fast"), "alarm")


def tx4_normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs, _ = _tables(spark, sf_dir)
    return docs.select("doc_id", nfkc(F.col("text")).alias("clean"), "text").select("doc_id", F.length("clean").cast("long").alias("chars"), F.xxhash64("clean").alias("hash"), (F.col("clean") != F.col("text")).alias("changed"))


def r53_latent_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _tables(spark, sf_dir)
    x, y = latent.vectors(docs, items.withColumnRenamed("item_id", "qid"), plain_tokens)
    return retrieval.top_k(latent.rerank(_ranked(spark, sf_dir, 100), x, y), 10).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def r56_saturated_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of the benchmark lead to along co-occurrences, until nothing new comes."""
    _, items = _tables(spark, sf_dir)
    seeds = items.select(F.explode(plain_tokens(F.col("text"))).alias("node"))
    links = _word_links(spark, sf_dir)
    linked = links.select(F.col("a").alias("node")).union(links.select("b"))
    return graph.reach(seeds.join(linked.distinct(), "node", "left_semi"), links).select(F.col("node").alias("word"), F.col("round").cast("long").alias("round"))


def tp1_subword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _tables(spark, sf_dir)
    return grams.frequencies(docs) if scoring.keyed(docs, "doc_id") else _plan("tp1_subword_index")(spark, sf_dir)


def r44_completeness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _tables(spark, sf_dir)
    return grams.unheld(docs, plain_tokens(F.col("text")))


def r2_multi_view_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    if not Base.bounded(spark, sf_dir):
        return _plan("r2_multi_view_bm25")(spark, sf_dir)
    docs, items = _tables(spark, sf_dir)
    asked = {(r.item_id, kind + t) for r in items.select("item_id", content_words(F.col("text")).alias("t")).collect() for w in r.t or () for kind, t in [("w", w), *([("p", w[:4])] if len(w) >= 4 else []), *(("t", w[i : i + 3]) for i in range(len(w) - 2))]}
    known = {r.token: r for r in grams.view_counts(docs, sorted({t for _, t in asked})).collect()}  # a row for each term asked for
    n, total = (known[""].df, known[""].dl) if "" in known else (0, 0.0)
    idf = {t: math.log(1 + (n - r.df + 0.5) / (r.df + 0.5)) for t, r in known.items() if t}
    terms = scoring.Terms([Row(qid=q, token=t) for q, t in asked if idf.get(t, 0.0) >= 0.3], idf=lambda r: idf[r.token])
    sums = lambda of, tf, dl, avgdl: [of["idf"] * 1.9 * tf / (tf + 0.9 * 0.6 + 0.9 * 0.4 * dl / avgdl)]
    found = scoring.scored(docs, terms, sums, ["score"], total / n if n else 1.0, keep=scoring.first_of(10, lambda q, c: c["score"]), bag=grams.Views(terms.tokens))
    return retrieval.top_k(found, 10).select("qid", "doc_id", "rank")


def r43_shared_rare_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _tables(spark, sf_dir)
    return copies.near_copies(docs) if scoring.keyed(docs, "doc_id") else _plan("r43_shared_rare_jaccard")(spark, sf_dir)


#: Queries that SQL does not express: a fold with state, a greedy walk, Unicode tables, principal axes. Tests hold them against plain Python.
WITHOUT_SQL = ("g12_conflict_schedule", "w17_adaptive_threshold", "tx4_normalised_text", "r53_latent_rerank")

REACH = CONTENT.replace("with w as", "with recursive w as", 1) + ", e as (select a, b, c from links), r(a, b) as (select a, b from (select a, b from e union select b, a from e) x union select r.a, y.b from r join (select a, b from e union select b, a from e) y on y.a = r.b), root as (select a word, least(a, min(b)) root from r group by a)"

_DUCK: dict[str, str] = {
    "g1_theme_clusters": REACH + " select word, root from root",
    "r56_saturated_learning": CONTENT.replace("with w as", "with recursive w as", 1) + ", e as (select a, b from links union select b, a from links), r(word, round) as (select distinct token, 0 from {tok:benchmark,item_id,text} t where token in (select a from e) union select e.b, round + 1 from r join e on e.a = r.word where round < 12) select word, cast(min(round) as bigint) round from r group by 1",
    "g3_cluster_hubs": REACH + ", s as (select word, sum(c) w from (select a word, c from e union all select b, c from e) group by 1), h as (select root, word hub, count(*) over (partition by root) words, row_number() over (partition by root order by w desc, word) k from root join s using (word)) select root, hub, words from h where k = 1",
    "tp28_shortest_paths": "with recursive up as (select 'n' || n_nationkey a, 'r' || n_regionkey b, cast(n_nationkey % 3 + 1 as bigint) w from nation union all select 'r' || r_regionkey, 'root', r_regionkey + 1 from region), e as (select a, b, w from up union all select b, a, w from up), p(a, b, w, n) as (select a, b, w, 1 from e union all select p.a, e.b, p.w + e.w, n + 1 from p join e on e.a = p.b where n < 4) select a, b, cast(min(w) as bigint) w from p where a <> b group by 1, 2",
    "r1_bm25_topk": BASE + "select qid, doc_id, rank, round(score, 6) score from rk where rank <= 10",
    "r9_tfidf_topk": BASE + ", s as (select q.qid, t.doc_id, sum(t.tf * (ln((n + 1) / (df.df + 1)) + 1)) score from qt q join tf t on t.token = q.token join df on df.token = q.token cross join st group by 1, 2) select qid, doc_id, rank, round(score, 6) score from (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) rank from s) where rank <= 10",
    "e1_ranking_metrics": BASE + ", h as (select r.qid, sum(1 / log2(r.rank + 1)) dcg, count(*) hits, min(r.rank) first_hit from rk r join rel on rel.qid = r.qid and rel.doc_id = r.doc_id where r.rank <= 10 group by 1), n as (select qid, count(*) n from rel group by 1), i as (select qid, n, (select sum(1 / log2(g + 1)) from generate_series(1, least(n, 10)) t(g)) ideal from n) select i.qid, round(coalesce(dcg / ideal, 0), 6) ndcg, round(coalesce(hits / n, 0), 6) recall, round(coalesce(1 / first_hit, 0), 6) mrr, first_hit from i left join h on h.qid = i.qid",
    "fu2_rank_fusion": BASE + ", h as (select q.qid, t.doc_id, count(*) c from qt q join tf t on t.token = q.token group by 1, 2), o as (select qid, doc_id, row_number() over (partition by qid order by c desc, doc_id) rank from h), f as (select qid, doc_id, sum(1 / (60 + rank - 1)) score from (select qid, doc_id, rank from rk where rank <= 50 union all select qid, doc_id, rank from o where rank <= 50) group by 1, 2) select qid, doc_id, rank, round(score, 9) score from (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) rank from f) where rank <= 10",
    "fu1_additive_fusion": BASE + ", x as (select q.qid, t.doc_id, sum(t.tf / (t.tf + 1)) score from qt q join tf t on t.token = q.token group by 1, 2), a as (select qid, doc_id, score / max(score) over (partition by qid) a from rk where rank <= 100), b as (select qid, doc_id, score / max(score) over (partition by qid) b from x), f as (select coalesce(a.qid, b.qid) qid, coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a, 0) + 0.25 * coalesce(b, 0) score from a full join b on a.qid = b.qid and a.doc_id = b.doc_id) select qid, doc_id, rank, round(score, 6) score from (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) rank from f) where rank <= 10",
    "tx7_stems": """with w as (select token word, count(*) n from {tok:documents,doc_id,text} t group by 1),
        s as (select word, n, case when length(word) > 5 and word like '%ies' then left(word, length(word) - 3) || 'y' when regexp_matches(word, '(sses|shes|ches|xes|zes)$') then left(word, length(word) - 2)
          when word like '%s' and not regexp_matches(word, '(ss|us|is|ics)$') then left(word, length(word) - 1) else word end one from w),
        b as (select word, n, one, case when length(one) > 5 and one like '%ing' then left(one, length(one) - 3) when length(one) > 4 and one like '%ed' then left(one, length(one) - 2) end bare from s)
        select case when length(word) <= 4 then word when bare is null then one when length(bare) > 2 and right(bare, 1) = left(right(bare, 2), 1) then left(bare, length(bare) - 1) else bare end stem, cast(sum(n) as bigint) n from b group by 1""",
    "tx6_crude_stems": "with w as (select token word, count(*) n from {tok:documents,doc_id,text} t group by 1) select case " + " ".join(f"when length(word) > {len(e) + 3} and word like '%{e}' then left(word, length(word) - {len(e)})" for e in CRUDE_ENDINGS) + " else word end stem, cast(sum(n) as bigint) n, count(*) words from w group by 1",
    "d4_ordered_dedup": "with f as (select doc_id, token, min(pos) pos from {tok:documents,doc_id,text} t group by 1, 2) select doc_id, count(*) n, md5(string_agg(token, ' ' order by pos)) words_md5 from f group by 1",
    "r50_retriever": BASE + "select r.qid, r.rank, r.doc_id, md5(d.text) text_md5, round(r.score, 6) score from rk r join documents d on d.doc_id = r.doc_id where r.rank <= 10",
    "j19_dense_similarity": "with p as (select q.vec_id qid, e.vec_id, list_dot_product(e.embedding::double[], q.embedding::double[]) s from embeddings e join embeddings q on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id) select qid, vec_id, rank, round(s, 6) score from (select *, row_number() over (partition by qid order by round(s, 9) desc, vec_id) rank from p) where rank <= 5",
}

_FRAMES = (r1_bm25_topk, r9_tfidf_topk, e1_ranking_metrics, fu2_rank_fusion, fu1_additive_fusion, tx7_stems, tx6_crude_stems, d4_ordered_dedup, r50_retriever, j19_dense_similarity, g1_theme_clusters, g3_cluster_hubs, tp28_shortest_paths, g12_conflict_schedule, w17_adaptive_threshold, tx4_normalised_text, r53_latent_rerank, r56_saturated_learning)


def _plan(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(sql_of(PLANS[name], "spark", sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FRAMES} | {n: stepwise(n) if n in STEPS else paired(n) if n in PAIRED else _plan(n) for n in PLANS} | {f.__name__: f for f in (r2_multi_view_bm25, r43_shared_rare_jaccard, tp1_subword_index, r44_completeness_audit)}


def oracle_sql() -> dict[str, str]:
    return {n: render(s, "duckdb") for n, s in _DUCK.items()} | {n: sql_of(PLANS[n], "duckdb") for n in PLANS}
