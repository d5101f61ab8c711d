"""More plans over the sample tables: routing, bridges, reranking, measures, sub-words and algebra."""

from __future__ import annotations

from .catalog import BASE, CONTENT, SENSOR

#: Document terms that go with a query term over the relevant pairs: weight is the share of its queries times idf.
BRIDGES = BASE + """
, nq as (select token, count(distinct qid) n from qt where qid in (select qid from rel) group by 1),
pc as (select q.token qt, t.token dt, count(distinct q.qid) c from rel join qt q on q.qid = rel.qid join tf t on t.doc_id = rel.doc_id group by 1, 2),
br as (select qt, dt, w from (select p.qt, p.dt, p.c * 1.0 / n.n * i.idf w, row_number() over (partition by p.qt order by round(p.c * 1.0 / n.n * i.idf, 9) desc, p.dt) k
  from pc p join nq n on n.token = p.qt join idf i on i.token = p.dt where p.qt <> p.dt and i.idf >= 3) x where k <= 12),
ex as (select q.qid, t.doc_id, sum(b.w * t.tf / (t.tf + 1.0)) score, count(distinct q.token) agree from qt q join br b on b.qt = q.token join tf t on t.token = b.dt group by 1, 2)
"""

#: The rarest terms of each query.
RARE3 = BASE + ", r3 as (select qid, token, df, idf, k from (select q.qid, q.token, i.df, i.idf, row_number() over (partition by q.qid order by i.df, q.token) k from qt q join idf i on i.token = q.token) x where k <= 3)"

#: Links between the documents of a query's pool by the idf of the rare terms they share.
POOL = BASE + """
, pool as (select qid, doc_id, score, score / max(score) over (partition by qid) part from rk where rank <= 60),
pt as (select p.qid, p.doc_id, t.token, i.idf from pool p join tf t on t.doc_id = p.doc_id join idf i on i.token = t.token where i.df between 2 and 20),
link as (select a.qid, a.doc_id, b.doc_id other, sum(a.idf) w from pt a join pt b on b.qid = a.qid and b.token = a.token and b.doc_id <> a.doc_id group by 1, 2, 3)
"""

#: The same with all terms that two documents can share.
POOL_ALL = POOL.replace("i.df between 2 and 20", "i.df >= 2")

#: Words, their prefixes and their trigrams as one weighted bag.
VIEWS = """
with w as {words:documents,doc_id,text}, qw as {words:benchmark,item_id,text},
bag as (select doc_id, concat('w', token) term, sum(case when pos < 14 then 1.6 else 1.0 end) tf from w group by 1, 2
  union all select doc_id, concat('p', left(token, 4)), count(*) * 0.2 from w where length(token) >= 4 group by 1, 2
  union all select doc_id, concat('t', g), count(*) * 0.3 from (select doc_id, {explode:{grams:token,3}} g from w) x group by 1, 2),
qbag as (select distinct item_id qid, concat('w', token) term from qw union select item_id, concat('p', left(token, 4)) from qw where length(token) >= 4 union select item_id, concat('t', g) from (select item_id, {explode:{grams:token,3}} g from qw) x),
dl as (select doc_id, sum(tf) dl from bag group by 1), st as (select count(*) n, avg(dl) avgdl from dl),
idf as (select term, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) idf from bag cross join st group by 1)
"""

#: Adjacent tokens and how often each pair and each token occurs.
BIGRAMS = """
with t as {tok:documents,doc_id,text}, b as (select doc_id, token a, lead(token) over (partition by doc_id order by pos) b from t),
u as (select token, count(*) c from t group by 1), n as (select sum(c) n from u),
g as (select a, b, count(*) c, count(distinct doc_id) d from b where b is not null group by 1, 2)
"""

TOP10 = "select qid, doc_id, rank from (select qid, doc_id, cast(row_number() over (partition by qid order by round(score, 9) desc, doc_id) as bigint) rank from f) x where rank <= 10"

PLANS: dict[str, str] = {
    # sources and tokens
    "s5_merged_judgements": "with m as (select doc_id, quality grade, 1 o from {labels} union all select doc_id, toxic, 2 from {labels}), r as (select doc_id, grade, row_number() over (partition by doc_id order by o desc, grade) k from m) select doc_id, grade from r where k = 1",
    "s10_semi_join_scan": "select d.doc_id, d.lang, d.n_chars from {documents} d where exists (select 1 from {labels} l where l.doc_id = d.doc_id)",
    "tx9_subword_runs": "with w as (select distinct token from {words:documents,doc_id,text} x), g as (select token, {explode:{grams:token,2}} g from w union all select token, {explode:{grams:token,3}} from w union all select token, {explode:{grams:token,4}} from w) select g, cast(count(*) as bigint) occurrences, cast(count(distinct token) as bigint) words from g group by 1",
    "tx14_digit_sums": "with t as (select distinct token from {tok:documents,doc_id,text} x where token between '0' and '9z'), l as (select token, {explode:{grams:token,1}} c from t) select token, cast(sum(ascii(c) - 48) as bigint) digit_sum, cast(count(*) as bigint) digits from l where c between '0' and '9' group by 1",
    "tx21_hub_filter": BASE + "select t.doc_id, cast(count(*) as bigint) kept from tf t left join (select token from idf where idf < 1.0) h on h.token = t.token where h.token is null group by 1",
    "tx23_glossary_rewrite": BRIDGES + "select qid, token, max(added) added from (select qid, token, 0 added from qt union all select q.qid, b.dt, 1 from qt q join br b on b.qt = q.token left join qt o on o.qid = q.qid and o.token = b.dt where o.token is null) x group by 1, 2",
    # gates
    "f2_rare_gates": BASE + "select g.gate, cast(count(*) as bigint) terms, cast(sum(i.df) as bigint) postings from idf i join (values (2.0), (2.5), (3.0), (3.5), (5.0), (5.5), (7.0)) g(gate) on i.idf >= g.gate group by 1",
    "f6_hub_idf_gate": BASE + "select token, df, round(idf, 9) idf from idf where idf < 2.0",
    "f7_entity_constraint": RARE3 + "select r.qid, r.doc_id, r.rank, case when t.token is null then 0 else 1 end entity from rk r join r3 on r3.qid = r.qid and r3.k = 1 left join tf t on t.doc_id = r.doc_id and t.token = r3.token and r3.idf >= 3 where r.rank <= 20",
    "f8_density_demotion": BASE + ", u as (select doc_id, count(*) / sum(tf) d from tf group by 1), f as (select r.qid, r.doc_id, r.score * case when u.d < 0.35 then 0.5 when u.d < 0.5 then 0.8 else 1.0 end score from rk r join u on u.doc_id = r.doc_id where r.rank <= 100) " + TOP10,
    "f9_lexical_gate": BASE + "select qid, doc_id, case when mx >= 1.0 and score < 0.12 * mx then 0 else 1 end is_open from (select qid, doc_id, score, max(score) over (partition by qid) mx from bm) x",
    "f10_dominance_caps": BASE + "select qid, doc_id, round(case when mx >= 5 then least(least(score + m * s, 4.0 * score), 4.5 * score) else least(score + m * s, 4.0 * score) end, 6) capped from (select *, max(score) over (partition by qid) mx from bm) x",
    "f11_promotion_gate": BASE + ", x as (select t.token, sum(t.tf) occurrences, max(i.df) df, max(st.n) n from tf t join idf i on i.token = t.token cross join st group by 1) select token, cast(occurrences as bigint) occurrences, df, case when occurrences >= 5 and df >= 3 and df * 2 <= n then 3 when occurrences >= 5 and df * 2 <= n then 2 else 1 end tier from x",
    # joins
    "j1_scoring_join": BASE + "select q.qid, t.doc_id, cast(sum(q.qw * t.tf) as bigint) dot from qt q join tf t on t.token = q.token group by 1, 2",
    "j2_star_join": BASE + "select i.df, cast(count(*) as bigint) postings, cast(sum(dl.dl) as bigint) lengths from tf t join idf i on i.token = t.token join dl on dl.doc_id = t.doc_id group by 1",
    "j4_list_intersection": RARE3 + "select a.qid, x.doc_id from r3 a join r3 b on b.qid = a.qid and a.k = 1 and b.k = 2 join tf x on x.token = a.token join tf y on y.token = b.token and y.doc_id = x.doc_id",
    "j5_pair_counts": CONTENT + "select c, cast(count(*) as bigint) pairs from pairs group by 1",
    "j7_bridge_counts": BRIDGES + "select qt, dt, cast(c as bigint) c from pc where c >= 2",
    "j8_bridge_expansion": BRIDGES + "select qid, doc_id, cast(agree as bigint) agree, round(score, 6) score from ex",
    "j9_new_candidates": BRIDGES + "select e.qid, e.doc_id from ex e left join (select qid, doc_id from rk where rank <= 100) r on r.qid = e.qid and r.doc_id = e.doc_id where r.doc_id is null",
    "j13_depth_meets": "with c as (select p.i p, n.i n, p.i + n.i z from {series:3,99} p cross join {series:1,100} n where p.i % 2 = 1) select z, cast(count(*) as bigint) meets from c a join c b using (z) where a.p < b.p group by 1",
    "j14_block_sizes": BASE + ", sg as (select doc_id, token from (select t.doc_id, t.token, row_number() over (partition by t.doc_id order by i.df, t.token) k from tf t join idf i on i.token = t.token where i.df >= 2) x where k <= 4) select n, cast(count(*) as bigint) terms from (select token, count(*) n from sg group by 1) x group by 1",
    "j20_ancestors": "{recursive} a(k, anc) as (select i, i from {series:1,300} s union all select k, cast(floor(anc / 2) as int) from a where anc > 1) select cast(k as bigint) k, cast(count(*) as bigint) depth, cast(min(anc) as bigint) root from a group by 1",
    "j21_pool_propagation": POOL + ", nb as (select l.qid, l.doc_id, sum(l.w * p.part) / sum(l.w) s from link l join pool p on p.qid = l.qid and p.doc_id = l.other group by 1, 2), f as (select p.qid, p.doc_id, 0.75 * p.part + 0.25 * coalesce(nb.s, 0.0) score from pool p left join nb on nb.qid = p.qid and nb.doc_id = p.doc_id) " + TOP10,
    # statistics
    "ag4_weighted_lengths": VIEWS + "select doc_id, round(dl, 6) dl from dl",
    "ag7_bigram_pmi": BIGRAMS + "select g.a, g.b, cast(g.c as bigint) c, round(log2(g.c * 1.0 * n.n / (x.c * 1.0 * y.c)), 9) pmi from g join u x on x.token = g.a join u y on y.token = g.b cross join n where g.c >= 3",
    "ag9_ppmi_neighbours": BIGRAMS + "select a, b, k from (select g.a, g.b, log2(g.c * 1.0 * n.n / (x.c * 1.0 * y.c)) pmi, cast(row_number() over (partition by g.a order by round(log2(g.c * 1.0 * n.n / (x.c * 1.0 * y.c)), 9) desc, g.b) as bigint) k from g join u x on x.token = g.a join u y on y.token = g.b cross join n where g.c >= 3) z where pmi > 0 and k <= 10",
    "ag11_compounds": BIGRAMS + "select g.a, g.b, cast(g.d as bigint) docs from g join u x on x.token = g.a join u y on y.token = g.b cross join n where g.d >= 5 and round(log2(g.c * 1.0 * n.n / (x.c * 1.0 * y.c)), 9) >= 3",
    "ag12_subword_scores": "with w as {words:documents,doc_id,text}, dw as (select distinct doc_id, token from w), nd as (select count(distinct doc_id) n from w), g as (select doc_id, token, {explode:{grams:token,3}} g from dw) select g, words, docs, round(ln(1 + words) * ln((n + 1.0) / (docs + 1)), 9) score from (select g, cast(count(distinct token) as bigint) words, cast(count(distinct doc_id) as bigint) docs, count(*) occurrences from g group by 1) x cross join nd where docs * 2 <= n and occurrences >= 5",
    "ag17_rarest_corridors": RARE3 + "select a.qid, x.doc_id, a.token absent, b.token present from r3 a join r3 b on b.qid = a.qid and a.k = 1 and b.k = 2 join tf x on x.token = b.token left join tf y on y.token = a.token and y.doc_id = x.doc_id where y.doc_id is null",
    "ag18_gold_triangulation": BASE + ", g as (select count(distinct doc_id) n from rel), gt as (select t.token, count(distinct t.doc_id) gd from tf t join (select distinct doc_id from rel) r on r.doc_id = t.doc_id group by 1) select gt.token, cast(gt.gd as bigint) gd, round(i.idf, 9) idf from gt join idf i on i.token = gt.token cross join g where gt.gd <= greatest(0.15 * g.n, 3.0)",
    "ag19_router_statistics": BASE + ", r as (select doc_id, count(distinct qid) c from rel group by 1), v as (select q.qid, q.token, i.df from (select qid, token from qt) q left join idf i on i.token = q.token) select round((select count(*) from r) * 1.0 / max(st.n), 9) gold_frac, round((select sum(case when c > 1 then 1 else 0 end) * 1.0 / count(*) from r), 9) reuse_frac, round(sum(case when v.df is null then 1 else 0 end) * 1.0 / count(*), 9) gap_frac from v cross join st",
    "ag20_gold_company": BRIDGES + "select p.qt, p.dt, cast(p.c as bigint) c from pc p join idf i on i.token = p.qt join idf j on j.token = p.dt where i.idf >= 2 and j.idf >= 3 and p.c >= 2 and p.qt <> p.dt",
    "ag22_branch_meet": RARE3 + ", co as (select r.qid, r.token q, t.token t, count(*) n from r3 r join tf x on x.token = r.token join tf t on t.doc_id = x.doc_id where r.df <= 50 group by 1, 2, 3) select qid, t, n from (select co.qid, co.t, cast(sum(co.n) as bigint) n, row_number() over (partition by co.qid order by round(sum(co.n) * max(i.idf), 9) desc, co.t) k from co join idf i on i.token = co.t left join qt o on o.qid = co.qid and o.token = co.t where o.token is null group by 1, 2 having count(distinct co.q) = 3) x where k <= 8",
    "ag23_exact_membership": "select source, lang, cast(count(distinct doc_id) as bigint) members from {documents} group by 1, 2",
    "ag27_phrase_composites": BIGRAMS + ", p as (select distinct doc_id, least(a, b) a, greatest(a, b) b from b where b is not null and a <> b), d as (select a, b, count(*) n from p group by 1, 2), k as (select p.doc_id, p.a, p.b, d.n, row_number() over (partition by p.doc_id order by d.n, p.a, p.b) k from p join d on d.a = p.a and d.b = p.b where d.n >= 2) select a, b, cast(count(*) as bigint) docs from k where k <= 64 group by 1, 2",
    "ag28_set_bridges": CONTENT
    + "select p.a, p.b, round(p.c * 1.0 / (x.df + y.df - p.c), 9) jaccard from dpairs p join df x on x.token = p.a join df y on y.token = p.b where x.df >= 3 and y.df >= 3 and p.c * 1.0 / (x.df + y.df - p.c) >= 0.4",
    "ag30_query_gaps": BASE + "select q.token, cast(count(*) as bigint) queries, cast(sum(case when r.hit is null then 2 else 1 end) as bigint) weight from qt q left join idf i on i.token = q.token left join (select rel.qid, 1 hit from rel join rk on rk.qid = rel.qid and rk.doc_id = rel.doc_id where rk.rank <= 10 group by 1) r on r.qid = q.qid where i.token is null group by 1",
    "ag32_category_markov": "with t as (select d.lang c, x.token from {tok:documents,doc_id,text} x join {documents} d on d.doc_id = x.doc_id where d.lang is not null), g as (select c, token, count(*) n from t group by 1, 2), a as (select c, sum(n) n from g group by 1), b as (select token, sum(n) n from g group by 1) select g.c, g.token, round(g.n * 1.0 / a.n, 9) p_word, round(g.n * 1.0 / b.n, 9) p_category from g join a on a.c = g.c join b on b.token = g.token where g.n >= 3",
    "ag34_next_word": BIGRAMS + "select a, b, c from (select a, b, cast(c as bigint) c, row_number() over (partition by a order by c desc, b) k from g) x where k = 1",
    "ag38_vocabulary_growth": "with t as (select token, min(doc_id) first_at from {tok:documents,doc_id,text} x group by 1), b as (select floor(first_at / 100) bucket, count(*) n from t group by 1) select cast(bucket as bigint) bucket, cast(n as bigint) fresh, cast(sum(n) over (order by bucket) as bigint) total from b",
    "ag40_percentiles": BASE + "select percentile_cont(0.5) within group (order by dl) p50, percentile_cont(0.99) within group (order by dl) p99 from dl",
    # retrieval
    "r2_multi_view_bm25": VIEWS + ", f as (select q.qid, b.doc_id, sum(i.idf * 1.9 * b.tf / (b.tf + 0.9 * 0.6 + 0.9 * 0.4 * dl.dl / st.avgdl)) score from qbag q join bag b on b.term = q.term join idf i on i.term = q.term join dl on dl.doc_id = b.doc_id cross join st where i.idf >= 0.3 group by 1, 2) " + TOP10,
    "r3_bm25_plus": BASE + ", k as (select qid, count(*) k from qt group by 1), f as (select b.qid, b.doc_id, b.score + 0.5 * b.s + 0.2 * b.score * b.m / k.k score from bm b join k on k.qid = b.qid) " + TOP10,
    "r5_champion_search": BASE + ", ch as (select token, doc_id, tf from (select t.token, t.doc_id, t.tf, row_number() over (partition by t.token order by round(t.tf / (t.tf + 0.54 + 0.36 * dl.dl / st.avgdl), 9) desc, t.doc_id) k from tf t join dl on dl.doc_id = t.doc_id cross join st) x where k <= 200), f as (select q.qid, t.doc_id, sum(i.idf * q.qw * 1.9 * t.tf / (t.tf + 0.54 + 0.36 * dl.dl / st.avgdl)) score from qt q join ch t on t.token = q.token join idf i on i.token = t.token join dl on dl.doc_id = t.doc_id cross join st where i.idf >= 0.3 group by 1, 2) " + TOP10,
    "r8_manifold_rerank": POOL_ALL + ", kn as (select qid, doc_id, w from (select *, row_number() over (partition by qid, doc_id order by round(w, 9) desc, other) k from link) x where k <= 20), ce as (select qid, doc_id, sum(w) c from kn group by 1, 2), f as (select p.qid, p.doc_id, p.part + 0.25 * coalesce(ce.c, 0.0) / max(ce.c) over (partition by p.qid) score from pool p left join ce on ce.qid = p.qid and ce.doc_id = p.doc_id) select qid, doc_id, rank from (select qid, doc_id, cast(row_number() over (partition by qid order by round(coalesce(score, 0.0), 9) desc, doc_id) as bigint) rank from f) x where rank <= 10",
    "r11_meet_expansion": RARE3 + ", d as (select a.qid, x.doc_id from r3 a join r3 b on b.qid = a.qid and a.k < b.k join tf x on x.token = a.token join tf y on y.token = b.token and y.doc_id = x.doc_id group by 1, 2) select qid, token from (select d.qid, t.token, row_number() over (partition by d.qid order by round(max(i.idf) * sqrt(count(*)), 9) desc, t.token) k from d join tf t on t.doc_id = d.doc_id join idf i on i.token = t.token cross join st left join qt o on o.qid = d.qid and o.token = t.token where o.token is null and i.df <= 0.05 * st.n and i.df >= 2 group by 1, 2) x where k <= 3",
    "r13_bridge_search": BRIDGES + ", l as (select qid, doc_id, score / max(score) over (partition by qid) v from rk where rank <= 100), e as (select qid, doc_id, v from (select qid, doc_id, score / max(score) over (partition by qid) v, row_number() over (partition by qid order by round(score, 9) desc, doc_id) k from ex) x where k <= 20), f as (select coalesce(l.qid, e.qid) qid, coalesce(l.doc_id, e.doc_id) doc_id, coalesce(l.v, 0.0) + 0.25 * coalesce(e.v, 0.0) score from l full outer join e on e.qid = l.qid and e.doc_id = l.doc_id) " + TOP10,
    "r15_corridor_boost": RARE3 + ", f as (select r.qid, r.doc_id, r.score * case when t.token is null then 1.0 else 1.35 end score from rk r left join r3 on r3.qid = r.qid and r3.k = 2 left join tf t on t.doc_id = r.doc_id and t.token = r3.token where r.rank <= 100) " + TOP10,
    "r16_vocabulary_gap": BRIDGES + "select q.qid, round(avg(case when b.qt is null then 1.0 else 0.0 end), 9) gap, case when avg(case when b.qt is null then 1.0 else 0.0 end) > 0.5 then 'lexical' else 'bridged' end route from qt q left join (select distinct qt from br) b on b.qt = q.token group by 1",
    "r17_bounded_pool": BASE + ", p as (select distinct q.qid, t.doc_id from qt q join idf i on i.token = q.token join tf t on t.token = q.token where i.df <= 256), f as (select b.qid, b.doc_id, b.score from bm b join p on p.qid = b.qid and p.doc_id = b.doc_id) " + TOP10,
    "r25_overlap_score": RARE3 + ", dn as (select t.doc_id, count(*) n from tf t join idf i on i.token = t.token where i.df between 2 and 200 group by 1), qn as (select q.qid, count(*) n from qt q join idf i on i.token = q.token where i.df between 2 and 200 group by 1), sh as (select q.qid, t.doc_id, count(*) k from qt q join idf i on i.token = q.token join tf t on t.token = q.token where i.df between 2 and 200 group by 1, 2), f as (select sh.qid, sh.doc_id, sh.k * 1.0 / (qn.n + dn.n - sh.k) score from sh join qn on qn.qid = sh.qid join dn on dn.doc_id = sh.doc_id) " + TOP10,
    "r26_meet_witnesses": BASE + ", qp as (select a.qid, a.token a, b.token b from qt a join qt b on b.qid = a.qid and a.token < b.token join idf i on i.token = a.token join idf j on j.token = b.token cross join st where i.df between 2 and greatest(50, 0.05 * st.n) and j.df between 2 and greatest(50, 0.05 * st.n)) select p.qid, x.doc_id, cast(count(*) as bigint) witnesses from qp p join tf x on x.token = p.a join tf y on y.token = p.b and y.doc_id = x.doc_id group by 1, 2",
    "r28_cascade": RARE3 + ", m as (select r.qid, t.doc_id, count(*) c, sum(r.idf) s from r3 r join tf t on t.token = r.token group by 1, 2), b as (select qid, max(c) c from m group by 1), f as (select m.qid, m.doc_id, m.s score from m join b on b.qid = m.qid and b.c = m.c) " + TOP10,
    "r32_recall_first_pool": BRIDGES + ", p as (select q.qid, t.doc_id from qt q join idf i on i.token = q.token join tf t on t.token = q.token union select qid, doc_id from ex), f as (select p.qid, p.doc_id, sum(t.tf / (t.tf + 1.2)) score from p join qt q on q.qid = p.qid join tf t on t.doc_id = p.doc_id and t.token = q.token group by 1, 2) " + TOP10,
    "r33_sparse_dot": BASE + ", f as (select q.qid, t.doc_id, sum(i.idf * q.qw * i.idf * ln(1 + t.tf)) score from qt q join tf t on t.token = q.token join idf i on i.token = t.token group by 1, 2) " + TOP10,
    "r35_composite_meet_pool": BASE + ", r6 as (select qid, token, k from (select q.qid, q.token, row_number() over (partition by q.qid order by i.df, q.token) k from qt q join idf i on i.token = q.token) x where k <= 6) select qid, doc_id from (select r.qid, t.doc_id from r6 r join tf t on t.token = r.token group by 1, 2 having count(*) >= 2) x union select r.qid, t.doc_id from r6 r join tf t on t.token = r.token where r.k = 1",
    "r37_nomination_floor": BASE + ", p as (select q.qid, t.doc_id from qt q join idf i on i.token = q.token join tf t on t.token = q.token where i.idf >= 3 group by 1, 2), b as (select q.qid from qt q left join p on p.qid = q.qid group by 1 having count(p.doc_id) = 0), f as (select m.qid, m.doc_id, m.score from bm m left join p on p.qid = m.qid and p.doc_id = m.doc_id left join b on b.qid = m.qid where p.doc_id is not null or b.qid is not null) " + TOP10,
    "r38_pruned_index": BASE + ", f as (select q.qid, t.doc_id, sum(i.idf * q.qw * 1.9 * least(t.tf, 15) / (least(t.tf, 15) + 0.54 + 0.36 * dl.dl / st.avgdl)) score from qt q join tf t on t.token = q.token join idf i on i.token = t.token join dl on dl.doc_id = t.doc_id cross join st where i.idf >= 4 group by 1, 2) " + TOP10,
    "r40_warm_expansion": RARE3 + ", co as (select r.qid, r.token q, r.df, r.idf qidf, t.token t, count(*) n from r3 r join tf x on x.token = r.token join tf t on t.doc_id = x.doc_id where r.df <= 50 and t.token <> r.token group by 1, 2, 3, 4, 5) select qid, q, t from (select co.qid, co.q, co.t, row_number() over (partition by co.qid, co.q order by round(co.n * 1.0 / co.df * i.idf / (1 + co.qidf), 9) desc, co.t) k from co join idf i on i.token = co.t where co.n * 1.0 / co.df >= 0.1) x where k <= 6",
    "r45_lattice_lexical": BASE + ", c as (select doc_id, count(*) n from tf group by 1), a as (select avg(n) n from c), f as (select q.qid, t.doc_id, sum(i.idf * t.tf / (t.tf + 1.2)) / (0.75 + 0.25 * max(c.n) / max(a.n)) score from qt q join tf t on t.token = q.token join idf i on i.token = t.token join c on c.doc_id = t.doc_id cross join a group by 1, 2) " + TOP10,
    "r46_shell_maxsim": CONTENT + ", q as (select distinct item_id qid, token from {words:benchmark,item_id,text} y), e as (select a s, b t, c * 1.0 / greatest(x.df, z.df) w from links p join wf x on x.token = p.a join wf z on z.token = p.b union all select b, a, c * 1.0 / greatest(x.df, z.df) from links p join wf x on x.token = p.a join wf z on z.token = p.b), m as (select q.qid, d.doc_id, q.token, 2.0 v from q join dw d on d.token = q.token union all select q.qid, d.doc_id, q.token, e.w from q join e on e.s = q.token join dw d on d.token = e.t), best as (select qid, doc_id, token, max(v) v from m group by 1, 2, 3), f as (select b.qid, b.doc_id, sum(r.idf * b.v) score from best b join rare r on r.token = b.token group by 1, 2) " + TOP10,
    "r47_oriented_rails": "with t as {tok:documents,doc_id,text}, q as {tok:benchmark,item_id,text}, d as (select doc_id, token a, lead(token) over (partition by doc_id order by pos) b from t), dp as (select doc_id, a, b, count(*) n from d where b is not null group by 1, 2, 3), e as (select item_id qid, token a, lead(token) over (partition by item_id order by pos) b from q), qp as (select distinct qid, a, b from e where b is not null), f as (select qp.qid, dp.doc_id, sum(2.0 + 3.0 * (1 - 1.0 / (1 + dp.n))) score from qp join dp on dp.a = qp.a and dp.b = qp.b group by 1, 2) " + TOP10,
    "r54_glossary_injection": RARE3 + ", gl as (select distinct r.token hub, q.token spoke from r3 r join qt q on q.qid = r.qid and q.token <> r.token), ad as (select q.qid, g.spoke, max(i.idf) w from qt q join gl g on g.hub = q.token join idf i on i.token = g.spoke left join qt o on o.qid = q.qid and o.token = g.spoke where i.idf >= 2 and o.token is null group by 1, 2), x as (select a.qid, t.doc_id, sum(a.w * t.tf / (t.tf + 1.0)) score from ad a join tf t on t.token = a.spoke group by 1, 2), f as (select r.qid, r.doc_id, r.score + 0.25 * coalesce(x.score, 0.0) score from rk r left join x on x.qid = r.qid and x.doc_id = r.doc_id where r.rank <= 100) " + TOP10,
    "r55_star_edges": RARE3 + "select r.token hub, q.token spoke, cast(count(*) as bigint) n from r3 r join qt q on q.qid = r.qid and q.token <> r.token join idf i on i.token = q.token where i.idf >= 2 group by 1, 2",
    # fusion and reranking
    "fu3_fusion_modes": BRIDGES + "select m.i fusion, r.qid, r.doc_id, round(case m.i when 1 then r.score + 0.25 * coalesce(e.score, 0.0) when 2 then r.score / r.mx + 0.25 * coalesce(e.score, 0.0) / 10 else r.score * (1 + 0.25 * coalesce(e.score, 0.0)) end, 6) score from (select *, max(score) over (partition by qid) mx from rk where rank <= 20) r left join ex e on e.qid = r.qid and e.doc_id = r.doc_id cross join {series:1,3} m",
    "fu6_company_rerank": BRIDGES + ", f as (select r.qid, r.doc_id, r.score + 0.3 * coalesce(e.score, 0.0) score from rk r left join ex e on e.qid = r.qid and e.doc_id = r.doc_id where r.rank <= 200) " + TOP10,
    "fu8_consensus_gate": BRIDGES + "select qid, doc_id, cast(agree as bigint) agree from ex where agree >= 2",
    "fu11_cross_hit_consensus": BASE + ", h as (select r.qid, t.token, count(*) c from rk r join tf t on t.doc_id = r.doc_id join idf i on i.token = t.token left join qt q on q.qid = r.qid and q.token = t.token where r.rank <= 20 and i.idf >= 2 and q.token is null group by 1, 2 having count(*) >= 2), v as (select r.qid, r.doc_id, sum(i.idf * ln(1 + h.c)) v from rk r join h on h.qid = r.qid join tf t on t.doc_id = r.doc_id and t.token = h.token join idf i on i.token = h.token where r.rank <= 20 group by 1, 2), f as (select r.qid, r.doc_id, r.score / max(r.score) over (partition by r.qid) + 0.25 * coalesce(v.v / max(v.v) over (partition by r.qid), 0.0) score from rk r left join v on v.qid = r.qid and v.doc_id = r.doc_id where r.rank <= 20) " + TOP10,
    "fu15_protected_cap": RARE3 + ", p as (select distinct r.qid, t.doc_id from r3 r join tf t on t.token = r.token where r.k = 1), o as (select b.qid, b.doc_id, row_number() over (partition by b.qid order by case when p.doc_id is null then 0 else 1 end desc, round(b.score, 9) desc, b.doc_id) k from bm b left join p on p.qid = b.qid and p.doc_id = b.doc_id) select qid, doc_id from o where k <= 50",
    "u5_exponent_union": "with a as (select token, count(*) n from {tok:documents,doc_id,text} x group by 1), b as (select token, count(*) n from {tok:benchmark,item_id,text} x group by 1) select coalesce(a.token, b.token) token, cast(greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as bigint) most, cast(coalesce(a.n, 0) + coalesce(b.n, 0) as bigint) added from a full outer join b on b.token = a.token",
    # measures
    "e2_graded_ndcg": BASE + ", g as (select r.qid, r.doc_id, case when l.quality = 1 then 2 else 1 end grade from rel r left join {labels} l on l.doc_id = r.doc_id), o as (select qid, grade, row_number() over (partition by qid order by grade desc, doc_id) k from g), i as (select qid, sum(grade / log2(k + 1)) ideal from o where k <= 10 group by 1), d as (select g.qid, sum(g.grade / log2(r.rank + 1)) dcg from g join rk r on r.qid = g.qid and r.doc_id = g.doc_id where r.rank <= 10 group by 1) select i.qid, round(coalesce(d.dcg, 0.0) / i.ideal, 9) ndcg from i left join d on d.qid = i.qid",
    "e3_recall_at_k": BASE + "select k.k, round(sum(case when r.rank <= k.k then 1 else 0 end) * 1.0 / count(*), 9) recall from rel left join rk r on r.qid = rel.qid and r.doc_id = rel.doc_id cross join (values (1), (10), (100)) k(k) group by 1",
    "e6_candidate_recall": BASE + "select round(count(b.doc_id) * 1.0 / count(*), 9) recall from rel left join bm b on b.qid = rel.qid and b.doc_id = rel.doc_id",
    "e8_failure_patterns": BASE + "select rel.qid, rel.doc_id, case when b.doc_id is null then 'unreachable' when r.rank <= 10 then 'hit' when r.rank <= 100 then 'rerank' else 'pool' end pattern from rel left join bm b on b.qid = rel.qid and b.doc_id = rel.doc_id left join rk r on r.qid = rel.qid and r.doc_id = rel.doc_id",
    "e12_polluters": BASE + "select r.doc_id, cast(count(*) as bigint) wrong from rk r join (select distinct qid from rel) q on q.qid = r.qid left join rel on rel.qid = r.qid and rel.doc_id = r.doc_id where r.rank <= 10 and rel.doc_id is null group by 1",
    "e14_purity": "select round(sum(most) * 1.0 / sum(n), 9) purity from (select source, max(c) most, sum(c) n from (select source, lang, count(*) c from {documents} group by 1, 2) x group by 1) y",
    # sensors
    "w4_peer_regression": SENSOR + ", p as (select unit, i, v, (sum(v) over (partition by i) - v) / nullif(count(*) over (partition by i) - 1, 0) peers from s), b as (select unit, regr_slope(v, peers) slope, regr_intercept(v, peers) base from p where i <= 20 and peers is not null group by 1 having count(*) >= 5), r as (select p.unit, p.i, p.v - b.slope * p.peers - b.base residual from p join b on b.unit = p.unit where p.peers is not null), z as (select unit, stddev_pop(residual) sd from r where i <= 20 group by 1) select r.unit, r.i, round(r.residual, 4) residual, round(r.residual / (z.sd + 1e-9), 4) z from r join z on z.unit = r.unit",
    "w6_marginal_alarms": SENSOR + ", b as (select unit, avg(v) m, stddev_pop(v) + 1e-9 sd from s where i <= 10 group by 1 having count(*) = 10), f as (select s.unit, s.i, case when abs(s.v - b.m) > 2 * b.sd then 1 else 0 end hit from s join b on b.unit = s.unit), g as (select unit, i, hit, sum(hit) over (partition by unit order by i rows between current row and 2 following) h from f) select unit, min(i) first_at from g where hit = 1 and h >= 2 group by 1",
    "w11_onset_address": SENSOR + ", t as (select unit, max(v) m, max(i) n from s group by 1), o as (select s.unit, min(s.i) - 1 place, max(t.n) n from s join t on t.unit = s.unit where s.v = t.m group by 1), x as (select unit, floor(place * 30.0 / n) c from o) select unit, cast(floor(c / 15) as bigint) d2, cast(floor(c / 5) % 3 as bigint) d3, cast(c % 5 as bigint) d5 from x",
    "w16_state_occupancy": SENSOR + ", d as (select unit, i, v - avg(v) over (partition by unit) x, v - lag(v) over (partition by unit order by i) y from s), q as (select case when x >= 0 and y >= 0 then 1 when x < 0 and y >= 0 then 2 when x < 0 then 3 else 4 end branch, floor(i / 16) period from d where y is not null) select cast(period as bigint) period, branch, cast(count(*) as bigint) n from q group by 1, 2",
    # integer algebra
    "m3_prime_tiers": "with n as (select i from {series:3,2000} s where i % 2 = 1), p as (select n.i p from n left join (select distinct a.i * b.i c from (select i from n where i < 45) a join n b on b.i >= a.i and a.i * b.i <= 2000) c on c.c = n.i where c.c is null), r as (select p, row_number() over (order by p) k, count(*) over () n from p) select p, case when k <= 0.41 * n then 1 when k <= 0.82 * n then 2 else 3 end tier from r",
    "m4_prime_factors": "with n as (select i from {series:2,600} s), p as (select i p from n a where not exists (select 1 from {series:2,24} d where d.i < a.i and a.i % d.i = 0)) select n.i n, cast(count(*) as bigint) factors, cast(sum(p.p) as bigint) factor_sum, cast(max(p.p) as bigint) largest from n join p on n.i % p.p = 0 group by 1",
    "m6_letter_overlap": "with w as (select distinct token from {words:benchmark,item_id,text} x), l as (select distinct token, {explode:{grams:token,1}} c from w), n as (select token, count(*) n from l group by 1), s as (select a.token a, b.token b, count(*) k from l a join l b on a.c = b.c and a.token < b.token where left(a.token, 2) = left(b.token, 2) group by 1, 2) select s.a, s.b, round(s.k * 1.0 / least(x.n, y.n), 9) ratio from s join n x on x.token = s.a join n y on y.token = s.b",
    "m14_missing_member": "select a.i a, b.i b, c.i c, k.i gone, a.i + b.i + c.i - case k.i when 1 then b.i + c.i when 2 then a.i + c.i else a.i + b.i end found from {series:1,15} a cross join {series:1,15} b cross join {series:1,15} c cross join {series:1,3} k where a.i < b.i and b.i < c.i",
    "m20_klein_group": "select p.i p, n.i n, k.i k, case when k.i in (0, 1) then p.i else -p.i end x, case when k.i in (0, 2) then n.i else -n.i end y from {series:1,20} p cross join {series:1,20} n cross join {series:0,3} k",
    # promotion and pruning
    "tp1_subword_index": "with t as {words:documents,doc_id,text}, w as (select doc_id, token, count(*) n from t group by 1, 2), g as (" + " union all ".join(f"select doc_id, n, {{explode:{{grams:token,{k}}}}} g from w" for k in (1, 2, 3)) + ") select g, cast(sum(n) as bigint) frequency, cast(count(distinct doc_id) as bigint) docs from g group by 1",
    "tp14_rare_shells": BASE + "select t.token, t.doc_id from tf t join idf i on i.token = t.token where i.df between 2 and 8",
    "tp22_transferred_links": BRIDGES + ", v as (select distinct token from {tok:conversations,conv_id,text} x) select b.qt, b.dt, round(b.w, 9) w from br b join v x on x.token = b.qt join v y on y.token = b.dt",
    "tp24_pruned_postings": BASE + "select doc_id, token, k from (select t.doc_id, t.token, cast(row_number() over (partition by t.doc_id order by round(t.tf * i.idf, 9) desc, t.token) as bigint) k from tf t join idf i on i.token = t.token) x where k <= 30",
    "tp25_gap_bytes": BASE + ", g as (select token, doc_id - lag(doc_id, 1, 0) over (partition by token order by doc_id) gap from tf) select token, cast(sum(case when gap < 128 then 1 when gap < 16384 then 2 when gap < 2097152 then 3 else 4 end) as bigint) varint_bytes, cast(ceil(count(*) * (floor(log2(max(gap) + 1)) + 1) / 8.0) as bigint) block_bytes from g group by 1",
    "tp27_exact_distinct": "with t as (select d.lang, x.token from {tok:documents,doc_id,text} x join {documents} d on d.doc_id = x.doc_id) select lang, cast(count(distinct token) as bigint) n from t group by 1",
}
