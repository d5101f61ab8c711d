"""Plans over the sample tables, by what they compute. Results are ordered by nothing; ties go to the smaller id."""

from __future__ import annotations

#: Common parts: documents as corpus, benchmark items as queries, containment as relevance.
BASE = """
with tok as {tok:documents,doc_id,text}, tf as (select doc_id, token, cast(count(*) as bigint) tf from tok group by 1, 2),
dl as (select doc_id, cast(sum(tf) as bigint) dl from tf group by 1), st as (select count(*) n, avg(dl) avgdl from dl),
df as (select token, cast(count(*) as bigint) df from tf group by 1),
idf as (select token, df, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from df cross join st),
qt as (select item_id qid, token, cast(count(*) as bigint) qw from {tok:benchmark,item_id,text} group by 1, 2),
rel as (select b.item_id qid, d.doc_id from {benchmark} b join {documents} d on contains(d.text, b.text)),
bm as (select q.qid, t.doc_id, sum(i.idf * q.qw * 1.9 * t.tf / (t.tf + 0.9 * 0.6 + 0.9 * 0.4 * dl.dl / st.avgdl)) score, cast(count(*) as bigint) m, sum(i.idf) s
  from qt q join tf t on q.token = t.token join idf i on i.token = t.token join dl on dl.doc_id = t.doc_id cross join st where i.idf >= 0.3 group by 1, 2),
rk as (select qid, doc_id, score, m, s, cast(row_number() over (partition by qid order by round(score, 9) desc, doc_id) as bigint) rank from bm)
"""

#: Content words, all of them. Words meet in windows of 48 words, so that the pairs grow with the text and not with its
#: square; ``wf`` and ``nw`` count windows, ``df`` and ``nd`` documents. Rare is what a fiftieth of the documents or fewer hold.
CONTENT = """
with w as {words:documents,doc_id,text},
dw as (select distinct doc_id, token from w),
nd as (select count(distinct doc_id) n from dw),
df as (select token, cast(count(*) as bigint) df from dw group by 1),
rare as (select token, df, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from df cross join nd),
top as (select dw.doc_id, dw.token, r.df, r.idf from dw join rare r on r.token = dw.token),
ww as (select distinct doc_id, cast(floor(pos / 48) as bigint) win, token from w),
nw as (select count(*) n from (select distinct doc_id, win from ww) x),
wf as (select token, cast(count(*) as bigint) df from ww group by 1),
pairs as (select a.token a, b.token b, cast(count(*) as bigint) c from ww a join ww b on a.doc_id = b.doc_id and a.win = b.win and a.token < b.token group by 1, 2),
dpairs as (select a, b, cast(count(*) as bigint) c from (select distinct a.doc_id, a.token a, b.token b from ww a join ww b on a.doc_id = b.doc_id and a.win = b.win and a.token < b.token) x group by 1, 2),
links as (select p.a, p.b, p.c from pairs p join wf x on x.token = p.a join wf y on y.token = p.b cross join nw where p.c >= 4 and ln((nw.n * p.c + 1.0) / (x.df * y.df + 1.0)) >= 3)
"""

SENSOR = """
with e as (select user_id unit, ts, event_id, value v from {events} where value is not null),
s as (select unit, v, cast(row_number() over (partition by unit order by ts, event_id) as bigint) i from e)
"""

PLANS: dict[str, str] = {
    # term statistics
    "ag1_term_frequency": BASE + "select doc_id, token, tf from tf",
    "ag2_document_frequency": BASE + "select token, df, round(idf, 9) idf from idf",
    "ag2_corpus_statistics": BASE + "select n, round(avgdl, 9) avgdl from st",
    "ag5_champion_lists": BASE + "select token, doc_id, tf, k from (select t.token, t.doc_id, t.tf, cast(row_number() over (partition by t.token order by round(t.tf / (t.tf + 0.54 + 0.36 * dl.dl / st.avgdl), 9) desc, t.doc_id) as bigint) k from tf t join dl on dl.doc_id = t.doc_id cross join st) x where k <= 5",
    "ag25_rarity_bands": BASE + "select token, df, case when df <= 1 then 'very_rare' when p >= 0.9 then 'very_common' when p >= 0.7 then 'common' when p >= 0.4 then 'medium' when p >= 0.15 then 'rare' else 'very_rare' end band from (select token, df, 1 - (row_number() over (order by df desc, token) - 1) / greatest(count(*) over () - 1.0, 1.0) p from df) x",
    "tx22_distinct_ratio": BASE + "select doc_id, round(count(*) / sum(tf), 9) ratio from tf group by doc_id",
    "f1_idf_floor": BASE + "select token, df from idf where idf >= 0.3 and df > 1",
    "f3_frequency_cap": BASE + "select token, df from df cross join st where df <= 0.5 * n",
    "f5_vocabulary_bounds": BASE + "select token, df from df where df between 3 and 40",
    "c1_gap_bits": BASE + "select token, cast(sum(bits) as bigint) bits from (select token, case when gap <= 1 then 1 else floor(log2(gap)) + 1 end bits from (select token, doc_id - coalesce(lag(doc_id) over (partition by token order by doc_id), -1) gap from tf) g) x group by 1",
    "d6_delta_coding": BASE + "select token, doc_id, cast(doc_id - lag(doc_id, 1, 0) over (partition by token order by doc_id) as bigint) gap from tf",
    "c2_vbyte_length": BASE + "select tf, cast(count(*) as bigint) n, case when tf < 128 then 1 when tf < 16384 then 2 else 3 end bytes from tf group by tf",
    # scoring plans
    "r21_score_parts": BASE + "select q.qid, t.doc_id, t.token, t.tf, round(i.idf * q.qw * 1.9 * t.tf / (t.tf + 0.54 + 0.36 * dl.dl / st.avgdl), 9) part from rk r join qt q on q.qid = r.qid join tf t on t.doc_id = r.doc_id and t.token = q.token join idf i on i.token = t.token join dl on dl.doc_id = t.doc_id cross join st where r.rank = 1 and i.idf >= 0.3",
    "r36_capped_bm25": BASE
    + ", least_df as (select q.qid, min(i.df) df from qt q join idf i on i.token = q.token group by 1), pool as (select distinct q.qid, t.doc_id from qt q join idf i on i.token = q.token join least_df l on l.qid = q.qid cross join st join tf t on t.token = q.token where i.df <= greatest(50, 0.05 * st.n, l.df)) select qid, doc_id, rank from (select b.qid, b.doc_id, cast(row_number() over (partition by b.qid order by round(b.score, 9) desc, b.doc_id) as bigint) rank from bm b join pool p on p.qid = b.qid and p.doc_id = b.doc_id) x where rank <= 10",
    "r39_exact_and": BASE + "select b.qid, b.doc_id from bm b join (select q.qid, count(*) k from qt q join idf i on i.token = q.token where i.idf >= 0.3 group by 1) a on a.qid = b.qid and a.k = b.m",
    "r31_coverage": BASE + "select qid, doc_id, m, round(s, 9) s from (select *, row_number() over (partition by qid order by m desc, round(s, 9) desc, doc_id) k from bm) x where k <= 10",
    "r12_pseudo_feedback": BASE + ", ex as (select qid, token, c, w from (select r.qid, t.token, count(*) c, count(*) * max(i.idf) w, row_number() over (partition by r.qid order by round(count(*) * max(i.idf), 9) desc, t.token) k from rk r join tf t on t.doc_id = r.doc_id join idf i on i.token = t.token left join qt q on q.qid = r.qid and q.token = t.token where r.rank <= 10 and i.idf >= 3 and q.token is null group by 1, 2 having count(*) >= 2) x where k <= 40) select qid, token, cast(c as bigint) c, round(w, 9) w from ex",
    "r34_rarest_pool": BASE + "select qid, token, df, upto from (select q.qid, q.token, i.df, cast(sum(i.df) over (partition by q.qid order by i.df, q.token rows between unbounded preceding and current row) as bigint) upto, row_number() over (partition by q.qid order by i.df, q.token) k from qt q join idf i on i.token = q.token) x where upto <= 200 or k = 1",
    "r42_multi_hop": BASE + ", hop as (select qid, token from (select r.qid, t.token, row_number() over (partition by r.qid order by i.df, t.token) k from rk r join tf t on t.doc_id = r.doc_id join idf i on i.token = t.token left join qt q on q.qid = r.qid and q.token = t.token where r.rank <= 3 and i.df between 2 and 50 and q.token is null) x where k = 1) select h.qid, h.token, t.doc_id from hop h join tf t on t.token = h.token left join (select qid, doc_id from rk where rank <= 3) s on s.qid = h.qid and s.doc_id = t.doc_id where s.qid is null",
    "r44_completeness_audit": "select distinct token, doc_id from (select doc_id, lower(text) low, {explode:regexp_extract_all(lower(text), '([a-z0-9]+)', 1)} token from {documents}) x where not contains(low, token)",
    "r6_sharded_topk": BASE + ", own as (select qid, doc_id, score, row_number() over (partition by qid, doc_id % 4 order by round(score, 9) desc, doc_id) k from bm) select qid, doc_id, rank from (select qid, doc_id, cast(row_number() over (partition by qid order by round(score, 9) desc, doc_id) as bigint) rank from own where k <= 10) x where rank <= 10",
    "r7_removed_documents": BASE + "select token, cast(count(*) as bigint) df from tf t left join (select doc_id gone from {labels} where toxic = 1) g on g.gone = t.doc_id where g.gone is null group by 1",
    "j3_three_way_meet": BASE + ", r3 as (select qid, token from (select q.qid, q.token, row_number() over (partition by q.qid order by i.df, q.token) k from qt q join idf i on i.token = q.token) x where k <= 3) select r.qid, t.doc_id from r3 r join tf t on t.token = r.token group by 1, 2 having count(distinct t.token) = 3",
    "j10_pool_semi_join": BASE + "select b.qid, b.doc_id, round(b.score, 6) score from bm b where exists (select 1 from {labels} l where l.doc_id = b.doc_id and l.quality = 1) and b.m >= 8",
    "j17_substring_join": BASE + ", q as (select distinct token from qt where length(token) >= 4), v as (select token from df where length(token) >= 4), qs as (select distinct token, {explode:SUBS} part from q), vs as (select distinct token, {explode:SUBS} part from v) select qs.token q, v.token v from qs join v on v.token = qs.part where qs.token <> v.token union select q.token q, vs.token v from q join vs on vs.part = q.token where q.token <> vs.token",
    "e11_discrimination": BASE + ", r3 as (select qid, token, k from (select q.qid, q.token, row_number() over (partition by q.qid order by i.df, q.token) k from qt q join idf i on i.token = q.token) x where k <= 3), m as (select r.qid, t.doc_id, count(*) c, max(k) k from r3 r join tf t on t.token = r.token group by 1, 2) select n, cast(count(*) as bigint) docs, cast(count(rel.doc_id) as bigint) gold from m join {series:1,3} s(n) on m.c >= s.n left join rel on rel.qid = m.qid and rel.doc_id = m.doc_id group by n",
    "e13_overlap_histogram": BASE + "select b.m, cast(count(*) as bigint) n from rel join bm b on b.qid = rel.qid and b.doc_id = rel.doc_id group by 1",
    "e7_pair_quality": BASE + ", found as (select qid, doc_id from rk where rank = 1) select cast(count(*) as bigint) pairs, cast(count(f.doc_id) as bigint) found, cast(count(r.doc_id) as bigint) relevant, cast(sum(case when f.doc_id is not null and r.doc_id is not null then 1 else 0 end) as bigint) hits from found f full outer join rel r on r.qid = f.qid and r.doc_id = f.doc_id",
    "fu4_rare_crossover": BASE + "select qid, doc_id, round(score + 0.5 * s * pow(m, 1.5), 6) score from rk where rank <= 20",
    "fu9_coordination": BASE + "select qid, doc_id, round(score + (m - 1) * s + (m - 1) * (m - 2) / 2 * s, 6) score from rk where rank <= 20",
    "fu5_diversity": BASE + "select r.qid, r.doc_id, round(r.score * pow(u.d, 0.25), 6) score from rk r join (select doc_id, count(*) / sum(tf) d from tf group by 1) u on u.doc_id = r.doc_id where r.rank <= 20",
    "fu7_confidence_gate": BASE + "select r.qid, round(r.score / q.most, 9) confidence, case when r.score / q.most < 0.3 then 1 else 0 end rerank from rk r join (select q.qid, sum(i.idf) most from qt q join idf i on i.token = q.token group by 1) q on q.qid = r.qid where r.rank = 1",
    "fu16_pool_union": BASE + "select qid, doc_id from rk where rank <= 10 union select qid, doc_id from (select qid, doc_id, row_number() over (partition by qid order by m desc, doc_id) k from bm) x where k <= 10",
    "k4_gold_rank": BASE + "select rel.qid, min(r.rank) best from rel left join rk r on r.qid = rel.qid and r.doc_id = rel.doc_id group by 1",
    "ag16_relevance_bridges": BASE + ", pr as (select q.qid, q.token qt, t.token dt from rel join qt q on q.qid = rel.qid join tf t on t.doc_id = rel.doc_id), c as (select p.qt, p.dt, count(distinct p.qid) c from pr p group by 1, 2), n as (select token, count(distinct qid) n from qt where qid in (select qid from rel) group by 1) select qt, dt, round(w, 9) w from (select c.qt, c.dt, c.c * 1.0 / n.n * i.idf w, row_number() over (partition by c.qt order by round(c.c * 1.0 / n.n * i.idf, 9) desc, c.dt) k from c join n on n.token = c.qt join idf i on i.token = c.dt join idf j on j.token = c.qt where c.c >= 2 and c.qt <> c.dt and i.idf >= 2 and j.idf >= 2) x where k <= 12",
    "ag31_stored_composites": BASE + ", t8 as (select doc_id, token, w from (select t.doc_id, t.token, t.tf * i.idf w, row_number() over (partition by t.doc_id order by round(t.tf * i.idf, 9) desc, t.token) k from tf t join idf i on i.token = t.token where i.df >= 2) x where k <= 8) select doc_id, a, b from (select x.doc_id, x.token a, y.token b, row_number() over (partition by x.doc_id order by round(least(x.w, y.w), 9) desc, x.token, y.token) k from t8 x join t8 y on x.doc_id = y.doc_id and x.token < y.token) z where k <= 12",
    # documents of 0.8 or more of their words in common. Equal word sets are one class: its smallest id stands for it and
    # is paired with the others at 1. Classes meet by the n - ceil(0.8 n) + 1 rarest of their n words, which loses no pair.
    "r43_shared_rare_jaccard": BASE
    + ", sets as (select doc_id, {setkey:token} mark, cast(count(*) as bigint) n from tf group by 1), rep as (select mark, min(doc_id) doc_id, min(n) n from sets group by 1), rt as (select t.doc_id, t.token, r.n from tf t join rep r on r.doc_id = t.doc_id), rdf as (select token, count(*) df from rt group by 1)"
    + ", px as (select doc_id, token, n from (select rt.doc_id, rt.token, rt.n, row_number() over (partition by rt.doc_id order by d.df, rt.token) k from rt join rdf d on d.token = rt.token) x where k <= n - floor((4 * n + 4) / 5) + 1)"
    + ", cand as (select distinct x.doc_id a, y.doc_id b, x.n an, y.n bn from px x join px y on x.token = y.token and x.doc_id < y.doc_id and 5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n)"
    + ", sh as (select c.a, c.b, c.an, c.bn, count(*) k from cand c join rt x on x.doc_id = c.a join rt y on y.doc_id = c.b and y.token = x.token group by 1, 2, 3, 4)"
    + " select a, b, round(k * 1.0 / (an + bn - k), 9) jaccard from sh where 5 * k >= 4 * (an + bn - k) union all select r.doc_id a, s.doc_id b, 1.0 jaccard from sets s join rep r on r.mark = s.mark where r.doc_id < s.doc_id",
    # words and co-occurrence
    "tx1_content_words": "select doc_id, pos, token from {words:documents,doc_id,text} w",
    "tx3_head_weights": "with w as {words:documents,doc_id,text} select doc_id, token, round(sum(case when pos < 14 then 1.6 else 1.0 end), 6) tf from w group by 1, 2",
    "tx2_prefix_view": "with w as {words:documents,doc_id,text} select doc_id, left(token, 4) token, round(count(*) * 0.2, 6) tf from w where length(token) >= 4 group by 1, 2",
    "tx2_trigram_view": "with w as {words:benchmark,item_id,text}, g as (select item_id, {explode:{grams}} token from w) select item_id, token, round(count(*) * 0.3, 6) tf from g group by 1, 2".replace("{explode:{grams}}", "GRAMS"),
    "tx10_fixed_chunks": "with w as (select distinct token from {words:benchmark,item_id,text} x), c as (select token, CHUNKS part from w) select part, cast(count(*) as bigint) n from c group by 1",
    "tx16_bigram_stream": "with t as {tok:documents,doc_id,text}, b as (select token a, lead(token) over (partition by doc_id order by pos) b from t) select a, b, cast(count(*) as bigint) n from b where b is not null group by 1, 2 having count(*) >= 3",
    "tx17_window_pairs": "with t as {tok:documents,doc_id,text}, n as (select doc_id, token a, " + ", ".join(f"lead(token, {k}) over (partition by doc_id order by pos) l{k}" for k in range(1, 8)) + " from t), p as (select a, case k.i " + " ".join(f"when {k} then l{k}" for k in range(1, 8)) + " end b from n cross join {series:1,7} k) select least(a, b) a, greatest(a, b) b, cast(count(*) as bigint) n from p where b is not null and a <> b group by 1, 2",
    "ag6_cooccurrence": CONTENT + "select a, b, c from pairs where c >= 4",
    "ag10_pmi_graph": CONTENT
    + ", r80 as (select doc_id, token from (select doc_id, token, row_number() over (partition by doc_id order by df, token) k from top) x where k <= 80), p80 as (select a.token a, b.token b, cast(count(*) as bigint) c from r80 a join r80 b on a.doc_id = b.doc_id and a.token < b.token group by 1, 2 having count(*) >= 4), e as (select p.a, p.b, p.c, ln((nd.n * p.c + 1.0) / (x.df * y.df + 1.0)) pmi from p80 p join df x on x.token = p.a join df y on y.token = p.b cross join nd), both_ways as (select a, b, c, pmi from e where pmi >= 3 union all select b, a, c, pmi from e where pmi >= 3) select a, b, c, round(pmi, 9) pmi from (select a, b, c, pmi, row_number() over (partition by a order by round(pmi, 9) desc, b) k from both_ways) z where k <= 10",
    "ag8_ppmi": CONTENT + "select p.a, p.b, round(greatest(0.0, log2(p.c * 1.0 * nw.n / (x.df * y.df))), 9) ppmi from pairs p join wf x on x.token = p.a join wf y on y.token = p.b cross join nw where p.c >= 3",
    "ag13_z_cohesion": CONTENT + "select p.a, p.b, round((p.c - x.df * y.df * 1.0 / nw.n) / sqrt(x.df * 1.0 * y.df / nw.n), 9) z from pairs p join wf x on x.token = p.a join wf y on y.token = p.b cross join nw where p.c >= 3",
    "ag21_neighbour_cosine": CONTENT
    + ", h as (select token from rare where idf >= 3.5), hp as (select p.a, p.b, p.c from pairs p join h x on x.token = p.a join h y on y.token = p.b where p.c >= 3), e as (select a, b, c from hp union all select b, a, c from hp), nm as (select a, sqrt(sum(c * c)) n from e group by 1) select x.a, y.a b, round(sum(x.c * y.c) / (max(p.n) * max(q.n)), 9) cosine from e x join e y on x.b = y.b and x.a < y.a join nm p on p.a = x.a join nm q on q.a = y.a group by 1, 2 having count(*) >= 3",
    "ag26_heavy_anchors": CONTENT
    + ", ra as (select ww.doc_id, ww.win, ww.token from ww join df on df.token = ww.token cross join nd where df.df <= greatest(10, 0.02 * nd.n)) select a, b, c, round(1.0 / c, 9) discrimination from (select x.token a, y.token b, count(distinct x.doc_id) c from ra x join ra y on x.doc_id = y.doc_id and x.win = y.win and x.token < y.token group by 1, 2) z where c between 2 and 10",
    "ag29_triples": CONTENT
    + ", t3 as (select doc_id, token from (select doc_id, token, row_number() over (partition by doc_id order by df desc, token) k from top where df between 3 and 40) x where k <= 6) select a.token a, b.token b, c.token c, cast(count(*) as bigint) n from t3 a join t3 b on a.doc_id = b.doc_id and a.token < b.token join t3 c on c.doc_id = a.doc_id and b.token < c.token group by 1, 2, 3 having count(*) >= 3",
    "ag33_bigram_perplexity": "with t as {tok:documents,doc_id,text}, u as (select token, count(*) c from t group by 1), n as (select sum(c) n, count(*) v from u), p as (select token a, lead(token) over (partition by doc_id order by pos) b from t), g as (select a, b, count(*) c from p where b is not null group by 1, 2) select round(exp(-sum(g.c * ln(0.7 * g.c / x.c + 0.3 * (y.c + 1.0) / (n.n + n.v))) / sum(g.c)), 6) perplexity from g join u x on x.token = g.a join u y on y.token = g.b cross join n",
    "ag35_counting_classifier": "with t as {tok:documents,doc_id,text}, l as (select doc_id, lang from {documents}), c as (select lang, token, count(*) c from t join l on l.doc_id = t.doc_id where t.doc_id % 2 = 0 group by 1, 2), n as (select lang, sum(c) n from c group by 1), v as (select count(distinct token) v from c), q as (select doc_id, token, count(*) k from t where doc_id % 2 = 1 group by 1, 2), s as (select q.doc_id, n.lang, sum(q.k * ln((coalesce(c.c, 0) + 1.0) / (n.n + v.v))) s from q cross join n cross join v left join c on c.lang = n.lang and c.token = q.token group by 1, 2) select doc_id, lang from (select doc_id, lang, row_number() over (partition by doc_id order by round(s, 6) desc, lang) k from s) x where k = 1",
    "r19_discriminative_labels": "with t as (select distinct doc_id, token from {words:documents,doc_id,text} w), l as (select doc_id, source from {documents}), n as (select source, count(*) n from l group by 1), f as (select l.source, t.token, count(*) * 1.0 / max(n.n) share from t join l on l.doc_id = t.doc_id join n on n.source = l.source group by 1, 2), o as (select x.source, x.token, max(x.share) f, max(g.share) other from f x left join f g on g.token = x.token and g.source <> x.source where x.share > 0.005 group by 1, 2) select source, token, round(f - coalesce(other, 0), 9) lift from (select *, row_number() over (partition by source order by round(f - coalesce(other, 0), 9) desc, token) k from o where f - coalesce(other, 0) > 0.002) x where k <= 36",
    "g6_chamber_vocabulary": "with t as (select distinct doc_id, token from {words:documents,doc_id,text} w), l as (select doc_id, source c from {documents}), nc as (select c, count(*) n from l group by 1), nn as (select count(*) n from l), df as (select token, count(*) df from t group by 1), x as (select l.c, t.token, count(*) k from t join l on l.doc_id = t.doc_id group by 1, 2) select c, token, round(w, 9) w from (select x.c, x.token, ln((x.k * 1.0 / nc.n) / (df.df * 1.0 / nn.n)) w, row_number() over (partition by x.c order by round(ln((x.k * 1.0 / nc.n) / (df.df * 1.0 / nn.n)), 9) desc, x.token) r from x join nc on nc.c = x.c join df on df.token = x.token cross join nn where df.df >= 3 and nc.n >= 5) y where w >= 0.5 and r <= 400",
    "d5_most_common": "with t as {tok:documents,doc_id,text} select lang, token, n from (select d.lang, t.token, cast(count(*) as bigint) n, row_number() over (partition by d.lang order by count(*) desc, t.token) k from t join {documents} d on d.doc_id = t.doc_id group by 1, 2) x where k <= 10",
    # sensor series: users are units, events their snapshots
    "w1_features": SENSOR + "select unit, round(sqrt(avg(v * v)), 9) rms, round(max(abs(v)) / sqrt(avg(v * v)), 9) crest from s group by 1",
    "w1_kurtosis": SENSOR + ", m as (select unit, avg(v) mean, stddev_pop(v) sd from s group by 1) select s.unit, round(avg(pow(s.v - m.mean, 4)) / pow(max(m.sd), 4), 6) kurtosis from s join m on m.unit = s.unit where m.sd > 0 group by 1",
    "w2_moving_average": SENSOR + ", n as (select unit, max(i) n from s group by 1), p as (select s.unit, s.i, s.v from s union all select s.unit, s.i - k.i, s.v from s cross join {series:1,2} k where s.i = 1 union all select s.unit, s.i + k.i, s.v from s join n on n.unit = s.unit and n.n = s.i cross join {series:1,2} k), a as (select unit, i, avg(v) over (partition by unit order by i rows between 2 preceding and 2 following) a from p) select a.unit, a.i, round(a.a, 6) a from a join n on n.unit = a.unit where a.i between 1 and n.n",
    "w3_baseline_z": SENSOR + ", b as (select unit, avg(v) m, stddev_pop(v) + 1e-9 sd from s where i <= 10 group by 1 having count(*) = 10) select s.unit, s.i, round((s.v - b.m) / b.sd, 6) z from s join b on b.unit = s.unit",
    "w5_sustained_crossing": SENSOR + ", t as (select unit, avg(v) m from s group by 1), f as (select s.unit, s.i, case when s.v > t.m then 1 else 0 end hit from s join t on t.unit = s.unit), g as (select unit, i, hit, sum(hit) over (partition by unit order by i rows between current row and 4 following) h from f) select unit, min(i) first_at from g where hit = 1 and h >= 3 group by 1",
    "w8_corroboration": SENSOR + ", z as (select unit, i, case when v > avg(v) over (partition by unit) then 1 else 0 end a, case when v > lag(v) over (partition by unit order by i) then 1 else 0 end b, case when v > avg(v) over (partition by unit order by i rows between 4 preceding and current row) then 1 else 0 end c from s) select unit, cast(sum(case when a + b + c >= 2 then 1 else 0 end) as bigint) agreed, cast(sum(case when a + b + c = 1 then 1 else 0 end) as bigint) lone from z group by 1",
    "w9_longest_run": SENSOR + ", f as (select unit, i, v > avg(v) over (partition by unit) hit from s), r as (select unit, i, i - row_number() over (partition by unit order by i) g from f where hit), q as (select unit, g, cast(count(*) as bigint) n, min(i) first_at from r group by 1, 2) select unit, n longest, first_at from (select *, row_number() over (partition by unit order by n desc, first_at) k from q) x where k = 1",
    "w10_peer_excess": SENSOR + ", p as (select unit, i, v, (sum(v) over (partition by i) - v) / nullif(count(*) over (partition by i) - 1, 0) peers from s) select unit, i, round(v - peers, 9) excess from p where peers is not null",
    "w12_running_peak": SENSOR + "select unit, i, round(max(v) over (partition by unit order by i rows between unbounded preceding and current row), 9) peak from s",
    "w13_interpolation": SENSOR + "select unit, i, round((v + lead(v) over (partition by unit order by i)) / 2, 9) mid from s",
    "w15_dft_bin": SENSOR + ", n as (select unit, count(*) n from s group by 1) select s.unit, k.i k, round(sqrt(pow(sum(s.v * cos(2 * pi() * k.i * (s.i - 1) / n.n)), 2) + pow(sum(s.v * sin(2 * pi() * k.i * (s.i - 1) / n.n)), 2)), 4) size from s join n on n.unit = s.unit cross join {series:1,3} k group by 1, 2",
    "w18_surprise": "with e as (select user_id unit, event_type t, row_number() over (partition by user_id order by ts, event_id) i from {events}), p as (select unit, i, t, lag(t) over (partition by unit order by i) b from e), c as (select unit, i, t, b, count(*) over (partition by b, t order by unit, i rows between unbounded preceding and current row) - 1 pair, count(*) over (partition by b order by unit, i rows between unbounded preceding and current row) - 1 base from p where b is not null) select unit, i, round(-log2((pair + 1.0) / (base + 8.0)), 9) bits from c",
    "w7_peak_deviation": SENSOR + ", z as (select unit, i, v - avg(v) over (partition by unit) d, max(i) over (partition by unit) n from s) select unit, round(max(abs(d)), 6) peak from z where i > n - 10 group by 1",
    "d2_elapsed_hours": "with e as (select user_id unit, event_id, {micros:ts} us, row_number() over (partition by user_id order by ts, event_id) i from {events}) select unit, event_id, round((us - lag(us) over (partition by unit order by i)) / 3.6e9, 6) as elapsed_hours from e",
    "ag39_specificity": SENSOR + ", t as (select i, max(v) mx, avg(v) av from s group by 1 having max(v) > 0) select round(avg((mx - av) / mx), 9) specificity from t",
    "ag41_rollup": SENSOR + "select floor(i / 8) epoch, floor(i / 64) era, cast(count(*) as bigint) n, round(avg(v), 6) level from s group by 1, 2",
    # integer geometry
    "m1_odd_primes": "with n as (select i from {series:3,2000} s where i % 2 = 1) select n.i p, cast(row_number() over (order by n.i) as bigint) k from n left join (select distinct a.i * b.i c from (select i from n where i < 45) a join n b on b.i >= a.i and a.i * b.i <= 2000) c on c.c = n.i where c.c is null",
    "m2_number_chains": "select cast(i as bigint) k, cast(2 * i as bigint) even, cast(pow(2, i) as bigint) power, cast(i * i as bigint) square from {series:1,30} s",
    "m9_single_anchor": "select p.i p, n.i n, p.i + n.i x1, p.i y1, -p.i y2, n.i x3, 2 * p.i + n.i x4, p.i + n.i z from {series:3,25} p cross join {series:1,25} n where p.i % 2 = 1",
    "m12_wings": "select p.i p, n.i n, w.i wing, case when w.i % 2 = 0 then p.i + n.i else p.i end * case when w.i in (2, 3, 6, 7) then -1 else 1 end x, case when w.i % 2 = 0 then p.i else p.i + n.i end * case when w.i in (1, 3, 5, 7) then -1 else 1 end y, case when w.i >= 4 then -1 else 1 end * (p.i + n.i) z from {series:3,15} p cross join {series:1,9} n cross join {series:0,7} w",
    "m15_meet_codec": "select a.i a, b.i b, a.i + b.i x, least(a.i, b.i) y, least(a.i, b.i) lo, a.i + b.i - least(a.i, b.i) hi from {series:1,60} a cross join {series:1,60} b where a.i < b.i",
    "m18_quantised_cells": "select vec_id, cast(floor(embedding[C0] * 4 + 0.5) as bigint) x, cast(floor(embedding[C1] * 4 + 0.5) as bigint) y, cast(floor(embedding[C2] * 4 + 0.5) as bigint) z from {embeddings}",
    "j11_cell_neighbours": "with c as (select vec_id, cast(floor(embedding[C0] * 4 + 0.5) as bigint) x, cast(floor(embedding[C1] * 4 + 0.5) as bigint) y, cast(floor(embedding[C2] * 4 + 0.5) as bigint) z from {embeddings}), q as (select vec_id q, x + a.i x, y + b.i y, z + d.i z from c cross join {series:-1,1} a cross join {series:-1,1} b cross join {series:-1,1} d) select q.q, cast(count(*) as bigint) n from q join c on c.x = q.x and c.y = q.y and c.z = q.z group by 1",
    "m22_pi_recurrence": "{recursive} r(k, n, side) as (select 0, 6.0e0, 1.0e0 union all select k + 1, n * 2, sqrt(2 - sqrt(4 - side * side)) from r where k < 10) select k, round(n * side / 2, 9) pi from r",
    "m23_cone_volume": "select round(sum(pi() * pow(i / 1000.0, 2) / 1000.0), 9) volume from {series:1,1000} s",
    "m25_mixed_radix": "select i n, i % 2 d2, floor(i / 2) % 3 d3, floor(i / 6) % 5 d5, floor(i / 30) % 7 d7 from {series:0,209} s",
    "m30_soft_minimum": "select user_id, round(-ln(sum(exp(-0.01 * value))) / 0.01, 6) soft from {events} where value is not null group by 1",
    "tx13_letter_sums": "with w as (select distinct token from {words:benchmark,item_id,text} x), l as (select token, {explode:GRAM1} c from w) select token, cast(sum(ascii(c) - 96) as bigint) letter_sum, cast(count(*) as bigint) letters from l where c between 'a' and 'z' group by 1",
    # vectors, sets, tables
    "j18_symmetric_difference": "select coalesce(a.doc_id, b.doc_id) doc_id, case when a.doc_id is null then 'right' else 'left' end side from (select doc_id from {documents} where doc_id % 3 <> 0) a full outer join (select doc_id from {labels}) b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null",
    "u3_difference": "select doc_id from {documents} except select doc_id from {labels}",
    "u2_intersection": "select doc_id from {documents} where lang = 'en' intersect select doc_id from {labels} where quality = 1",
    "u1_union": "select doc_id from {documents} where lang = 'fr' union select doc_id from {labels} where toxic = 1",
    "g9_hierarchy_closure": "{recursive} h(k, anc, depth) as (select i, i, 0 from {series:1,200} s union all select k, cast(floor(anc / 3) as int), depth + 1 from h where anc >= 3 and depth < 8) select cast(anc as bigint) anc, cast(count(*) as bigint) below, cast(max(depth) as bigint) depth from h where anc > 0 group by 1",
    "r18_branch_statistics": "with t as (select d.source, d.doc_id, count(*) dl from {tok:documents,doc_id,text} x join {documents} d on d.doc_id = x.doc_id group by 1, 2) select source, cast(count(*) as bigint) n, round(avg(dl), 6) avgdl, cast(max(dl) as bigint) longest from t group by 1",
    "f4_tombstones": "select d.doc_id, d.lang from {documents} d left join (select doc_id gone from {labels} where quality = 0) g on g.gone = d.doc_id where g.gone is null",
    "ag36_adjusted_effect": "with x as (select d.source s, d.lang = 'en' t, l.quality y from {documents} d join {labels} l on l.doc_id = d.doc_id), p as (select s, count(*) * 1.0 / (select count(*) from x) w from x group by 1), e as (select s, t, avg(y) y from x group by 1, 2) select e.t, round(sum(e.y * p.w) / sum(p.w), 9) adjusted from e join p on p.s = e.s group by 1",
    "tx24_role_turns": "select role, cast(count(*) as bigint) n, round(avg(length(text)), 6) len from {conversations} group by 1",
}


def sql_of(text: str, dialect: str, sf_dir: str = "") -> str:
    from .dialect import render

    duck = dialect == "duckdb"
    for k in range(3):
        text = text.replace(f"[C{k}]", f"[{k + duck}]")
    marked = "concat(concat('^', token), '$')"
    text = text.replace("GRAMS", "unnest(list_transform(generate_series(1, length(token)), lambda i: substring(concat('^', token, '$'), i, 3)))" if duck else f"explode(transform(sequence(1, length(token)), i -> substring({marked}, i, 3)))")
    text = text.replace("SUBS", "list_distinct(flatten(list_transform(generate_series(4, length(token)), lambda n: list_transform(generate_series(1, length(token) - n + 1), lambda i: substring(token, i, n)))))" if duck else "array_distinct(flatten(transform(sequence(4, length(token)), n -> transform(sequence(1, length(token) - n + 1), i -> substring(token, i, n)))))")
    text = text.replace("CHUNKS", "unnest(regexp_extract_all(token, '(..?.?.?)', 1))" if duck else "explode(regexp_extract_all(token, '(..?.?.?)', 1))")
    text = text.replace("{explode:GRAM1}", "unnest(string_split(token, ''))" if duck else "explode(split(token, ''))")
    return render(text, dialect, sf_dir)
