"""Further plans: candidate routing, hub signatures, learned weights, chambers, addresses, codecs and audits."""

from __future__ import annotations

from .catalog import BASE, CONTENT, SENSOR
from .extra import BIGRAMS, BRIDGES, POOL, RARE3, TOP10

#: Pieces of two to four signs with the words and documents they occur in.
PIECES = """
with dw as (select distinct doc_id, token from {words:documents,doc_id,text} w),
pc as (select distinct doc_id, token, g from (select doc_id, token, {explode:{grams:token,2}} g from dw union all select doc_id, token, {explode:{grams:token,3}} from dw union all select doc_id, token, {explode:{grams:token,4}} from dw) x),
ps as (select g, cast(count(distinct token) as bigint) words, cast(count(distinct doc_id) as bigint) docs, cast(count(*) as bigint) n from pc group by 1)
"""

#: Neighbours of a word on its right in each language, and how alike they are in two languages.
CONTEXTS = """
with t as {words:documents,doc_id,text}, b as (select doc_id, token, lead(token) over (partition by doc_id order by pos) o from t),
c as (select distinct d.lang, b.token, b.o from b join {documents} d on d.doc_id = b.doc_id where b.o is not null and d.lang is not null),
n as (select lang, token, count(*) n from c group by 1, 2),
sh as (select x.token, x.lang a, y.lang b, count(*) k from c x join c y on y.token = x.token and y.o = x.o and x.lang < y.lang group by 1, 2, 3),
jac as (select x.token, coalesce(sh.k, 0) * 1.0 / (x.n + y.n - coalesce(sh.k, 0)) jaccard from n x join n y on y.token = x.token and x.lang < y.lang left join sh on sh.token = x.token and sh.a = x.lang and sh.b = y.lang)
"""

#: The words that mark each source most, as votes for it.
CHAMBERS = """
with t as (select distinct doc_id, token from {words:documents,doc_id,text} w), l as (select doc_id, source c from {documents} where source is not null),
df as (select token, count(*) df from t group by 1), x as (select l.c, t.token, count(*) k from t join l on l.doc_id = t.doc_id group by 1, 2),
kw as (select c, token, w from (select x.c, x.token, x.k * 1.0 / df.df w, row_number() over (partition by x.c order by round(x.k * 1.0 / df.df, 9) desc, x.k desc, x.token) r from x join df on df.token = x.token where x.k >= 3) y where r <= 20)
"""

#: Canon addresses of chains of three anchors p1 < p2 < p3: segment s, then depth z.
CHAIN3 = """
with c as (select p1, p2, p3, n, case when n < p1 then 0 when n < p2 then 1 when n < p3 then 2 else 3 end s from
  (select cast(a.i as bigint) p1, cast(b.i as bigint) p2, cast(d.i as bigint) p3, cast(e.i as bigint) n from {series:2,11} a cross join {series:3,13} b cross join {series:5,17} d cross join {series:1,20} e where a.i < b.i and b.i < d.i and a.i in (3, 5, 7, 11) and b.i in (5, 7, 11, 13) and d.i in (7, 11, 13, 17)) x)
"""

#: Gaps between the pair of tokens next to each other in a query and in a document.
PHRASES = BASE + """
, qb as (select distinct qid, a, b from (select item_id qid, token a, lead(token) over (partition by item_id order by pos) b from {tok:benchmark,item_id,text} t) x where b is not null),
tb as (select doc_id, token a, lead(token) over (partition by doc_id order by pos) b from tok),
ph as (select qb.qid, tb.doc_id, count(*) c from qb join tb on tb.a = qb.a and tb.b = qb.b group by 1, 2)
"""

PLANS: dict[str, str] = {
    # sources and tokens
    "s9_pool_sample": BASE + "select doc_id from rel union (select doc_id from {documents} order by (doc_id * 2654435761) % 4294967296, doc_id limit 100)",
    "s11_key_lookup": "select l.doc_id, d.source, cast(length(d.text) as bigint) chars from {labels} l join {documents} d on d.doc_id = l.doc_id",
    "s12_nested_sentences": "select doc_id, cast(count(*) as bigint) sentences, cast(max(length(s)) as bigint) longest from (select doc_id, {explode:regexp_extract_all(text, '([^.]+)', 1)} s from {documents}) x group by 1",
    "tx5_token_species": "with t as (select doc_id, {explode:regexp_extract_all(text, '([A-Za-z0-9]+)', 1)} raw from {documents}) select doc_id, case when translate(raw, '0123456789', '') = '' then 'number' when length(translate(raw, '0123456789', '')) < length(raw) then 'mixed' else 'word' end species, cast(count(*) as bigint) n, cast(sum(length(raw)) as bigint) chars from t group by 1, 2",
    "tx8_ordered_subwords": "with t as (select token, count(*) c from {tok:documents,doc_id,text} x group by 1), g as (select c, {explode:{grams:token,1}} g from t union all select c, {explode:{grams:token,2}} from t union all select c, {explode:{grams:token,3}} from t) select g, cast(sum(c) as bigint) n from g group by 1",
    "tx15_symbol_bands": "with t as (select token, count(*) c from {tok:documents,doc_id,text} x group by 1), s as (select c, {explode:{grams:token,1}} g from t) select g, case when g between 'a' and 'z' then 1 else 2 end band, case when g between 'a' and 'z' then ascii(g) - 97 else ascii(g) - 48 end place, cast(sum(c) as bigint) n from s group by 1, 2, 3",
    "tx18_embedded_words": "with v as (select distinct token from {words:documents,doc_id,text} x), g as (select token, {explode:{grams:token,3}} g from v union all select token, {explode:{grams:token,4}} from v union all select token, {explode:{grams:token,5}} from v union all select token, {explode:{grams:token,6}} from v), m as (select g.token, g.g root, row_number() over (partition by g.token order by length(g.g) desc, g.g) k from (select distinct token, g from g) g join v on v.token = g.g where g.g <> g.token) select token, root, case when left(token, length(root)) = root then substring(token, length(root) + 1) end suffix from m where k = 1",
    "tx19_word_records": BASE + "select t.token, cast(length(t.token) as bigint) chars, cast(ascii(t.token) as bigint) head, cast(ascii(right(t.token, 1)) as bigint) tail, i.df, cast(sum(t.tf) as bigint) n from tf t join idf i on i.token = t.token group by t.token, i.df",
    "tx20_token_states": BASE + "select token, case when df * 2 > n then 0 when df >= 3 then 3 when df = 2 then 2 else 1 end state from df cross join st",
    "tp18_bit_pairs": BASE + "select b.i place, cast(floor(t.tf / power(4, b.i)) as bigint) % 4 state, cast(count(*) as bigint) n from tf t cross join {series:0,3} b group by 1, 2",
    "d3_json_records": BASE + "select token, {json:token,df} record from df",
    # statistics
    # words cut from left to right, at each place the longest of the 800 best pieces of three or four signs, else one letter;
    # good pieces are in many words and few documents, in five words at least and half of the documents at most
    "tx12_greedy_chunks": "with d as (select distinct doc_id, token from {words:documents,doc_id,text} x), v as (select distinct token from d), nd as (select count(distinct doc_id) n from d)"
    + ", gt as (select token, {explode:{grams:token,4}} g from v union select token, {explode:{grams:token,3}} g from v), gw as (select g, count(*) words from gt where g >= 'a' group by 1 having count(*) >= 5)"
    + ", gd as (select g, count(*) docs from (select distinct d.doc_id, t.g from d join gt t on t.token = d.token join gw on gw.g = t.g) x group by 1)"
    + ", best as (select g from (select gw.g, row_number() over (order by round(ln(1.0 + gw.words) * ln((nd.n + 1.0) / (gd.docs + 1.0)), 9) desc, gw.g) k from gw join gd on gd.g = gw.g cross join nd where gd.docs <= 0.5 * nd.n) y where k <= 800)"
    + ", pat as (select concat('(', coalesce(concat({longest:g}, '|'), ''), '[a-z])') p from best) select token, {matches:token,p} chunks from v cross join pat",
    "ag14_promoted_pieces": PIECES + "select g, words, docs, cast(row_number() over (partition by length(g) order by words desc, docs desc, g) as bigint) rank from ps where words >= 3 and docs >= 2 and n >= 5",
    "ag15_context_divergence": CONTEXTS + "select token, round(min(jaccard), 9) least, case when min(jaccard) < 0.2 then 1 else 0 end differ from jac group by 1",
    "g2_bridge_words": CONTEXTS + "select token, cast(count(*) as bigint) pairs from jac where jaccard < 0.2 group by 1 having count(*) >= 2",
    "ag24_bloom_filter": "with k as (select i from {series:1,3} s), bits as (select distinct k.i, (l.doc_id * 2654435761 + k.i * 40503) % 4294967296 % 65536 bit from {labels} l cross join k), p as (select d.doc_id, count(b.bit) found from {documents} d cross join k left join bits b on b.i = k.i and b.bit = (d.doc_id * 2654435761 + k.i * 40503) % 4294967296 % 65536 group by 1) select p.doc_id, case when p.found = 3 then 1 else 0 end maybe, case when l.doc_id is null then 0 else 1 end member from p left join (select distinct doc_id from {labels}) l on l.doc_id = p.doc_id",
    "ag37_factor_union": BASE + ", u as (select a.qid, a.token from qt a union select b.qid - 1, b.token from qt b), n as (select qid, count(*) n from qt group by 1) select u.qid, cast(count(*) as bigint) merged, cast(max(x.n) as bigint) mine, cast(max(y.n) as bigint) theirs from u join n x on x.qid = u.qid join n y on y.qid = u.qid + 1 group by 1",
    # engines
    "r10_routed_bm25": BASE + ", px as (select q.qid, t.doc_id, count(distinct t.token) c from (select distinct qid, token from qt where length(token) > 5) q join tf t on left(t.token, 5) = left(q.token, 5) and t.token <> q.token group by 1, 2), k as (select qid, count(*) k from qt group by 1), f as (select b.qid, b.doc_id, (b.score + 0.6 * coalesce(px.c, 0)) * (1 + 0.15 * b.m / k.k) score from bm b join k on k.qid = b.qid left join px on px.qid = b.qid and px.doc_id = b.doc_id) " + TOP10,
    "r14_gold_document_search": BASE + ", g as (select count(distinct doc_id) n from rel), gt as (select t.token, count(distinct t.doc_id) gd from tf t join (select distinct doc_id from rel) r on r.doc_id = t.doc_id group by 1), a as (select gt.token, i.idf from gt join idf i on i.token = gt.token cross join g where gt.gd <= greatest(0.15 * g.n, 3.0)), f as (select q.qid, t.doc_id, sum(a.idf * t.tf / (t.tf + 1.0)) score from qt q join a on a.token = q.token join tf t on t.token = q.token group by 1, 2) " + TOP10,
    "r20_glass_box_fusion": BRIDGES + ", lx as (select qid, doc_id, score / max(score) over (partition by qid) s from rk where rank <= 100), bx as (select qid, doc_id, score / max(score) over (partition by qid) s from ex), f as (select coalesce(lx.qid, bx.qid) qid, coalesce(lx.doc_id, bx.doc_id) doc_id, coalesce(lx.s, 0.0) + 0.3 * coalesce(bx.s, 0.0) - case when lx.s is null then 0.1 else 0.0 end score from lx full join bx on lx.qid = bx.qid and lx.doc_id = bx.doc_id) " + TOP10,
    "r22_hub_signature_ranker": POOL + ", nb as (select l.qid, l.doc_id, count(*) c, sum(l.w * p.part) s, sum(l.w) w from link l join pool p on p.qid = l.qid and p.doc_id = l.other group by 1, 2), f as (select p.qid, p.doc_id, p.part + case when nb.c >= 2 then 0.2 * nb.s / nb.w else 0.0 end score from pool p left join nb on nb.qid = p.qid and nb.doc_id = p.doc_id) " + TOP10,
    "r23_candidate_tiers": RARE3 + ", c as (select r.qid, t.doc_id, case when r.k = 1 then 1 else 2 end tier from r3 r join tf t on t.token = r.token union all select qid, doc_id, 3 from bm) select qid, tier, cast(count(*) as bigint) docs from (select qid, doc_id, min(tier) tier from c group by 1, 2) x group by 1, 2",
    "r24_anchor_router": RARE3 + ", c as (select r.qid, t.doc_id, 2 hit from r3 r join tf t on t.token = r.token union all select qid, doc_id, 1 from rk where rank <= 20) select qid, doc_id, hits from (select qid, doc_id, cast(sum(hit) as bigint) hits, row_number() over (partition by qid order by sum(hit) desc, doc_id) k from c group by 1, 2) x where k <= 30",
    "r27_bucket_witnesses": BASE + ", q as (select distinct qid, left(token, 4) b from qt where length(token) >= 4), d as (select t.doc_id, left(t.token, 4) b, max(i.idf) w from tf t join idf i on i.token = t.token where length(t.token) >= 4 and i.idf >= 1 group by 1, 2), f as (select q.qid, d.doc_id, sum(d.w) score from q join d on d.b = q.b group by 1, 2) " + TOP10,
    "r29_rare_correlations": CONTENT + ", scarce as (select token from df cross join nd where df between 4 and greatest(10, 0.02 * n)), q as (select distinct w.item_id qid, w.token from {words:benchmark,item_id,text} w join scarce on scarce.token = w.token), e as (select a, b, c from pairs where c >= 4 union all select b, a, c from pairs where c >= 4), f as (select q.qid, t.doc_id, sum(ln(1.0 + e.c)) score from q join e on e.a = q.token join scarce s on s.token = e.b join dw t on t.token = e.b group by 1, 2) " + TOP10,
    "r41_corridor_provenance": BRIDGES + "select qid, doc_id, qt, dt, round(part, 6) part from (select q.qid, t.doc_id, b.qt, b.dt, b.w * t.tf / (t.tf + 1.0) part, row_number() over (partition by q.qid, t.doc_id order by round(b.w * t.tf / (t.tf + 1.0), 9) desc, b.qt, b.dt) k from qt q join br b on b.qt = q.token join tf t on t.token = b.dt) x where k = 1",
    "r48_hybrid_modes": BRIDGES + ", er as (select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id) rank from ex), u as (select qid, doc_id, rank lr, null er from rk where rank <= 100 union all select qid, doc_id, null, rank from er where rank <= 100), f as (select qid, doc_id, case when max(er) is null then 1.0 / (60 + max(lr)) when max(lr) is null then 0.5 / (60 + max(er)) else 1.0 / (60 + max(lr)) + 1.0 / (60 + max(er)) end score from u group by 1, 2) " + TOP10,
    "r49_wing_cages": RARE3 + ", c as (select r.qid, t.doc_id, count(*) c, sum(r.idf) w from r3 r join tf t on t.token = r.token group by 1, 2), f as (select b.qid, b.doc_id, b.score + case coalesce(c.c, 0) when 3 then c.w when 2 then 0.5 * c.w else 0.0 end score from bm b left join c on c.qid = b.qid and c.doc_id = b.doc_id) " + TOP10,
    "r51_linear_scorer": BASE + ", x as (select rk.score, rk.m, case when rel.qid is null then 0.0 else 1.0 end y from rk left join rel on rel.qid = rk.qid and rel.doc_id = rk.doc_id where rk.rank <= 50) select round(regr_slope(y, score), 6) slope, round(regr_intercept(y, score), 6) intercept, round(corr(y, score), 6) r, cast(count(*) as bigint) n from x",
    "fu10_missing_neighbours": POOL + ", q3 as (select q.qid, q.token, i.idf from qt q join idf i on i.token = q.token where i.idf >= 3), has as (select p.qid, p.doc_id, q.token, q.idf, case when t.token is null then 0 else 1 end h from pool p join q3 q on q.qid = p.qid left join tf t on t.doc_id = p.doc_id and t.token = q.token), f as (select p.qid, p.doc_id, p.part - 0.1 * coalesce(x.gone / x.total, 0.0) score from pool p left join (select qid, doc_id, sum(case when h = 0 then idf else 0.0 end) gone, sum(idf) total from has group by 1, 2) x on x.qid = p.qid and x.doc_id = p.doc_id) " + TOP10,
    "fu12_gravity_cascade": POOL + ", h1 as (select l.qid, l.doc_id, sum(l.w * p.part) s from link l join pool p on p.qid = l.qid and p.doc_id = l.other group by 1, 2), h2 as (select l.qid, l.doc_id, sum(l.w * h1.s) s from link l join h1 on h1.qid = l.qid and h1.doc_id = l.other group by 1, 2), n as (select qid, max(s) m from h1 group by 1), n2 as (select qid, max(s) m from h2 group by 1), f as (select p.qid, p.doc_id, p.part + 0.2 * coalesce(h1.s / n.m, 0.0) + 0.05 * coalesce(h2.s / n2.m, 0.0) score from pool p left join h1 on h1.qid = p.qid and h1.doc_id = p.doc_id left join n on n.qid = p.qid left join h2 on h2.qid = p.qid and h2.doc_id = p.doc_id left join n2 on n2.qid = p.qid) " + TOP10,
    "fu13_phrase_bonus": PHRASES + ", f as (select b.qid, b.doc_id, b.score + 0.5 * ln(1.0 + coalesce(ph.c, 0)) score from bm b left join ph on ph.qid = b.qid and ph.doc_id = b.doc_id) " + TOP10,
    "tp13_pair_routing": PHRASES + "select qid, doc_id, c from (select qid, doc_id, cast(c as bigint) c, row_number() over (partition by qid order by c desc, doc_id) k from ph) x where k <= 30",
    "fu14_anchor_accuracy": BASE + ", h as (select q.token, count(*) seen, sum(case when rel.qid is null then 0 else 1 end) good from rk join qt q on q.qid = rk.qid join tf t on t.doc_id = rk.doc_id and t.token = q.token left join rel on rel.qid = rk.qid and rel.doc_id = rk.doc_id where rk.rank <= 10 group by 1) select token, cast(seen as bigint) seen, cast(good as bigint) good, round((good + 1.0) / (seen + 2.0), 9) weight, case when seen >= 5 and good = 0 then 1 else 0 end negative from h",
    "tp21_tuned_engine": BASE + ", k as (select qid, count(*) k, avg(length(token)) wl from qt group by 1), u as (select doc_id, count(*) u from tf group by 1), f as (select b.qid, b.doc_id, b.score * power(dl.dl, case when k.k >= 12 then -0.05 when k.wl >= 6 then -0.1 else 0.0 end) * (1 + 0.5 * b.m / (k.k + u.u - b.m)) score from bm b join k on k.qid = b.qid join dl on dl.doc_id = b.doc_id join u on u.doc_id = b.doc_id) " + TOP10,
    "tp23_unsupervised_bridges": BIGRAMS + ", p as (select g.a, g.b, log2(g.c * 1.0 * n.n / (x.c * 1.0 * y.c)) pmi from g join u x on x.token = g.a join u y on y.token = g.b cross join n where g.c >= 5), q as (select distinct item_id qid, token from {tok:benchmark,item_id,text} z) select q.qid, p.b, cast(count(*) as bigint) links, round(max(p.pmi), 9) pmi from q join p on p.a = q.token left join q o on o.qid = q.qid and o.token = p.b where o.token is null and p.pmi >= 2 group by 1, 2",
    "tp7_rare_triples": BASE + ", g as (select rel.qid, rel.doc_id, q.token, row_number() over (partition by rel.qid, rel.doc_id order by i.df, q.token) k from rel join qt q on q.qid = rel.qid join tf t on t.doc_id = rel.doc_id and t.token = q.token join idf i on i.token = q.token) select a.qid, a.doc_id, a.token a, b.token b, c.token c from g a join g b on b.qid = a.qid and b.doc_id = a.doc_id and b.k = 2 join g c on c.qid = a.qid and c.doc_id = a.doc_id and c.k = 3 where a.k = 1",
    "tp4_word_correlations": BIGRAMS + "select a, b, cast(c as bigint) c, cast(length(a) + length(b) as bigint) span from g where length(a) + length(b) between 10 and 27 and c >= 3",
    "tp10_subword_composites": "with q as (select distinct token from {words:benchmark,item_id,text} x), v as (select distinct token from {words:documents,doc_id,text} x), qg as (select distinct token, {explode:{grams:token,4}} g from q), vg as (select distinct token, {explode:{grams:token,4}} g from v) select qg.token q, vg.token v, cast(count(*) as bigint) shared from qg join vg on vg.g = qg.g where qg.token <> vg.token group by 1, 2 having count(*) >= 2",
    "tp11_registry_upsert": PIECES + ", old as (select distinct token g from {words:benchmark,item_id,text} x where length(token) <= 4), m as (select g, 1 src from old union all select g, 2 from ps where words >= 3 and docs >= 2) select g, max(src) src, cast(count(*) as bigint) writes from m group by 1",
    "tp15_rare_cages": BASE + ", s as (select doc_id, token from (select t.doc_id, t.token, row_number() over (partition by t.doc_id order by i.df, t.token) k from tf t join idf i on i.token = t.token where i.df between 2 and 50) x where k <= 4) select a.token a, b.token b, c.token c, cast(count(*) as bigint) docs from s a join s b on b.doc_id = a.doc_id and a.token < b.token join s c on c.doc_id = a.doc_id and b.token < c.token group by 1, 2, 3",
    "tp19_hub_signatures": CONTENT + ", st as (select token, count(*) deg, sum(c) s from (select a token, c from pairs union all select b, c from pairs) x group by 1) select doc_id, token, cast(k as bigint) k, s from (select t.doc_id, t.token, cast(st.s as bigint) s, row_number() over (partition by t.doc_id order by st.s desc, t.token) k from top t join st on st.token = t.token) x where k <= 5",
    "tp26_document_reordering": BASE + ", r as (select doc_id, df, token from (select t.doc_id, t.token, i.df, row_number() over (partition by t.doc_id order by i.df, t.token) k from tf t join idf i on i.token = t.token where i.df >= 2) x where k = 1), o as (select doc_id, row_number() over (order by df, token, doc_id) fresh, row_number() over (order by doc_id) old from r), g as (select old - lag(old, 1, 0) over (partition by t.token order by old) before_gap, fresh - lag(fresh, 1, 0) over (partition by t.token order by fresh) after_gap from tf t join o on o.doc_id = t.doc_id) select cast(sum(floor(log2(before_gap)) + 1) as bigint) before_bits, cast(sum(floor(log2(after_gap)) + 1) as bigint) after_bits, cast(count(*) as bigint) postings from g",
    "tp3_piece_meets": PIECES + "select p.g, a.g a, b.g b, p.words, p.docs, least(a.docs, b.docs) meet from ps p join ps a on a.g = left(p.g, 2) join ps b on b.g = right(p.g, 2) where length(p.g) = 4 and p.words >= 3 and p.docs >= 2 and a.words >= 3 and b.words >= 3",
    "tp20_routed_corridors": BRIDGES + ", route as (select q.qid, case when min(i.df) <= 20 then 0.1 else 0.3 end w from qt q join idf i on i.token = q.token group by 1), lx as (select qid, doc_id, score / max(score) over (partition by qid) s from bm), bx as (select qid, doc_id, score / max(score) over (partition by qid) s from ex), f as (select coalesce(lx.qid, bx.qid) qid, coalesce(lx.doc_id, bx.doc_id) doc_id, coalesce(lx.s, 0.0) + route.w * coalesce(bx.s, 0.0) score from lx full join bx on lx.qid = bx.qid and lx.doc_id = bx.doc_id join route on route.qid = coalesce(lx.qid, bx.qid)) " + TOP10,
    "g11_frequent_pairs": "with u as (select distinct user_id, event_type from {events} where user_id is not null and event_type is not null) select a.event_type a, b.event_type b, cast(count(*) as bigint) support from u a join u b on b.user_id = a.user_id and a.event_type < b.event_type group by 1, 2 having count(*) >= 5",
    # words as symbols
    "tp2_symbol_paths": "with v as (select distinct token from {words:documents,doc_id,text} x), k as (select token, {sorted:token} path from v) select path, cast(count(*) as bigint) words, min(token) first_word from k group by 1",
    "tp5_unique_synthesis": "with v as (select distinct token from {words:documents,doc_id,text} x), l as (select token, {explode:{grams:token,1}} c from v), s as (select token, sum((ascii(c) - 96) * (ascii(c) - 96) + 2) total from l group by 1) select token, cast(total as bigint) total, case when count(*) over (partition by total) = 1 then 1 else 0 end is_unique from s",
    "tp6_adjacent_meets": "with v as (select token, count(*) n from {words:documents,doc_id,text} x group by 1), g as (select n, {explode:{grams:token,2}} g from v) select ascii(g) + ascii(right(g, 1)) z, cast(count(distinct g) as bigint) pairs, cast(sum(n) as bigint) n from g group by 1",
    "c3_index_packing": "with l as (select doc_id, {explode:{grams:token,1}} c from {tok:documents,doc_id,text} x), n as (select doc_id, count(*) n, count(distinct c) k from l group by 1) select doc_id, cast(k as bigint) alphabet, cast(n * greatest(ceil(log2(k)), 1.0) as bigint) bits, cast(n * 8 as bigint) plain_bits from n",
    "c5_promotion_savings": "with v as (select token, count(*) n from {words:documents,doc_id,text} x group by 1), g as (select token, n, {explode:{grams:token,3}} g from v union all select token, n, {explode:{grams:token,4}} from v) select g, cast(sum(n) as bigint) n, cast((length(g) - 1) * sum(n) - length(g) as bigint) saved from g group by g having (length(g) - 1) * sum(n) - length(g) > 0",
    # chambers and graph
    "g4_subject_chambers": CHAMBERS + "select doc_id, c, round(v, 9) v, cast(k as bigint) k from (select t.doc_id, kw.c, sum(kw.w) v, row_number() over (partition by t.doc_id order by round(sum(kw.w), 9) desc, kw.c) k from t join kw on kw.token = t.token group by 1, 2) y where k <= 3",
    "g5_chamber_neighbours": CHAMBERS + ", m as (select kw.c, t.doc_id, kw.token from t join kw on kw.token = t.token) select a.c, a.token a, b.token b, cast(count(*) as bigint) docs from m a join m b on b.c = a.c and b.doc_id = a.doc_id and a.token < b.token group by 1, 2, 3",
    "g7_knowledge_graph": CONTENT + ", e as (select a, b, c from pairs where c >= 3 union all select b, a, c from pairs where c >= 3) select a token, cast(count(*) as bigint) neighbours, cast(sum(c) as bigint) strength, cast(max(c) as bigint) strongest from e group by 1",
    "g8_cell_classes": BASE + "select token, df, case when df * 2 > n then 'membrane' when df * 10 > n then 'carrier' when df >= 3 then 'signal' else 'trace' end cell from df cross join st",
    "g14_meet_network": "with p as (select cast(i as bigint) p from {series:3,41} s where i in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)), m as (select a.p a, b.p b, a.p + b.p z from p a join p b on a.p < b.p) select x.z, cast(count(*) as bigint) meets, min(x.a) least_anchor, max(x.b) largest_anchor, cast(sum(case when y.p is null then 0 else 1 end) as bigint) follows from m x left join p y on y.p = x.z - 1 group by 1",
    "g15_analogies": BASE + ", rem as (select a.qid, a.token from qt a left join qt b on b.qid = a.qid + 1 and b.token = a.token where b.token is null), ad as (select b.qid - 1 qid, b.token from qt b left join qt a on a.qid = b.qid - 1 and a.token = b.token where a.token is null), c as (select qid - 2 qid, token from qt) select qid, token from (select c.qid, c.token from c left join rem on rem.qid = c.qid and rem.token = c.token where rem.token is null union select ad.qid, ad.token from ad where ad.qid in (select qid from c)) x",
    # addresses
    "m5_composites": "with p as (select cast(i as bigint) p from {series:2,31} s where i in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)), c as (select a.p * b.p * d.p n, a.p a, b.p b, d.p c from p a join p b on a.p < b.p join p d on b.p < d.p) select c.n, min(p.p) a, cast(sum(p.p) as bigint) - min(p.p) - max(p.p) b, max(p.p) c, cast(count(*) as bigint) factors from c join p on c.n % p.p = 0 group by 1",
    "m7_order_exponents": "with s as (select cast(a.i as bigint) a, cast(b.i as bigint) b, cast(c.i as bigint) c from {series:1,3} a cross join {series:1,3} b cross join {series:1,3} c where a.i <> b.i and b.i <> c.i and a.i <> c.i), e as (select cast(power(2, a) * power(3, b) * power(5, c) as bigint) n from s), d as (select e.n, p.i p, max(k.i) pos from e cross join {series:2,5} p cross join {series:1,3} k where p.i in (2, 3, 5) and e.n % cast(power(p.i, k.i) as bigint) = 0 group by 1, 2) select n, p, pos from d",
    "m8_permutation_index": "select a.i a, b.i b, c.i c, case when a.i > b.i then 2 else 0 end + case when a.i > c.i then 2 else 0 end + case when b.i > c.i then 1 else 0 end place, round(cos((case when a.i > b.i then 2 else 0 end + case when a.i > c.i then 2 else 0 end + case when b.i > c.i then 1 else 0 end) * pi() * (3.0 - sqrt(5.0))), 9) side from {series:1,6} a cross join {series:1,6} b cross join {series:1,6} c where a.i <> b.i and b.i <> c.i and a.i <> c.i",
    "m10_pair_canon": "with c as (select cast(a.i as bigint) a, cast(b.i as bigint) p, cast(e.i as bigint) n from {series:3,11} a cross join {series:5,13} b cross join {series:1,20} e where a.i < b.i and a.i in (3, 5, 7, 11) and b.i in (5, 7, 11, 13)) select a, p, n, a + p + n z, case when n < a then a + p else p + n end x1, case when n < a then a when n < p then n else p end y1, case when n < a then 2 * n + a + p else 2 * a + n + p end x2, case when n < a then -a when n < p then -n else -p end y2, case when n < a then n + p when n < p then a + p else a + n end x3, case when n < a then -n else -a end y3, case when n < a then 2 * a + p + n when n < p then 2 * n + p + a else 2 * p + a + n end x4, case when n < a then n else a end y4 from c",
    "m11_chain_canon": CHAIN3 + "select p1, p2, p3, n, s, p1 + p2 + p3 + case when s in (0, 3) then n else 0 end z, case when s = 0 then p1 + p3 else p3 + n end x1, case when s = 0 then p1 when s < 3 then n else p3 end y1, case when s = 0 then 2 * n + p1 + p3 else 2 * p1 + n + p3 end x2, case when s = 0 then -p1 when s < 3 then -n else -p3 end y2, case when s = 0 then n + p3 when s < 3 then p1 + p3 else p1 + n end x3, case when s = 0 then -n else -p1 end y3, case when s = 0 then 2 * p1 + p3 + n when s < 3 then 2 * n + p1 + p3 else 2 * p3 + p1 + n end x4, case when s = 0 then n else p1 end y4 from c",
    "m16_slide_meets": "with c as (select p.i p, n.i n, p.i + n.i x, case when n.i >= p.i then p.i else n.i end y from {series:3,31} p cross join {series:1,40} n where p.i in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)) select a.p pa, a.n na, b.p pb, b.n nb, a.x, a.y from c a join c b on b.x = a.x and b.y = a.y and a.p < b.p",
    "m17_promotion_gate": CHAIN3 + ", deep as (select distinct p1, p2, p3, n, case when s = 0 then p1 + p3 else p3 + n end x, case when s = 0 then p1 when s < 3 then n else p3 end y, p1 + p2 + p3 + case when s in (0, 3) then n else 0 end z from c), sh as (select distinct c.p1, c.p2, k.n, case when k.n < c.p1 then c.p1 + c.p2 else c.p2 + k.n end x, case when k.n < c.p1 then c.p1 when k.n < c.p2 then k.n else c.p2 end y, c.p1 + c.p2 + k.n z from c join (select cast(i as bigint) n from {series:1,40} g) k on 1 = 1) select d.p1, d.p2, d.p3, cast(count(*) as bigint) witnesses from deep d join sh on sh.p1 = d.p1 and sh.p2 = d.p2 and sh.x = d.x and sh.y = d.y and sh.z = d.z group by 1, 2, 3",
    "m24_walk": "with w as (select i, cos(i * 2.0 * pi() / 7) dx, sin(i * 2.0 * pi() / 11) dy from {series:1,200} s) select i, round(sum(dx) over (order by i) + 1000, 6) x, round(sum(dy) over (order by i) + 1000, 6) y from w",
    "m26_set_sketch": "with k as (select doc_id, (doc_id * 2654435761 + s.i * 40503) % 4294967296 % 257 cell from {documents} cross join {series:1,3} s) select cell, cast(count(*) as bigint) n, bit_xor(doc_id) keys, cast(sum(doc_id) as bigint) total from k group by 1",
    "m27_address_erasure": "select doc_id, n_chars, doc_id + n_chars parity, (doc_id + n_chars) - n_chars rebuilt_id, (doc_id + n_chars) - doc_id rebuilt_chars from {documents} where n_chars is not null",
    "m34_blinded_intersection": "{recursive} h(e, v) as (select 0, 1 union all select e + 1, v * 7 % 10007 from h where e < 95), g as (select cast(e as bigint) e, cast(v as bigint) v from h) select x.e a, y.e b, z.v shared from g x join g y on y.e in (2, 3, 5) join g z on z.e = x.e * y.e where x.e between 1 and 19",
    "m28_factor_analogy": BASE + ", x as (select qid, token, qw from qt union all select qid - 1, token, -qw from qt union all select qid - 2, token, qw from qt), n as (select distinct qid from qt) select x.qid, x.token, cast(sum(x.qw) as bigint) power from x join n on n.qid = x.qid group by 1, 2 having sum(x.qw) <> 0",
    "m29_document_numbers": BASE + ", o as (select token, row_number() over (order by df desc, token) place from df) select t.doc_id, round(sum(t.tf * ln(1.0 + o.place)), 6) log_number, cast(count(*) as bigint) factors, cast(max(o.place) as bigint) largest from tf t join o on o.token = t.token group by 1",
    "tp16_widened_pins": "with c as (select p.i p, n.i n, p.i + n.i x, case when n.i >= p.i then p.i else n.i end y from {series:3,31} p cross join {series:1,40} n where p.i in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)), v as (select a.p pin, b.p witness, b.n - a.n velocity from c a join c b on b.x = a.x and b.y = a.y and a.p <> b.p) select pin, witness, cast(count(*) as bigint) meets, cast(min(velocity) as bigint) slowest from v group by 1, 2",
    "g10_lineage": "select c.c_custkey, cast(count(o.o_orderkey) as bigint) orders, n.n_name, r.r_name from {customer} c join {nation} n on n.n_nationkey = c.c_nationkey join {region} r on r.r_regionkey = n.n_regionkey left join {orders} o on o.o_custkey = c.c_custkey group by c.c_custkey, n.n_name, r.r_name",
    "g13_origin_tree": "{recursive} h(node, depth) as (select 0, 0 union all select h.node * 3 + k.i, depth + 1 from h join {series:1,3} k on 1 = 1 where depth < 5) select cast(node as bigint) node, cast(depth as bigint) depth, cast(case when node = 0 then -1 else floor((node - 1) / 3) end as bigint) parent from h",
    # sensors and audits
    "w14_envelope_bins": SENSOR + ", m as (select unit, avg(v) m, count(*) n from s group by 1), r as (select s.unit, s.i, abs(s.v - m.m) e, m.n from s join m on m.unit = s.unit where m.n >= 8) select unit, k.i bin, round(power(sum(e * cos(2.0 * pi() * k.i * r.i / n)), 2) + power(sum(e * sin(2.0 * pi() * k.i * r.i / n)), 2), 3) power from r cross join {series:1,4} k group by 1, 2",
    "w19_fused_diagnosis": SENSOR + ", b as (select unit, avg(v) m, stddev_pop(v) + 1e-9 sd from s group by 1), z as (select s.unit, s.i, (s.v - b.m) / b.sd z, (s.v - lag(s.v) over (partition by s.unit order by s.i)) / b.sd dz from s join b on b.unit = s.unit) select case when abs(z) > 1.5 and abs(dz) > 2 then 'both' when abs(z) > 1.5 then 'content' when abs(dz) > 2 then 'channel' else 'clear' end diagnosis, cast(count(*) as bigint) n, cast(count(distinct unit) as bigint) units from z group by 1",
    "e9_audit_rows": BASE + ", h as (select rel.qid, count(*) gold, min(rk.rank) first_hit, sum(case when rk.rank <= 10 then 1 else 0 end) in_ten, sum(case when rk.rank is null then 1 else 0 end) unreached from rel left join rk on rk.qid = rel.qid and rk.doc_id = rel.doc_id group by 1), p as (select qid, count(*) pool, max(score) best from rk group by 1) select p.qid, cast(p.pool as bigint) pool, round(p.best, 6) best, cast(h.gold as bigint) gold, h.first_hit, cast(h.in_ten as bigint) in_ten, cast(h.unreached as bigint) unreached from p left join h on h.qid = p.qid",
    "e10_acceptance_gates": BASE + ", h as (select avg(case when rk.rank <= 10 then 1.0 else 0.0 end) r10, avg(case when rk.rank <= 100 then 1.0 else 0.0 end) r100 from rel left join rk on rk.qid = rel.qid and rk.doc_id = rel.doc_id), p as (select count(*) postings from tf) select round(r10, 9) r10, round(r100, 9) r100, case when r10 >= 0.5 then 1 else 0 end r10_ok, case when r100 >= 0.8 then 1 else 0 end r100_ok, round(8.0 * postings / n, 6) bytes_per_document from h cross join p cross join st",
}
