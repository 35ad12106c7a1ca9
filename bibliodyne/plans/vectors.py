"""Registered queries of retrieval, ranking and learning; even ids are the library, odd ones candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibliodyne.operators import clustering as C
from bibliodyne.operators import vectors as V
from bibliodyne.operators.graph import similar_papers
from bibliodyne.operators.neighbours import knn_approximate
from bibliodyne.operators.relational import last_surfaced
from bibliodyne.plans.graph import EDGES, LIB, signals
from bibliodyne.plans.registry import query
from bibliodyne.session import materialize

NOW = "2024-02-01"


def vecs(t, rest=None):
    out = t.raw("embeddings").select(F.concat(F.lit("10.1/"), "vec_id").alias("doi"), "vec_id", "embedding", "label")
    return out if rest is None else out.filter(F.col("vec_id") % 2 == rest)


def liked(t):
    """The mean of the vectors of one label, as the domain vector."""
    return V.mean_vector(vecs(t).filter("label = 3"))


VEC = "v as (select concat('10.1/', vec_id) as doi, vec_id, embedding::double[] as embedding, label from embeddings)"
COS = "list_cosine_similarity({0}, {1})"
KNN = f"""near as (select * from (select q.doi as query, l.doi, round({COS.format('q.embedding', 'l.embedding')}, 4) as score, row_number() over (partition by q.doi order by round({COS.format('q.embedding', 'l.embedding')}, 4) desc, l.doi) as rank
from v q join v l on q.vec_id % 2 = 1 and l.vec_id % 2 = 0) where rank <= {{0}})"""
MEAN = "dom as (select list(m order by i) as vector from (select i, avg(x) as m from (select unnest(embedding) as x, unnest(range(len(embedding))) as i from v where label = 3) group by i))"

query("vec_cosine", f"with {VEC} select a.doi, round({COS.format('a.embedding', 'b.embedding')}, 6) as cosine from v a join v b on b.vec_id = (a.vec_id + 7)")(
    lambda t: vecs(t).alias("a").join(vecs(t).alias("b"), F.expr("b.vec_id = a.vec_id + 7")).select("a.doi", F.round(V.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine")))
query("vec_knn_papers", f"with {VEC}, {KNN.format(10)} select query, doi, score, rank from near")(lambda t: V.knn(vecs(t, 1), vecs(t, 0), 10))
# By an index tuned for a recall of 0.97 on audited queries, so there is no SQL.
query("vec_knn_papers_approximate")(lambda t: knn_approximate(vecs(t, 1), vecs(t, 0), 10))
query("vec_knn_chunks", f"""with {VEC}, c as (select concat('10.1/', vec_id % 100) as doi, concat('10.1/', vec_id % 100, '#', vec_id) as chunk, embedding from v where vec_id % 2 = 0),
n as (select *, row_number() over (partition by query order by score desc, chunk) as r0 from (select q.doi as query, c.doi, chunk, round({COS.format('q.embedding', 'c.embedding')}, 4) as score from v q, c where q.vec_id % 2 = 1)),
b as (select * from (select *, row_number() over (partition by query, doi order by r0) as n1 from n where r0 <= 15 and query <> doi) where n1 = 1)
select query, doi, chunk, score, rank from (select *, row_number() over (partition by query order by score desc, doi) as rank from b) where rank <= 5""")(
    lambda t: V.knn_chunks(vecs(t, 1), vecs(t, 0).select(F.expr("concat('10.1/', vec_id % 100)").alias("doi"), F.col("vec_id").alias("chunk_id"), "embedding"), 5))
query("vec_two_stage_rerank")(lambda t: V.two_stage(vecs(t, 1), vecs(t, 0), t.raw("documents").select(F.concat(F.lit("10.1/"), "doc_id").alias("doi"), "text"), V.token_overlap, 5))
query("vec_interest_rank", f"with {VEC}, {MEAN} select doi, round({COS.format('embedding', 'vector')}, 4) as score from v, dom where vec_id % 2 = 0 order by score desc, doi limit 25")(
    lambda t: V.rank_by_vector(vecs(t, 0), liked(t), 25).select("doi", "score"))
query("rank_vector_base", f"with {VEC}, {KNN.format(1)} select v.doi, coalesce(score, 0) as vector_score from v left join near on v.doi = query where vec_id % 2 = 1")(lambda t: V.vector_base(vecs(t, 1), vecs(t, 0)))
query("rank_domain_leg", f"with {VEC}, {MEAN} select doi, round(0.2 * {COS.format('embedding', 'vector')}, 6) as domain from v, dom where vec_id % 2 = 1")(
    lambda t: V.domain_leg(vecs(t, 1), liked(t), 0.2).select("doi", F.round("domain", 6).alias("domain")))
CENT = "cent as (select label as id, list(m order by i) as centroid from (select label, i, avg(x) as m from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as i from v) group by 1, 2) group by label)"
ASSIGN = f"asg as (select * from (select v.doi, vec_id, c.id as cluster_id, {COS.format('embedding', 'centroid')} as s, row_number() over (partition by v.doi order by {COS.format('embedding', 'centroid')} desc, c.id) as r from v, cent c) where r = 1)"


def cents(t):
    return V.mean_vector(vecs(t), ["label"]).select(F.col("label").alias("id"), F.col("vector").alias("centroid"))


query("ml_assign", f"with {VEC}, {CENT}, {ASSIGN} select doi, cluster_id, round(1 - s, 6) as distance from asg")(lambda t: V.assign_nearest(vecs(t), cents(t)).withColumn("distance", F.round("distance", 6)))
query("ml_route_question", f"with {VEC}, {CENT}, {ASSIGN} select doi, cluster_id, round(s, 6) as similarity from asg where vec_id % 2 = 1 and s >= 0.3")(
    lambda t: V.route(vecs(t, 1), cents(t)).withColumn("similarity", F.round("similarity", 6)))
query("rank_cluster_leg", f"with {VEC}, {CENT}, {ASSIGN} select doi, round(0.1 * s, 6) as cluster, display_name as matched from asg left join clusters on id = cluster_id where vec_id % 2 = 1")(
    lambda t: V.cluster_leg(vecs(t, 1), cents(t), t.clusters, 0.1).select("doi", F.round("cluster", 6).alias("cluster"), "matched"))
query("rank_interest_leg", f"with {VEC}, {MEAN} select doi, round(0.3 * 20.0 / 50 * {COS.format('embedding', 'vector')}, 6) as feedback from v, dom where vec_id % 2 = 1")(
    lambda t: V.interest_leg(vecs(t, 1), liked(t), 20, 0.3).select("doi", F.round("feedback", 6).alias("feedback")))
SIG = f"""{EDGES}, {LIB}, a as (select doi, supplier as author from mentions), sig as (select c.doi, coalesce(s.n, 0) as e, 2 * coalesce(o.n, 0) + coalesce(i.n, 0) as k, coalesce(x.n, 0) as h from cand c
left join (select doi, count(*) as n from edges where canonical_id in (select canonical_id from edges where doi in (select doi from lib)) group by doi) s on c.doi = s.doi
left join (select source, count(*) as n from cites where target in (select doi from lib) group by 1) o on c.doi = o.source left join (select target, count(*) as n from cites where source in (select doi from lib) group by 1) i on c.doi = i.target
left join (select doi, count(distinct author) as n from a where author in (select author from a where doi in (select doi from lib)) group by doi) x on c.doi = x.doi)"""


def _scored(found):
    """Legs and a score of papers with their signals, which are found once."""
    return V.graph_leg(found).join(found.select("doi", (1 - F.col("n_shared_entities") / 100).alias("score")), "doi")


query("rank_graph_leg", f"with {SIG} select doi, round(0.15 * least(e / 5.0, 1.0), 6) as entities, round(0.1 * least(k / 3.0, 1.0), 6) as citations, round(0.05 * least(h / 3.0, 1.0), 6) as authors from sig")(
    lambda t: V.graph_leg(signals(t)).select("doi", *[F.round(c, 6).alias(c) for c in ("entities", "citations", "authors")]))
query("rank_breakdown", f"""with {SIG} select doi, round(round(1 - e / 100.0, 3) - round(0.15 * least(e / 5.0, 1.0), 3) - round(0.1 * least(k / 3.0, 1.0), 3) - round(0.05 * least(h / 3.0, 1.0), 3), 3) as vector, round(0.1 * least(k / 3.0, 1.0), 3) as citations, 0.0::double as feedback from sig""")(
    lambda t: V.breakdown(_scored(materialize(signals(t), "signals"))).select(
        "doi", F.col("breakdown")["vector"].alias("vector"), F.col("breakdown")["citations"].alias("citations"), F.col("breakdown")["feedback"].alias("feedback")))
query("flt_domain_split", f"with {VEC}, {MEAN} select doi, {COS.format('embedding', 'vector')} >= 0.1 as in_domain from v, dom where vec_id % 2 = 1")(
    lambda t: V.domain_split(vecs(t, 1), liked(t), 0.1).select("doi", "in_domain"))
query("rank_soft_floor", f"""with {VEC}, {MEAN}, s as (select doi, vec_id % 97 / 97.0 as score, {COS.format('embedding', 'vector')} >= 0.1 as in_domain from v, dom where vec_id % 2 = 1)
select doi, in_domain from (select *, row_number() over (partition by in_domain order by score desc, doi) as n from s) where (in_domain and n <= 38) or (not in_domain and n <= 2)""")(
    lambda t: V.soft_floor(V.domain_split(vecs(t, 1), liked(t), 0.1).withColumn("score", F.col("vec_id") % 97 / 97), 40).select("doi", "in_domain"))
GNEAR = f"""gp as (select a.doi as query, b.doi, count(*) as n from edges a join edges b on a.canonical_id = b.canonical_id and a.doi <> b.doi where a.doi in (select doi from v where vec_id % 2 = 1) group by 1, 2),
gnear as (select * from (select query, doi, row_number() over (partition by query order by n desc, doi) as rank from gp) where rank <= 10)"""
RRF = "fused as (select query, doi, round(sum(1.0::double / (60 + rank)), 9) as score, row_number() over (partition by query order by round(sum(1.0::double / (60 + rank)), 12) desc, min(l * 1000 + rank), doi) as rank from (select query, doi, rank, 0 as l from near union all select query, doi, rank, 1 from gnear) group by query, doi)"


def graph_near(t):
    return similar_papers(t.mentions, 10, vecs(t, 1)).select(F.col("doi").alias("query"), F.col("other").alias("doi"), "rank")


query("rrf_fuse", f"with {VEC}, {EDGES}, {KNN.format(10)}, {GNEAR}, {RRF} select query, doi, score, rank from fused")(
    lambda t: V.rrf(V.knn(vecs(t, 1), vecs(t, 0), 10).select("query", F.lit(0).alias("list_id"), "rank", "doi").unionByName(graph_near(t).select("query", F.lit(1).alias("list_id"), "rank", "doi"))).withColumn("score", F.round("score", 9)))
query("retrieve_modes", f"with {VEC}, {EDGES}, {KNN.format(10)}, {GNEAR}, {RRF} select query, doi, score, rank from fused where rank <= 5")(
    lambda t: V.retrieve("hybrid", 5, V.knn(vecs(t, 1), vecs(t, 0), 10), graph_near(t)).withColumn("score", F.round("score", 9)))
query("rank_graph_mode", f"with {VEC}, {EDGES}, {KNN.format(10)}, {GNEAR}, {RRF} select v.doi, coalesce(max(score), 0) as score from v left join fused on v.doi = query where vec_id % 2 = 1 group by v.doi")(
    lambda t: V.graph_mode_scores(vecs(t, 1), V.retrieve("hybrid", 5, V.knn(vecs(t, 1), vecs(t, 0), 10), graph_near(t))).withColumn("score", F.round("score", 9)))
query("retrieve_context")(lambda t: V.retrieve_context(
    V.knn_chunks(vecs(t, 1), vecs(t, 0).select(F.expr("concat('10.1/', vec_id % 100)").alias("doi"), F.col("vec_id").alias("chunk_id"), "embedding"), 5),
    t.raw("documents").select(F.expr("concat('10.1/', doc_id % 100, '#', doc_id)").alias("id"), "text"), t.papers.select("doi", F.col("title").alias("document"), F.get_json_object("extraction", "$.core_finding").alias("core_finding")), 3))

query("agg_interest_centroid", f"with {VEC} select i as pos, round(avg(x), 6) as m from (select unnest(embedding) as x, unnest(range(len(embedding))) as i from v) group by i")(
    lambda t: V.mean_vector(vecs(t)).select(F.posexplode("vector").alias("pos", "m")).withColumn("m", F.round("m", 6)))
query("udaf_weighted_mean", f"with {VEC} select label, i as pos, round(sum(x * (1 + vec_id % 3)) / sum(1 + vec_id % 3), 6) as m from (select label, vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from v) group by label, i")(
    lambda t: V.mean_vector(vecs(t), ["label"], 1 + F.col("vec_id") % 3).select("label", F.posexplode("vector").alias("pos", "m")).withColumn("m", F.round("m", 6)))
SIGN = "case when signal_type in ('saved', 'thumbs_up') or (signal_type = 'rated' and rating >= 4) then 1 when signal_type in ('dismissed', 'thumbs_down') or (signal_type = 'rated' and rating <= 2) then -1 else 0 end"
# Fixed values of the oracle: the weight of each signal.
WEIGHT = "case signal_type when 'opened' then 0.3 when 'saved' then 1.0 when 'dismissed' then -0.5 when 'thumbs_up' then 0.8 when 'thumbs_down' then -0.8 else 0.5 * (rating - 3) * 0.5 end"
DECAY = f"pow(0.5, greatest((epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 86400e6, 0) / 90)"
INPUTS = f"inputs as (select doi, {SIGN} as sign, abs({WEIGHT}) * {DECAY} * case when source = 's1' then 0.5 else 1 end as weight, embedding from feedback join v using (doi) where {SIGN} <> 0)"


def inputs(t):
    return V.feedback_inputs(t.feedback.withColumn("source", F.when(F.col("source") == "s1", "implicit").otherwise(F.col("source"))), vecs(t), NOW)


query("learn_inputs", f"with {VEC}, {INPUTS} select doi, sign, count(*) as n, round(sum(weight), 6) as weight from inputs group by doi, sign")(
    lambda t: inputs(t).groupBy("doi", "sign").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight")))
ROCCHIO = f"""{INPUTS}, part as (select sign, i, sum(weight * x) / sum(weight) as m from (select sign, weight, unnest(embedding) as x, unnest(range(len(embedding))) as i from inputs) group by 1, 2),
c as (select i, avg(x) as m from (select unnest(embedding) as x, unnest(range(len(embedding))) as i from v where vec_id % 2 = 0) group by i),
raw as (select c.i, c.m + 0.75 * p.m - 0.15 * n.m as m from c join part p on c.i = p.i and p.sign = 1 join part n on c.i = n.i and n.sign = -1)"""
query("learn_rocchio", f"with {VEC}, {ROCCHIO} select i as pos, round(m / (select sqrt(sum(m * m)) from raw), 6) as m from raw")(
    lambda t: V.rocchio(inputs(t), vecs(t, 0)).select(F.posexplode("vector").alias("pos", "m")).withColumn("m", F.round("m", 6)))
WEIGHTS = f"""mass as (select cluster_id, sum(case when {SIGN} < 0 then {DECAY} else 0 end) as d, sum(case when {SIGN} > 0 then {DECAY} else 0 end) as p from feedback join assignments using (doi) group by 1),
weights as (select c.id as cluster_id, case when d is null or d + p = 0 then 1.0 else greatest(0.3, least(1.0, 1 - 0.9 * d / (d + p + 3 + 1e-9))) end as weight from clusters c left join mass on c.id = mass.cluster_id where not archived)"""
query("agg_cluster_feedback", f"with {WEIGHTS} select cluster_id, round(weight, 6) as weight from weights")(
    lambda t: V.cluster_weights(t.feedback, t.assignments, t.clusters, NOW).withColumn("weight", F.round("weight", 6)))
query("learn_state", f"""with {VEC}, {ROCCHIO}, {WEIGHTS}, iv as (select list(m order by i) as vector from raw),
top as (select doi, row_number() over (order by round({COS.format('embedding', 'vector')}, 4) desc, doi) as r from v, iv where vec_id % 2 = 0),
named as (select cluster_id, weight, coalesce(display_name, 'Cluster ' || cluster_id) as name from weights join clusters on id = cluster_id)
select n as n_events, f as n_at_floor, round(case when n < 10 then 0 else n / (n + 30.0) end, 6) as gate, n < 10 as inert, p as top_papers, l as weights from (select count(*) as n from inputs), (select count(*) filter (weight <= 0.3 + 1e-9) as f from weights),
(select string_agg(concat(doi, ' ', coalesce(title, '-')), ';' order by r) as p from top left join papers using (doi) where r <= 10), (select string_agg(name || case when weight <= 0.3 then ' at floor' else '' end, ';' order by weight, cluster_id) as l from named)""")(
    lambda t: _state(t))
query("explore_under_engaged", f"""with {WEIGHTS}, l as (select a.cluster_id, max(u.started_at) as last_at from results r join runs u on r.run_id = u.id join assignments a on a.doi = r.doi where a.doi_key % 2 = 0 and a.cluster_id < 3 group by 1)
select w.cluster_id, l.last_at, round(weight, 6) as weight from weights w left join l on w.cluster_id = l.cluster_id where (l.last_at is null or l.last_at <= timestamp '2002-01-01' - interval 28 day) and weight > 0.35""")(
    lambda t: V.under_engaged(last_surfaced(t.clusters, t.assignments.filter("doi_key % 2 = 0 and cluster_id < 3"), t.results, t.runs), V.cluster_weights(t.feedback, t.assignments, t.clusters, NOW), "2002-01-01").withColumn("weight", F.round("weight", 6)))
query("ml_stable_ids", f"""with {VEC}, {CENT}, n as (select id as pos, centroid from cent where id <> 4), o as (select id + 100 as id, centroid from cent where id < 7)
select pos, case when pos < 7 then pos + 100 else 106 + row_number() over (partition by pos < 7 order by pos) end as id, pos < 7 as inherited from n""")(
    lambda t: V.stable_ids(cents(t).filter("id <> 4").withColumnRenamed("id", "pos"), cents(t).filter("id < 7").withColumn("id", F.col("id") + 100)))
query("ml_kmeans_auto_k")(lambda t: V.kmeans_auto(vecs(t))[2].select("doi", "pos"))
query("ml_kmeans_silhouettes")(lambda t: _silhouettes(t))
query("ml_recompute")(lambda t: V.recompute_clusters(vecs(t), t.papers, cents(t).select("id", "centroid"))["clusters"].select("id", "inherited", "display_name", F.size("sample_titles").alias("n_titles")))


def _state(t):
    """The learning state with its two short lists."""
    weights = V.cluster_weights(t.feedback, t.assignments, t.clusters, NOW)
    state = V.learning_state(inputs(t), weights).withColumn("gate", F.round("gate", 6))
    in_order = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("x")))), lambda s: s["x"]), ";")
    top = V.top_aligned(vecs(t, 0), V.rocchio(inputs(t), vecs(t, 0)), t.papers)
    papers = top.agg(in_order([(-F.col("cosine")).alias("c"), F.col("doi")], F.concat_ws(" ", "doi", F.coalesce("title", F.lit("-")))).alias("top_papers"))
    listed = V.weight_list(weights, t.clusters)
    names = listed.agg(in_order([F.col("place")], F.concat("name", F.when(F.col("at_floor"), " at floor").otherwise(""))).alias("weights"))
    return state.join(F.broadcast(papers), F.lit(True)).join(F.broadcast(names), F.lit(True))  # one row each


def _silhouettes(t):
    rows = C.usable(vecs(t))
    return C.silhouettes(rows, C.fit_grid(rows, list(range(5, 16)))[0])
