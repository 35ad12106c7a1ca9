"""Registered queries of sources and sinks: each returns the snapshot that would be written."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibliodyne.plans.registry import ORACLE_SQL, query
from bibliodyne.plans.standins import cites
from bibliodyne.plans.vectors import vecs
from bibliodyne.session import shared_path
from bibliodyne.sources import readers as R
from bibliodyne.sources import sinks as K
from bibliodyne.sources.buckets import BucketTable

query("src_candidates", "select case when o_orderkey % 5 = 0 then '' else concat('10.1/', o_orderkey) end as doi, concat('T', o_custkey) as title, 'A|B' as authors, cast(year(o_orderdate) as int) as year, case when o_orderkey % 4 = 0 then '' else concat('Journal ', o_custkey % 40) end as journal, 'db' as dbs from orders")(
    lambda t: R.candidates(t.papers.selectExpr("case key % 5 when 0 then null when 1 then concat('https://doi.org/', doi, '/') when 2 then concat(' DOI: ', doi) else doi end as doi", "concat(' T', author, ' ') as title", "array('A ', '', 'B') as authors", "concat(year, '-01-02') as publication_date", "case when key % 4 <> 0 then journal end as journal", "cast(null as string) as abstract", "cast(null as array<string>) as keywords", "array('db') as databases"))
    .select("doi", "title", F.array_join("authors", "|").alias("authors"), "year", "journal", F.array_join("source_databases", "|").alias("dbs")))
query("src_openalex_works", "select doi, title, concat('Author ', author) as authors, year, journal, 'deep models' as abstract from papers")(
    lambda t: R.openalex_works(t.papers.select(F.from_json(F.to_json(F.struct(
        F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), "title", F.col("year").alias("publication_year"), F.array(F.struct(F.struct(F.concat(F.lit("Author "), "author").alias("display_name")).alias("author")), F.struct(F.struct(F.lit("").alias("display_name")).alias("author"))).alias("authorships"),
        F.struct(F.struct(F.col("journal").alias("display_name")).alias("source")).alias("primary_location"), F.create_map(F.lit("models"), F.array(F.lit(1)), F.lit("deep"), F.array(F.lit(0))).alias("abstract_inverted_index"))), R.WORK).alias("w")).select("w.*"))
    .select("doi", "title", F.array_join("authors", "|").alias("authors"), "year", "journal", "abstract"))
query("src_s2_results", "select case when key % 2 = 0 then doi else '' end as doi, title, 'n|m' as authors, case when key % 3 = 0 then '' else journal end as journal, 'Physics' as fields, key % 10 / 10.0 as relevance from papers")(
    lambda t: R.s2_results(t.papers.selectExpr("title", "year", "case when key % 2 = 0 then map('DOI', upper(doi)) else map('ArXiv', 'x') end as externalIds", "case when key % 3 <> 0 then journal end as venue", "cast(null as string) as abstract", "array('Physics') as fieldsOfStudy", "array(struct('n' as name), struct('' as name), struct(cast(null as string) as name), struct('m' as name)) as authors", "key % 10 / 10.0D as score"))
    .select("doi", "title", F.array_join("authors", "|").alias("authors"), "journal", F.array_join("keywords", "|").alias("fields"), "relevance"))
query("src_vocab_tables", "select type, surface, min(canonical_id) as canonical from (select coalesce(type, 'none') as type, surface, canonical_id, canonical_id % 5 = 0 as dep, min(canonical_id % 5 = 0) over (partition by coalesce(type, 'none'), surface) as best from entities) where dep = best group by 1, 2")(
    lambda t: R.vocabulary(t.entities.select(F.coalesce("type", F.lit("none")).alias("type"), F.upper("surface").alias("surface"), F.col("canonical_id").alias("canonical"), (F.col("canonical_id") % 5 == 0).alias("deprecated"))).drop("deprecated"))
query("src_vectors", "select concat('10.1/', vec_id) as doi, label from embeddings where vec_id in (select o_orderkey from orders where o_orderstatus = 'F')")(
    lambda t: R.vectors(vecs(t), t.papers.filter("status = 'discovered'")).select("doi", "label"))

OLD = "old as (select key as k, title, journal from papers where key % 2 = 0)"
query("sink_upsert_coalesce", f"with {OLD}, new as (select key as k, case when key % 3 = 0 then 'new title' end as title, case when key % 5 = 0 then 'new journal' end as journal from papers where key % 4 <> 1) select coalesce(o.k, n.k) as k, coalesce(n.title, o.title) as title, coalesce(n.journal, o.journal) as journal from old o full join new n on o.k = n.k")(
    lambda t: K.upsert_coalesce(t.papers.filter("key % 2 = 0").selectExpr("key as k", "title", "journal"),
                                t.papers.filter("key % 4 <> 1").selectExpr("key as k", "case when key % 3 = 0 then 'new title' end as title", "cast(null as string) as journal", "1 as o").unionByName(t.papers.filter("key % 4 <> 1").selectExpr("key as k", "cast(null as string) as title", "case when key % 5 = 0 then 'new journal' end as journal", "2 as o")),
                                ["k"], F.col("o")).select("k", "title", "journal"))
CIT = "select source, '[1]' as ref_id, case when length(target) % 2 = 0 then target end as target, 'old' as context, case when length(target) % 2 = 0 then 'numeric' else 'unresolved' end as resolution from cites where source not like '%3'"
NEW = "select source, '[1]' as ref_id, case when source like '%5' then 'X' end as target, 'new' as context, case when source like '%5' then 'fuzzy' else 'unresolved' end as resolution from cites where source not like '%7'"
query("sink_citation_upsert", f"""with o as ({CIT}), n as ({NEW}) select coalesce(o.source, n.source) as source, coalesce(n.target, o.target) as target, case when n.source is not null then n.context else o.context end as context,
case when n.source is null then o.resolution when n.target is not null or o.source is null then n.resolution else o.resolution end as resolution from o full join n on o.source = n.source""")(
    lambda t: K.upsert_citations(cites(t.papers).filter("source not like '%3'").selectExpr("source", "'[1]' as ref_id", "case when length(target) % 2 = 0 then target end as target", "'old' as context", "case when length(target) % 2 = 0 then 'numeric' else 'unresolved' end as resolution"),
                                 cites(t.papers).filter("source not like '%7'").selectExpr("source", "'[1]' as ref_id", "case when source like '%5' then 'X' end as target", "'new' as context", "case when source like '%5' then 'fuzzy' else 'unresolved' end as resolution")).drop("ref_id"))
query("sink_vectors_upsert", "select vec_id, label, false as fresh from embeddings where vec_id % 3 <> 0 or vec_id % 2 = 1 union all select vec_id, label + 100, true from embeddings where vec_id % 6 = 0")(
    lambda t: K.replace_by_key(vecs(t).select("vec_id", "label", F.lit(False).alias("fresh")), vecs(t).filter("vec_id % 6 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(True).alias("fresh")), "vec_id"))
query("sink_edges_idempotent", "select doi, canonical_id, field, min(source) as source from mentions where canonical_id in (select canonical_id from entities where type is not null) and (doi, canonical_id, field) not in (select doi, canonical_id, field from mentions where line = 1) group by 1, 2, 3")(
    lambda t: K.insert_absent(t.mentions.filter("line = 1"), t.mentions.select("doi", "canonical_id", "field", "source"), ["doi", "canonical_id", "field"], [F.col("source")], [(t.entities.filter("type is not null"), "canonical_id", "canonical_id")]))


def _buckets(t, kind):
    """The same three writes into tables of hash buckets."""
    root = shared_path(t.spark, "buckets")
    if kind == "upsert":
        table = BucketTable.create(t.papers.filter("key % 2 = 0").selectExpr("key as k", "title", "journal"), root, ["k"], 64)
        due = t.papers.filter("key % 4 <> 1")
        titles = due.selectExpr("key as k", "case when key % 3 = 0 then 'new title' end as title", "cast(null as string) as journal", "1 as o")
        table.upsert(titles.unionByName(due.selectExpr("key as k", "cast(null as string) as title", "case when key % 5 = 0 then 'new journal' end as journal", "2 as o")), F.col("o"))
    elif kind == "replace":
        table = BucketTable.create(vecs(t).select("vec_id", "label", F.lit(False).alias("fresh")), root, ["vec_id"], 16)
        table.replace(vecs(t).filter("vec_id % 6 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(True).alias("fresh")))
    else:
        old, keys = t.mentions.filter("line = 1").select("doi", "canonical_id", "field", "source"), ["doi", "canonical_id", "field"]
        table = BucketTable.create(old.dropDuplicates(keys), root, keys, 64)
        known = t.entities.filter("type is not null").select("canonical_id")
        table.insert_absent(t.mentions.select("doi", "canonical_id", "field", "source").join(known, "canonical_id", "left_semi").select(*old.columns), [F.col("source")])
        return table.read().join(old.select(*keys).distinct(), keys, "left_anti")
    return table.read()


for kind, name, like in (("upsert", "sink_upsert_buckets", "sink_upsert_coalesce"), ("replace", "sink_vectors_buckets", "sink_vectors_upsert"), ("insert", "sink_edges_buckets", "sink_edges_idempotent")):
    query(name)(lambda t, kind=kind: _buckets(t, kind))
    ORACLE_SQL[name] = ORACLE_SQL[like]

query("sink_atomic_replace", """with n as (select n_nationkey as pos, case when n_nationkey % 2 = 0 then n_nationkey end as id, case when n_nationkey % 3 = 0 then n_name end as display_name from nation where n_nationkey < 8),
l as (select coalesce(id, (select max(id) from clusters) + row_number() over (partition by id is null order by pos)) as id, display_name from n)
select id, coalesce(display_name, 'Cluster ' || id) as display_name, false as archived from l union all select id, display_name, true from clusters where id not in (select id from l)""")(
    lambda t: K.atomic_replace(t.clusters, t.raw("nation").filter("n_nationkey < 8").selectExpr("n_nationkey as pos", "case when n_nationkey % 2 = 0 then n_nationkey end as id", "case when n_nationkey % 3 = 0 then n_name end as display_name")))
query("sink_digest")(lambda t: K.digest(t.papers.select("doi", "title", F.transform(F.sequence(F.lit(1), F.col("author") % 5 + 1), lambda i: F.concat(F.lit("A"), i)).alias("authors"), "year", F.round(F.col("price") / 500000, 4).alias("score")), "2024-02-01", 0.5))
query("sink_snapshot", "select 'r1' as run, (select count(*) from papers) as n_papers, (select count(*) from papers where graph_indexed) as n_graph_indexed, count(*) as n_mentions, count(distinct canonical_id) as n_entities from mentions")(
    lambda t: K.corpus_snapshot(t.papers, t.mentions, "r1"))
query("sink_writeback_plan", "select a.doi, p.k as key, 'theme/' || replace(coalesce(c.display_name, 'Cluster ' || c.id), '/', '-') as tag, case when p.k is null then 'skipped' else 'added' end as state from assignments a join clusters c on a.cluster_id = c.id and not c.archived left join (select doi, case when key % 3 <> 0 then title end as k from papers) p on a.doi = p.doi")(
    lambda t: K.writeback_plan(t.assignments, t.clusters, t.papers.select("doi", F.expr("case when key % 3 <> 0 then title end").alias("external_key"))))
query("sink_results_append", "select doi, price as score, 7 as run_id, status = 'complete' as ingested, case when status = 'complete' then '2024-02-01' end as ingested_at from (select doi, price, coalesce(status, '') as status from papers)")(
    lambda t: K.results_append(t.papers.select("doi", F.col("price").alias("score")), 7, t.papers.filter("status = 'complete'"), "2024-02-01"))
query("sink_domain_focus", "select v.f as field_type, coalesce(n, '') as names from (values ('topics'), ('methods'), ('materials'), ('applications'), ('keywords')) v(f) left join (select 'topics' as g, string_agg(distinct surface, '|' order by surface) as n from entities union all select 'methods', string_agg(distinct brand, '|' order by brand) from entities) on f = g")(
    lambda t: K.read_domain_focus(K.domain_focus(t.entities.select(F.array("surface", F.lit("  ")).alias("topics"), F.array("brand").alias("methods"), F.array("surface").alias("unknown")))).select("field_type", F.array_join("values", "|").alias("names")))
query("sink_embedding_provenance", "select r_name as collection, case when r_regionkey = 2 then 'm2' else 'm1' end as model, r_regionkey = 2 as is_current from region")(
    lambda t: K.embedding_provenance(t.raw("region").selectExpr("r_name as collection", "'m1' as model", "false as is_current"), t.raw("region").filter("r_regionkey = 2").selectExpr("r_name as collection", "'m2' as model"), t.raw("region").filter("r_regionkey = 2").first().r_name))
query("sink_interest_vector", "select concat('s', label) as scope, count(*) as n_events from embeddings where label <> 3 group by 1 union all select 's3', 99")(
    lambda t: K.interest_vectors(vecs(t).groupBy(F.concat(F.lit("s"), "label").alias("scope")).agg(F.count("*").alias("n_events")), t.spark.createDataFrame([("s3", 99)], "scope string, n_events long")))
query("sink_trending_actions", "select canonical_id as id, case when canonical_id % 4 = 0 then 'accepted' when canonical_id % 4 = 1 then 'dismissed' else 'pending' end as status, case when canonical_id % 4 < 2 then 'd2' end as acted_at from entities")(
    lambda t: K.trending_actions(t.entities.selectExpr("canonical_id as id", "'pending' as status", "cast(null as string) as acted_at"),
                                 t.entities.selectExpr("canonical_id as id", "case canonical_id % 4 when 0 then 'accepted' when 1 then 'dismissed' else 'liked' end as action", "'d2' as at").unionByName(t.entities.filter("canonical_id % 4 = 0").selectExpr("canonical_id as id", "'dismissed' as action", "'d1' as at"))))
query("sink_mark_progress", "select key as doi, key % 2 = 0 or key % 3 = 0 as simple, key % 5 = 0 as complex, (key % 2 = 0 or key % 3 = 0) and key % 5 = 0 as complete from papers")(
    lambda t: K.mark_progress(t.papers.selectExpr("key as doi", "key % 2 = 0 as simple", "cast(null as boolean) as complex"), t.papers.filter("key % 3 = 0").selectExpr("key as doi", "'simple' as phase").union(t.papers.filter("key % 5 = 0").selectExpr("key as doi", "'complex' as phase"))))
query("sink_reset_extractions", "select doi, title, 'pending' as status, cast(null as varchar) as extraction, false as graph_indexed, false as chunks_indexed, false as notes_synced, false as embeddings_indexed from papers")(
    lambda t: K.reset_extractions(t.papers).select("doi", "title", "status", "extraction", "graph_indexed", "chunks_indexed", "notes_synced", "embeddings_indexed"))
query("sink_purge_types", "select doi, title, source_type from papers where source_type not in ('5-LOW', '1-URGENT')")(
    lambda t: K.purge_types(t.papers, ("5-LOW", "1-URGENT")).select("doi", "title", "source_type"))
