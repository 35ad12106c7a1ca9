"""Registered queries: filters, joins, aggregations, windows and sets on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibliodyne.operators import quarantine as Q
from bibliodyne.operators import relational as R
from bibliodyne.operators import sketches as K
from bibliodyne.plans.registry import query
from bibliodyne.plans.standins import cites
from bibliodyne.session import shared_path
from bibliodyne.sources import days as D

OC = "cast(json_extract_string(extraction, '$._overall_confidence') as double)"

query("flt_corpus_search", "select key, doi, title from papers where contains(lower(title), '1-urgent') and source_type = '1-URGENT' and (status is null or status not in ('complete')) and not coalesce(graph_indexed, false) order by year desc, doi limit 300 offset 20")(
    lambda t: R.corpus_search(t.papers, "1-URGENT", "1-URGENT", ("complete",), ("graph_indexed",), "year", True, 300, 20).select("key", "doi", "title"))
query("flt_low_confidence", f"select doi, {OC} as overall_confidence from papers where {OC} < 0.5")(
    lambda t: R.low_confidence(t.papers).select("doi", "overall_confidence"))
query("flt_library", "select doi, status from papers where status is null or status <> 'discovered'")(lambda t: R.library(t.papers).select("doi", "status"))
query("flt_indexable", "select doi from papers where extraction is not null")(lambda t: R.indexable(t.papers).select("doi"))
query("flt_backlog", """select 'graph' as kind, doi from papers where graph_indexed = false and last_updated >= timestamp '1999-01-01'
union all select 'chunks', doi from papers where chunks_indexed = false and embeddings_indexed = true
union all select 'notes', doi from papers where notes_synced = false""")(
    lambda t: R.backlog(t.papers, "graph", "1999-01-01").select(F.lit("graph").alias("kind"), "doi")
    .union(R.backlog(t.papers, "chunks").select(F.lit("chunks"), "doi")).union(R.backlog(t.papers, "notes").select(F.lit("notes"), "doi")))
query("flt_item_quality", """select key, coalesce(trim(title), '') <> '' as accepted,
concat_ws(',', case when abstract is null or trim(abstract) = '' then 'abstract' end, case when date is null or not regexp_matches(date, '[0-9]{4}') then 'date' end) as warnings
from (select key, author, case when key % 11 <> 0 then title else '  ' end as title, case when key % 5 <> 0 then journal end as abstract, case when key % 7 <> 0 then cast(year as varchar) else 'n.d.' end as date from papers)""")(
    lambda t: R.item_quality(t.papers.select("key", "author", F.expr("case when key % 11 <> 0 then title else '  ' end").alias("title"), F.expr("case when key % 5 <> 0 then journal end").alias("abstract"), F.expr("case when key % 7 <> 0 then cast(year as string) else 'n.d.' end").alias("date"))).select("key", "accepted", "warnings"))
query("flt_window", "select doi from papers where last_updated >= timestamp '1997-03-01' and last_updated <= timestamp '1998-03-01'")(
    lambda t: R.date_window(t.papers, "last_updated", "1997-03-01", "1998-03-01").select("doi"))
query("flt_min_relevance", "select id, score from (select id, case when part % 13 <> 0 then score end as score from results) where coalesce(score, 1.0) >= 0.7")(
    lambda t: R.min_relevance(t.results.select("id", F.expr("case when part % 13 <> 0 then score end").alias("score")), 0.7))
query("flt_mention_low_conf", "select doi, canonical_id, line from mentions where confidence < 0.65")(lambda t: R.low_confidence_mentions(t.mentions).select("doi", "canonical_id", "line"))
query("flt_span_valid", """select doc_id, s as start from (select doc_id, text, (doc_id * 7) % 400 as s, (doc_id * 7) % 400 + 3 + doc_id % 9 as e from documents)
where e <= length(text) and doc_id % 4 <> 0""")(
    lambda t: R.valid_spans(t.raw("documents").select("doc_id", "text", F.expr("cast(doc_id * 7 % 400 as int)").alias("start"), F.expr("cast(doc_id * 7 % 400 + 3 + doc_id % 9 as int)").alias("end"))
                            .withColumn("surface", F.when(F.col("doc_id") % 4 != 0, F.expr("substring(text, start + 1, end - start)")).otherwise("#never#"))).select("doc_id", "start"))

query("jn_run_history", """select r.id, r.status, l.run_type, coalesce(c.n, 0) as n_results, coalesce(c.i, 0) as n_ingested from runs r left join run_log l on r.id = l.id
left join (select run_id, count(*) as n, count(*) filter (ingested) as i from results group by run_id) c on r.id = c.run_id""")(
    lambda t: R.run_history(t.runs, t.run_log, t.results).select("id", "status", "run_type", "n_results", "n_ingested"))
query("jn_progress_papers", "select p.doi, p.complete, q.title from (select concat('10.1/', l_orderkey + 5) as doi, l_returnflag = 'A' as complete from lineitem where l_linenumber = 1) p left join papers q on p.doi = q.doi")(
    lambda t: R.progress_papers(t.raw("lineitem").filter("l_linenumber = 1").selectExpr("concat('10.1/', l_orderkey + 5) as doi", "l_returnflag = 'A' as complete"), t.papers).select("doi", "complete", "title"))
query("jn_cluster_members", "select a.doi, a.cluster_id, p.title, row_number() over (partition by a.cluster_id order by a.distance, a.doi) as place from assignments a left join papers p on a.doi = p.doi")(
    lambda t: R.cluster_members(t.assignments, t.papers).select("doi", "cluster_id", "title", "place"))
query("jn_theme_exists", "select doi from papers where doi in (select a.doi from assignments a join clusters c on a.cluster_id = c.id where not c.archived and c.display_name = 'NATION_3')")(
    lambda t: R.with_theme(t.papers, t.assignments, t.clusters, "NATION_3").select("doi"))
query("jn_known_filter", "select id, doi from results where doi is null or lower(doi) not in (select lower(doi) from papers where status = 'complete')")(
    lambda t: R.unknown_candidates(t.results.select("id", F.expr("concat('https://doi.org/', doi, '/')").alias("doi")), t.papers.filter("status = 'complete'")).select("id", F.expr("replace(substring(doi, 17), '10.1', '10.1')").alias("d"))
    .select("id", F.expr("case when d is not null then substring(d, 1, length(d) - 1) end").alias("doi")))
query("jn_exploration_dedup", """select doi from (select distinct concat('10.1/', canonical_id) as doi from mentions where canonical_id % 3 = 0) e
where doi not in (select doi from papers where year = 1997 and doi is not null) order by length(doi), doi limit (select cast(ceil(count(*) * 0.05) as bigint) from papers where year = 1997)""")(
    lambda t: R.exploration_extra(t.mentions.filter("canonical_id % 3 = 0").select(F.expr("concat('10.1/', canonical_id)").alias("doi")).distinct().withColumn("position", F.length("doi")), t.papers.filter("year = 1997"), 0.05).select("doi"))
query("jn_last_surfaced", """select c.id, l.last_at from clusters c left join (select a.cluster_id, max(u.started_at) as last_at from results r join runs u on r.run_id = u.id join assignments a on a.doi = r.doi
where trim(r.doi) <> '' group by a.cluster_id) l on c.id = l.cluster_id where not c.archived""")(
    lambda t: R.last_surfaced(t.clusters, t.assignments, t.results, t.runs).select("id", "last_at"))
query("jn_first_surfaced", "select r.doi, cast(cast(min(u.started_at) as date) as varchar) as first_on from results r join runs u on r.run_id = u.id where trim(r.doi) <> '' group by r.doi")(
    lambda t: R.first_surfaced(t.results, t.runs).withColumn("first_on", F.col("first_on").cast("string")))
query("jn_implicit_saves", """select distinct p.doi from papers p where p.status = 'complete' and p.doi in (select doi from results where doi is not null)
and p.doi not in (select doi from feedback where signal_type = 'saved' and source = 's1')""")(
    lambda t: R.implicit_saves(t.papers.filter("status = 'complete'"), t.results, t.feedback.withColumn("source", F.when(F.col("source") == "s1", "implicit"))))
query("jn_mark_ingested", """select r.id, r.ingested or coalesce(p.hit, false) as ingested, case when p.hit then coalesce(r.ship, p.at) else r.ship end as ingested_at
from (select id, doi, ingested, case when ingested then ship end as ship from results) r left join (select doi, true as hit, min(last_updated) as at from papers where status = 'complete' group by doi) p on r.doi = p.doi""")(
    lambda t: R.mark_ingested(t.results.select("id", "doi", "ingested", F.expr("case when ingested then ship end").alias("ingested_at")), t.papers.filter("status = 'complete'")).select("id", "ingested", "ingested_at"))
query("jn_mirror_citations", """select distinct source, target from cites where source in (select doi from papers where status = 'complete' or status is null) and target in (select doi from papers where status = 'complete' or status is null)
and (source, target) not in (select source, target from cites where source like '%7')""")(
    lambda t: R.mirror_citations(cites(t.papers), R.library(t.papers), cites(t.papers).filter("source like '%7'")).select("source", "target"))
query("jn_cited_notes", "select distinct c.source, c.target, p.title from cites c join papers p on c.target = p.doi where p.title is not null")(lambda t: R.cited_papers(cites(t.papers), t.papers).select("source", "target", "title"))
query("jn_citing", "select target, count(distinct source) as n_citing from cites group by target")(lambda t: R.citing_counts(cites(t.papers)))
query("jn_related_work", """select doi, other, row_number() over (partition by doi order by part, position, other) as place from (
select source as doi, target as other, 0 as part, 0 as position from cites union all
select doi, other, 1, position from (select p.doi, concat('10.1/', (p.key * 3 + n.k) % 1000) as other, n.k as position from papers p, (values (1), (2), (3)) n(k)) s where (doi, other) not in (select source, target from cites))""")(
    lambda t: R.related_work(cites(t.papers).select(F.col("source").alias("doi"), F.col("target").alias("other"), F.lit(0).alias("position")),
                             t.papers.withColumn("position", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("doi", F.expr("concat('10.1/', (key * 3 + position) % 1000)").alias("other"), "position")))
query("jn_unmapped", "select distinct surface as keyword from entities where surface not in (select surface from entities where canonical_id % 4 = 0)")(
    lambda t: R.unmapped(t.entities.select(F.col("surface").alias("keyword")).distinct(), t.entities.filter("canonical_id % 4 = 0").select(F.col("surface").alias("keyword"))))
query("jn_hydrate", "select r.doi, r.place, p.title, p.year, p.journal from (select concat('10.1/', c_custkey * 11) as doi, c_custkey as place from customer) r left join papers p on r.doi = p.doi")(
    lambda t: R.hydrate(t.raw("customer").selectExpr("concat('10.1/', c_custkey * 11) as doi", "c_custkey as place"), t.papers))

query("agg_status_counts", "select status, count(*) as n from papers group by status")(lambda t: R.status_counts(t.papers))
query("agg_index_coverage", "select count(extraction) as extracted, count(*) filter (embeddings_indexed) as embedded, count(*) filter (graph_indexed) as graphed from papers")(lambda t: R.index_coverage(t.papers))
query("agg_graph_health", """select total, indexed, case when total > 0 and indexed > 0 then 'ok' else 'warn' end as health from
(select count(*) filter (status <> 'discovered') as total, count(*) filter (status <> 'discovered' and graph_indexed) as indexed from papers)""")(lambda t: R.graph_health(t.papers))
query("agg_corpus_stats", "select v.source, coalesce(n, 0) as n from (values ('A'), ('N'), ('R'), ('X')) v(source) left join (select source, count(*) as n from mentions group by source) c on v.source = c.source")(
    lambda t: R.zero_filled_counts(t.mentions, "source", ("A", "N", "R", "X")))
query("agg_entities_by_type", "select type, count(*) as n from entities where type is not null group by type")(lambda t: R.counts_by(t.entities, "type", drop_null=True))
query("agg_mentions_by_source", "select source, count(*) as n, count(distinct canonical_id) as n_entities from mentions group by source")(
    lambda t: t.mentions.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("canonical_id").alias("n_entities")))
query("agg_relations_by_version", "select field, source, count(*) as n from mentions group by field, source")(lambda t: R.counts_by(t.mentions, "field", "source"))
query("agg_feedback_summary", "select v.signal_type, coalesce(n, 0) as n from (values ('saved'), ('thumbs_up'), ('thumbs_down'), ('dismissed'), ('opened'), ('rated')) v(signal_type) left join (select signal_type, count(*) as n from feedback group by signal_type) c on v.signal_type = c.signal_type")(
    lambda t: R.zero_filled_counts(t.feedback, "signal_type", R.SIGNALS))
query("agg_feedback_by_source", "select coalesce(source, 'unknown') as source, count(*) as n from feedback group by 1")(lambda t: R.counts_by(t.feedback, "source", unknown="unknown"))
query("agg_feedback_timeline", """select strftime(created_at, '%Y-W%W') as bucket, signal_type, count(*) as n from feedback group by 1, 2
union all select strftime(created_at, '%Y-%m-%d'), coalesce(source, 'none'), count(*) from feedback where created_at >= timestamp '2024-01-20' group by 1, 2""")(
    lambda t: R.feedback_timeline(t.feedback, weekly=True).union(R.feedback_timeline(t.feedback.withColumn("source", F.coalesce("source", F.lit("none"))), "source", since="2024-01-20")))
query("agg_run_conversion", "select run_id, count(*) as n_results, count(*) filter (ingested) as n_ingested from results group by run_id")(lambda t: R.run_conversion(t.results))
TRENDING = """select canonical_id, count(*) filter (extracted_at >= timestamp '2000-06-01' - interval 60 day) as n_new, count(*) filter (extracted_at < timestamp '2000-06-01' - interval 60 day) as n_prev
from mentions where extracted_at >= timestamp '2000-06-01' - interval 120 day and extracted_at < timestamp '2000-06-01' group by canonical_id"""
query("agg_trending_counts", f"select * from ({TRENDING}) where n_new > 0 order by n_new desc, canonical_id limit 500")(lambda t: R.trending_counts(t.mentions, "2000-06-01"))
query("agg_keyword_pairs", "select distinct doi, keyword from (select doi, unnest([journal, source_type, journal, '']) as keyword from papers) where trim(keyword) <> ''")(
    lambda t: R.keyword_pairs(t.papers.withColumn("tags", F.array("journal", "source_type", "journal", F.lit("")))))
query("agg_merge_passes", """select doi, field, value, confidence from (select *, row_number() over (partition by doi, field order by case confidence when 'explicit' then 2 when 'inferred' then 1 else 0 end desc, chunk) as r
from (select doi, field, line as chunk, concat('v', canonical_id) as value, case source when 'A' then 'explicit' when 'N' then 'inferred' else 'absent' end as confidence, canonical_id from
(select * , row_number() over (partition by doi, field, line order by canonical_id, source, supplier) as one from mentions) where one = 1)) where r = 1""")(
    lambda t: R.merge_passes(R.top_per_group(t.mentions, ["doi", "field", "line"], [F.col("canonical_id"), F.col("source"), F.col("supplier")], 1)
                             .select("doi", "field", F.col("line").alias("chunk"), F.expr("concat('v', canonical_id)").alias("value"), F.expr("case source when 'A' then 'explicit' when 'N' then 'inferred' else 'absent' end").alias("confidence"))))
query("agg_merge_themes", """select theme, string_agg(keyword, ',' order by position, i) as keywords from (select theme, keyword, position, i, row_number() over (partition by theme, keyword order by position, i) as r from
(select type as theme, canonical_id as position, 0 as i, surface as keyword from entities where type is not null union all select type, canonical_id, 1, brand from entities where type is not null)) where r = 1 group by theme""")(
    lambda t: R.merge_themes(t.entities.filter("type is not null").select(F.col("type").alias("theme"), F.col("canonical_id").alias("position"), F.array("surface", "brand").alias("keywords"))).withColumn("keywords", F.array_join("keywords", ",")))

query("win_same_day_ordinal", "select id, row_number() over (partition by cast(started_at as date) order by id) as ordinal from runs")(lambda t: R.same_day_ordinal(t.runs).select("id", "ordinal"))
SNAP = "select year as yr, count(*) as n_papers, count(distinct author) as n_authors from papers group by year"
query("win_snapshot_delta", f"select yr, n_papers, n_authors, n_papers - lag(n_papers) over (order by yr) as n_papers_delta, n_authors - lag(n_authors) over (order by yr) as n_authors_delta from ({SNAP}) order by yr desc limit 1")(
    lambda t: R.snapshot_delta(t.papers.groupBy(F.col("year").alias("yr")).agg(F.count("*").alias("n_papers"), F.countDistinct("author").alias("n_authors")), "yr", ("n_papers", "n_authors")))
query("win_nearest_cluster", """select doi, cluster_id, distance from (select *, row_number() over (partition by doi order by distance, cluster_id) as r from (
select a.doi, a.cluster_id, a.distance from assignments a union all select doi, (cluster_id + 3) % 10, round(1 - distance, 6) from assignments) where cluster_id in (select id from clusters where not archived)) where r = 1""")(
    lambda t: R.nearest_cluster(t.assignments.select("doi", "cluster_id", "distance").union(t.assignments.selectExpr("doi", "(cluster_id + 3) % 10", "round(1 - distance, 6)")), t.clusters))
query("win_latest_breakdown", "select doi, breakdown from (select *, row_number() over (partition by doi order by run_id desc, id desc, breakdown desc) as r from results where breakdown is not null and doi is not null) where r = 1")(
    lambda t: R.latest_breakdown(R.top_per_group(t.results, ["doi", "run_id", "id"], [F.desc_nulls_last("breakdown")], 1)))
query("topk_run_papers", "select run_id, id, score, place from (select run_id, id, score, row_number() over (partition by run_id order by score desc, id, part) as place from results) where place <= 5")(
    lambda t: R.top_per_group(t.results, ["run_id"], [F.desc("score"), F.col("id"), F.col("part")], 5).select("run_id", "id", "score", "place"))
query("topk_entities", """select * from (select c.canonical_id, e.type, e.surface, n_papers, row_number() over (partition by type order by n_papers desc, c.canonical_id) as place from
(select canonical_id, count(distinct doi) as n_papers from mentions group by canonical_id) c join entities e on c.canonical_id = e.canonical_id where e.type is not null) where place <= 10""")(
    lambda t: R.top_entities(t.mentions, t.entities, 10))
query("topk_query_terms", """select theme, string_agg(case when contains(term, ' ') then '"' || term || '"' else term end, ' OR ' order by place) as query from (
select theme, term, row_number() over (partition by theme order by length(term), pos) as place from (select brand as theme, min(canonical_id) as pos, surface as term from entities group by 1, 3)) where place <= 4 group by theme""")(
    lambda t: R.query_terms(t.entities.groupBy(F.col("brand").alias("theme"), F.col("surface").alias("term")).agg(F.min("canonical_id").alias("pos"))))
query("page_feedback", "select id, signal_type from feedback where created_at >= timestamp '2024-01-05' order by created_at desc, id desc limit 50 offset 100")(
    lambda t: R.page(t.feedback.filter("created_at >= timestamp_ntz '2024-01-05'"), [F.desc("created_at"), F.desc("id")], 50, 100).select("id", "signal_type"))
query("page_runs", "select id, (select count(*) from runs where status = 'F') as total from runs where status = 'F' order by started_at desc, id desc limit 20 offset 40")(
    lambda t: R.page(t.runs.filter("status = 'F'"), [F.desc("started_at"), F.desc("id")], 20, 40).select("id", F.lit(t.runs.filter("status = 'F'").count()).alias("total")))
query("page_trending", f"select canonical_id, n_new from ({TRENDING}) where n_new > n_prev order by n_new desc, canonical_id limit 100")(
    lambda t: R.page(R.trending_counts(t.mentions, "2000-06-01", top=None).filter("n_new > n_prev"), [F.desc("n_new"), F.col("canonical_id")], 100).select("canonical_id", "n_new"))

query("set_search_dedup", """select doi, source_order, position from (select *, row_number() over (partition by k order by source_order, position) as r from (
select *, case when doi <> '' then 'd:' || doi when source_order = 0 then 't:' || lower(substring(title, 1, 60)) end as k from (
select coalesce(doi, '') as doi, concat('Title ', part) as title, 0 as source_order, id * 10000 + part as position from results where run_id % 2 = 0 union all
select coalesce(doi, ''), concat('Title ', part), 1, id * 10000 + part from results)) where k is not null) where r = 1""")(
    lambda t: R.search_dedup(t.results.filter("run_id % 2 = 0").selectExpr("coalesce(doi, '') as doi", "concat('Title ', part) as title", "0 as source_order", "id * 10000 + part as position")
                             .unionByName(t.results.selectExpr("coalesce(doi, '') as doi", "concat('Title ', part) as title", "1 as source_order", "id * 10000 + part as position"))).select("doi", "source_order", "position"))
query("set_relation_union", "select doi from mentions where canonical_id = 77 union select source from cites where target like '10.1/77%'")(
    lambda t: R.relation_union(t.mentions.filter("canonical_id = 77"), cites(t.papers).filter("target like '10.1/77%'").withColumnRenamed("source", "doi")))
query("set_mentions_merge", """select distinct doi, canonical_id, source, field, span_start from (select doi, canonical_id, source, field, cast(null as int) as span_start, cast(null as int) as span_end from mentions where source <> 'R'
union all select doi, canonical_id, source, field, line, line + 3 from mentions where source <> 'A')""")(
    lambda t: R.mentions_merge(t.mentions.filter("source <> 'R'").selectExpr("doi", "canonical_id", "source", "field", "cast(null as int) as span_start", "cast(null as int) as span_end"),
                               t.mentions.filter("source <> 'A'").selectExpr("doi", "canonical_id", "source", "field", "line as span_start", "line + 3 as span_end")).select("doi", "canonical_id", "source", "field", "span_start"))
query("set_case_dedup", """with f as (select brand, lower(surface) as s, min(canonical_id) as position from entities group by 1, 2),
k as (select * from (select *, row_number() over (partition by brand order by position) as r from f) where r <= 6),
o as (select brand, s, position, row_number() over (partition by s order by brand, position) as r2 from k) select brand, s as surface, position from o where r2 = 1 order by brand, position limit 40""")(
    lambda t: R.case_dedup(t.entities.select("brand", F.initcap("surface").alias("surface"), F.col("canonical_id").alias("position")), "surface", "brand", 6, 40).withColumn("surface", F.lower("surface")))


def _by_day(t):
    """The papers laid out by the day of their last update."""
    path = shared_path(t.spark, "papers-by-day")
    D.write_days(t.papers.select("doi", "last_updated"), "last_updated", path)
    return path


# Days, quarantine and sketches. The feedback and answers are the tables' own, with every 17th signal, every 13th rating
# and some answers spoilt.
query("flt_window_days", "select doi from papers where last_updated >= timestamp '1997-03-01' and last_updated <= timestamp '1998-03-01'")(
    lambda t: D.read_days(t.spark, _by_day(t), "last_updated", "1997-03-01", "1998-03-01").select("doi"))
query("inc_newest_day", "select max(last_updated) as last_updated from papers")(lambda t: D.newest(t.spark, _by_day(t), "last_updated"))
query("flt_feedback_quarantine", """select id, reasons = '' as accepted, reasons from (select id, concat_ws(',',
case when not known then 'signal' end, case when known and s = 'rated' and not coalesce(r between 1 and 5, false) then 'rating' end,
case when known and s <> 'rated' and r is not null then 'stray_rating' end) as reasons
from (select *, coalesce(s in ('rated', 'opened', 'saved', 'dismissed', 'thumbs_up', 'thumbs_down'), false) as known
from (select id, case when id % 17 = 0 then 'liked' when id % 19 <> 0 then signal_type end as s, case when id % 13 = 0 then 9 else rating end as r from feedback)))""")(
    lambda t: Q.divide(t.feedback.selectExpr("id", "case when id % 17 = 0 then 'liked' when id % 19 <> 0 then signal_type end as signal_type", "case when id % 13 = 0 then 9 else rating end as rating"),
                       Q.feedback_rules()).labelled("id"))
query("flt_answer_quarantine", """select key, reasons = '' as accepted, reasons from (select key,
case when coalesce(trim(a), '') = '' then 'empty' when not json_valid(a) then 'invalid' else '' end as reasons
from (select key, case key % 7 when 0 then '  ' when 1 then extraction || ' and more' when 2 then 'none' else extraction end as a from papers))""")(
    lambda t: Q.divide(t.papers.selectExpr("key", "case key % 7 when 0 then '  ' when 1 then extraction || ' and more' when 2 then 'none' else extraction end as answer"), Q.answer_rules()).labelled("key"))
query("flt_item_quarantine", "select key, key % 11 <> 0 as accepted, case when key % 11 <> 0 then '' else 'title' end as reasons from papers")(
    lambda t: Q.divide(t.papers.select("key", F.expr("case when key % 11 <> 0 then title else '  ' end").alias("title")), Q.item_rules()).labelled("key"))
query("agg_mentions_by_source_sketch")(
    lambda t: K.distinct_counts(K.daily_sketches(t.mentions, "extracted_at", "canonical_id", ["source"]), ["source"], "n_entities"))
