"""Registered queries of the entity and citation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibliodyne.operators import graph as G
from bibliodyne.operators.relational import library, trending_counts
from bibliodyne.plans.registry import query
from bibliodyne.plans.relational import TRENDING
from bibliodyne.plans.standins import cites
from bibliodyne.session import materialize

EDGES = "edges as (select distinct doi, canonical_id from mentions)"
PAIRS = "pairs as (select a.doi, b.doi as other, count(*) as n_shared from edges a join edges b on a.canonical_id = b.canonical_id and a.doi <> b.doi where {0} group by 1, 2)"
SIMILAR = f"with {EDGES}, {PAIRS.format('1 = 1')} select doi, other, n_shared, rank from (select *, row_number() over (partition by doi order by n_shared desc, other) as rank from pairs) where rank <= 10"

query("gr_similar_papers", SIMILAR)(lambda t: G.similar_papers(t.mentions))
query("gr_papers_by_entities", """select query_id, doi, count(distinct m.canonical_id) as n_shared from mentions m join (select brand as query_id, canonical_id from entities) w on m.canonical_id = w.canonical_id group by 1, 2""")(
    lambda t: G.papers_by_entities(t.mentions, t.entities.selectExpr("brand as query_id", "canonical_id")))
query("gr_find_by_entity", "select doi, title from papers where doi in (select doi from mentions where canonical_id in (select canonical_id from entities where lower(surface) = 'small ring'))")(
    lambda t: G.find_by_entity(t.mentions, t.entities, t.papers, "Small Ring").select("doi", "title"))
query("gr_neighborhood", """select canonical_id, other, n_paths, place from (select *, row_number() over (partition by canonical_id order by n_paths desc, other) as place from (
select a.canonical_id, b.canonical_id as other, count(*) as n_paths from mentions a join mentions b on a.doi = b.doi and a.canonical_id <> b.canonical_id group by 1, 2)) where place <= 25""")(
    lambda t: G.neighborhood(t.mentions, t.entities))
query("gr_co_occurrence", f"""with {EDGES}, d as (select canonical_id, count(*) as n from edges group by 1), terms as (select distinct substring(surface, 1, 5) as term from entities),
seed as (select term, canonical_id from (select term, e.canonical_id, row_number() over (partition by term order by n desc, e.canonical_id) as r from entities e join terms on contains(lower(surface), lower(term)) join d on e.canonical_id = d.canonical_id) where r = 1)
select term, other, n_papers, place from (select term, other, n_papers, row_number() over (partition by term order by n_papers desc, other) as place from (
select term, b.canonical_id as other, count(distinct a.doi) as n_papers from seed s join edges a on s.canonical_id = a.canonical_id join edges b on a.doi = b.doi and a.canonical_id <> b.canonical_id group by 1, 2)) where place <= 3""")(
    lambda t: G.co_occurrence(t.mentions, t.entities, t.entities.select(F.substring("surface", 1, 5).alias("term")).distinct()))
CENTRAL = "central as (select * from (select cluster_id, canonical_id, n_papers, row_number() over (partition by cluster_id order by n_papers desc, canonical_id) as place from (select cluster_id, canonical_id, count(distinct e.doi) as n_papers from edges e join assignments a on e.doi = a.doi group by 1, 2)) where place <= {0})"
query("gr_central_entities", f"with {EDGES}, {CENTRAL.format(5)} select * from central")(lambda t: G.central_entities(t.mentions, t.assignments))
query("gr_exploration_queries", f"""with {EDGES}, {CENTRAL.format(3)}, near as (select * from (select *, row_number() over (partition by canonical_id order by n_paths desc, other) as near_place from (
select a.canonical_id, b.canonical_id as other, count(*) as n_paths from mentions a join mentions b on a.doi = b.doi and a.canonical_id <> b.canonical_id where a.canonical_id in (select canonical_id from central) group by 1, 2)) where near_place <= 3),
both_parts as (select c.cluster_id, c.place as sp, 0 as np, 0 as part, lower(e.surface) as q from central c join entities e on c.canonical_id = e.canonical_id union all
select c.cluster_id, c.place, n.near_place, 1, lower(e.surface) from central c join near n on c.canonical_id = n.canonical_id join entities e on n.other = e.canonical_id),
once as (select * from (select *, row_number() over (partition by cluster_id, q order by part, sp, np) as r from both_parts) where r = 1)
select cluster_id, place, q as query from (select *, row_number() over (partition by cluster_id order by part, sp, np) as place from once) where place <= 5""")(
    lambda t: G.exploration_queries(t.mentions, t.entities, t.assignments))
query("gr_paper_snapshot", f"""with {EDGES} select p.doi, coalesce(e.n, 0) as n_types, coalesce(e.m, 0) as n_entities, coalesce(o.n, '') as cites, coalesce(i.n, '') as cited_by from papers p
left join (select doi, count(distinct type) as n, count(*) as m from edges join entities using (canonical_id) where type is not null group by doi) e on p.doi = e.doi
left join (select source, string_agg(distinct target, ',' order by target) as n from cites group by 1) o on p.doi = o.source left join (select target, string_agg(distinct source, ',' order by source) as n from cites group by 1) i on p.doi = i.target""")(
    lambda t: G.paper_snapshot(t.papers, t.mentions, t.entities, cites(t.papers)).select(
        "doi", F.coalesce(F.size("entities"), F.lit(0)).alias("n_types"), F.coalesce(F.size(F.flatten(F.map_values("entities"))), F.lit(0)).alias("n_entities"),
        *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("cites", "cited_by")]))


def signals(t):
    """Signals of discovered papers; what a paper cites it extends or compares to."""
    cited = materialize(cites(t.papers), "cites")
    edges = cited.select(F.col("source").alias("doi"), F.expr("case when length(source) % 2 = 0 then 'EXTENDS' else 'COMPARES_TO' end").alias("predicate"), F.col("target").alias("target_id"))
    return G.candidate_signals(t.papers.filter("status = 'discovered'"), t.mentions, cited, library(t.papers), t.mentions.select("doi", F.col("supplier").alias("author")), edges)


def _gated(t):
    """Names of researchers against author texts; a paper is one supplier's, so that texts are per paper."""
    paper = F.concat_ws("/", "doi", "supplier").alias("doi")
    text = F.concat(F.lit("Author "), "supplier", F.lit(" and Author "), F.col("supplier") % 7).alias("author")
    names = t.mentions.select(F.concat(F.lit("Author "), F.col("supplier") % 100).alias("author"))
    return G.researcher_gate(t.mentions.select(paper, text), t.mentions.select(paper, "canonical_id"), t.entities.filter("type = 'promo'"), 3, names)


LIB = "lib as (select doi from papers where status is null or status <> 'discovered'), cand as (select doi from papers where status = 'discovered')"
query("gr_candidate_signals", f"""with {EDGES}, {LIB}, a as (select doi, supplier as author from mentions)
select c.doi, coalesce(s.n, 0) as n_shared_entities, coalesce(o.n, 0) as n_cites_out, coalesce(i.n, 0) as n_cites_in, coalesce(r.e, 0) as n_extends, coalesce(r.k, 0) as n_compares, coalesce(x.n, 0) as n_shared_authors, coalesce(x.some, '') as shared_authors_sample from cand c
left join (select doi, count(*) as n from edges where canonical_id in (select canonical_id from edges where doi in (select doi from lib)) group by doi) s on c.doi = s.doi
left join (select source, count(*) as n from cites where target in (select doi from lib) group by 1) o on c.doi = o.source
left join (select target, count(*) as n from cites where source in (select doi from lib) group by 1) i on c.doi = i.target
left join (select source, count(*) filter (length(source) % 2 = 0) as e, count(*) filter (length(source) % 2 = 1) as k from cites where target in (select doi from lib) group by 1) r on c.doi = r.source
left join (select doi, count(distinct author) as n, array_to_string(list_sort(list(distinct author))[1:3], ',') as some from a where author in (select author from a where doi in (select doi from lib)) group by doi) x on c.doi = x.doi""")(
    lambda t: signals(t).withColumn("shared_authors_sample", F.array_join(F.transform("shared_authors_sample", lambda a: a.cast("string")), ",")))
# "Author 1" is contained in the texts of authors 1, 10, 11 and so on.
query("gr_researcher_gate", """with texts as (select distinct m.doi, m.canonical_id, concat('Author ', supplier, ' and Author ', supplier % 7) as text from mentions m join entities e on m.canonical_id = e.canonical_id where e.type = 'promo'),
names as (select distinct concat('Author ', supplier % 100) as author from mentions)
select author from (select author, count(distinct canonical_id) as n from names join (select distinct text, canonical_id from texts) on contains(text, author) group by 1) where n >= 3""")(lambda t: _gated(t))
query("gr_trending", f"""with c as ({TRENDING}) select c.canonical_id, n_new, n_prev, n_new / greatest(n_prev, 1)::double - 1 as growth, type, surface, exists (select 1 from entities t where t.canonical_id % 3 = 0 and contains(lower(t.surface), lower(e.surface))) as in_topics
from c join entities e on c.canonical_id = e.canonical_id where n_new >= 2 and n_new / greatest(n_prev, 1)::double - 1 >= 0.3 and lower(surface) not in (select lower(surface) from entities where canonical_id % 7 = 3 and brand = 'Brand#1')""")(
    lambda t: G.trending(trending_counts(t.mentions, "2000-06-01", top=None), t.entities, t.entities.filter("canonical_id % 7 = 3 and brand = 'Brand#1'").select(F.col("surface").alias("concept_text")), t.entities.filter("canonical_id % 3 = 0").select(F.col("surface").alias("topic")), 2))
query("gr_graph_rebuild", f"""with {LIB} select 'graph_papers' as name, doi as a, '' as b, '' as c from lib union all select distinct 'mentions', doi, cast(canonical_id as varchar), field from mentions where doi in (select doi from lib)
union all select distinct 'relations', source, target, '' from cites where source in (select doi from lib) and target in (select doi from lib)""")(
    lambda t: _rows(G.graph_rebuild(library(t.papers), t.mentions, cites(t.papers))))


def _rows(tables):
    keys = {"graph_papers": ["doi"], "mentions": ["doi", "canonical_id", "field"], "relations": ["source", "target"]}
    out = None
    for name, df in tables.items():
        columns = [F.col(c).cast("string") for c in keys[name]] + [F.lit("")] * (3 - len(keys[name]))
        rows = df.select(F.lit(name).alias("name"), *[x.alias(c) for x, c in zip(columns, "abc", strict=True)])
        out = rows if out is None else out.union(rows)
    return out


def _typed(t):
    """Mentions with a relation type and surface."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("method", "material", "topic", "keyword", "author")]), (F.col("canonical_id") % 5 + 1).cast("int"))
    return t.mentions.join(t.entities.select("canonical_id", "surface"), "canonical_id").select("doi", "canonical_id", "source", "line", "surface", kind.alias("type"))


TYPED = "typed as (select m.doi, m.canonical_id, m.source, m.line, e.surface, (m.canonical_id % 5) + 1 as r from mentions m join entities e on m.canonical_id = e.canonical_id)"
query("jn_relation_targets", f"""with {TYPED}, w as (select distinct doi, surface from typed where source = 'A')
select doi, surface, canonical_id as target_id from (select w.doi, w.surface, t.canonical_id, row_number() over (partition by w.doi, w.surface order by r, t.canonical_id) as k from w join typed t on w.doi = t.doi and lower(w.surface) = lower(t.surface) where r <= 4) where k = 1""")(
    lambda t: G.relation_targets(_typed(t).filter("source = 'A'").select("doi", "surface").distinct(), _typed(t)))
query("er_relations_schema", f"""with {TYPED}, f as (select distinct doi, surface, case source when 'A' then 'DEPENDS_ON' when 'N' then 'PROPOSES' end as predicate from typed where source <> 'R')
select distinct f.doi, predicate, target_id, 'Entity' as target_kind from f join (select doi, s, canonical_id as target_id from (select doi, lower(surface) as s, canonical_id, row_number() over (partition by doi, lower(surface) order by r, canonical_id) as k from typed where r <= 4) where k = 1) x on f.doi = x.doi and lower(f.surface) = x.s""")(
    lambda t: G.relations_from_fields(_typed(t).withColumn("field", F.expr("case source when 'A' then 'assumptions' when 'N' then 'future_work' else 'depends_on' end")).select("doi", "field", "surface"), _typed(t)))
query("er_relations_merge", """select distinct doi, predicate, target_id, prompt_version from (select doi, 'PROPOSES' as predicate, canonical_id as target_id, 'schema-1' as prompt_version from mentions where source = 'A'
union all select doi, 'PROPOSES', canonical_id, 'model-2' from mentions where source <> 'N')""")(
    lambda t: G.merge_relations((t.mentions.filter("source = 'A'").selectExpr("doi", "'PROPOSES' as predicate", "canonical_id as target_id"), "schema-1"), (t.mentions.filter("source <> 'N'").selectExpr("doi", "'PROPOSES' as predicate", "canonical_id as target_id"), "model-2")))
query("jn_compares_to", "select distinct source as doi, 'COMPARES_TO' as predicate, target as target_id from cites where source in (select doi from papers where status = 'complete')")(
    lambda t: G.compares_to(t.papers.withColumn("comparison_to_prior", F.when(F.col("status") == "complete", "better").otherwise(" ")), cites(t.papers)))
query("flt_relation_valid", "select source_doi, predicate, target_id from (select doi as source_doi, case source when 'A' then 'CITES' when 'N' then 'LIKES' else 'PROPOSES' end as predicate, case when line <> 2 then cast(canonical_id as varchar) else ' ' end as target_id, case when field = 'F' then 'Entity' else 'Thing' end as target_kind from mentions) where predicate <> 'LIKES' and trim(target_id) <> '' and target_kind = 'Entity'")(
    lambda t: G.valid_relations(t.mentions.selectExpr("doi as source_doi", "case source when 'A' then 'CITES' when 'N' then 'LIKES' else 'PROPOSES' end as predicate", "case when line <> 2 then cast(canonical_id as string) else ' ' end as target_id", "case when field = 'F' then 'Entity' else 'Thing' end as target_kind")).select("source_doi", "predicate", "target_id"))
query("flt_triple_valid", """select doi, pos, reject from (select doi, pos, case when reject is null and row_number() over (partition by doi, reject is null order by pos) > 2 then 'too many' else reject end as reject from (
select doi, pos, case when field = 'O' and source = 'R' then 'subject' when source = 'N' then 'predicate' when confidence < 0.5 then 'confidence' end as reject from (select *, row_number() over (partition by doi order by line, canonical_id, source, field, supplier, confidence) as pos from mentions)))""")(
    lambda t: G.judge_triples(t.mentions.withColumn("pos", F.expr("row_number() over (partition by doi order by line, canonical_id, source, field, supplier, confidence)")).selectExpr(
        "doi", "pos", "case when field = 'O' and source = 'R' then 'other' else upper(doi) end as subject", "case when source = 'N' then 'LIKES' else 'PROPOSES' end as predicate", "cast(canonical_id as string) as object", "'Entity' as kind", "confidence"), 2).select("doi", "pos", "reject"))
query("er_extract_entities", """with r as (select m.doi, e.surface as s, m.supplier, m.field as journal from mentions m join entities e on m.canonical_id = e.canonical_id)
select distinct doi, s as canonical_id, 'method' as type, 'methods_summary' as field, 0 as span_start from r union all
select distinct doi, case when s like 's%' then 'canon ' || s else s end, 'topic', 'discovered_topics', null from r union all
select distinct doi, s, 'keyword', null, null from r union all select distinct doi, concat('author', supplier), 'author', null, null from r union all select distinct doi, 'journal of ' || lower(journal), 'journal', null, null from r""")(
    lambda t: G.extract_entities(t.mentions.join(t.entities.select("canonical_id", "surface"), "canonical_id").select(
        "doi", F.to_json(F.struct(F.concat(F.lit(" "), F.upper("surface")).alias("methods_summary"), F.array(F.concat("surface", F.lit("s.")), F.lit(" ")).alias("discovered_topics"), F.lit(None).cast("string").alias("novelty_statement"))).alias("extraction"),
        F.array("surface").alias("keywords"), F.array(F.concat(F.lit("Author"), "supplier")).alias("authors"), F.concat(F.lit("Journal of "), "field").alias("journal")),
        t.entities.filter("surface like 's%'").select(F.lit("topic").alias("type"), "surface", F.concat(F.lit("canon "), "surface").alias("canonical")).distinct()).select("doi", "canonical_id", "type", "field", "span_start"))
query("er_ner_mentions", "select doi, surface as canonical_id, case when label = 'DISEASE' then 'topic' else 'method' end as type, line as span_start from (select doi, lower(surface) as surface, line, case source when 'A' then 'DISEASE' when 'N' then 'TECHNIQUE' else 'GENE' end as label from mentions m join entities e on m.canonical_id = e.canonical_id) where label <> 'GENE'")(
    lambda t: G.ner_mentions(t.mentions.join(t.entities.select("canonical_id", "surface"), "canonical_id").selectExpr("doi", "surface as text", "case source when 'A' then 'b-disease' when 'N' then 'LAB_TECHNIQUE' else 'GENE' end as label", "line as start", "line + 5 as end", "confidence")).select("doi", "canonical_id", "type", "span_start"))
NAMED = "named as (select m.doi, lower(e.surface) as canonical_id, m.line, m.source as src, m.field from mentions m join entities e on m.canonical_id = e.canonical_id)"


def _named(t):
    return t.mentions.join(t.entities.select("canonical_id", F.col("surface").alias("text")), "canonical_id").select("doi", "text", "line", "source", "field", "confidence")


def _answers(t):
    item = "concat('{\"surface\": \"', text, '\", \"type\": \"topic\", \"span_start\": ', line, ', \"span_end\": 9}')"
    check = "concat('{\"surface\": \"', text, '\", \"keep\": ', field = 'F', ', \"reason\": \"r\"}')"
    return _named(t).filter("source <> 'R'").select("doi", F.expr(f"case when line = 7 then '{{bad' else concat('{{\"new_entities\": [', {item}, '], \"validations\": [', {check}, ']}}') end").alias("answer"))


MODEL = "select doi, canonical_id, 'topic' as type, line as span_start from named where src <> 'R' and line <> 7 union all select doi, canonical_id, 'material', null from named where src <> 'R' and line <> 7 and field = 'F'"
query("er_model_mentions", f"with {NAMED} {MODEL}")(lambda t: G.model_mentions(_answers(t)).select("doi", "canonical_id", "type", "span_start"))
query("er_build_mentions", f"""with {NAMED} select distinct doi, canonical_id, 'schema' as source, field, cast(null as int) as span_start from named
union all select distinct doi, canonical_id, 'biobert', null, line from named where src = 'A' union all select distinct doi, canonical_id, 'llm_cloud', null, span_start from ({MODEL})""")(
    lambda t: G.build_mentions(_named(t).select("doi", F.lower("text").alias("canonical_id"), F.lit("topic").alias("type"), F.lit("schema").alias("source"), "field"),
                               _named(t).filter("source = 'A'").selectExpr("doi", "text", "'METHOD' as label", "line as start", "9 as end", "confidence"), _answers(t)).select("doi", "canonical_id", "source", "field", "span_start"))
