"""Registered queries of column jobs, text jobs, fuzzy matching and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibliodyne.functions import scalar as S
from bibliodyne.functions import text as T
from bibliodyne.operators import fuzzy as Z
from bibliodyne.operators import quality as Q
from bibliodyne.plans.registry import query
from bibliodyne.plans.vectors import DECAY, NOW, SIGN, VEC, WEIGHT, vecs

DIRTY = "case key % 4 when 0 then concat('  DOI: ', upper(doi), '/ ') when 1 then concat('https://doi.org/', doi) when 2 then concat('HTTP://DX.DOI.ORG/', doi, '//') end"
query("fn_normalize_doi", "select key, case when key % 4 = 3 then '' else doi end as doi from papers")(
    lambda t: t.papers.select("key", S.normalize_doi(F.expr(DIRTY)).alias("doi")))
query("fn_embed_text", "select key, concat_ws(' ', title, nullif(case when key % 3 <> 0 then journal else '' end, ''), status) as text from papers")(
    lambda t: t.papers.select("key", S.embed_text(F.col("title"), F.expr("case when key % 3 <> 0 then journal else '' end"), F.col("status")).alias("text")))
query("fn_query_text", "select doc_id, concat_ws(' ', nullif(source, ''), nullif(substring(text, 1, 500), '')) as text from documents")(
    lambda t: t.raw("documents").select("doc_id", S.query_text(F.col("source"), F.col("text")).alias("text")))
query("fn_focused_query", "select doc_id, coalesce(nullif(concat_ws(' ', case when doc_id % 2 = 0 then source end, case when doc_id % 2 = 0 then lang end), ''), substring(text, 1, 300)) as text from documents")(
    lambda t: t.raw("documents").select("doc_id", S.focused_query(F.expr("case when doc_id % 2 = 0 then source end"), F.expr("case when doc_id % 2 = 0 then lang end"), F.lit(None), F.col("text"), 300).alias("text")))
query("fn_parse_authors_json", "select c_custkey as id, case when c_custkey % 2 = 0 then c_name || '|' || c_mktsegment || ', F' else c_mktsegment end as authors from customer")(
    lambda t: t.raw("customer").select(F.col("c_custkey").alias("id"), F.array_join(S.parse_authors(F.expr(
        "case when c_custkey % 2 = 0 then concat('[\"', c_name, ' \", {\"lastName\": \"', c_mktsegment, '\", \"firstName\": \"F\"}, \"  \"]') else concat('[{\"last\": \"', c_mktsegment, '\"}]') end")), "|").alias("authors")))
query("fn_parse_json_strings", "select c_custkey as id, c_name as strings from customer")(
    lambda t: t.raw("customer").select(F.col("c_custkey").alias("id"), F.array_join(S.parse_json_strings(F.expr("concat('[\" ', c_name, '\", ', c_custkey, ', \"\", null, {\"a\": 1}]')")), "|").alias("strings")))
query("fn_split_authors", "select c_custkey as id, c_name || '|' || c_mktsegment as authors from customer")(
    lambda t: t.raw("customer").select(F.col("c_custkey").alias("id"), F.array_join(S.split_authors(F.expr("concat(c_name, '; ', c_mktsegment, ';;', c_name, ' ;')")), "|").alias("authors")))
query("fn_parse_year", "select key, case when key % 3 = 0 then 0 else year end as parsed from papers")(
    lambda t: t.papers.select("key", S.parse_year(F.expr("case key % 3 when 0 then 'n.d.' when 1 then concat(year, '-03-01') else concat('03-', year) end")).alias("parsed")))
query("fn_inverted_abstract", "select key, concat(journal, ' ', source_type, ' ', journal) as text from (select key, replace(journal, ' ', '_') as journal, source_type from papers)")(
    lambda t: t.papers.select("key", S.inverted_abstract(F.create_map(F.replace("journal", F.lit(" "), F.lit("_")), F.array(F.lit(0), F.lit(2)), F.col("source_type"), F.array(F.lit(1)))).alias("text")))
query("fn_detect_review", "select key, key % 5 = 0 or key % 7 = 0 or key % 11 = 0 as is_review from papers")(
    lambda t: t.papers.select("key", S.detect_review(F.expr("case when key % 5 = 0 then array('Review') else array('Article') end"), F.expr("case when key % 7 = 0 then 'A Systematic Review of x' else title end"), F.lit(None), F.expr("case when key % 11 = 0 then 'Nature Reviews X' end")).alias("is_review")))
query("fn_feedback_weight", f"select id, round({WEIGHT}, 6) as weight from feedback")(lambda t: t.feedback.select("id", F.round(S.feedback_weight(F.col("signal_type"), F.col("rating")), 6).alias("weight")))
query("fn_signal_sign", f"select id, {SIGN} as sign from feedback")(lambda t: t.feedback.select("id", S.signal_sign(F.col("signal_type"), F.col("rating")).alias("sign")))
query("fn_time_decay", f"select id, round({DECAY}, 9) as decay from feedback")(lambda t: t.feedback.select("id", F.round(S.time_decay(F.col("created_at"), F.lit(NOW).cast("timestamp_ntz")), 9).alias("decay")))
query("fn_soft_gate", "select c_custkey as id, case when c_custkey < 10 then 0 else c_custkey / (c_custkey + 30.0) end as gate from customer")(
    lambda t: t.raw("customer").select(F.col("c_custkey").alias("id"), S.soft_gate(F.col("c_custkey")).alias("gate")))
query("fn_growth_rate", "select canonical_id, n_new / greatest(n_prev, 1)::double - 1 as growth from (select canonical_id, count(*) filter (source = 'A') as n_new, count(*) filter (source = 'N') as n_prev from mentions group by 1)")(
    lambda t: t.mentions.groupBy("canonical_id").agg(F.count_if(F.col("source") == "A").alias("n"), F.count_if(F.col("source") == "N").alias("p")).select("canonical_id", S.growth_rate(F.col("n"), F.col("p")).alias("growth")))
FIELDS = "fields as (select doi, cast(line as varchar) as field, case when canonical_id % 6 = 0 then '  ' else source end as value, case when canonical_id % 4 = 0 then 'sure' when canonical_id % 4 = 1 then 'inferred' else 'explicit' end as confidence, canonical_id from mentions)"
query("fn_normalise_extraction", f"""with {FIELDS} select doi, field, case when trim(value) = '' or (field = '2' and value = 'R') then null else value end as value,
case when trim(value) = '' or (field = '2' and value = 'R') then 'absent' when confidence = 'sure' then 'explicit' else confidence end as confidence, field = '2' and value = 'R' as violation from fields""")(
    lambda t: Q.normalise_extraction(t.mentions.selectExpr("doi", "cast(line as string) as field", "case when canonical_id % 6 = 0 then '  ' else source end as value", "case when canonical_id % 4 = 0 then 'sure' when canonical_id % 4 = 1 then 'inferred' else 'explicit' end as confidence"),
                                     t.spark.createDataFrame([("2", ["A", "N"]), ("3", None)], "field string, valid_values array<string>")))
query("fn_parse_model_json", "select key, case when key % 3 <> 2 then key end as a from papers")(
    lambda t: t.papers.select("key", F.try_variant_get(S.parse_model_json(F.expr("case key % 3 when 0 then concat('<think>x {\"a\": 9}\n</think>```json\n{\"a\": ', key, '}\n```') when 1 then concat('{\"a\": ', key, '}') else concat('{\"a\": ', key) end")), "$.a", "long").alias("a")))
query("fn_confidence_score", "select key, round((1 + case when key % 2 = 0 then 0.5 else 0 end + 0) / 3.0, 3) as score from papers")(
    lambda t: t.papers.select("key", S.confidence_score(F.expr("map('a', 'x', 'a_confidence', 'explicit', 'b_confidence', case when key % 2 = 0 then 'inferred' else 'absent' end, 'c_confidence', 'absent', '_overall_confidence', '1')")).alias("score")))
query("fn_overall_confidence", "select key, cast(json_extract_string(extraction, '$._overall_confidence') as double) as confidence from papers")(lambda t: t.papers.select("key", S.overall_confidence(F.col("extraction")).alias("confidence")))
query("fn_excerpt", "select doc_id, case when length(text) > 200 then regexp_replace(substring(text, 1, 200), ' [^ ]*$', '') || '…' else text end as excerpt from (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from documents)")(
    lambda t: t.raw("documents").select("doc_id", S.excerpt(F.col("text")).alias("excerpt")))
# Fixed values of the oracle: heading lines of reference lists and of end matter.
REFS_SQL = "references|bibliography|works[ \\t]+cited|literature[ \\t]+cited|reference[ \\t]+list|cited[ \\t]+works|citations"
END_SQL = REFS_SQL + "|acknowledge?ments?|funding(?:[ \\t]+information)?|conflicts?[ \\t]+of[ \\t]+interests?|competing[ \\t]+interests?|author[ \\t]+contributions?|data[ \\t]+availability(?:[ \\t]+statement)?|code[ \\t]+availability(?:[ \\t]+statement)?|supplementary[ \\t]+(?:information|material|data)|supporting[ \\t]+information"
STRIP = """select doc_id, case when regexp_matches(tail, '(?i){1}') then regexp_replace(substring(text, 1, greatest(s - 1, 0)) || regexp_replace(tail, '(?is){1}.*', ''), '\\s+$', '') else text end as text
from (select *, substring(text, greatest(s, 1)) as tail from (select *, cast(floor(length(text) * 0.7::double) as bigint) as s from (select doc_id, {0} as text from documents)))"""
LINE = "\\n(?:#{{1,3}}[ \\t]*)?(?:{0})[ \\t]*(?::[ \\t]*)?(?:\\n|$)"
WITH_REFS = "case doc_id % 3 when 0 then concat(text, '{0}## Reference List{0}[1] A{0}[2] B') when 1 then concat(text, '{0}Citations: see below{0}') else concat(text, ' ') end"
WITH_END = "case doc_id % 3 when 0 then concat(text, '{0}Funding information:{0}Thanks.') when 1 then concat(text, '{0}# Supporting Information{0}S1') else concat(text, '{0}Appendix{0}A') end"
query("fn_strip_references", STRIP.format(WITH_REFS.format("' || chr(10) || '"), LINE.format(REFS_SQL)))(
    lambda t: t.raw("documents").select("doc_id", S.strip_references(F.expr(WITH_REFS.format("\n"))).alias("text")))
query("fn_strip_end_matter", STRIP.format(WITH_END.format("' || chr(10) || '"), LINE.format(END_SQL)))(
    lambda t: t.raw("documents").select("doc_id", S.strip_end_matter(F.expr(WITH_END.format("\n"))).alias("text")))
# A stop before a blank is no trailing one, and keeps the plural.
query("fn_basic_normalize", "select distinct surface, case when surface like '%ring' then surface || 's.' else surface end as normalized from entities")(
    lambda t: T.basic_normalize(t.entities.select(F.concat(F.upper("surface"), F.when(F.endswith("surface", F.lit("ring")), "s. ").otherwise("s.;")).alias("raw"), "surface").distinct(), "raw").select("surface", "normalized")
)
query("fn_chunk_markdown")(lambda t: T.chunk_markdown(t.raw("documents").select(F.col("doc_id").cast("string").alias("doi"), "text")))
query("fn_split_windows", "select doc_id, md5(text) as joined from documents where length(text) > 0")(
    lambda t: T.split_windows(t.raw("documents").select(F.col("doc_id").cast("string").alias("doi"), "text"), 2000).groupBy("doi").agg(F.array_sort(F.collect_list(F.struct("window", "text"))).alias("w"))
    .select(F.col("doi").cast("long").alias("doc_id"), F.md5(F.array_join(F.transform("w", lambda x: x["text"]), "")).alias("joined")))

def surfaces(t):
    """Entity and customer segment names with numbers: short strings that are near each other."""
    return t.entities.select(F.concat_ws(" ", "surface", "brand").alias("term")).distinct()


def vocab(t):
    return t.entities.filter("canonical_id % 3 = 0").select(F.lit("topic").alias("type"), F.concat_ws(" ", "surface", "brand").alias("canonical")).distinct()


query("er_fuzzy_ratio")(lambda t: Z.fuzzy_pairs(surfaces(t).select(F.col("term").alias("a")), surfaces(t).select(F.col("term").alias("b")), 90.0, same=True))
query("er_keyword_canon")(lambda t: Z.keyword_groups(surfaces(t).withColumnRenamed("term", "keyword")))
query("er_alias_proposals")(lambda t: Z.alias_proposals(t.entities.filter("type is not null").select("type", F.concat_ws(" ", "surface", "brand").alias("surface")), vocab(t).select("type", F.upper("canonical").alias("surface"))))
query("er_topic_novelty")(lambda t: Z.novel_terms(surfaces(t).withColumn("o", F.reverse("term")), vocab(t).select(F.col("canonical").alias("name"))))
query("er_alias_resolve")(lambda t: Z.resolve_aliases(surfaces(t).select(F.lit("topic").alias("type"), F.col("term").alias("surface")), vocab(t).filter("canonical like 's%'").select("type", F.col("canonical").alias("surface"), F.upper("canonical").alias("canonical")), vocab(t)))
query("er_query_resolve")(lambda t: Z.query_entities(surfaces(t).withColumnRenamed("term", "query"), vocab(t).select("type", F.col("canonical").alias("surface"), "canonical"), vocab(t), ("method", "topic")))
query("er_realias")(lambda t: Z.realias(surfaces(t).select(F.lit("topic").alias("type"), F.col("term").alias("surface"), F.lower("term").alias("canonical_id")),
                                        Z.resolve_aliases(surfaces(t).select(F.lit("topic").alias("type"), F.col("term").alias("surface")), vocab(t).select("type", F.col("canonical").alias("surface"), F.upper("canonical").alias("canonical")), vocab(t), None)))
# Chains of three names and cycles of two.
RENAMED = "case canonical_id % 7 when 1 then canonical_id + 3 when 2 then canonical_id + 2 when 3 then canonical_id + 1 when 6 then canonical_id - 1 else canonical_id end"
query("er_realias_folded", f"""select 'mention' as part, doi, {RENAMED} as id, field as detail from mentions group by 2, 3, 4 union all select distinct 'entity', '', {RENAMED}, '' from entities
union all select distinct 'relation', doi, {RENAMED}, source from mentions where line = 1""")(lambda t: _folded(t))
query("jn_title_match")(lambda t: Z.match_titles(surfaces(t).select(F.concat("term", F.lit(", 2nd ed.")).alias("citation")), vocab(t).select(F.md5("canonical").alias("doi"), F.col("canonical").alias("title"))))
query("jn_keyword_theme")(lambda t: Z.keyword_themes(surfaces(t).withColumnRenamed("term", "keyword"), vocab(t).select(F.substring_index("canonical", " ", 1).alias("theme"), F.col("canonical").alias("term"))))
REFS = "refs as (select doi, line as pos, min(concat('10.1/', canonical_id)) as ref_doi from mentions group by doi, line)"
query("jn_ref_numeric", f"with {REFS} select m.doi, m.ref_id, r.ref_doi as target, 'numeric' as resolution from (select doi, concat('[', max(line), ']') as ref_id, max(line) as n from mentions group by doi) m join refs r on m.doi = r.doi and m.n = r.pos")(
    lambda t: Z.numeric_references(t.mentions.groupBy("doi").agg(F.concat(F.lit("["), F.max("line"), F.lit("]")).alias("ref_id")), refs(t)))


def surname(number):
    return F.concat(F.lit("Author"), F.translate(number.cast("string"), "0123456789", "abcdefghij"))


def refs(t):
    return t.mentions.groupBy("doi", F.col("line").alias("pos")).agg(F.min(F.concat(F.lit("10.1/"), "canonical_id")).alias("ref_doi"), F.min("supplier").alias("s")).withColumn("surname", surname(F.col("s"))).withColumn("year", F.col("pos").cast("int") + 2000)


def citations(t):
    """A numeric citation, one of two authors with a year, and some that name nobody, per paper."""
    named = t.mentions.groupBy("doi", "line").agg(F.min("supplier").alias("s")).withColumn("name", surname(F.col("s")))
    return named.select("doi", F.expr("case when line = 1 then '[1]' when line = 2 then concat(name, ' & Jones (2002)') else concat('Nobody ', 1950 + line) end").alias("ref_id"))


NAMED_REF = "select m.doi, concat('Author', translate(cast(min(supplier) as varchar), '0123456789', 'abcdefghij'), ' & Jones (2002)') as ref_id, min(concat('10.1/', canonical_id)) as target, 'fuzzy' as resolution from mentions m where line = 2 group by m.doi"
query("jn_ref_author_year", NAMED_REF)(lambda t: Z.author_year_references(citations(t), refs(t)))
query("er_ref_resolution", f"""with named as ({NAMED_REF}) select * from named union all select doi, '[1]', min(concat('10.1/', canonical_id)), 'numeric' from mentions where line = 1 group by doi
union all select doi, concat('Nobody ', 1950 + line), null, 'unresolved' from mentions where line > 2 group by doi, line""")(lambda t: Z.resolve_references(citations(t), refs(t)))

query("qa_text_fields", f"""with {VEC} select a.doi, case when a.vec_id % 10 = 0 then 'PASS' when a.vec_id % 10 = 1 then 'FAIL' when list_cosine_similarity(a.embedding, b.embedding) >= 0.2 then 'PASS' when list_cosine_similarity(a.embedding, b.embedding) >= 0.1 then 'WARN' else 'FAIL' end as grade
from v a join v b on b.vec_id = a.vec_id + 3""")(
    lambda t: Q.text_field_grades(vecs(t).alias("a").join(vecs(t).alias("b"), F.expr("b.vec_id = a.vec_id + 3")).select(
        "a.doi", F.expr("case when a.vec_id % 10 < 1 then '' else 'x' end").alias("actual"), F.expr("case when a.vec_id % 10 < 2 then ' ' else 'y' end").alias("expected"), F.col("a.embedding").alias("actual_embedding"), F.col("b.embedding").alias("expected_embedding")), 0.2, 0.1).select("doi", "grade"))
query("qa_null_honesty", "select doi, cast(line as varchar) as field, source as value from mentions where canonical_id % 9 = 0 and source <> 'N'")(
    lambda t: Q.null_honesty(t.mentions.selectExpr("concat(doi, ':', canonical_id, ':', supplier, ':', confidence, ':', extracted_at, source, field) as doi", "cast(line as string) as field", "canonical_id % 9 = 0 as expected_null").distinct(),
                             t.mentions.selectExpr("concat(doi, ':', canonical_id, ':', supplier, ':', confidence, ':', extracted_at, source, field) as doi", "cast(line as string) as field", "case when source <> 'N' then source else ' ' end as value").distinct()).withColumn("doi", F.substring_index("doi", ":", 1)))
query("qa_model_compare", """select model, cast(sum(missing) as bigint) as missing_required, count(*) filter (blank) as empty_outputs, cast(sum(made) as bigint) as fabrications, round(avg(seconds), 6) as mean_seconds from (
select source as model, doi, count(*) filter (line < 3 and canonical_id % 6 = 0) as missing, bool_and(canonical_id % 6 = 0) as blank, count(*) filter (field = 'F' and canonical_id % 6 <> 0) as made, max(supplier) as seconds from mentions group by source, doi) group by model""")(
    lambda t: Q.model_comparison(t.mentions.selectExpr("source as model", "doi", "line < 3 as required", "case when canonical_id % 6 = 0 then '' else 'v' end as value", "field = 'F' as expected_null", "supplier as seconds")).withColumn("mean_seconds", F.round("mean_seconds", 6)))
query("flt_failed_phases", "select doi, 'a' as phases from papers where key % 8 = 1")(
    lambda t: Q.failed_phases(t.papers.withColumn("extraction", F.expr("case key % 8 when 1 then '{\"_phase_errors\": {\"a\": \"timeout\", \"b\": \"\"}}' when 2 then '{\"_phase_errors\": {}}' when 3 then '{bad' else '{}' end"))).withColumn("phases", F.array_join("phases", ",")))
query("qa_schema_drift", """select 'missing' as side, 'journal' as column_name, count(journal) as n_filled from papers union all select 'unknown', 'extra', count(extraction) from papers union all select 'retyped', 'year', count(year) from papers""")(lambda t: _drift(t))


def _folded(t):
    """All three tables after renames 1 to 2 to 3 to 4 and 5 to 6 to 5 (by the rest modulo 7)."""
    ids = t.mentions.select(F.col("canonical_id").alias("old")).union(t.entities.select("canonical_id")).distinct()
    # The chains are whole whatever ids the tables hold.
    steps = ids.select(F.explode(F.sequence(F.col("old") - F.col("old") % 7 + 1, F.col("old") - F.col("old") % 7 + 6)).alias("old")).distinct()
    steps = steps.selectExpr("old", "case old % 7 when 5 then old + 1 when 6 then old - 1 when 4 then null else old + 1 end as new").filter("new is not null")
    relations = t.mentions.filter("line = 1").selectExpr("doi", "source as predicate", "canonical_id as target_id", "'Entity' as target_kind", "confidence")
    out = Z.fold_renamed(t.entities, t.mentions.select("doi", "canonical_id", "field", "confidence", "extracted_at"), relations, steps, F.desc("confidence"), F.desc("confidence"))
    return (
        out["mentions"].selectExpr("'mention' as part", "doi", "canonical_id as id", "field as detail").unionByName(out["entities"].selectExpr("'entity' as part", "'' as doi", "canonical_id as id", "'' as detail"))
        .unionByName(out["relations"].selectExpr("'relation' as part", "doi", "target_id as id", "predicate as detail"))
    )


def _drift(t):
    """Differences between a changed projection of papers and the table itself, with the values at stake."""
    written = t.papers.drop("journal").withColumn("extra", F.col("extraction")).withColumn("year", F.col("year").cast("string"))
    found = Q.schema_drift(written.schema, t.papers.schema)
    out = None
    for side, columns in found.items():
        for c in columns:
            rows = (t.papers if side == "missing" else written).agg(F.count(c).alias("n_filled")).select(F.lit(side).alias("side"), F.lit(c).alias("column_name"), "n_filled")
            out = rows if out is None else out.union(rows)
    return out
