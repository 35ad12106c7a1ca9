"""The concept tables (papers, entities, mentions, ...) over the driver's Parquet tables.

Each is a projection of one table, in expressions that Spark SQL and ANSI SQL read alike, so that the
same text gives the DataFrame and the common table expression of the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, columns, condition)
CONCEPTS: dict[str, tuple[str, dict[str, str], str]] = {
    "papers": ("orders", {
        "key": "o_orderkey", "doi": "concat('10.1/', o_orderkey)", "title": "concat('Paper ', o_custkey, ' on ', o_orderpriority)",
        "author": "o_custkey", "year": "cast(year(o_orderdate) as int)", "journal": "concat('Journal ', o_custkey % 40)",
        "status": "case when o_orderstatus = 'F' then 'discovered' when o_orderstatus = 'P' then 'complete' end",
        "source_type": "o_orderpriority", "price": "o_totalprice", "last_updated": "o_orderdate",
        "embeddings_indexed": "o_orderstatus <> 'O'", "graph_indexed": "o_orderkey % 3 = 0", "chunks_indexed": "o_orderkey % 5 = 0", "notes_synced": "o_orderkey % 7 = 0",
        "extraction": "case when o_orderkey % 4 <> 0 then concat('{\"core_finding\": \"f', o_orderkey, '\", \"_overall_confidence\": 0.', lpad(cast(o_orderkey % 100 as varchar(9)), 2, '0'), '}') end",
    }, "1 = 1"),
    "entities": ("part", {"canonical_id": "p_partkey", "type": "case when p_partkey % 50 <> 0 then lower(p_type) end", "surface": "p_name", "brand": "p_brand"}, "1 = 1"),
    "mentions": ("lineitem", {
        "doi": "concat('10.1/', l_orderkey)", "paper_key": "l_orderkey", "canonical_id": "l_partkey", "source": "l_returnflag", "field": "l_linestatus",
        "confidence": "l_discount * 10", "extracted_at": "l_shipdate", "supplier": "l_suppkey", "line": "l_linenumber",
    }, "1 = 1"),
    "feedback": ("events", {
        "id": "event_id", "doi": "concat('10.1/', event_id % 500)", "doi_key": "event_id % 500", "user_id": "user_id", "created_at": "ts",
        "signal_type": "case event_type when 'purchase' then 'saved' when 'click' then 'thumbs_up' when 'view' then 'opened' when 'error' then 'dismissed' else 'rated' end",
        "rating": "cast(case when event_type = 'signup' then 1 + event_id % 5 end as int)", "source": "case when user_id % 4 <> 0 then concat('s', user_id % 4) end",
    }, "1 = 1"),
    "runs": ("orders", {"id": "o_orderkey", "started_at": "o_orderdate", "status": "o_orderstatus", "trigger_kind": "o_orderpriority"}, "o_orderkey % 30 = 0"),
    "run_log": ("orders", {"id": "o_orderkey", "run_type": "o_orderpriority", "papers_processed": "o_custkey"}, "o_orderkey % 60 = 0"),
    "results": ("lineitem", {
        "id": "l_orderkey * 10 + l_linenumber", "run_id": "l_orderkey - l_orderkey % 30", "doi": "case when l_partkey % 17 <> 0 then concat('10.1/', l_partkey) end",
        "part": "l_partkey", "score": "l_extendedprice / 100000", "ingested": "l_returnflag = 'A'", "ship": "l_shipdate",
        "breakdown": "case when l_linestatus = 'F' then l_quantity end", "line_price": "l_extendedprice",
    }, "1 = 1"),
    "assignments": ("embeddings", {"doi": "concat('10.1/', vec_id)", "doi_key": "vec_id", "cluster_id": "label", "distance": "round((vec_id * 37 % 101) / 101.0, 6)"}, "1 = 1"),
    "clusters": ("nation", {"id": "n_nationkey", "display_name": "case when n_nationkey % 5 <> 4 then n_name end", "archived": "n_nationkey >= 8", "region": "n_regionkey"}, "n_nationkey < 10"),
}


def concept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, where = CONCEPTS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def cites(papers: DataFrame) -> DataFrame:
    """(source, target): each paper cites the one before it by the same author."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from bibliodyne.session import dealt

    of_author = dealt(papers.select("author", "last_updated", "key", "doi"), papers.count(), "author")
    before = F.lag("doi").over(W.partitionBy("author").orderBy("last_updated", "key"))
    return of_author.select(F.col("doi").alias("source"), before.alias("target")).filter("target IS NOT NULL")


def with_concepts(sql: str) -> str:
    """An oracle query with the concept tables as common table expressions."""
    parts = [f"{n} as (select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {t} where {w})" for n, (t, columns, w) in CONCEPTS.items()]
    parts.append("cites as (select source, target from (select doi as source, lag(doi) over (partition by author order by last_updated, key) as target from papers) where target is not null)")
    body = sql.strip()
    return f"with {', '.join(parts)}, {body[5:]}" if body.lower().startswith("with ") else f"with {', '.join(parts)} {body}"
