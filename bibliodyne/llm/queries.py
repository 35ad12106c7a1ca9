"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file, found where the query runs; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.bpe import bpe_table

    return bpe_table(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.secret_scan import secret_table

    return secret_table(table(spark, sf_dir, "documents"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.simhash import simhash_table

    return simhash_table(table(spark, sf_dir, "documents"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.mixing import mix_table

    return mix_table(table(spark, sf_dir, "documents"))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.pii import pii_table

    return pii_table(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.langid import langid_table

    return langid_table(table(spark, sf_dir, "documents"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.quality import quality_table

    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.warc import warc_table

    return warc_table(table(spark, sf_dir, "pages"))


# Five hexadecimal digits are four base-32 digits.
ORACLE_SQL["op2_warc_bundles"] = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select html, min(page_id) as first_id from p group by html)
select page_id, cast(strlen(p.html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31), 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from p join f on p.html = f.html"""


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.ann import neighbours_table

    return neighbours_table(table(spark, sf_dir, "embeddings"))


@query
def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.nndescent import links_table

    return links_table(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op10_embedding_links"] = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings left join n on n.a = vec_id join c on c.a = vec_id"""


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.token_counts import token_table

    return token_table(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.gnat import negatives_table

    return negatives_table(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op12_hard_negatives"] = """
with v as (select row_number() over () as rid, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from v where vec_id % 100 = 0),
s as (select a.rid, a.vec_id as anchor_id, a.label as anchor_label, v.rid as other, v.vec_id, v.label, cast(list_dot_product(a.x, v.x) as bigint) as score from a join v on a.rid <> v.rid),
p as (select * from (select *, row_number() over (partition by rid order by score desc, vec_id, other) as place from s where label = anchor_label) where place <= 5),
n as (select p.rid, p.place, p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.rid, p.place order by s.score desc, s.vec_id, s.other) as rank
  from p join s on s.rid = p.rid and s.label <> s.anchor_label and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibliodyne.llm.periodic_runs import runs_table

    return runs_table(table(spark, sf_dir, "documents"))
