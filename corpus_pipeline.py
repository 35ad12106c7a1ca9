"""The corpus pipeline: language, near copies, personal data, source mix, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of ``documents``. ``run`` applies them to the ``documents`` table of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibliodyne.llm import bpe, langid, mixing, pii, simhash
from bibliodyne.llm.queries import tokenizer_path
from bibliodyne.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told (no letter, or no label with a mean posterior of 0.35).

    Null and empty texts go; texts of any length are labelled whole; repeated rows share their fate; an empty table,
    or one without a labelled row, gives no rows."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: texts of which five-word shingles have a
    Jaccard coefficient of 0.8 or more, directly or through others.

    Null and empty texts are one group. Of ties (rows that repeat the smallest id) the row with the smallest text
    digest stays, of equal rows one; rows without id come last. An empty table stays empty."""
    return simhash.keep_one(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in the texts; keeps all documents.

    Null and empty texts stay as they are; repeated rows get equal texts; an empty table stays empty."""
    return pii.sanitize(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources meet their target shares of words.

    Null and empty texts have no words and are left out; a null source is a source of its own; repeated rows have
    copies of their own; reruns agree (but for which of equal rows is taken); an empty table stays empty."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, in place of its text.

    Null and empty texts have none; long texts are encoded whole; columns named like a new one give way to it; an
    empty table stays empty."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("pii", remove_personal_data),
    ("mix_sources", mix_sources),
    ("bpe_tokens", tokenize),
]
#: No stage is expressible in SQL: a learned model, hashed votes, a disclosure search, pivotal rounding, BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
