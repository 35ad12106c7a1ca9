"""Sources: provider dumps to candidate rows, vocabularies, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHOR = "array<struct<name:string>>"
CANDIDATE = "doi string, title string, authors array<string>, year int, journal string, abstract string, keywords array<string>, source_databases array<string>, tracked_author boolean"
WORK = "id string, doi string, title string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>"
S2 = "paperId string, title string, year int, externalIds map<string,string>, venue string, abstract string, fieldsOfStudy array<string>, authors array<struct<name:string>>, score double"


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return candidates(spark.read.schema("doi string, title string, authors array<string>, publication_date string, journal string, abstract string, keywords array<string>, databases array<string>").json(path))


def candidates(hits: DataFrame, tracked: bool = False) -> DataFrame:
    """Search hits to candidate rows: dois in normal form, empty strings for what is missing; blank authors and
    keywords are dropped."""
    from bibliodyne.functions.scalar import normalize_doi, parse_year, strip

    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), strip), lambda x: x != "")
    return hits.select(
        normalize_doi(F.col("doi")).alias("doi"), F.coalesce(strip(F.col("title")), F.lit("")).alias("title"), clean(F.col("authors")).alias("authors"), parse_year(F.col("publication_date")).alias("year"), F.coalesce("journal", F.lit("")).alias("journal"),
        F.coalesce("abstract", F.lit("")).alias("abstract"), clean(F.col("keywords")).alias("keywords"), clean(F.col("databases")).alias("source_databases"), F.lit(tracked).alias("tracked_author"),
    )


def openalex_works(works: DataFrame) -> DataFrame:
    """Nested works to candidate rows of tracked authors (schema ``WORK``)."""
    from bibliodyne.functions.scalar import inverted_abstract, normalize_doi

    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return works.select(
        normalize_doi(F.col("doi")).alias("doi"), "title", F.coalesce(names, F.expr("cast(array() as array<string>)")).alias("authors"), F.col("publication_year").alias("year"),
        F.col("primary_location.source.display_name").alias("journal"), F.coalesce(inverted_abstract(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"),
        F.expr("cast(array() as array<string>)").alias("keywords"), F.array(F.lit("openalex")).alias("source_databases"), F.lit(True).alias("tracked_author"),
    )


def s2_results(results: DataFrame) -> DataFrame:
    """Second provider's results to candidate rows with relevance (schema ``S2``). Authors without a name are dropped; a
    missing venue is an empty journal."""
    from bibliodyne.functions.scalar import normalize_doi

    empty = F.expr("cast(array() as array<string>)")
    return results.select(
        normalize_doi(F.try_element_at("externalIds", F.lit("DOI"))).alias("doi"), "title", F.coalesce(F.filter(F.transform("authors", lambda a: a["name"]), lambda x: F.coalesce(x, F.lit("")) != ""), empty).alias("authors"), "year",
        F.coalesce("venue", F.lit("")).alias("journal"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce("fieldsOfStudy", empty).alias("keywords"),
        F.array(F.lit("semantic_scholar")).alias("source_databases"), F.lit(False).alias("tracked_author"), F.col("score").alias("relevance"),
    )


def vocabulary(rows: DataFrame) -> DataFrame:
    """(type, surface, canonical, deprecated) with lower-case surfaces, one canonical per (type, surface): a live
    entry before a deprecated one, then the least."""
    from bibliodyne.functions.scalar import strip

    keyed = rows.select("type", F.lower(strip(F.col("surface"))).alias("surface"), "canonical", F.coalesce("deprecated", F.lit(False)).alias("deprecated")).filter("surface <> ''")
    return keyed.groupBy("type", "surface").agg(F.min(F.struct("deprecated", "canonical")).alias("b")).select("type", "surface", "b.canonical", "b.deprecated")


def vectors(table: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Paper vectors, all or those of some ids."""
    return table if ids is None else table.join(ids.select("doi").distinct(), "doi", "left_semi")
