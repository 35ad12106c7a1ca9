"""Incremental batch rules: frontiers, polling, phase flags, and re-embedding or re-chunking of what is due."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliodyne.functions.models import embed
from bibliodyne.functions.text import chunk_markdown
from bibliodyne.operators.relational import backlog
from bibliodyne.sources.sinks import has_snapshot, read_snapshot, replace_by_key, write_snapshot


def next_frontier(runs: DataFrame) -> DataFrame:
    """Adds ``next_frontier``: the later of the old one and what a clean, real run has covered."""
    clean = F.col("clean") & ~F.col("dry_run")
    return runs.withColumn("next_frontier", F.when(clean, F.greatest("frontier", "covered_to")).otherwise(F.col("frontier")))


def seeded_frontier(frontier: DataFrame, runs: DataFrame) -> DataFrame:
    """The stored frontier, or else the last run's date."""
    last = runs.agg(F.to_date(F.max("started_at")).alias("seed"))
    return last.join(F.broadcast(frontier.select("frontier").limit(1)), F.lit(True), "left").select(F.coalesce("frontier", "seed").alias("frontier"))


def poll(spark: SparkSession, items: DataFrame, root: str, version: str = "version", process: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Items newer than the stored version; the first call stores a baseline and returns none.

    ``process`` is called with the new items before the version is stored, so what fails is polled again.
    Without it the caller takes the returned items and the version is stored at once."""
    newest = items.agg(F.max(version).alias("v"))
    if not has_snapshot(spark, root):
        write_snapshot(newest, root)
        return items.limit(0)
    seen = read_snapshot(spark, root).first().v
    fresh = items if seen is None else items.filter(F.col(version) > seen)
    if process is not None:
        process(fresh)
    write_snapshot(newest.select(F.greatest("v", F.lit(seen)).alias("v")), root)
    return fresh


def index_then_flag(papers: DataFrame, root: str, text_job: Callable[[DataFrame], DataFrame], graph_job: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Flags after their writes: text rows first, whose failure stops everything; graph rows are independent,
    and a failure leaves only their flag unset. Returns (doi, text_indexed, graph_indexed)."""
    write_snapshot(text_job(papers), f"{root}/text")
    graphed = False
    if graph_job is not None:
        try:
            write_snapshot(graph_job(papers), f"{root}/graph")
            graphed = True
        except Exception:
            logging.getLogger(__name__).exception("graph index not written, its flag stays unset")
    flags = papers.select("doi", F.lit(True).alias("text_indexed"), F.lit(graphed).alias("graph_indexed"))
    write_snapshot(flags, f"{root}/flags")
    return read_snapshot(papers.sparkSession, f"{root}/flags")


def embed_due(texts: DataFrame, stored: DataFrame, model: str, embed_fn: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors of the texts (doi, text) that the store (doi, model) lacks for this model; blank texts are left out."""
    done = stored.filter(F.col("model") == model).select("doi")
    due = texts.filter(F.trim(F.coalesce("text", F.lit(""))) != "").join(done, "doi", "left_anti").dropDuplicates(["doi"])
    return embed(due, embed_fn).withColumn("model", F.lit(model))


def chunk_due(papers: DataFrame, texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk table with the chunks of all papers of the backlog anew."""
    due = texts.join(backlog(papers, "chunks").select("doi"), "doi", "left_semi")
    return replace_by_key(chunks, chunk_markdown(due), "doi")
