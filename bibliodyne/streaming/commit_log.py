"""Micro-batch writes to several index tables, with a log that says which batches are whole.

Every table has a folder per batch number, overwritten when a batch is repeated; a folder counts once Spark has
marked it as complete. Flags are not stored: a paper is indexed in a table if its last batch is complete there. So a
crash between two writes leaves a batch that is whole in one table and missing in the other, readers see just that, and
the replay of the batch (the stream's checkpoint starts it again under the same number) gives every row once.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliodyne.sources.sinks import has_snapshot, read_snapshot, write_snapshot

Job = Callable[[DataFrame], DataFrame]


def complete_batches(spark: SparkSession, root: str, table: str) -> list[int]:
    """Numbers of the batches whose folder is complete."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("_batch=")]
    return sorted(int(p.getName().removeprefix("_batch=")) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _batches(spark: SparkSession, root: str, table: str, numbers: list[int], schema: str | None = None) -> DataFrame:
    paths = [f"{root}/{table}/_batch={n}" for n in numbers]
    if not paths:
        return spark.createDataFrame([], schema or "doi string, _batch int")
    return spark.read.option("basePath", f"{root}/{table}").parquet(*paths)


def index_batch(batch: DataFrame, number: int, root: str, text_job: Job, graph_job: Job | None = None) -> None:
    """Write one batch of papers (doi, ...): its dois, then the text rows, whose failure stops the batch, then the graph
    rows, whose failure leaves the batch open in the graph table only."""
    put = lambda rows, table: rows.write.mode("overwrite").parquet(f"{root}/{table}/_batch={number}")
    put(batch.select("doi").distinct(), "papers")
    put(text_job(batch), "text")
    if graph_job is not None:
        try:
            put(graph_job(batch), "graph")
        except Exception:
            logging.getLogger(__name__).exception("graph rows of batch %s not written, the batch stays open there", number)


def index_stream(papers: DataFrame, root: str, text_job: Job, graph_job: Job | None = None) -> None:
    """Index what a stream of papers holds now, and go on after the last complete batch when called again."""
    write = lambda batch, number: index_batch(batch, number, root, text_job, graph_job)
    papers.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def indexed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of an index table: for each paper those of its last complete batch."""
    rows = _batches(spark, root, table, complete_batches(spark, root, table))
    last = rows.groupBy("doi").agg(F.max("_batch").alias("_last"))
    met = rows.join(last.withColumnRenamed("doi", "_doi"), (F.col("doi") == F.col("_doi")) & (F.col("_batch") == F.col("_last")))
    return met.drop("_doi", "_last", "_batch")


def flags(spark: SparkSession, root: str) -> DataFrame:
    """(doi, text_indexed, graph_indexed) of every paper seen, by its last batch."""
    seen = _batches(spark, root, "papers", complete_batches(spark, root, "papers")).groupBy("doi").agg(F.max("_batch").alias("b"))
    text, graph = (complete_batches(spark, root, t) for t in ("text", "graph"))
    return seen.select("doi", F.col("b").isin(text).alias("text_indexed"), F.col("b").isin(sorted({*text} & {*graph})).alias("graph_indexed"))


def repair_graph(papers: DataFrame, root: str, graph_job: Job) -> list[int]:
    """Write the graph rows of batches that are whole in the text table and open in the graph; returns their numbers."""
    spark = papers.sparkSession
    text, graph = (complete_batches(spark, root, t) for t in ("text", "graph"))
    missing = sorted({*text} - {*graph})
    for n in missing:
        due = papers.join(_batches(spark, root, "papers", [n]).select("doi"), "doi", "left_semi")
        graph_job(due).write.mode("overwrite").parquet(f"{root}/graph/_batch={n}")
    return missing


def poll_stream(items: DataFrame, root: str, version: str = "version") -> DataFrame | None:
    """Items of a stream that are newer than the baseline, in a table with their batch number.

    The first call takes note of the newest version there is and processes nothing (None); later ones write what is
    newer, each batch under its number, so that a repeated batch does no harm. The baseline stays: what an item's
    version decides is whether the library had it before the first call."""
    spark = items.sparkSession
    first = not has_snapshot(spark, f"{root}/baseline")
    seen = None if first else read_snapshot(spark, f"{root}/baseline").first().v

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.agg(F.max(version).alias("v")) if first else batch if seen is None else batch.filter(F.col(version) > seen)
        rows.write.mode("overwrite").parquet(f"{root}/{'versions' if first else 'items'}/_batch={number}")

    items.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if first:
        kind = items.schema[version].dataType.simpleString()
        write_snapshot(_batches(spark, root, "versions", complete_batches(spark, root, "versions"), f"v {kind}, _batch int").agg(F.max("v").alias("v")), f"{root}/baseline")
        return None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", _batch int"
    return _batches(spark, root, "items", complete_batches(spark, root, "items"), schema)
