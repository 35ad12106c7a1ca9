"""Structured Streaming jobs: counts, trending buckets, deduplication and decayed masses as events arrive.

Late rows beyond the watermark are dropped from stream aggregates; the batch jobs recompute them. State
and output live in the shared folder under the query's checkpoint, so a restart goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from bibliodyne.session import shared_path


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream over the Parquet files of a table, a folder or a single file."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def daily_counts(events: DataFrame, at: str, keys: list[str], late: str = "7 days", length: str = "1 day") -> DataFrame:
    """Counts per tumbling window and keys."""
    stamped = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counted = stamped.groupBy(F.window("_at", length), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("bucket"), *keys, "n")


def dedup_stream(hits: DataFrame, at: str, key: str, within: str = "30 days") -> DataFrame:
    """The first row of each key; repeats within the time are dropped."""
    return hits.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", within).dropDuplicatesWithinWatermark([key])


MASS = "cluster_id long, disliked double, liked double, at double"


def cluster_mass(events: DataFrame, half_life_days: float = 90.0) -> DataFrame:
    """Decayed masses per cluster from (cluster_id, sign, at seconds): the state holds masses as of its latest
    event and is decayed to a later one, so the order of events does not matter."""
    day = 86400.0

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        down, up, at = state.get if state.exists else (0.0, 0.0, float("-inf"))
        for b in batches:
            now = max(at, float(b["at"].max()))
            old = 0.5 ** ((now - at) / day / half_life_days) if at > float("-inf") else 0.0
            mass = 0.5 ** ((now - b["at"]) / day / half_life_days)
            down, up, at = down * old + float(mass[b.sign < 0].sum()), up * old + float(mass[b.sign > 0].sum()), now
        state.update((down, up, at))
        yield pd.DataFrame({"cluster_id": [key[0]], "disliked": [down], "liked": [up], "at": [at]})

    return events.groupBy("cluster_id").applyInPandasWithState(update, MASS, "disliked double, liked double, at double", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there now and return its output: appended rows ('append'), the last result
    ('complete'), or all updates with their batch number in ``_batch`` ('update')."""
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        # A folder per batch, overwritten when a batch is repeated, makes the sink exactly-once.
        if mode != "complete" or not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    rows = spark.read.schema(schema).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("_batch")).first()[0]
        return rows.filter(F.col("_batch") == last).drop("_batch")
    return rows if mode == "update" else rows.drop("_batch")


def last_state(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    others = [c for c in updates.columns if c not in (*keys, "_batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("s")).select(*keys, "s.*")


def upsert_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Apply a keyed, repeatable write to each micro-batch of what is there now."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
