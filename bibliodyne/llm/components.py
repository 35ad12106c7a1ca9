"""Connected components of an edge table by alternating star contractions.

Each round is a grouped minimum and an equality join, so no component is gathered in one task, and
every round's edges are written to the shared folder, which cuts the lineage. The number of rounds
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliodyne.session import drop_path, shared_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: the larger (or the smaller and own) neighbours of a node move to the least."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable type, a <> b).

    ``root`` is the least node of the component; a root maps to itself. An edge table without rows
    gives no rows.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = shared_path(spark, "edges")
    edges.write.parquet(path)
    if spark.read.schema(edges.schema).parquet(path).isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    digest = None
    for _ in range(max_rounds):
        current = spark.read.parquet(path)
        new = shared_path(spark, "edges")
        _star(_star(current, True), False).write.parquet(new)
        drop_path(spark, path)
        path = new
        seen = spark.read.parquet(path).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == digest:
            break
        digest = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    done = spark.read.parquet(path).select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root"))
    return done.union(done.select(F.col("root").alias("node"), "root").distinct())
