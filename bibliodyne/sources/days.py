"""Tables laid out by day, so that a time window reads the files of its days only.

A day's rows are cut into files by a range over (day, hash of the row), so a busy day is written by several tasks and a
quiet one shares a task with its neighbours. Rows without a time are under a null day; a window leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "_day"


def write_days(rows: DataFrame, column: str, path: str, files: int | None = None, replace: bool = False) -> None:
    """Write ``rows`` by the day of ``column`` in about ``files`` tasks (the session's shuffle partitions). ``replace``
    puts the rows in place of the stored ones of their days, and leaves other days alone; else they are added.

    The table keeps all columns; one named ``_day`` is not allowed."""
    if DAY in rows.columns:
        raise ValueError(f"a column named {DAY} stands for the partition")
    n = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashable = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    dealt = rows.withColumn(DAY, F.to_date(column)).repartitionByRange(n, DAY, F.xxhash64(*[F.col(f"`{c}`") for c in hashable]))
    writer = dealt.write.partitionBy(DAY)
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else writer.mode("append")).parquet(path)


def read_days(spark: SparkSession, path: str, column: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows with ``since`` <= ``column`` <= ``until`` (either may be None); the days become partition filters."""
    rows = spark.read.parquet(path)
    for bound, keep in ((since, lambda c, b: c >= b), (until, lambda c, b: c <= b)):
        if bound is not None:
            limit = F.lit(bound).cast("timestamp_ntz")
            rows = rows.filter(keep(F.col(DAY), F.lit(bound[:10]).cast("date")) & keep(F.col(column), limit))
    return rows.drop(DAY)


def newest(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row, the greatest ``column``: the days are compared by name, then the last one's files are read."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max(DAY)).first()[0]
    return rows.filter(F.col(DAY).eqNullSafe(F.lit(last).cast("date"))).agg(F.max(column).alias(column))
