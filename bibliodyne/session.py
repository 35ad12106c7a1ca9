"""Session settings and the one place that knows where shared intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def builder(app: str = "bibliodyne", cores: str = "8") -> SparkSession.Builder:
    """A local builder for tests and the bench; on a cluster the submitter's settings apply."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; a cluster without it is an
    error, since a machine-local folder would be invisible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_ROOT[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier call has returned."""
    return f"{shared_root(spark)}/bibliodyne/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete everything this application has written to the shared folder; call it when its results
    have been read or stored elsewhere."""
    drop_path(spark, f"{shared_root(spark)}/bibliodyne/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, and an
    executor's loss costs only the tasks that were running."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task that groups them by a key.
TASK_ROWS = 400_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by the keys, to as many tasks as keep one to about ``TASK_ROWS`` of its ``rows``: adaptive execution
    neither joins them again nor lets them grow with the input. What is grouped by the keys needs no other shuffle."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns and all columns as one struct ``_row``, which no other name can clash with."""
    from pyspark.sql import functions as F

    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*needed, F.struct(*[quoted(c) for c in df.columns]).alias("_row"))
