"""Joins of rows with a per-key table where a few keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with over one of so many rows go to every task; there are at most so many of them.
SHARE = 1000
#: Tasks that the rows of such keys are dealt to.
SPREAD = 1 << 16


def join_keys(rows: DataFrame, keys: DataFrame, on: str, deal: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``keys`` (a materialised table, one row a value of ``on``, with the number of
    its rows in ``size``).

    Rows of the few large keys meet them by a broadcast of those keys only, and are dealt by ``deal``; all others
    are dealt by the key. No task gets a large key, and adaptive execution is not needed for it."""
    total = keys.agg(F.sum(size)).first()[0] or 0
    values = [c for c in keys.columns if c not in (on, size)]
    side = lambda part, name: part.select(F.col(on).alias(f"_{name}_key"), F.struct(size, *values).alias(f"_{name}"))
    large = F.broadcast(side(keys.filter(F.col(size) > total / SHARE), "large"))
    # Not a literal, which the optimizer would take out of the join's keys.
    small = side(keys.filter(F.col(size) <= total / SHARE), "small").withColumn("_no", F.pmod(F.xxhash64("_small_key"), F.lit(1)))
    tagged = rows.join(large, F.col(on) == F.col("_large_key"), "left")
    tagged = tagged.withColumn("_deal", F.when(F.col("_large_key").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(deal), F.lit(SPREAD))))
    met = tagged.join(small, (F.col("_deal") == F.col("_no")) & (F.col(on) == F.col("_small_key")), "left")
    return met.withColumn("_value", F.coalesce("_large", "_small")).filter("_value IS NOT NULL").select(*rows.columns, "_value.*")
