"""Rows that break a rule go to a table of their own, with reasons and counters.

The input is read once: each row gets the names of the rules it breaks, the rows are written in two partitions, and
counters are observed on the way. Both tables are then read by partition, so accepted rows never cost a scan of
rejected ones. Together they are the input, row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from bibliodyne.functions.scalar import SIGNAL_WEIGHTS, parse_model_json
from bibliodyne.session import shared_path


@dataclass
class Divided:
    """``rejected`` has the input's columns and ``_reasons``; ``counts`` has rows, rejected and one entry per rule."""

    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int]

    def labelled(self, key: str) -> DataFrame:
        """(key, accepted, reasons) of all rows."""
        ok = self.accepted.select(key, F.lit(True).alias("accepted"), F.lit("").alias("reasons"))
        return ok.union(self.rejected.select(key, F.lit(False), F.array_join("_reasons", ",")))


def feedback_rules() -> dict[str, Column]:
    """An unknown signal; a rated one without a rating of 1 to 5; a rating with another signal."""
    signal, rating = F.col("signal_type"), F.col("rating")
    known = F.coalesce(signal.isin("rated", *SIGNAL_WEIGHTS), F.lit(False))
    return {
        "signal": ~known,
        "rating": known & (signal == "rated") & ~F.coalesce(rating.between(1, 5), F.lit(False)),
        "stray_rating": known & (signal != "rated") & rating.isNotNull(),
    }


def answer_rules(text: str = "answer") -> dict[str, Column]:
    """No answer, or one that is no JSON once think blocks and fences are gone."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return {"empty": blank, "invalid": ~blank & parse_model_json(F.col(text)).isNull()}


def item_rules() -> dict[str, Column]:
    """A blank title rejects an item; what is only missing beside it warns (``item_quality``)."""
    return {"title": F.coalesce(F.trim("title"), F.lit("")) == ""}


def divide(rows: DataFrame, rules: dict[str, Column], path: str | None = None) -> Divided:
    """The rows that break no rule and those that do. A rule that is null for a row is not broken. An input column
    named ``_reasons`` does not come through in ``rejected``; an empty input gives two empty tables and zeros.

    ``path`` is where the two partitions go (by default a new folder of the shared one)."""
    spark = rows.sparkSession
    path = path or shared_path(spark, "quarantine")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    marked = rows.select(F.struct(*[quoted(c) for c in rows.columns]).alias("_row"), reasons.alias("_reasons")).withColumn("_rejected", (F.size("_reasons") > 0).cast("int"))
    seen = Observation()
    counters = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_rejected") == 1).alias("rejected")]
    counters += [F.count_if(F.array_contains("_reasons", name)).alias(f"rule_{name}") for name in rules]
    marked.observe(seen, *counters).write.partitionBy("_rejected").parquet(path)
    counts = dict.fromkeys(["rows", "rejected", *(f"rule_{name}" for name in rules)], 0) | seen.get
    stored = spark.read.schema(marked.schema).parquet(path)
    rejected = stored.filter("_rejected = 1").select("_row.*", F.col("_reasons").alias("_why")).drop("_reasons").withColumnRenamed("_why", "_reasons")
    return Divided(stored.filter("_rejected = 0").select("_row.*"), rejected, counts)
