"""Joins of rows with their class where one class may hold a large share of all rows, and of wide rows with few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliodyne.session import materialize

#: Classes with over one of so many rows go to every task; there are at most so many of them.
SHARE = 1000
#: Tasks that the rows of such classes are dealt to.
SPREAD = 1 << 16
#: Bits of a sieve for each key that it lets through, and words of 64 bits that it has at most, whatever the input.
SIEVE_BITS, SIEVE_WORDS = 32, 1 << 19


def join_class(rows: DataFrame, classes: DataFrame, key: str, spread: str, copies: str = "copies", twice: bool = False) -> DataFrame:
    """``rows`` with the other columns of their class (one row for each value of ``key``, with the number of its rows
    in ``copies``; a materialised table).

    Rows of the few large classes meet them by a broadcast and are dealt by ``spread``, all others are
    dealt by their key, in one shuffle: no task gets a large class, whatever the settings. With ``twice`` the former are
    read apart, so that the broadcast meets nothing else; that is for rows that are cheap to make twice."""
    total = classes.agg(F.sum(copies)).first()[0] or 0
    values = [c for c in classes.columns if c not in (key, copies)]
    as_value = lambda part, name: part.select(F.col(key).alias(f"_{name}_key"), F.struct(*values).alias(f"_{name}"))
    large = F.broadcast(as_value(classes.filter(F.col(copies) > total / SHARE), "large"))
    # Not a literal, which the optimizer would take out of the join's keys.
    small = as_value(classes.filter(F.col(copies) <= total / SHARE), "small").withColumn("_no", F.pmod(F.xxhash64("_small_key"), F.lit(1)))
    if twice:
        hot = [r[0] for r in classes.filter(F.col(copies) > total / SHARE).select(key).collect()]
        is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
        rest = small.drop("_no")
        met = rows.filter(~is_hot).join(rest, F.col(key) == F.col("_small_key"), "left").select(*rows.columns, "_small.*")
        return met.unionByName(rows.filter(is_hot).join(large, F.col(key) == F.col("_large_key")).select(*rows.columns, "_large.*")) if hot else met
    tagged = rows.join(large, F.col(key) == F.col("_large_key"), "left")
    deal = F.when(F.col("_large_key").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SPREAD)))
    met = tagged.withColumn("_deal", deal).join(small, (F.col(key) == F.col("_small_key")) & (F.col("_deal") == F.col("_no")), "left")
    return met.select(*rows.columns, F.coalesce("_large", "_small").alias("_value")).select(*rows.columns, "_value.*")


def sieved(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be one of ``wanted`` (materialised; null is a key), and the others, whose key surely is none.

    One bit of a bitmap of bounded size is set for each wanted key, and only the bitmap goes to every task: rows that a
    join would drop stay where they are. The former rows still need that join, since keys may share a bit."""
    words = max(1, min(SIEVE_WORDS, wanted.count() * SIEVE_BITS // 64))
    hashed = lambda c: F.xxhash64(F.lit(11), c)
    word = lambda c: F.pmod(F.shiftrightunsigned(hashed(c), 6), F.lit(words))
    place = lambda c: F.pmod(hashed(c), F.lit(64)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place(wanted_key))
    bitmap = F.broadcast(materialize(wanted.groupBy(word(wanted_key).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "sieve"))
    there = (word(key) == F.col("_word")) & (F.getbit("_bits", place(key)) == 1)
    return rows.join(bitmap, there, "left_semi"), rows.join(bitmap, there, "left_anti")
