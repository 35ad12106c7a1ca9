"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words, and so every document of it the same number of copies, a fraction
in general. Whole copies are taken; the fractional rest is rounded by a pivotal method: two documents
with fractional probabilities exchange mass, at random in one of two directions, until one of them is
0 or 1. What one gives in words the other gets, so the expected copies stay and the words taken by a
source do not change at all; only the last document of a source is rounded alone. A source is thus off
its target by less than one document.

The exchanges run as a reduction tree. Documents are dealt by hash to blocks of about ``BLOCK``; a block
leaves at most one fractional document, and these residuals form the blocks of the next level, until
a source has one left. No task sees more than a few blocks of a source, however large it is. All of
it is DataFrame expressions, and all random choices are hashes of a document's own columns and the
seed, so that reruns and other partitionings agree.

Every exchange draws its own number, hashed from the level and both documents, so the expected copies of a
document are exactly its fraction.

Rows that are equal in doc_id, source, size and text hash are one unit: of its fractional copies the whole
ones go to its first rows, and only what is left over takes part in the exchanges, as one row. Null texts and texts without words have size 0 and are taken 0 times; a null source is a
source of its own, last in order. A source without words has target 0. An empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliodyne.session import materialize, packed

#: No document is taken more often than this.
MOST = 3
#: Documents of one source in a block of the tree, on average.
BLOCK = 256
#: Equal rows that one task writes at a time.
CHUNK = 10_000
KEY = ("doc_id", "source", "size", "hash")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Weights repeat over the sources in code-point order. A target is capped at ``MOST`` times its
    source's size; in order of cap per weight the capped sources come first, so the common level of
    the others follows from running sums over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = by_source.withColumn("w", weight.cast("double")).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    every = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    leveled = ranked.withColumn("rest", rest).withColumn("left", left).withColumn("open", F.col("rest") / F.col("left") <= F.col("cap") / F.col("w"))
    first = leveled.withColumn("level", F.first(F.when(F.col("open"), F.struct("rest", "left")), ignorenulls=True).over(W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level.rest") / F.col("level.left")))
    return first.select("source", "source_size", target.alias("target"))


def _uniform(seed: int, *of: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _exchange(held: Column, unit: Column, seed: int) -> Column:
    """One pivotal step of two fractional units: struct(done, held), ``done`` integral now."""
    s, t, p, q = held["mass"], unit["mass"], held["p"], unit["p"]
    # Copies that ``held`` can gain or lose with the words coming from or going to ``unit``.
    gain, loss = F.least(1 - p, q * t / s), F.least(p, (1 - q) * t / s)
    up = _uniform(seed, held["h"], unit["h"]) * (gain + loss) < loss
    new_p = F.when(up, p + gain).otherwise(p - loss)
    new_q = F.when(up, q - gain * s / t).otherwise(q + loss * s / t)
    # Which of the two ends at a bound is known from the minimum, not from rounded sums.
    held_ends = F.when(up, 1 - p <= q * t / s).otherwise(p <= (1 - q) * t / s)
    end_p, end_q = F.when(up, 1.0).otherwise(0.0), F.when(up, 0.0).otherwise(1.0)
    moved = lambda x, value: x.withField("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
    return F.struct(
        F.when(held_ends, moved(held, end_p)).otherwise(moved(unit, end_q)).alias("done"),
        F.when(held_ends, moved(unit, new_q)).otherwise(moved(held, new_p)).alias("held"),
    )


def _reduce(units: DataFrame, seed: int) -> DataFrame:
    """Blocks (source, block) of units to (source, block, done array<unit>, held unit)."""
    blocks = units.groupBy("source", "block").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    kind = blocks.schema["units"].dataType.elementType.simpleString()
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("done"), F.expr(f"cast(null as {kind})").alias("held"))

    def step(acc: Column, unit: Column) -> Column:
        pair = _exchange(acc["held"], unit, seed)
        settled = F.struct(F.concat(acc["done"], F.array(unit)).alias("done"), acc["held"].alias("held"))
        taken = F.struct(acc["done"].alias("done"), unit.alias("held"))
        both = F.struct(F.concat(acc["done"], F.array(pair["done"])).alias("done"), pair["held"].alias("held"))
        return F.when((unit["p"] <= 0) | (unit["p"] >= 1), settled).when(acc["held"].isNull(), taken).otherwise(both)

    return blocks.select("source", "block", F.aggregate("units", start, step).alias("r")).select("source", "block", "r.done", "r.held")


def mixed_units(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 5) -> DataFrame:
    """(doc_id, source, size, hash, rows, source_size, target, base, more) of distinct (doc_id, source, size,
    hash): each of a unit's rows is taken ``base`` times, and ``more`` of them once more."""
    grouped = materialize(sizes.groupBy(*KEY).agg(F.count("*").alias("rows")), "mix-units")
    goal = materialize(
        targets(grouped.select("source", (F.col("size") * F.col("rows")).alias("size")), weights)
        .join(grouped.filter("size > 0").groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "source_n"), F.col("source").eqNullSafe(F.col("source_n")), "left")
        .drop("source_n"),
        "mix-targets",
    )
    goal_key = goal.withColumnRenamed("source", "goal_source")
    spread = grouped.join(goal_key, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    ratio = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    spread = spread.withColumn("base", F.floor(ratio).cast("long")).withColumn("part", (ratio - F.floor(ratio)) * F.col("rows"))
    spread = spread.withColumn("whole", F.floor("part").cast("long")).withColumn("p", F.col("part") - F.floor("part"))
    own = ["size", "hash", "rows", "base", "whole"]
    tree = spread.filter((F.col("size") > 0) & (F.col("p") > 0))
    flat = spread.filter((F.col("size") <= 0) | (F.col("p") <= 0)).select("doc_id", "source", *own[:-1], F.col("whole").alias("more"))
    # Longest first: a long document meets many shorter ones and settles, so that a short one is left.
    unit = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(seed), *KEY).alias("h"), "p", F.col("size").cast("double").alias("mass"), "doc_id", *own)
    block = F.pmod(F.xxhash64(F.lit(seed + 2), *KEY), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)))
    level = tree.select("source", block.alias("block"), unit.alias("unit"))
    most = goal.agg(F.max("n")).first()[0] or 0
    blocks, depth = max(1, math.ceil(most / BLOCK)), 0
    decided = flat
    done = lambda c: [c["doc_id"].alias("doc_id"), F.col("source"), *[c[x].alias(x) for x in own[:-1]], (c["whole"] + (c["p"] >= 1).cast("long")).alias("more")]
    while True:
        reduced = materialize(_reduce(level, seed + 10 + depth), "mix-level")
        decided = decided.unionByName(reduced.select("source", F.explode("done").alias("unit")).select(*done(F.col("unit"))))
        if blocks == 1:
            last = F.col("held")
            alone = (_uniform(seed + 1, last["h"]) < last["p"]).cast("double")
            return decided.unionByName(
                reduced.filter("held IS NOT NULL").select("source", last.withField("p", alone).alias("unit")).select(*done(F.col("unit")))
            ).join(goal_key.drop("n"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
        level = reduced.filter("held IS NOT NULL").select("source", F.expr(f"block div {BLOCK}").alias("block"), F.col("held").alias("unit"))
        blocks, depth = math.ceil(blocks / BLOCK), depth + 1


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), *more)


def mix_table(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 5) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``."""
    units = materialize(mixed_units(_sized(docs), weights, seed), "mix-decided")
    # The rows of a unit that is repeated very often are written by many tasks, a chunk each.
    chunks = units.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(CHUNK).cast("long"))))
    often = chunks.filter(F.col("rows") > CHUNK).repartition("doc_id", "hash", "from")
    each = chunks.filter(F.col("rows") <= CHUNK).unionByName(often)
    each = each.withColumn("row", F.explode(F.sequence(F.col("from"), F.least(F.col("rows"), F.col("from") + CHUNK - 1))))
    copies = F.col("base") + (F.col("row") <= F.col("more")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 5) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it (not at all, or up to ``MOST``). Which of
    several rows equal in doc_id, source and text is taken once more is not defined."""
    sized = _sized(packed(docs, "doc_id", "source", "text"), "_row")
    units = materialize(mixed_units(sized.select(*KEY), weights, seed), "mix-decided")
    chosen = units.select(*[F.col(c).alias(f"k_{c}") for c in KEY], "rows", "base", "more").filter("base > 0 OR more > 0")
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in KEY]
    # Rows of a unit need a number only where some of them, and not all, are taken once more.
    some = "more > 0 AND more < rows"
    taken = sized.join(chosen.filter(f"NOT ({some})"), same).select("_row", (F.col("base") + (F.col("more") > 0).cast("long")).alias("copies"))
    if not chosen.filter(some).isEmpty():
        number = F.row_number().over(W.partitionBy(*[f"k_{c}" for c in KEY]).orderBy(F.lit(1)))
        numbered = sized.join(chosen.filter(some), same).withColumn("number", number)
        taken = taken.unionByName(numbered.select("_row", (F.col("base") + (F.col("number") <= F.col("more")).cast("long")).alias("copies")))
    return taken.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
