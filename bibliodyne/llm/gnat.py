"""Hard negatives by a multiway hyperplane tree (GNAT) over all vectors.

The tree is built level by level in Spark. Of each node at most ``3 * fan`` rows (those of the least hash) are looked at
for its split points, which are chosen far apart; every row then goes to its nearest split point, and the node keeps
for each split point the least and greatest distance to the rows of every sibling subtree. Rows of a node are dealt
in blocks, so that a node of any size is spread; every row is in a leaf.

Scores are inner products, which are no distance, so vectors get one more coordinate that lifts them to a sphere
of the greatest norm M, and queries get 0 there: then ``d(q, x)**2 = |q|**2 + M**2 - 2 q.x``, and a window of scores is
an annulus of distances. A search goes down the tree for all queries at once: with ``t`` the distance to a split point
and [lo, hi] its range to a subtree, the subtree's rows lie within ``max(lo - t, t - hi)`` and ``t + hi`` of the
query; a subtree whose bounds miss all annuli of the query is dropped. Leaves are compared exactly, in integers, in
blocks of rows and queries. The query's own leaf goes first: the k-th best score there narrows the annuli.

Each search returns exactly the first ``k`` rows of every window by score, then vec_id. Distances carry a slack for
rounding, so nothing is lost.

Rows with a null vec_id, a null label, a null vector, a null or non-finite component, or a vector of another length than
the commonest take no part; zero vectors do. Rows that repeat an id are rows of their own (other than each other), as
anchors, too. Scores must fit a long. An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliodyne.llm.hot import join_class
from bibliodyne.session import materialize

#: Rows of a leaf on average, and split points of a node at most and at least.
LEAF, WIDEST, NARROWEST = 512, 32, 4
#: Rows, and queries, of a node that one task takes together.
ROWS, QUERIES = 8192, 16384
#: Queries of a block that are compared at a time.
CHUNK = 256
K = 5
FAR = 1 << 62


@dataclass
class Tree:
    """Levels of (node, splits, child, lo, hi) from the root down, and all rows with their leaf as ``node``."""

    levels: list[DataFrame]
    rows: DataFrame
    square: float  # the greatest squared norm


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in doubles where no sum can lose a bit."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 1 << 53 else a @ b.T


def _lifted(a: np.ndarray, b: np.ndarray, square: float) -> np.ndarray:
    """Distances of lifted rows."""
    height = lambda x: np.sqrt(np.maximum(0.0, square - (x.astype(np.float64) ** 2).sum(axis=1)))
    return np.sqrt(np.maximum(0.0, 2 * square - 2 * (_products(a, b) + np.outer(height(a), height(b)))))


def points(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, label, x) of the rows that take part: labels moved where the contract says, integer vectors."""
    v = F.col("embedding")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    ok = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    size = ok.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = ok.filter(F.size(v) == (size.d if size else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), whole.alias("x"))
    return materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "gnat-points")


def _blocks(rows: DataFrame, sizes: DataFrame, per: int, name: str) -> DataFrame:
    """``rows`` with the number of blocks of their node (``name`` + s) and their own block."""
    classes = materialize(sizes.select("node", F.col("n").alias("copies"), F.ceil(F.col("n") / per).alias(f"{name}s")), "gnat-sizes")
    return join_class(rows, classes, "node", "rid").withColumn(name, F.pmod(F.xxhash64(F.lit(7), "rid"), F.col(f"{name}s")))


def _count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.count("*").alias("n"))


def _every(blocks: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))


def _splits(rows: DataFrame, fan: int, square: float) -> DataFrame:
    """(node, splits): up to ``fan`` rows of each node that are far from each other, from ``3 * fan`` of the least hash."""
    place = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64(F.lit(12), "vec_id", "rid")))
    some = rows.select("node", "x", "vec_id", "rid", place.alias("place")).filter(F.col("place") <= 3 * fan)

    def chosen(t: pa.Table) -> pa.Table:
        x = _matrix(t.sort_by("place").column("x"))
        d = _lifted(x, x, square)
        taken, near = [0], d[0].copy()
        while len(taken) < fan and near.max() > 0:
            taken.append(int(near.argmax()))
            near = np.minimum(near, d[taken[-1]])
        taken = [i for n, i in enumerate(taken) if i not in taken[:n]]
        return pa.table({"node": t.column("node")[:1], "splits": pa.array([x[taken].tolist()], pa.list_(pa.list_(pa.int64())))})

    return some.groupBy("node").applyInArrow(chosen, "node long, splits array<array<long>>")


def _assigned(rows: DataFrame, splits: DataFrame, square: float, fan: int) -> DataFrame:
    """``rows`` with their child and their distances to all split points of their node."""
    sizes = materialize(_count(rows), "gnat-counts")
    left = _blocks(rows, sizes, ROWS, "block")
    right = splits.join(sizes, "node").select("node", "splits", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / ROWS) - 1)).alias("block"))

    def near(t: pa.Table, s: pa.Table) -> pa.Table:
        d = _lifted(_matrix(t.column("x")), np.array(s.column("splits")[0].as_py(), dtype=np.int64), square) if len(t) else np.zeros((0, 1))
        child = t.column("node").to_numpy() * fan + d.argmin(axis=1) if len(t) else np.zeros(0, np.int64)
        kept = {c: t.column(c) for c in ("rid", "vec_id", "label", "x")}
        offsets = pa.array(np.arange(len(t) + 1, dtype=np.int32) * d.shape[1])
        return pa.table(kept | {"parent": t.column("node"), "node": child, "far": pa.ListArray.from_arrays(offsets, pa.array(d.reshape(-1)))})

    out = "rid long, vec_id long, label long, x array<long>, parent long, node long, far array<double>"
    return left.groupBy("node", "block").cogroup(right.groupBy("node", "block")).applyInArrow(near, out)


def build(rows: DataFrame, leaf: int = LEAF) -> Tree:
    """The tree over all rows (rid, vec_id, label, x)."""
    norm = F.aggregate(F.transform("x", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    n, square = rows.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
    leaves = max(NARROWEST, math.ceil(n / leaf))
    depth = max(1, math.ceil(math.log(leaves, WIDEST) - 1e-9))
    fan = max(NARROWEST, math.ceil(leaves ** (1 / depth) - 1e-9))
    placed, levels = rows.withColumn("node", F.lit(0).cast("long")), []
    for _ in range(depth):
        splits = materialize(_splits(placed, fan, square), "gnat-splits")
        assigned = materialize(_assigned(placed, splits, square, fan), "gnat-assigned")
        bound = lambda f: F.array(*[f(F.get("far", F.lit(i))) for i in range(fan)])
        ranges = assigned.groupBy("parent", "node").agg(bound(F.min).alias("lo"), bound(F.max).alias("hi"))
        child = F.array_sort(F.collect_list(F.struct(F.col("node").alias("child"), "lo", "hi"))).alias("children")
        held = ranges.groupBy(F.col("parent").alias("node")).agg(child)
        levels.append(materialize(held.join(splits, "node"), "gnat-level"))
        placed = assigned.drop("parent", "far")
    return Tree(levels, placed, square)


def _descended(tree: Tree, queries: DataFrame) -> DataFrame:
    """``queries`` (rid, label, x, lows, highs), each with every leaf (``node``) whose bounds meet one of its annuli."""
    square, slack = tree.square, 1e-9 * (1.0 + tree.square)
    columns = ["rid", "label", "x", "lows", "highs"]
    found = queries.select(*columns, F.lit(0).cast("long").alias("node"))
    for level in tree.levels:
        sizes = materialize(_count(found), "gnat-visits")
        left = _blocks(found, sizes, QUERIES, "block")
        right = level.join(sizes, "node").select("node", "splits", "children", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / QUERIES) - 1)).alias("block"))

        def met(q: pa.Table, s: pa.Table) -> pa.Table:
            if not len(q) or not len(s):
                return pa.table({c: q.column(c)[:0] for c in [*columns, "node"]})
            x, splits = _matrix(q.column("x")), np.array(s.column("splits")[0].as_py(), dtype=np.int64)
            own = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] + square
            apart = lambda scores: np.sqrt(np.maximum(0.0, own - 2.0 * scores))
            t = apart(_products(x, splits))
            # A rounding error of a square may be large beside a small distance: the slack is one of squares.
            wider = lambda d, sign: np.sqrt(np.maximum(0.0, d * d + sign * slack))
            inner, outer = wider(apart(_matrix(q.column("highs"))), -1), wider(apart(_matrix(q.column("lows"))), 1)
            children = s.column("children")[0].as_py()
            some = np.zeros((len(q), len(children)), dtype=bool)
            for j, c in enumerate(children):
                lo, hi = (np.array(c[k][: len(splits)], dtype=np.float64) for k in ("lo", "hi"))
                nearest = wider(np.maximum(0.0, np.maximum(lo - t, t - hi)).max(axis=1), -1)
                farthest = wider((t + hi).min(axis=1), 1)
                some[:, j] = ((nearest[:, None] <= outer) & (farthest[:, None] >= inner)).any(axis=1)
            i, j = np.nonzero(some)
            out = {c: q.column(c).take(pa.array(i)) for c in columns}
            return pa.table(out | {"node": pa.array(np.array([c["child"] for c in children], dtype=np.int64)[j])})

        out = "rid long, label long, x array<long>, lows array<long>, highs array<long>, node long"
        found = materialize(left.groupBy("node", "block").cogroup(right.groupBy("node", "block")).applyInArrow(met, out), "gnat-frontier")
    return found


def _scanned(tree: Tree, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(rid, w, vec_id, score): of every query's leaves the first ``k`` rows of each window, of the same label or of others,
    the query itself left out. Blocks return their best; each window keeps the best of its blocks."""
    visits = materialize(_count(asked), "gnat-visits")
    sizes = materialize(_count(tree.rows), "gnat-leaves").join(visits.withColumnRenamed("n", "asked"), "node")
    sizes = materialize(sizes.select("node", F.col("n"), F.ceil(F.col("n") / ROWS).alias("row_blocks"), F.ceil(F.col("asked") / QUERIES).alias("query_blocks"), "asked"), "gnat-cells")
    classes = sizes.withColumn("copies", F.col("n")).drop("n", "asked")
    rows = join_class(tree.rows, materialize(classes, "gnat-row-cells"), "node", "rid").filter("query_blocks IS NOT NULL")
    rows = rows.select("node", F.pmod(F.xxhash64(F.lit(7), "rid"), F.col("row_blocks")).alias("r"), _every("query_blocks").alias("q"), "rid", "vec_id", "label", "x")
    met = join_class(asked, materialize(sizes.withColumn("copies", F.col("asked")).drop("n", "asked"), "gnat-query-cells"), "node", "rid")
    met = met.select("node", _every("row_blocks").alias("r"), F.pmod(F.xxhash64(F.lit(7), "rid"), F.col("query_blocks")).alias("q"), "rid", "label", "x", "lows", "highs")

    def best(q: pa.Table, t: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        found = [(empty, empty, empty, empty)]
        if len(q) and len(t):
            t = t.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
            x, ids, labels, rids = _matrix(t.column("x")), *(t.column(c).to_numpy() for c in ("vec_id", "label", "rid"))
            qx, lows, highs = (_matrix(q.column(c)) for c in ("x", "lows", "highs"))
            q_rids, q_labels = q.column("rid").to_numpy(), q.column("label").to_numpy()
            for s in range(0, len(q), CHUNK):
                at = slice(s, s + CHUNK)
                scores = _products(qx[at], x)
                fits = ((q_labels[at, None] == labels[None]) == same) & (q_rids[at, None] != rids[None])
                for w in range(lows.shape[1]):
                    i, j = np.nonzero(fits & (scores >= lows[at, w, None]) & (scores <= highs[at, w, None]))
                    # Rows are in the order of their ids, so a stable order by score has ties right.
                    order = np.lexsort((-scores[i, j], i))
                    i, j = i[order], j[order]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[nth < k], j[nth < k]
                    found.append((q_rids[at][i], np.full(len(i), w), ids[j], scores[i, j]))
        rid, w, vec_id, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"rid": rid, "w": pa.array(w, pa.int32()), "vec_id": vec_id, "score": score})

    cells = ["node", "r", "q"]
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # new column ids: queries may come from the tree's rows
    near = met.groupBy(*cells).cogroup(rows.groupBy(*cells)).applyInArrow(best, "rid long, w int, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("rid", "w").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(tree: Tree, queries: DataFrame, same: bool, k: int = K) -> DataFrame:
    """(rid, w, vec_id, score, rank): for each query (rid, label, x, node: its own leaf, lows, highs: score windows, both
    ends included) and window the first ``k`` rows by score, then vec_id."""
    own = _scanned(tree, queries, same, k).groupBy("rid", "w").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k)
    bounds = own.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("held"))
    narrowed = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at("held", i), low)))
    asked = materialize(queries.join(bounds, "rid", "left").withColumn("lows", narrowed).select("rid", "label", "x", "lows", "highs"), "gnat-asked")
    return materialize(_scanned(tree, _descended(tree, asked), same, k), "gnat-found")


def negatives_table(vectors: DataFrame, k: int = K, every: int = 100, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by
    ``every``) and each of its ``k`` best rows of the same label the first ``k`` rows of other labels with
    ``share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score``."""
    tree = build(points(vectors))
    anchors = tree.rows.filter(F.col("vec_id") % every == 0)
    long = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    whole = materialize(anchors.withColumn("lows", long(-FAR)).withColumn("highs", long(FAR)), "gnat-anchors")
    positives = search(tree, whole, True, k)
    # The least n with share[1] * n >= share[0] * p; ``div`` cuts towards 0.
    low = F.expr(f"({share[0]} * score + if(score > 0, {share[1] - 1}, 0)) div {share[1]}")
    windows = positives.withColumn("low", low).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "low"))).alias("p"))
    of = lambda name: F.transform("p", lambda p: p[name])
    asked = materialize(whole.drop("lows", "highs").join(windows, "rid").withColumn("lows", of("low")).withColumn("highs", of("score")), "gnat-windows")
    # Windows are arrays of one length within a batch: shorter ones are filled with empty windows.
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("long"), F.lit(k) - F.size(c)))
    filled = asked.withColumn("lows", fill(F.col("lows"), FAR)).withColumn("highs", fill(F.col("highs"), -FAR))
    found = search(tree, filled, False, k)
    of_anchor = asked.select("rid", F.col("vec_id").alias("anchor_id"), "p")
    met = found.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(of_anchor, "rid")
    p = F.element_at("p", F.col("w") + 1)
    return met.select("anchor_id", p["vec_id"].alias("positive_id"), "rank", "negative_id", p["score"].alias("positive_score"), "negative_score")
