"""Near-duplicate embeddings by NN-descent, compared within a label.

Exact copies collapse to one node first. Neighbour lists start from blocks of rows that share a prefix
of random hyperplane signs in one of several tables (blocks are split when they grow too large), and are
refined: the neighbours and reverse neighbours of a node are compared with each other, and whoever
finds a nearer one takes it into its list. Every table and every round cuts what is too large anew. A
list whose entries all reach the threshold is saturated and gets four times the room. Rounds end when
few entries change; then an audit compares the links found for some nodes, with and without links, with
those of a brute-force count, and if too many are missing, further tables and rounds follow. Labels that
still lack links after that are counted exactly, like dense groups. Links are the list entries at or
above the threshold, in both directions.

Lists that stay saturated at ``MOST_ROOM`` entries belong to dense groups, whose pairs are not listed. A link
of such a node with one whose list is not saturated stands in the latter's list. Dense nodes are compared
with each other only, within their label, in blocks that return counts and a spanning forest, so links and
components are whole while no group's pairs are written out. That work still grows with the square of
the dense nodes of a label (not with the label's other rows).

Vectors that are null, zero, not finite or of an uncommon length, and rows without label or id, link
with nothing: no links, a component of their own. Rows that repeat an id are rows of their own, in
one label or several: each has its links, and an id's rows may lie in several components. An empty table
gives no rows; columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliodyne.llm.components import components
from bibliodyne.llm.hot import join_class
from bibliodyne.llm.vectors import dots, matrix, usable
from bibliodyne.session import materialize

THRESHOLD = 0.93
ROOM, MOST_ROOM = 8, 64
TABLES, BITS = 8, 30
#: Rows of a starting block on average, and at most before it is split.
LEAF, SPLIT = 96, 256
#: Neighbours of one node that are compared with each other in one piece.
PIECE = 64
#: Audited nodes with links, and at least and at most so many without.
AUDITED, MOST_AUDITED = 512, 8192
#: Dense nodes of a label in a block that is compared with another one.
DENSE = 2048
LIST = "id long, nb array<struct<s:double,id:long>>"
#: Rows of a bucket of blocks that a task takes together, on average.
BUCKET = 4096


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _entries(ids: np.ndarray, x: np.ndarray, room: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, similarity, other) of each row's nearest others, ``room`` at most, that are nearer than ``least``."""
    s = x @ x.T
    s[ids[:, None] == ids[None]] = -np.inf
    k = min(int(room.max(initial=0)), len(ids) - 1)
    if k <= 0:
        return ids[:0], np.zeros(0), ids[:0]
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(s, top, axis=1)
    order = np.argsort(-near, axis=1)
    near, top = np.take_along_axis(near, order, axis=1), np.take_along_axis(top, order, axis=1)
    i, j = np.nonzero((np.arange(k) < room[:, None]) & (near > least[:, None] + 1e-12))
    other = top[i, j]
    # Row products do not depend on where a row stands, so equal pairs compare equal later.
    return ids[i], dots(x[i], x[other]), ids[other]


def _blocks(b: pa.Table, key: list[str], room: str | None, least: str | None) -> pa.Table:
    """Lists found within each block of a bucket; rows of a block have equal keys."""
    b = b.sort_by([(k, "ascending") for k in key])
    keys = np.stack([b.column(k).to_numpy() for k in key], axis=1) if len(b) else np.zeros((0, len(key)))
    ids, x = b.column("id").to_numpy(), _vectors(b.column("v"))
    rooms = b.column(room).to_numpy() if room else np.full(len(b), ROOM)
    low = b.column(least).to_numpy() if least else np.full(len(b), -np.inf)
    ends = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [len(b)]])
    found = [_entries(ids[s:e], x[s:e], rooms[s:e], low[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True) if e - s > 1]
    owner, near, other = (np.concatenate(c) for c in zip(*found, (ids[:0], np.zeros(0), ids[:0]), strict=True))
    starts = np.concatenate([[0], np.nonzero(owner[1:] != owner[:-1])[0] + 1]) if len(owner) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.concatenate([starts, [len(owner)]]).astype(np.int32))
    entries = pa.StructArray.from_arrays([pa.array(near, pa.float64()), pa.array(other, pa.int64())], names=["s", "id"])
    return pa.table({"id": pa.array(owner[starts], pa.int64()), "nb": pa.ListArray.from_arrays(offsets, entries)})


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows in double of a column of vectors of one length."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _merged(parts: DataFrame, room: Column) -> DataFrame:
    """One list per id from rows (id, nb, room): the nearest distinct entries."""
    both = F.sort_array(F.array_distinct(F.flatten(F.collect_list("nb"))), asc=False)
    return parts.groupBy("id").agg(F.slice(both, 1, F.max(room)).alias("nb"), F.max(room).alias("room"))


def _starting_lists(nodes: DataFrame, first_table: int, tables: int) -> DataFrame:
    """(id, nb) from blocks of equal hyperplane signs, for the tables from ``first_table`` on."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(pa.chunked_array([b.column("v")]))
            planes = [np.random.default_rng([10, t]).standard_normal((x.shape[1], BITS)) for t in range(first_table, first_table + tables)]
            shift = BITS - b.column("bits").to_numpy()
            for t, p in enumerate(planes):
                code = ((x @ p > 0) @ (1 << np.arange(BITS - 1, -1, -1))) >> shift
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("place"), b.column("v"), pa.array(np.full(len(code), t), pa.int32()), pa.array(code, pa.int64())], names=["id", "place", "v", "t", "code"])

    sizes = materialize(nodes.groupBy("label").agg(F.count("*").alias("n")).withColumn("place", F.monotonically_increasing_id()), "nn-labels")
    bits = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF)))).cast("int")
    # Numbers stand for labels: equal ones are told apart by the numbers of their blocks alone.
    sized = nodes.join(sizes.select("label", "place", bits.alias("bits")), "label").select("id", "place", "v", "bits")
    vector = nodes.schema["v"].dataType.simpleString()
    rows = materialize(sized.mapInArrow(coded, f"id long, place long, v {vector}, t int, code long"), "nn-codes")
    key = ["place", "t", "code"]
    pieces = rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select(*key, F.ceil(F.col("n") / LEAF).alias("pieces"))
    split = rows.join(pieces, key, "left").withColumn("piece", F.pmod(F.xxhash64(F.lit(1), "t", "id"), F.coalesce("pieces", F.lit(1)))).drop("pieces")
    buckets = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) * tables // BUCKET)
    split = split.withColumn("bucket", F.pmod(F.xxhash64(F.lit(9), *key, "piece"), F.lit(buckets)))
    return split.groupBy("bucket").applyInArrow(lambda b: _blocks(b, [*key, "piece"], None, None), LIST)


def _refined(nodes: DataFrame, lists: DataFrame, total: int, turn: int) -> DataFrame:
    """(id, nb) of nearer neighbours found among neighbours of neighbours; each turn cuts crowds anew."""
    entries = lists.select("id", F.explode("nb").alias("e")).select(F.col("id").alias("u"), F.col("e.id").alias("x"))
    around = entries.union(entries.select(F.col("x").alias("u"), F.col("u").alias("x"))).distinct()
    crowded = around.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > PIECE).select("u", F.ceil(F.col("n") / PIECE).alias("pieces"))
    piece = F.pmod(F.xxhash64(F.lit(2), F.lit(turn), "x", "u"), F.coalesce("pieces", F.lit(1)))
    least = F.when(F.size("nb") < F.col("room"), F.lit(-2.0)).otherwise(F.array_min(F.transform("nb", lambda e: e["s"])))
    state = nodes.select("id", "v").join(lists.select("id", "room", least.alias("least")), "id")
    rows = around.join(crowded, "u", "left").withColumn("piece", piece).drop("pieces").join(state, F.col("x") == F.col("id")).drop("x")
    buckets = max(1, total * 2 * ROOM // BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(3), "u", "piece"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(lambda b: _blocks(b, ["u", "piece"], "room", "least"), LIST)


def _linked(s: Column, threshold: float) -> Column:
    return s >= threshold


def _saturated(threshold: float) -> Column:
    return (F.size("nb") >= F.col("room")) & F.forall("nb", lambda e: _linked(e["s"], threshold))


def _audit(nodes: DataFrame, lists: DataFrame, threshold: float, missing: float, turn: int) -> tuple[float, list]:
    """Share of the links of unsaturated nodes that the lists lack, and the labels where some lack.

    Nodes with and without listed links are sampled apart and weighted by their numbers. Without, so many
    are taken (``MOST_AUDITED`` at most) that a share of over ``missing`` would show.
    """
    rest = lists.filter(~_saturated(threshold)).select("id", F.size(F.filter("nb", lambda e: _linked(e["s"], threshold))).alias("found"))
    n, linked, links = rest.agg(F.count("*"), F.coalesce(F.sum((F.col("found") > 0).cast("int")), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
    enough = int(min(MOST_AUDITED, max(AUDITED, 3 * (n - linked) / (missing * max(1, links)))))
    some = lambda part, k: rest.filter(part).orderBy(F.xxhash64(F.lit(4), F.lit(turn), "id"), "id").limit(k)
    asked = some("found > 0", AUDITED).union(some("found = 0", enough)).join(nodes.select("id", "label", "v"), "id").toPandas()
    if not len(asked):
        return 0.0, []
    a, ids, labels, found = _unit(matrix(asked.v)), asked.id.to_numpy(), asked.label.to_numpy(), asked.found.to_numpy()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, label, own = _unit(matrix(b.v)), b.label.to_numpy(), b.id.to_numpy()
            for s in range(0, len(ids), AUDITED):
                at = slice(s, s + AUDITED)
                hit = (a[at] @ x.T >= threshold) & (labels[at, None] == label[None]) & (ids[at, None] != own[None])
                yield pd.DataFrame({"id": ids[at], "n": hit.sum(axis=1)})

    true = dict(nodes.select("id", "label", "v").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False))
    true = np.array([true.get(i, 0) for i in ids])
    lacking = np.maximum(0, true - found)
    weight = np.where(found > 0, linked / max(1, (found > 0).sum()), (n - linked) / max(1, (found == 0).sum()))
    return float((weight * lacking).sum() / max(1, (weight * true).sum())), asked.label[lacking > 0].unique().tolist()


def _without_room(lists: DataFrame, these: Column) -> DataFrame:
    none = F.expr("cast(array() as array<struct<s:double,id:long>>)")
    return lists.select("id", F.when(these, none).otherwise(F.col("nb")).alias("nb"), F.when(these, F.lit(0)).otherwise(F.col("room")).alias("room"))


def neighbour_lists(nodes: DataFrame, threshold: float = THRESHOLD, missing: float = 0.01, rounds: int = 4, attempts: int = 3) -> DataFrame:
    """(id, nb, room) after refinement; nodes have id, label and v (a vector).

    A list without room is left to the exact count of ``_dense``: its label failed the last audits.
    """
    total = nodes.count()
    room = F.coalesce("room", F.lit(ROOM))
    empty = nodes.select("id", F.expr("cast(array() as array<struct<s:double,id:long>>)").alias("nb"), F.lit(ROOM).alias("room"))
    lists = empty
    for attempt in range(attempts):
        started = _starting_lists(nodes, attempt * TABLES, TABLES).withColumn("room", F.lit(0))
        lists = materialize(_merged(started.unionByName(lists), room), "nn-lists")
        for turn in range(rounds):
            # Saturated lists get room for four times as many, before the round that may fill it.
            roomy = lists.withColumn("room", F.when(_saturated(threshold), F.least(F.lit(MOST_ROOM), 4 * F.col("room"))).otherwise(F.col("room")))
            found = materialize(_refined(nodes, roomy, total, attempt * rounds + turn).withColumn("room", F.lit(0)), "nn-found")
            changed = found.agg(F.sum(F.size("nb"))).first()[0] or 0
            lists = materialize(_merged(found.unionByName(roomy), room), "nn-lists")
            if changed <= 0.002 * total * ROOM:
                break
        share, short = _audit(nodes, lists, threshold, missing, attempt)
        if share <= missing:
            return lists
    # Labels seen to lack links are counted exactly, and if the others fail again and again, all are.
    for turn in range(attempts, attempts + 3):
        lists = materialize(_without_room(lists.join(nodes.select("id", "label"), "id"), F.col("label").isin(short)), "nn-lists")
        share, short = _audit(nodes, lists, threshold, missing, turn)
        if share <= missing:
            return lists
    return _without_room(lists, F.lit(True))


def _dense(nodes: DataFrame, dense: DataFrame, threshold: float) -> DataFrame:
    """Rows (kind, a, b, n) of dense nodes against those of their label: kind 0 a sum of the links' copies, 2 a link
    of a spanning forest."""
    rows = nodes.join(dense.select("id"), "id", "left_semi").select("id", "label", "v", "c")
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / DENSE).alias("blocks"))
    placed = rows.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = placed.withColumn("i", F.col("own")).withColumn("j", spread).drop("own", "blocks")
    right = placed.withColumn("j", F.col("own")).withColumn("i", spread).drop("own", "blocks")

    def cell(x: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(d):
            return pd.DataFrame({"kind": [], "a": [], "b": [], "n": []})
        a, b = d.id.to_numpy(), x.id.to_numpy()
        hit = (_unit(matrix(d.v)) @ _unit(matrix(x.v)).T >= threshold) & (a[:, None] != b[None])
        out = [pd.DataFrame({"kind": 0, "a": a, "b": a, "n": hit @ x.c.to_numpy()})]
        if hit.any():
            big = np.iinfo(np.int64).max
            low, right = a.copy(), np.full(len(b), big)
            while True:
                new_right = np.minimum(b, np.where(hit, low[:, None], big).min(axis=0))
                new_low = np.minimum(low, np.where(hit, new_right[None], big).min(axis=1))
                if (new_right == right).all() and (new_low == low).all():
                    break
                low, right = new_low, new_right
            linked = hit.any(axis=0)
            forest = pd.DataFrame({"kind": 2, "a": np.concatenate([a, b[linked]]), "b": np.concatenate([low, right[linked]]), "n": 0})
            out.append(forest[forest.a != forest.b])
        return pd.concat(out).astype("int64")

    keys = ["label", "i", "j"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # new column ids: both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "kind long, a long, b long, n long")


def links_table(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, label, embedding).

    Nodes are the classes of equal label and vector, under numbers of their own; an id is looked at for output only. A row
    links with every other row of its label that is near enough, whatever their ids."""
    own = ["vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")]
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("e"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "nn-rows")
    takes = usable(base.filter("vec_id IS NOT NULL AND label IS NOT NULL"), "e")
    classes = takes.groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count("*").alias("c"))

    nodes = materialize(classes.select("label", "c", F.col("e").alias("v"), "least").withColumn("id", F.monotonically_increasing_id()), "nn-nodes")
    lists = neighbour_lists(nodes.select("id", "label", "c", "v"), threshold)
    dense = materialize(lists.filter(_saturated(threshold)).select("id"), "nn-dense-ids")
    exact = materialize(_dense(nodes, dense, threshold), "nn-dense")
    listed = lists.select("id", F.explode(F.filter("nb", lambda e: _linked(e["s"], threshold))).alias("e")).select(F.col("id").alias("a"), F.col("e.id").alias("b"))
    pairs = materialize(listed.union(listed.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "nn-pairs")
    # Pairs of two dense nodes are counted by blocks, all others from the lists.
    is_dense = lambda c: dense.select(F.col("id").alias(c), F.lit(True).alias(f"dense_{c}"))
    told = pairs.join(is_dense("a"), "a", "left").join(is_dense("b"), "b", "left").filter("dense_a IS NULL OR dense_b IS NULL")
    sparse = told.join(nodes.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.sum("c").alias("n"))
    counts = sparse.union(exact.filter("kind = 0").groupBy("a").agg(F.sum("n").alias("n"))).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(pairs.filter("a > b").union(exact.filter("kind = 2").select("a", "b"))).withColumnRenamed("node", "id")
    placed = nodes.join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = materialize(placed.select("label", "v", "least", "root", "c", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links")), "nn-placed")
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # One value stands for a class, so that a large one meets its rows without a hot task.
    key = F.struct("label", F.col("v").alias("e"))
    found = materialize(placed.join(first, "root").select(key.alias("key"), "n_links", "component_id", F.col("c").alias("copies")), "nn-found")
    met = join_class(takes.select("vec_id", "row", F.struct("label", "e").alias("key")), found, "key", "row")
    taken = met.select("row", "vec_id", "n_links", "component_id")
    alone = base.join(taken.select("row"), "row", "left_anti").select(*own)
    return taken.drop("row").unionByName(alone).select("vec_id", "n_links", "component_id", kept)
