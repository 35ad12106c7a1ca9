"""Approximate nearest neighbours with learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts (recursive spectral bisection at the
median). A small network learns to predict, from a vector, in which parts its neighbours lie. It
routes every row to its most probable part and every query to its several most probable ones,
whose rows are scored exactly. How many parts a query visits is set so that a bounded number of
audited queries, compared by brute force with all rows, reach the wanted recall.

Parts are searched in blocks of bounded size (rows and queries), so a part that holds a third of all
rows spreads over tasks like any other; each block returns one row per query with its best k.

The number of parts grows with the square root of the number of rows, to at most ``MOST_PARTS`` (reached at
some 270 million rows, beyond which the parts grow). A part's rows are repeated for the blocks of its own
queries only. Rows with a null id take no part, nor do vectors that are null, zero, not finite or of an uncommon
length. A query never meets its own id; rows that repeat an id are candidates each, and one query (of the
smallest vector). Fewer than k candidates are all returned. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliodyne.llm.vectors import dots, matrix, usable
from bibliodyne.session import materialize

MOST_PARTS = 4096
#: Sampled rows per part that the model is fitted on.
SAMPLE_PER_PART = 64
AUDITED = 200
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) positions of the largest inner products, in blocks."""
    out = np.zeros((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 40, seed: int = 7) -> np.ndarray:
    """Cut a neighbour graph into ``parts`` (a power of two) of equal size."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    label, rng = np.zeros(n, dtype=np.int64), np.random.default_rng(seed)
    for _ in range(int(math.log2(parts))):
        # All parts are bisected at once: edges between parts are gone, and sums run per part.
        inside = label[a] == label[b]
        ea, eb = a[inside], b[inside]
        degree = np.bincount(ea, minlength=n) + 1.0
        size = np.bincount(label)
        f = rng.standard_normal(n)
        for _ in range(rounds):
            f = 0.5 * (f + (np.bincount(ea, weights=f[eb], minlength=n) + f) / degree)
            f -= (np.bincount(label, weights=f * degree) / np.bincount(label, weights=degree))[label]
            f /= np.sqrt(np.bincount(label, weights=f * f) / size + 1e-12)[label]
        order = np.lexsort((f, label))
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - start[label[order]]
        label = 2 * label + (place >= size[label] // 2)
    return label


class Router:
    """One hidden layer, softmax over parts."""

    def __init__(self, d: int, parts: int, hidden: int = 128, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.parts = parts
        self.w = [rng.standard_normal((d, hidden)) / math.sqrt(d), np.zeros(hidden), rng.standard_normal((hidden, parts)) / math.sqrt(hidden), np.zeros(parts)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, seen: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3, seed: int = 7) -> Router:
        """Adam on the cross entropy with the parts ``seen`` (rows, places) of each row and its neighbours."""
        rng, moment, power, t = np.random.default_rng(seed), [0 * w for w in self.w], [0 * w for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                i, t = order[at : at + batch], t + 1
                h = np.maximum(x[i] @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                g = p / p.sum(axis=1, keepdims=True)
                np.add.at(g, (np.repeat(np.arange(len(i)), seen.shape[1]), seen[i].ravel()), -1.0 / seen.shape[1])
                g /= len(i)
                gh = (g @ self.w[2].T) * (h > 0)
                grads = [x[i].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
                for j, grad in enumerate(grads):
                    moment[j] = 0.9 * moment[j] + 0.1 * grad
                    power[j] = 0.999 * power[j] + 0.001 * grad**2
                    self.w[j] = self.w[j] - rate * (moment[j] / (1 - 0.9**t)) / (np.sqrt(power[j] / (1 - 0.999**t)) + 1e-8)
        return self


def parts_for(rows: int) -> int:
    """1 for small tables, else a power of two near a quarter of the square root of the rows."""
    return 1 if rows < 1024 else min(MOST_PARTS, 1 << max(3, round(math.log2(math.sqrt(rows) / 4))))


def fit_router(vectors: DataFrame, rows: int, graph_k: int = 16) -> Router | None:
    """Fit on the rows with the smallest hashes, ``SAMPLE_PER_PART`` per part."""
    parts = parts_for(rows)
    if parts == 1:
        return None
    wanted = min(rows, SAMPLE_PER_PART * parts)
    h = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 40))
    near = vectors.select("id", "v", h.alias("h")).filter(F.col("h") < F.lit(int((1 << 40) * min(1.0, 1.5 * wanted / rows + 0.001))))
    x = matrix(near.orderBy("h", "id").limit(wanted).select("v").toPandas().v)
    if len(x) <= 2 * graph_k:
        return None
    graph = neighbour_graph(x, graph_k)
    label = balanced_parts(graph, parts)
    return Router(x.shape[1], parts).fit(x, np.concatenate([label[graph], label[:, None]], axis=1))


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """Per query its k best (-score, id): candidates by a matrix product, order by exact row products."""
    out = []
    for at in range(0, len(q), 128):
        s = q[at : at + 128] @ x.T
        s[q_ids[at : at + 128, None] == x_ids[None]] = -np.inf
        for i, row in enumerate(s):
            edge = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            # A matrix product may differ in the last bits from place to place: keep what may tie.
            some = np.nonzero((row >= edge - 1e-9 * max(1.0, abs(edge))) & (row > -np.inf))[0] if edge > -np.inf else np.nonzero(row > -np.inf)[0]
            exact = dots(np.broadcast_to(q[at + i], (len(some), q.shape[1])), x[some])
            order = np.lexsort((x_ids[some], -exact))[:k]
            out.append([(-float(exact[j]), int(x_ids[some][j])) for j in order])
    return out


def _audit(index: DataFrame, queries: DataFrame, router: Router, k: int, recall: float) -> int:
    """The number of parts to visit for the wanted mean recall over some queries, by brute force."""
    h = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 40))
    some = queries.select("id", "v").orderBy(h, "id").limit(AUDITED).toPandas()
    if not len(some):
        return router.parts
    q, q_ids = matrix(some.v), some.id.to_numpy()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, ids, part = matrix(b.v), b.id.to_numpy(), dict(zip(b.id, b.part, strict=True))
            found = _best(q, q_ids, x, ids, k)
            rows = [(int(q_ids[i]), s, j, int(part[j])) for i, best in enumerate(found) for s, j in best]
            yield pd.DataFrame(rows, columns=["q", "s", "id", "part"])

    each = index.mapInPandas(local, "q long, s double, id long, part int")
    top = each.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "id", "part"))), 1, k).alias("top"))
    truth = {r.q: r.part for r in top.select("q", "top.part").collect()}
    order = np.argsort(-router.log_odds(q), axis=1)
    visits = np.zeros(router.parts)
    for i, q_id in enumerate(q_ids):
        place = {int(p): n for n, p in enumerate(order[i])}
        hits = [place[p] for p in truth.get(int(q_id), [])]
        np.add.at(visits, hits, 1.0 / max(1, len(hits)) / len(q_ids))
    return int(np.searchsorted(np.cumsum(visits), recall) + 1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.96) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` nearest to each row of ``queries``.

    Both have vec_id and embedding. Nearness is the inner product; ties go to the smaller vec_id.
    """
    columns = [F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")]
    rows = usable(vectors.filter("vec_id IS NOT NULL")).select(*columns)
    asked = usable(queries.filter("vec_id IS NOT NULL")).select(*columns).groupBy("id").agg(F.min("v").alias("v"))
    total = rows.count()
    router = fit_router(rows, total)
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def routed(n: int) -> Column:
        """The n most probable parts of a vector."""

        @F.pandas_udf("array<int>")
        def parts(v: pd.Series) -> pd.Series:
            order = np.argsort(-shared.value.log_odds(matrix(v)), axis=1)[:, :n] if len(v) else []
            return pd.Series([r.astype("int32") for r in order], dtype=object)

        return parts(F.col("v"))

    if router is None:
        index = rows.withColumn("part", F.lit(0))
        parts = asked.withColumn("parts", F.array(F.lit(0)))
    else:
        index = materialize(rows.withColumn("part", F.element_at(routed(1), 1)), "ann-index")
        sizes = {r.part: r["count"] for r in index.groupBy("part").count().collect()}
        visited = min(router.parts, _audit(index, asked, router, k, recall))
        # However the rows fall, the visited parts hold at least k candidates, or all parts are visited.
        small = sorted(sizes.get(p, 0) for p in range(router.parts))
        while visited < router.parts and sum(small[:visited]) <= k:
            visited += 1
        parts = asked.withColumn("parts", routed(visited))
    # One row a part; the blocks of a part's rows meet the blocks of the queries that visit it.
    visits = materialize(parts.withColumn("part", F.explode("parts")).select("id", "v", "part"), "ann-visits")
    of = lambda rows, size, name: rows.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = F.broadcast(of(index, BLOCK_ROWS, "rows_in").join(of(visits, BLOCK_QUERIES, "asked_in"), "part"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int")
    left = index.join(blocks, "part").withColumn("cb", block(3, "rows_in")).withColumn("qb", spread("asked_in"))
    right = visits.join(blocks, "part").withColumn("qb", block(5, "asked_in")).withColumn("cb", spread("rows_in"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def best(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "top": []})
        found = _best(matrix(q.v), q.id.to_numpy(), matrix(x.v), x.id.to_numpy(), k)
        return pd.DataFrame({"query_id": q.id, "top": [[{"s": s, "id": i} for s, i in r] for r in found]})

    keys = ["part", "cb", "qb"]
    tops = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, top array<struct<s:double,id:long>>")
    merged = tops.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def neighbours_table(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The search with every row whose id is divisible by ``every`` as a query."""
    return search(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
