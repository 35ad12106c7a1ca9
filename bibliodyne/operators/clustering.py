"""k-means for many k and many starts in shared scans, and silhouettes by true distances.

Every pass over the vectors moves all models that have not settled yet, so the number of passes is that of the slowest
model, not the sum over k and starts. A task returns sums per model and cluster, which are added up component by
component before the shuffle. Starts are drawn (k-means++) from at most ``START_ROWS`` rows, those of the smallest hash.

A silhouette is taken at no more than ``MOST_POINTS`` points, again of the smallest hash, against **all** rows: up to that
many rows it is the plain silhouette, beyond it an estimate with an error of about 0.5 / sqrt(MOST_POINTS).

Vectors that are null, hold null or non-finite components, or have another length than most of the starting rows take no
part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START_ROWS = 4096
MOST_POINTS = 2000
#: Rows that are compared with all points at a time.
BLOCK = 1024


@dataclass
class Partition:
    k: int
    centers: np.ndarray
    cost: float


def usable(vectors: DataFrame) -> DataFrame:
    """(doi, embedding as doubles) without null and non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(finite & (F.size("embedding") > 0), F.lit(False))
    return vectors.filter(good).select("doi", F.col("embedding").cast("array<double>").alias("embedding"))


def least_by_hash(rows: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` rows, the same in every run."""
    return rows.orderBy(F.xxhash64("doi"), "doi").limit(most).toPandas()


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0.0)


def drawn(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starting centres, each drawn with a chance in proportion to the squared distance to the ones before."""
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = far.sum()
        at = int(rng.choice(len(x), p=far / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
    return x[chosen].copy()


def moved(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """For each model the means of its clusters (an empty one keeps its centre) and the cost of the given centres."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {m: (np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))) for m, c in models.items()}
        for batch in batches:
            if not len(batch):
                continue
            x = stacked(batch.embedding)
            for m, c in models.items():
                d = squares(x, c)
                near = d.argmin(1)
                one = np.zeros((len(c), len(x)))
                one[near, np.arange(len(x))] = 1.0
                s, n, cost = total[m]
                s += one @ x
                n += one.sum(1)
                cost += one @ d[np.arange(len(x)), near]
        out = [(m, pos, [n[pos], cost[pos], *s[pos]]) for m, (s, n, cost) in total.items() for pos in np.nonzero(n)[0]]
        yield pd.DataFrame([(m, int(p), v) for m, p, v in out], columns=["m", "pos", "v"])

    parts = rows.select("embedding").mapInPandas(sums, "m int, pos int, v array<double>").select("m", "pos", F.posexplode("v").alias("i", "x"))
    added = parts.groupBy("m", "pos", "i").agg(F.sum("x").alias("x")).groupBy("m", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    result = {m: (c.copy(), 0.0) for m, c in models.items()}
    # One row per model and cluster.
    for row in added.select("m", "pos", F.transform("v", lambda e: e["x"]).alias("v")).collect():
        centers, cost = result[row.m]
        centers[row.pos] = np.asarray(row.v[2:]) / row.v[0]
        result[row.m] = (centers, cost + row.v[1])
    return result


def fit_grid(rows: DataFrame, ks: list[int], inits: int = 10, seed: int = 42, max_iter: int = 20, tolerance: float = 1e-4) -> tuple[dict[int, Partition], int]:
    """The cheapest of ``inits`` partitions for each k, and the number of passes over ``rows`` (doi, embedding).

    A model has settled when no centre moves by more than ``tolerance``."""
    start = least_by_hash(rows, START_ROWS)
    if not len(start):
        return {}, 0
    size = Counter(map(len, start.embedding)).most_common(1)[0][0]
    x = stacked(start.embedding[start.embedding.map(len) == size])
    rows = rows.filter(F.size("embedding") == size)
    models = {i: drawn(x, k, np.random.default_rng([seed, k, s])) for i, (k, s) in enumerate((k, s) for k in ks for s in range(inits))}
    best: dict[int, Partition] = {}
    passes = 0
    while models:
        found, passes = moved(rows, models), passes + 1
        still = {}
        for m, (centers, cost) in found.items():
            before = models[m]
            if passes > max_iter or np.sqrt(((centers - before) ** 2).sum(1)).max() <= tolerance:
                k = len(before)
                if k not in best or cost < best[k].cost:
                    best[k] = Partition(k, before, cost)
            else:
                still[m] = centers
        models = still
    return best, passes


def silhouettes(rows: DataFrame, partitions: dict[int, Partition], most: int = MOST_POINTS) -> DataFrame:
    """(k, euclidean, squared, n_clusters): mean silhouettes of each partition, from distances and from their squares.

    A point that is alone in its cluster counts as 0. All k share one scan."""
    points = least_by_hash(rows, most)
    size = len(next(iter(partitions.values())).centers[0])
    p = stacked(points.embedding[points.embedding.map(len) == size])
    centers = {k: part.centers for k, part in partitions.items()}
    of_point = {k: squares(p, c).argmin(1) for k, c in centers.items()}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros((3, len(p), len(c))) for k, c in centers.items()}
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                x = stacked(batch.embedding.iloc[at : at + BLOCK])
                d2 = squares(p, x)
                d = np.sqrt(d2)
                for k, c in centers.items():
                    one = np.zeros((len(x), len(c)))
                    one[np.arange(len(x)), squares(x, c).argmin(1)] = 1.0
                    total[k] += np.stack([np.broadcast_to(one.sum(0), (len(p), len(c))), d @ one, d2 @ one])
        for k, t in total.items():
            i, pos = np.nonzero(t[0])
            yield pd.DataFrame({"k": k, "p": i, "pos": pos, "own": of_point[k][i] == pos, "n": t[0][i, pos], "d": t[1][i, pos], "d2": t[2][i, pos]})

    parts = rows.filter(F.size("embedding") == size).select("embedding").mapInPandas(sums, "k int, p int, pos int, own boolean, n double, d double, d2 double")
    means = parts.groupBy("k", "p", "pos", "own").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("d2").alias("d2"))
    inside = lambda c: F.max(F.when(F.col("own") & (F.col("n") > 1), F.col(c) / (F.col("n") - 1)))
    outside = lambda c: F.min(F.when(~F.col("own"), F.col(c) / F.col("n")))
    each = means.groupBy("k", "p").agg(inside("d").alias("a"), outside("d").alias("b"), inside("d2").alias("a2"), outside("d2").alias("b2"))
    value = lambda a, b: F.coalesce(F.try_divide(F.col(b) - F.col(a), F.greatest(a, b)), F.lit(0.0))
    found = each.groupBy("k").agg(F.avg(value("a", "b")).alias("euclidean"), F.avg(value("a2", "b2")).alias("squared"))
    return found.join(means.groupBy("k").agg(F.count_distinct("pos").alias("n_clusters")), "k").select("k", "euclidean", "squared", "n_clusters")


def assigned(rows: DataFrame, partition: Partition) -> DataFrame:
    """(doi, pos, embedding): the nearest centre of each row, ties to the first."""
    centers = partition.centers

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(pos=squares(stacked(batch.embedding), centers).argmin(1).astype(np.int32))[["doi", "pos", "embedding"]]

    kept = rows.filter(F.size("embedding") == centers.shape[1])
    return kept.mapInPandas(near, f"doi {rows.schema['doi'].dataType.simpleString()}, pos int, embedding array<double>")


def best_partition(vectors: DataFrame, k_min: int = 5, k_max: int = 15, inits: int = 10, seed: int = 42) -> tuple[Partition, DataFrame] | None:
    """The partition of the k with the best Euclidean silhouette (of equal ones the smallest k) and its members; None
    below ``k_min`` + 1 usable rows, or if no k gives two clusters."""
    rows = usable(vectors).persist()
    try:
        ks = list(range(k_min, min(k_max, rows.count() - 1) + 1))
        found, _ = fit_grid(rows, ks, inits, seed) if ks else ({}, 0)
        scores = [r for r in silhouettes(rows, found).collect() if r.n_clusters > 1] if found else []
    finally:
        rows.unpersist()
    if not scores:
        return None
    best = found[min(scores, key=lambda r: (-r.euclidean, r.k)).k]
    return best, assigned(usable(vectors), best)
