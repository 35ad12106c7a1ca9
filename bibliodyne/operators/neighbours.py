"""Approximate nearest neighbours by an inverted file: rows lie in cells around centroids, and a query looks
into the cells nearest to it only.

Centroids are k-means centres (MLlib) of a bounded sample of the unit vectors; every row is indexed, in the cell of
its nearest centroid. A query probes its ``probes`` nearest cells, which is set by an audit: for some queries
the exact neighbours are counted, and the least number of probes is taken under which ``recall`` of them lie in a
probed cell. Rows of the probed cells, and of what shares a bin with them, are compared exactly, in blocks, so scores
and ties are those of ``knn``.

Large cells are cut into blocks of ``BLOCK_ROWS`` rows, so no task gets a cell that holds a third of all rows. An index
can be written as Parquet partitioned by cell and read again (``write``, ``read_index``); a search then opens the
folders of the probed cells only if queries are few.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliodyne.operators.vectors import TINY, best_of, knn, units
from bibliodyne.session import materialize

#: Cells at most; with more rows cells grow. Rows a cell that the centroids are fitted on.
MOST_CELLS, SAMPLE_PER_CELL = 4096, 32
#: Queries whose exact neighbours the audit counts.
AUDITED = 256
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Rows at most of small cells that are searched together.
BIN_ROWS = 4096


@dataclass
class CellIndex:
    """Unit centroids and all usable rows (doi, embedding, cell, block)."""

    centroids: np.ndarray
    rows: DataFrame
    probes: int

    def write(self, path: str) -> None:
        """Rows partitioned by cell, and the centroids with the number of probes beside them, written last."""
        self.rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        head = {"probes": self.probes, "centroids": self.centroids.tolist()}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def read_index(spark: SparkSession, path: str) -> CellIndex:
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    return CellIndex(np.array(head["centroids"]), spark.read.parquet(f"{path}/rows"), head["probes"])


def _nearest_cells(vectors: DataFrame, centroids: np.ndarray, probes: int, name: str, bins: np.ndarray | None = None) -> DataFrame:
    """(doi, embedding, cells): the ``probes`` nearest cells of each usable vector, the nearest first; or their bins, once each."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, good = units(b.embedding, centroids.shape[1])
            far = -(x @ centroids.T)
            # No whole order of the cells for a few of them.
            some = np.sort(np.argpartition(far, probes - 1, axis=1)[:, :probes], axis=1) if 1 < probes < len(centroids) else np.argmin(far, axis=1)[:, None] if probes == 1 else np.tile(np.arange(len(centroids)), (len(x), 1))
            order = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)
            found = list(order) if bins is None else [pd.unique(o) for o in bins[order]]
            yield pd.DataFrame({"doi": b.doi, "embedding": b.embedding, name: found})[good]

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("doi", "embedding").mapInPandas(near, f"doi string, embedding {kind}, {name} array<int>")


def build_index(library: DataFrame, cells: int | None = None, seed: int = 42) -> CellIndex:
    """The index of ``library`` (doi, embedding); about the root of its rows in cells. Vectors that are null, tiny, not
    finite or of an uncommon length are left out, as ``knn`` leaves them out. All cells are probed until it is tuned."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    usable = library.filter("embedding IS NOT NULL").withColumn("_n", norm).filter((F.col("_n") >= TINY) & (F.col("_n") < float("inf")) & ~F.isnan("_n"))
    sizes = usable.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return CellIndex(np.zeros((1, 1)), library.select("doi", "embedding", F.lit(0).alias("cell"), F.lit(0).alias("block")).limit(0), 1)
    n = sizes.n
    cells = min(cells or max(1, round(math.sqrt(n))), MOST_CELLS, n)
    # A row is in the sample by its hash: no sort, and reruns agree.
    share = min(1.0, SAMPLE_PER_CELL * cells / n)
    some = usable.filter(F.size("embedding") == sizes.d).filter(F.pmod(F.xxhash64(F.lit(seed), "doi"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    features = some.select(array_to_vector(F.transform(v, lambda x: x / F.col("_n"))).alias("features")).persist()
    model = KMeans(k=cells, seed=seed, maxIter=8, initSteps=2).fit(features)
    features.unpersist()
    centres = np.array([c for c in model.clusterCenters() if np.linalg.norm(c) >= TINY] or [np.eye(1, sizes.d)[0]])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    placed = _nearest_cells(usable.filter(F.size("embedding") == sizes.d), centres, 1, "cells").select("doi", "embedding", F.col("cells")[0].alias("cell"))
    placed = materialize(placed, "cells")
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    # One row a cell, and MOST_CELLS of them at most.
    cut = placed.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("doi"), F.col("blocks")).cast("int"))
    return CellIndex(centres, materialize(cut.select("doi", "embedding", "cell", "block"), "cells"), len(centres))


def tuned(index: CellIndex, queries: DataFrame, k: int, recall: float = 0.97) -> CellIndex:
    """``index`` with the least number of probes under which ``recall`` of the ``k`` exact neighbours of the audited
    queries lie in a probed cell. The audit compares ``AUDITED`` queries of the least hash with all rows."""
    some = queries.select("doi", "embedding").orderBy(F.xxhash64(F.lit(5), "doi"), "doi").limit(AUDITED)
    some = materialize(_nearest_cells(some, index.centroids, len(index.centroids), "order"), "audit")
    exact = knn(some.select("doi", "embedding"), index.rows.select("doi", "embedding"), k).select("query", "doi")
    placed = exact.join(index.rows.select("doi", "cell"), "doi").join(some.select(F.col("doi").alias("query"), "order"), "query")
    ranks = placed.groupBy(F.array_position("order", F.col("cell")).alias("rank")).agg(F.count("*").alias("n")).orderBy("rank").collect()
    total, seen = sum(r.n for r in ranks), 0
    for r in ranks:
        seen += r.n
        if seen >= recall * total:
            return replace(index, probes=int(r["rank"]))
    return index


def _bins(index: CellIndex) -> np.ndarray:
    """For each cell the number of its bin: near small cells that are searched together, so that a query of many cells
    is not sent to each of them. A bin has a quarter of the rows that a query probes at most."""
    counts = np.zeros(len(index.centroids), dtype=np.int64)
    for r in index.rows.groupBy("cell").agg(F.count("*").alias("n")).collect():  # MOST_CELLS at most
        counts[r["cell"]] = r.n
    most = min(BIN_ROWS, counts.sum() * index.probes / len(counts) / 4)
    bins, at, number, held = np.zeros(len(counts), dtype=np.int32), 0, 0, 0
    left = np.ones(len(counts), dtype=bool)
    while True:  # each cell is followed by the nearest one that is left
        if held and held + counts[at] > most:
            number, held = number + 1, 0
        bins[at], left[at], held = number, False, held + counts[at]
        if not left.any():
            return bins
        at = int(np.argmax(np.where(left, index.centroids @ index.centroids[at], -np.inf)))


def _searched(index: CellIndex, asked: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(query, doi, score): up to k rows for each block of a cell that a query is in ``asked`` (materialised) with."""
    visits = asked.groupBy(F.col("q_cell").alias("cell")).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("q_blocks"))
    held = index.rows.groupBy("cell").agg((F.max("block") + 1).alias("blocks"))
    cells = materialize(held.join(visits, "cell"), "cells-met")  # one row a cell
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.rows.join(F.broadcast(cells), "cell").select(F.col("doi").alias("l_doi"), F.col("embedding").alias("l_v"), F.col("cell").alias("l_c"), F.col("block").alias("l_r"), every("q_blocks").alias("l_q"))
    of_cell = F.broadcast(cells.withColumnRenamed("cell", "_c"))
    right = asked.join(of_cell, F.col("q_cell") == F.col("_c")).select("q_doi", "q_v", "q_f", "q_cell", every("blocks").alias("q_r"), F.pmod(F.xxhash64(F.lit(1), "q_doi"), F.col("q_blocks")).cast("int").alias("q_q"))
    return left.groupBy("l_c", "l_r", "l_q").cogroup(right.groupBy("q_cell", "q_r", "q_q")).applyInPandas(lambda rows, some: best_of(rows, some, k, exclude_self), "query string, doi string, score double")


def search(index: CellIndex, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """(query, doi, score, rank) as ``knn`` gives them, from the probed cells.

    Cells are searched by bins, whole ones. The nearest cell's goes first: its k-th score is a floor under which rows of
    the others are not written."""
    best = lambda near: near.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doi"))).filter(F.col("rank") <= k)
    bins = _bins(index)
    of_cell = F.broadcast(queries.sparkSession.createDataFrame(list(enumerate(bins.tolist())), "cell int, bin int"))
    index = replace(index, rows=index.rows.join(of_cell, "cell").select("doi", "embedding", F.col("bin").alias("cell"), "block"))
    placed = materialize(_nearest_cells(queries, index.centroids, index.probes, "cells", bins), "probes")
    none = F.lit(None).cast("double")
    asked = placed.select(F.col("doi").alias("q_doi"), F.col("embedding").alias("q_v"), F.col("cells")[0].alias("q_cell"), none.alias("q_f"))
    first = materialize(best(_searched(index, asked, k, exclude_self)), "near")
    if index.probes == 1:
        return first.select("query", "doi", "score", "rank")
    floor = first.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("q_f"))
    rest = placed.join(floor, F.col("doi") == F.col("query"), "left").select(F.col("doi").alias("q_doi"), F.col("embedding").alias("q_v"), F.explode(F.slice("cells", 2, len(bins))).alias("q_cell"), "q_f")
    near = _searched(index, materialize(rest, "probes"), k, exclude_self)
    return best(first.drop("rank").unionByName(near))


def compared(index: CellIndex, queries: DataFrame) -> int:
    """Pairs of a query and a row that a search compares."""
    asked = _nearest_cells(queries, index.centroids, index.probes, "cells").select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
    held = index.rows.groupBy("cell").agg(F.count("*").alias("n"))
    return asked.join(held, "cell").agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0))).first()[0]


def knn_approximate(queries: DataFrame, library: DataFrame, k: int, recall: float = 0.97, exclude_self: bool = True, cells: int | None = None) -> DataFrame:
    """``knn`` through an index built and tuned for these queries."""
    index = tuned(build_index(library, cells), queries, k, recall)
    return search(index, queries, k, exclude_self)
