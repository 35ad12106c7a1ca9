"""Vector retrieval, ranking signals and fusion.

Single comparisons are native expressions; volume goes through block products: rows and queries are dealt
to blocks of bounded size, each pair of blocks returns its best k per query, and a window takes the best.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-9
#: Centroids that are sent to every task at most.
MOST_CENTROIDS = 10_000
#: Queries of a block whose products with its rows a task holds at once.
SLAB = 64
#: Row products made at once.
PRODUCTS = 8192


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 if either vector is null, of another length, not finite or shorter than 1e-9."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    good = (F.size(a) == F.size(b)) & (na >= TINY) & (nb >= TINY) & (na < float("inf")) & (nb < float("inf")) & ~F.isnan(na) & ~F.isnan(nb)
    return F.when(good, dot(a, b) / (na * nb)).otherwise(0.0)


def units(v: pd.Series, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which rows are usable (of the longest length or of ``size``, finite, not tiny)."""
    size = size or max((len(x) for x in v if x is not None), default=1)
    x = np.stack([np.asarray(r, dtype=np.float64) if r is not None and len(r) == size else np.full(size, np.nan) for r in v]) if len(v) else np.zeros((0, size))
    n = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(n) & (n >= TINY)
    return np.where(good[:, None], x, 0.0) / np.where(good, n, 1.0)[:, None], good


def best_of(rows: pd.DataFrame, asked: pd.DataFrame, k: int, exclude_self: bool) -> pd.DataFrame:
    """(query, doi, score) of the k nearest ``rows`` (l_doi, l_v) of each of ``asked`` (q_doi, q_v), of those with a score of ``q_f``
    or more if ``asked`` has that column (null: all).

    A matrix product finds whoever may be among them; row products, which do not depend on the block a pair
    stands in, give the scores."""
    out: list[pd.DataFrame] = []
    if len(rows) and len(asked):
        x, xg = units(rows.l_v)
        q, qg = units(asked.q_v)
        ids, names = rows.l_doi.to_numpy(), asked.q_doi.to_numpy()
        order_of = ids.astype(str)
        floor = np.nan_to_num(asked.q_f.to_numpy(dtype=np.float64), nan=-np.inf) if "q_f" in asked else np.full(len(q), -np.inf)
        for at in range(0, len(q) if x.shape[1] == q.shape[1] else 0, SLAB):
            near = q[at : at + SLAB] @ x.T
            near[:, ~xg] = -np.inf
            near[~qg[at : at + SLAB]] = -np.inf
            last = max(0, len(ids) - 1 - k)
            edges = np.maximum(np.partition(near, last, axis=1)[:, last], floor[at : at + SLAB])
            # Rounding to 4 decimals may tie what the product tells apart.
            i, j = np.nonzero(np.isfinite(near) & (near >= edges[:, None] - 2e-4))
            i += at
            if exclude_self:
                other = ids[j] != names[i]
                i, j = i[other], j[other]
            s = np.concatenate([np.zeros(0), *[np.round((x[j[c : c + PRODUCTS]] * q[i[c : c + PRODUCTS]]).sum(axis=1), 4) for c in range(0, len(i), PRODUCTS)]])
            over = s >= floor[i]
            i, j, s = i[over], j[over], s[over]
            order = np.lexsort((order_of[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pd.DataFrame({"query": names[i[first]], "doi": ids[j[first]], "score": s[first]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame([], columns=["query", "doi", "score"])


def knn(queries: DataFrame, library: DataFrame, k: int, block_rows: int = 8192, block_queries: int = 1024, exclude_self: bool = True) -> DataFrame:
    """(query, doi, score, rank): the k nearest library rows by cosine, rounded to 4 decimals, ties by doi.

    Both tables have doi and embedding. Unusable vectors take no part.
    """
    n_rows, n_queries = library.count(), queries.count()
    rb, qb = max(1, math.ceil(n_rows / block_rows)), max(1, math.ceil(n_queries / block_queries))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = library.select(F.col("doi").alias("l_doi"), F.col("embedding").alias("l_v"), F.pmod(F.xxhash64("doi"), F.lit(rb)).cast("int").alias("l_r"), spread(qb).alias("l_q"))
    right = queries.select(F.col("doi").alias("q_doi"), F.col("embedding").alias("q_v"), F.pmod(F.xxhash64(F.lit(1), "doi"), F.lit(qb)).cast("int").alias("q_q"), spread(rb).alias("q_r"))

    near = left.groupBy("l_r", "l_q").cogroup(right.groupBy("q_r", "q_q")).applyInPandas(lambda rows, some: best_of(rows, some, k, exclude_self), "query string, doi string, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "doi")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_chunks(queries: DataFrame, chunks: DataFrame, k: int, over_fetch: int = 3) -> DataFrame:
    """As ``knn`` over chunk vectors (doi, chunk_id, embedding): the best chunk of each of k documents."""
    keyed = chunks.select(F.concat_ws("#", "doi", "chunk_id").alias("doi"), "embedding")
    found = knn(queries, keyed, k * max(over_fetch, 3), exclude_self=False).withColumnRenamed("doi", "chunk").withColumn("doi", F.substring_index("chunk", "#", 1))
    best = found.filter("query <> doi").withColumn("n", F.row_number().over(W.partitionBy("query", "doi").orderBy("rank"))).filter("n = 1")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doi"))).filter(F.col("rank") <= k).select("query", "doi", "chunk", "score", "rank")


def two_stage(queries: DataFrame, library: DataFrame, texts: DataFrame, scorer: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """Retrieve 3k by cosine, score (query text, text) with ``scorer``, keep k. ``texts`` has doi, text."""
    near = knn(queries, library, 3 * k).withColumnRenamed("score", "first_score").drop("rank")
    q = texts.select(F.col("doi").alias("query"), F.col("text").alias("q_text"))
    scored = near.join(texts.select("doi", "text"), "doi").join(q, "query").withColumn("score", scorer(F.col("q_text"), F.col("text")))
    order = W.partitionBy("query").orderBy(F.desc("score"), F.desc("first_score"), "doi")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "doi", "score", "rank")


def token_overlap(a: Column, b: Column) -> Column:
    """A reranker for tests: shared share of distinct lower-case tokens."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    shared = F.size(F.array_intersect(words(a), words(b)))
    return F.round(shared / F.greatest(F.size(F.array_union(words(a), words(b))), F.lit(1)), 6)


def rank_by_vector(library: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Library rows by cosine to one vector (a table of one row, column vector)."""
    one = vector.select("vector").limit(1)
    scored = library.join(F.broadcast(one), F.lit(True)).withColumn("score", F.round(cosine(F.col("embedding"), F.col("vector")), 4))
    return scored.orderBy(F.desc("score"), "doi").limit(k).drop("vector")


def vector_base(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Score of the best library neighbour of each candidate, 0 if there is none."""
    best = knn(candidates, library, 1).select(F.col("query").alias("doi"), F.col("score").alias("vector_score"))
    return candidates.select("doi").join(best, "doi", "left").fillna(0.0, ["vector_score"])


def domain_leg(candidates: DataFrame, vector: DataFrame, weight: float) -> DataFrame:
    one = vector.select("vector").limit(1)
    return candidates.join(F.broadcast(one), F.lit(True)).withColumn("domain", weight * cosine(F.col("embedding"), F.col("vector"))).drop("vector")


def assign_nearest(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(doi, cluster_id, distance) of the nearest centroid by cosine distance. Centroids (id, centroid)
    are a short list and go to every task; more than ``MOST_CENTROIDS`` are an error."""
    if centroids.limit(MOST_CENTROIDS + 1).count() > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    short = [(r.id, [float(x) for x in r.centroid]) for r in centroids.select("id", "centroid").orderBy("id").collect()]
    if not short:
        return vectors.select("doi", F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("double").alias("distance")).limit(0)
    ids = np.array([i for i, _ in short])
    c, _ = units(pd.Series([v for _, v in short]))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, good = units(b.embedding)
            s = np.stack([(x * v).sum(axis=1) for v in c], axis=1)
            j = s.argmax(axis=1)
            yield pd.DataFrame({"doi": b.doi, "cluster_id": ids[j], "distance": 1 - s[np.arange(len(j)), j]})[good]

    return vectors.select("doi", "embedding").mapInPandas(near, "doi string, cluster_id long, distance double")


def cluster_leg(candidates: DataFrame, centroids: DataFrame, names: DataFrame, weight: float) -> DataFrame:
    """Weighted best cosine to a centroid, and that cluster's name."""
    near = assign_nearest(candidates, centroids).join(names.select(F.col("id").alias("cluster_id"), F.col("display_name").alias("matched")), "cluster_id", "left")
    return candidates.join(near.select("doi", (weight * (1 - F.col("distance"))).alias("cluster"), "matched"), "doi", "left").fillna(0.0, ["cluster"])


def route(questions: DataFrame, centroids: DataFrame, least: float = 0.3) -> DataFrame:
    """(doi, cluster_id, similarity) of questions near enough to a cluster."""
    return assign_nearest(questions, centroids).withColumn("similarity", 1 - F.col("distance")).filter(F.col("similarity") >= least).drop("distance")


def interest_leg(candidates: DataFrame, vector: DataFrame, n_events: int, weight: float) -> DataFrame:
    from bibliodyne.functions.scalar import soft_gate

    one = vector.select("vector").limit(1)
    gate = soft_gate(F.lit(n_events))
    return candidates.join(F.broadcast(one), F.lit(True)).withColumn("feedback", weight * gate * cosine(F.col("embedding"), F.col("vector"))).drop("vector")


def graph_leg(signals: DataFrame, w_entities: float = 0.15, w_cites: float = 0.1, w_authors: float = 0.05) -> DataFrame:
    """Capped shares of shared entities (5), edges of citing, extending and comparing (3) and shared authors (3)."""
    part = lambda c, cap: F.least(c / float(cap), F.lit(1.0))
    cites = F.col("n_cites_in") + F.col("n_cites_out") + F.col("n_extends") + F.col("n_compares")
    return signals.select("doi", (w_entities * part(F.col("n_shared_entities"), 5)).alias("entities"), (w_cites * part(cites, 3)).alias("citations"), (w_authors * part(F.col("n_shared_authors"), 3)).alias("authors"))


LEGS = ("domain", "cluster", "feedback", "entities", "citations", "authors")


def breakdown(scored: DataFrame) -> DataFrame:
    """Adds a map of seven contributions rounded to 3; ``vector`` is the rounded score less the others."""
    legs = {c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 3) if c in scored.columns else F.lit(0.0) for c in LEGS}
    rest = sum(legs.values(), F.lit(0.0))
    pairs = [x for c, v in legs.items() for x in (F.lit(c), v)]
    return scored.withColumn("breakdown", F.create_map(F.lit("vector"), F.round(F.round("score", 3) - rest, 3), *pairs))


def soft_floor(ranked: DataFrame, size: int, share: float = 0.05) -> DataFrame:
    """The digest's rows: off-domain ones get max(1, ceil(size * share)) places, in-domain ones the rest."""
    off = max(1, math.ceil(size * share))
    first = lambda rows, n: rows.orderBy(F.desc("score"), "doi").limit(n)
    n_off = ranked.filter("NOT in_domain").limit(off).count()
    return first(ranked.filter("in_domain"), size - n_off).unionByName(first(ranked.filter("NOT in_domain"), off))


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion per query: rows (query, list_id, rank, doi) to (query, doi, score, rank).
    Ties go to the first appearance by list, then rank."""
    scored = rankings.groupBy("query", "doi").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_id", "rank")).alias("first"))
    order = W.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "first", "doi")
    return scored.withColumn("rank", F.row_number().over(order)).drop("first")


def retrieve(mode: str, k: int, vector: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """Retrieval by 'vector', 'graph' or 'hybrid' from rankings (query, doi, rank); dois are normalised
    before they are fused."""
    from bibliodyne.functions.scalar import normalize_doi

    if mode not in ("vector", "graph", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = [p for name, p in (("vector", vector), ("graph", graph)) if mode in (name, "hybrid")]
    lists = [p.select("query", F.lit(i).alias("list_id"), "rank", normalize_doi(F.col("doi")).alias("doi")) for i, p in enumerate(parts)]
    both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    return rrf(both).filter(F.col("rank") <= k)


def graph_mode_scores(candidates: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Score of each candidate's best retrieved row, 0 if none."""
    best = retrieved.groupBy(F.col("query").alias("doi")).agg(F.max("score").alias("score"))
    return candidates.select("doi").join(best, "doi", "left").fillna(0.0, ["score"])


def domain_split(candidates: DataFrame, vector: DataFrame, least: float = 0.35) -> DataFrame:
    """Adds ``in_domain``: cosine at least ``least``, or no usable vector."""
    one = vector.select("vector").limit(1)
    joined = candidates.join(F.broadcast(one), F.lit(True))
    usable = F.coalesce(dot(F.col("embedding"), F.col("embedding")) >= TINY**2, F.lit(False))
    return joined.withColumn("in_domain", ~usable | (cosine(F.col("embedding"), F.col("vector")) >= least)).drop("vector")


def retrieve_context(near_chunks: DataFrame, chunk_texts: DataFrame, papers: DataFrame, k: int, chars: int = 600) -> DataFrame:
    """Passages for the top papers of a query: the best chunk's text, else the paper's own, cut to length."""
    best = near_chunks.filter(F.col("rank") <= k).join(chunk_texts.select(F.col("id").alias("chunk"), "text"), "chunk", "left")
    joined = best.join(papers.select("doi", "document", "core_finding"), "doi", "left")
    return joined.select("query", "rank", "doi", F.substring(F.coalesce("text", "document"), 1, chars).alias("passage"), "core_finding")


# ---------------------------------------------------------------- means, clusters, learning

def mean_vector(vectors: DataFrame, group: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Weighted mean per group as an array; vectors with a null or non-finite component are skipped."""
    w = F.lit(1.0) if weight is None else weight
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    parts = vectors.filter(F.coalesce(finite, F.lit(False))).select(*(group or []), w.alias("_w"), F.posexplode("embedding").alias("i", "x"))
    sums = parts.groupBy(*(group or []), "i").agg(F.sum(F.col("_w") * F.col("x").cast("double")).alias("s"), F.sum("_w").alias("w"))
    listed = sums.groupBy(*(group or [])).agg(F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("w")).alias("m")))).alias("m"))
    return listed.select(*(group or []), F.transform("m", lambda x: x["m"]).alias("vector"))


def feedback_inputs(events: DataFrame, vectors: DataFrame, now: str, implicit: float = 0.5) -> DataFrame:
    """Events with a direction and a vector: (doi, sign, weight, embedding)."""
    from bibliodyne.functions.scalar import feedback_weight, signal_sign, time_decay

    signal, rating = F.col("signal_type"), F.col("rating")
    decay = time_decay(F.col("created_at"), F.lit(now).cast("timestamp_ntz"))
    weight = F.abs(feedback_weight(signal, rating)) * decay * F.when(F.col("source") == "implicit", implicit).otherwise(1.0)
    live = events.withColumn("sign", signal_sign(signal, rating)).withColumn("weight", weight).filter("sign <> 0 AND weight IS NOT NULL")
    return live.select("doi", "sign", "weight").join(vectors.select("doi", "embedding"), "doi")


def rocchio(inputs: DataFrame, library: DataFrame, beta: float = 0.75, gamma: float = 0.15) -> DataFrame:
    """One row (vector): the unit vector of centroid + beta * liked - gamma * disliked; the centroid
    itself if that is degenerate."""
    add = lambda a, b, f: F.zip_with(a, b, lambda x, y: x + f * y)
    base = mean_vector(library).withColumnRenamed("vector", "c")
    means = mean_vector(inputs, ["sign"], F.col("weight")).groupBy().pivot("sign", [1, -1]).agg(F.first("vector"))
    both = base.join(F.broadcast(means), F.lit(True))  # one row each
    moved = F.when(F.col("1").isNull(), F.col("c")).otherwise(add(F.col("c"), F.col("1"), beta))
    both = both.withColumn("m", moved)
    both = both.withColumn("m", F.when(F.col("`-1`").isNull(), F.col("m")).otherwise(add(F.col("m"), F.col("`-1`"), -gamma)))
    norm = F.sqrt(dot(F.col("m"), F.col("m")))
    good = (norm >= TINY) & (norm < float("inf"))
    return both.withColumn("n", norm).select(F.when(good, F.transform("m", lambda x: x / F.col("n"))).otherwise(F.col("c")).alias("vector"))


def cluster_weights(events: DataFrame, assignments: DataFrame, clusters: DataFrame, now: str, floor: float = 0.3) -> DataFrame:
    """Per active cluster max(floor, min(1, 1 - 0.9 * d / (d + p + 3 + 1e-9))) of decayed dismissals d and
    approvals p; 1 without events."""
    from bibliodyne.functions.scalar import signal_sign, time_decay

    decay = time_decay(F.col("created_at"), F.lit(now).cast("timestamp_ntz"))
    signed = events.withColumn("sign", signal_sign(F.col("signal_type"), F.col("rating"))).withColumn("m", decay).join(assignments.select("doi", "cluster_id"), "doi")
    mass = signed.groupBy("cluster_id").agg(F.sum(F.when(F.col("sign") < 0, F.col("m")).otherwise(0.0)).alias("d"), F.sum(F.when(F.col("sign") > 0, F.col("m")).otherwise(0.0)).alias("p"))
    active = clusters.filter(~F.col("archived")).select(F.col("id").alias("cluster_id"))
    raw = 1 - 0.9 * F.col("d") / (F.col("d") + F.col("p") + 3 + 1e-9)
    weight = F.when(F.col("d").isNull() | (F.col("d") + F.col("p") == 0), 1.0).otherwise(F.greatest(F.lit(floor), F.least(F.lit(1.0), raw)))
    return active.join(mass, "cluster_id", "left").select("cluster_id", weight.alias("weight"))


def under_engaged(surfaced: DataFrame, weights: DataFrame, now: str, weeks: int = 4, floor: float = 0.3) -> DataFrame:
    """Clusters quiet for some weeks or never surfaced, whose weight is clear of the floor."""
    quiet = F.col("last_at").isNull() | (F.col("last_at") <= F.lit(now).cast("timestamp_ntz") - F.make_interval(weeks=F.lit(weeks)))
    return surfaced.join(weights, surfaced["id"] == weights["cluster_id"]).filter(quiet & (F.col("weight") > floor + 0.05)).select("cluster_id", "last_at", "weight")


def top_aligned(library: DataFrame, vector: DataFrame, papers: DataFrame, k: int = 10) -> DataFrame:
    """(doi, title, cosine) of the library papers nearest to the interest vector."""
    near = rank_by_vector(library.select("doi", "embedding"), vector, k).select("doi", F.col("score").alias("cosine"))
    return near.join(papers.select("doi", "title"), "doi", "left").select("doi", "title", "cosine")


def weight_list(weights: DataFrame, clusters: DataFrame, floor: float = 0.3) -> DataFrame:
    """(cluster_id, name, weight, at_floor, place) of active clusters, the most faded first; 1 without a weight."""
    active = clusters.filter(~F.col("archived")).select(F.col("id").alias("cluster_id"), F.coalesce("display_name", F.concat(F.lit("Cluster "), "id")).alias("name"))
    listed = active.join(weights, "cluster_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return listed.withColumn("at_floor", F.col("weight") <= floor).withColumn("place", F.row_number().over(W.orderBy("weight", "cluster_id")))


def learning_state(inputs: DataFrame, weights: DataFrame, floor: float = 0.3) -> DataFrame:
    """One row: events, gate, whether learning is inert, and clusters at the floor (the lists beside it are
    ``top_aligned`` and ``weight_list``)."""
    from bibliodyne.functions.scalar import soft_gate

    n = inputs.agg(F.count("*").alias("n_events"))
    at_floor = weights.agg(F.count_if(F.col("weight") <= floor + 1e-9).alias("n_at_floor"))
    gate = soft_gate(F.col("n_events"))
    return n.join(F.broadcast(at_floor), F.lit(True)).withColumn("gate", gate).withColumn("inert", gate == 0)


def stable_ids(new: DataFrame, old: DataFrame, within: float = 0.3) -> DataFrame:
    """New clusters (pos, centroid) with the id of the nearest old one (id, centroid) if its cosine distance
    is below ``within``; the earliest new one wins an id, the others get fresh ids after the largest."""
    # Both are closed short lists of centroids.
    pairs = new.join(F.broadcast(old.select(F.col("id").alias("old_id"), F.col("centroid").alias("old_c"))), F.lit(True))
    near = pairs.withColumn("d", 1 - cosine(F.col("centroid"), F.col("old_c"))).groupBy("pos").agg(F.min(F.struct("d", "old_id")).alias("b"))
    claim = near.filter(F.col("b.d") < within).withColumn("n", F.row_number().over(W.partitionBy("b.old_id").orderBy("pos"))).filter("n = 1").select("pos", F.col("b.old_id").alias("id"))
    rest = new.join(claim, "pos", "left_anti").withColumn("n", F.row_number().over(W.orderBy("pos")))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = rest.join(F.broadcast(top), F.lit(True)).select("pos", (F.col("top") + F.col("n")).alias("id"))
    return claim.withColumn("inherited", F.lit(True)).unionByName(fresh.withColumn("inherited", F.lit(False)))


def kmeans_auto(vectors: DataFrame, k_min: int = 5, k_max: int = 15, inits: int = 10, seed: int = 42) -> tuple[int, DataFrame, DataFrame] | None:
    """(k, centroids, members) of the k with the best Euclidean silhouette; the cheapest of several starts counts for
    each k. None if there are too few rows or no k gives two clusters (see ``clustering``)."""
    from bibliodyne.operators.clustering import best_partition

    found = best_partition(vectors, k_min, k_max, inits, seed)
    if found is None:
        return None
    best, members = found
    centroids = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best.centers)], "pos int, centroid array<double>")
    return best.k, centroids, members


def recompute_clusters(vectors: DataFrame, papers: DataFrame, old: DataFrame, least: int = 100, k_min: int = 5, k_max: int = 15, inits: int = 10) -> dict[str, DataFrame] | None:
    """Clusters with stable ids, sample titles and assignments; None below ``least`` rows."""
    if vectors.count() < least:
        return None
    found = kmeans_auto(vectors, k_min, k_max, inits)
    if found is None:
        return None
    _, centroids, members = found
    ids = stable_ids(centroids, old)
    named = centroids.join(ids, "pos").withColumn("display_name", F.concat(F.lit("Cluster "), F.col("id")))
    assigned = assign_nearest(vectors, named.select("id", "centroid"))
    titles = assigned.join(papers.select("doi", "title"), "doi").withColumn("n", F.row_number().over(W.partitionBy("cluster_id").orderBy("distance", "doi"))).filter("n <= 5")
    samples = titles.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("n", "title"))).alias("t")).select("cluster_id", F.transform("t", lambda x: x["title"]).alias("sample_titles"))
    return {"clusters": named.join(samples, named["id"] == samples["cluster_id"], "left").drop("cluster_id"), "assignments": assigned}
