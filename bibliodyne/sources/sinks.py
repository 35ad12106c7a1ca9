"""Sinks: each gives the next snapshot of a table from the current one and a batch.

Snapshots are plain Parquet folders named by version; a numbered pointer file is added last, so a reader sees
the old version or the new one. Batches are reduced to one row per key before they meet the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Per key each column's last non-null value in order."""
    others = [c for c in batch.columns if c not in keys]
    ranked = batch.withColumn("_o", order)
    return ranked.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in others])


def upsert_coalesce(table: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows of both by key; a non-null new value wins, a null one never wipes an old one."""
    new = latest_per_key(batch, keys, order)
    others = [c for c in table.columns if c not in keys]
    renamed = new.withColumnsRenamed({c: f"_n_{c}" for c in others if c in new.columns})
    joined = table.join(renamed, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) if c in new.columns else F.col(c) for c in others])


def upsert_citations(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Citation edges (source, ref_id, target, context, resolution): a resolved edge keeps its target and
    resolution when the new one has none, the newest context always counts."""
    renamed = batch.withColumnsRenamed({c: f"_n_{c}" for c in ("target", "context", "resolution")})
    joined = edges.withColumn("_old", F.lit(True)).join(renamed.withColumn("_new", F.lit(True)), ["source", "ref_id"], "full_outer")
    resolution = F.when(F.col("_new").isNull(), F.col("resolution")).when(F.col("_n_target").isNotNull() | F.col("_old").isNull(), F.col("_n_resolution")).otherwise(F.col("resolution"))
    context = F.when(F.col("_new"), F.col("_n_context")).otherwise(F.col("context"))
    return joined.select("source", "ref_id", F.coalesce("_n_target", "target").alias("target"), context.alias("context"), resolution.alias("resolution"))


def replace_by_key(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """All rows of the batch's keys are replaced: delete, then add (vectors by id, chunk sets by document)."""
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def insert_absent(table: DataFrame, batch: DataFrame, keys: list[str], order: list[Column], ends: list[tuple[DataFrame, str, str]] = ()) -> DataFrame:
    """Rows to append: the first per key in order whose key the table lacks; ``ends`` lists (table, its key,
    column) that a row's column must be found in."""
    first = batch.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    for other, key, column in ends:
        first = first.join(other.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    return first.join(table.select(*keys), keys, "left_anti").select(*batch.columns)


def atomic_replace(clusters: DataFrame, new: DataFrame) -> DataFrame:
    """Old clusters archived and new ones (id or null, display_name, pos) installed in one snapshot: inherited ids
    come back to life, others get ids after the largest, a null name becomes "Cluster <id>"."""
    top = clusters.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top"))
    n = F.row_number().over(W.partitionBy(F.col("id").isNull()).orderBy("pos"))
    numbered = new.withColumn("_n", n).join(F.broadcast(top), F.lit(True)).withColumn("id", F.coalesce(F.col("id").cast("long"), F.col("top") + F.col("_n")))
    live = numbered.select("id", F.coalesce("display_name", F.concat(F.lit("Cluster "), "id")).alias("display_name"), F.lit(False).alias("archived"))
    old = clusters.join(live, "id", "left_anti").select(F.col("id").cast("long").alias("id"), "display_name", F.lit(True).alias("archived"))
    return live.unionByName(old)


SIGNAL_ROWS = ("vector", "domain", "cluster", "feedback", "entities", "citations", "authors")


def digest(ranked: DataFrame, date: str, threshold: float = 0.3, top: int = 20, databases: int = 4, decomposition: bool = False) -> DataFrame:
    """(line_no, line) of a run's report in Markdown from (doi, title, authors, year, score), with ``rationale``
    and, if ``decomposition``, ``breakdown`` (a map) where the table has them.

    Papers come by score. Line numbers follow from range-sorted partitions and their sizes, so no task holds all
    lines; the top section is a short list.
    """
    text = lambda c: F.col(c).cast("string") if c in ranked.columns else F.lit(None).cast("string")
    names = F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.when(F.size("authors") > 3, " et al.").otherwise(""))
    title = F.when(F.coalesce("doi", F.lit("")) != "", F.format_string("[**%s**](https://doi.org/%s)", F.coalesce("title", F.lit("")), "doi")).otherwise(F.format_string("**%s**", F.coalesce("title", F.lit(""))))
    number = lambda x: F.format_string("%.3f", x)
    entry = F.concat(F.lit("- "), title, F.lit(" · "), F.coalesce(names, F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(") · score: "), number(F.col("score")))
    rows = ranked.withColumn("line", entry)
    parts = F.array(F.col("line"), F.when(F.coalesce(text("rationale"), F.lit("")) != "", F.concat(F.lit("  > "), text("rationale"))))
    if decomposition and "breakdown" in ranked.columns:
        table = F.transform(F.array(*[F.lit(x) for x in SIGNAL_ROWS]), lambda k: F.when(F.map_contains_key("breakdown", k), F.concat(F.lit("  | "), k, F.lit(" | "), number(F.element_at("breakdown", k)), F.lit(" |"))))
        total = F.concat(F.lit("  | **total** | **"), number(F.col("score")), F.lit("** |"))
        parts = F.concat(parts, F.when(F.col("breakdown").isNotNull(), F.concat(F.array(F.lit("  | Signal | Score |"), F.lit("  |---|---|")), table, F.array(total))).otherwise(F.expr("cast(array() as array<string>)")))
    by_score = [F.desc("score"), F.asc("doi")]
    best = rows.filter(F.col("score") >= threshold).orderBy(*by_score).limit(top).withColumn("n", F.row_number().over(W.orderBy(*by_score)))
    best = best.select("n", F.posexplode(F.array_compact(parts)).alias("k", "line"))
    best = best.select((F.row_number().over(W.orderBy("n", "k"))).cast("long").alias("i"), "line")
    spark = ranked.sparkSession
    count, highest = rows.agg(F.count("*"), F.max("score")).first()
    n_best = best.count()
    head = [
        "---", f'date: "{date}"', f"new_papers: {count}", f"top_similarity: {highest or 0.0:.3f}", "---", f"# Discovery Digest — {date}", f"{count} new results found across {databases} databases.",
        f"Similarity threshold: >{threshold:.2f}", "## Top Results",
    ]
    middle = [*([] if n_best else ["*No results.*"]), "", f"## All New Results ({count})", *([] if count else ["*No results.*"])]
    fixed = [(i + 1, x) for i, x in enumerate(head)] + [(len(head) + n_best + i + 1, x) for i, x in enumerate(middle)]
    before_all = len(head) + n_best + len(middle)
    fixed += [(before_all + count + 1, "---"), (before_all + count + 2, f"*Generated by bibliodyne · {date}*")]
    every = numbered(rows.select("score", "doi", "line"), by_score).select((F.col("row_no") + before_all).alias("line_no"), "line")
    lines = spark.createDataFrame(fixed, "line_no long, line string").unionByName(best.select((F.col("i") + len(head)).alias("line_no"), "line"))
    return lines.unionByName(every)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``row_no`` from 1 in an order: range partitions are sorted, numbered alone and shifted by the
    sizes of those before them."""
    from bibliodyne.session import materialize

    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("first"))
    # One row a partition.
    before = sizes.select("_p", "first", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "_p").withColumn("row_no", F.col("before") + F.col("_m") - F.col("first") + 1).drop("_p", "_m", "first", "before")


def corpus_snapshot(papers: DataFrame, mentions: DataFrame, run: str) -> DataFrame:
    """One row of counters to append per run."""
    p = papers.agg(F.count("*").alias("n_papers"), F.count_if("graph_indexed").alias("n_graph_indexed"))
    m = mentions.agg(F.count("*").alias("n_mentions"), F.countDistinct("canonical_id").alias("n_entities"))
    return p.join(F.broadcast(m), F.lit(True)).withColumn("run", F.lit(run))  # one row each


def writeback_plan(assignments: DataFrame, clusters: DataFrame, papers: DataFrame, namespace: str = "theme") -> DataFrame:
    """(doi, key, tag, state): a tag per clustered paper; without an external key it is skipped."""
    live = clusters.filter(~F.col("archived")).select(F.col("id").alias("cluster_id"), "display_name")
    tag = F.concat(F.lit(f"{namespace}/"), F.replace(F.coalesce("display_name", F.concat(F.lit("Cluster "), "cluster_id")), F.lit("/"), F.lit("-")))
    joined = assignments.select("doi", "cluster_id").join(live, "cluster_id").join(papers.select("doi", "external_key"), "doi", "left")
    return joined.select("doi", F.col("external_key").alias("key"), tag.alias("tag"), F.when(F.col("external_key").isNull(), "skipped").otherwise("added").alias("state"))


def results_append(ranked: DataFrame, run_id: int, ingested: DataFrame, now: str) -> DataFrame:
    """Ranked rows as result rows of a run; ``ingested_at`` is set for ingested ones only."""
    hit = ranked.join(ingested.select("doi").distinct().withColumn("_in", F.lit(True)), "doi", "left").withColumn("ingested", F.coalesce("_in", F.lit(False))).drop("_in")
    return hit.withColumn("run_id", F.lit(run_id)).withColumn("ingested_at", F.when(F.col("ingested"), F.lit(now)))


FOCUS_FIELDS = ("topics", "methods", "materials", "applications", "keywords")


def domain_focus(lists: DataFrame) -> DataFrame:
    """(field_type, value) of rows with the array columns of ``FOCUS_FIELDS``; blanks are dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field_type"), F.col(c).alias("vs")) for c in FOCUS_FIELDS if c in lists.columns])
    rows = lists.select(F.explode(pairs).alias("p")).select("p.field_type", F.explode("p.vs").alias("value"))
    return rows.withColumn("value", F.trim("value")).filter("value <> ''").distinct()


def read_domain_focus(stored: DataFrame) -> DataFrame:
    """(field_type, values) with every field, an empty list where nothing is stored."""
    known = stored.sparkSession.createDataFrame([(f,) for f in FOCUS_FIELDS], "field_type string")
    got = stored.groupBy("field_type").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return known.join(got, "field_type", "left").withColumn("values", F.coalesce("values", F.expr("cast(array() as array<string>)")))


def embedding_provenance(table: DataFrame, batch: DataFrame, current: str) -> DataFrame:
    """(collection, provider, model, dim, is_current) with the batch's rows in place."""
    return replace_by_key(table.drop("is_current"), batch, "collection").withColumn("is_current", F.col("collection") == current)


def interest_vectors(table: DataFrame, row: DataFrame) -> DataFrame:
    return replace_by_key(table, row, "scope")


def trending_actions(pending: DataFrame, actions: DataFrame) -> DataFrame:
    """Suggestions with the accepted or dismissed actions (id, action, at) applied; other actions count not."""
    known = actions.filter(F.col("action").isin("accepted", "dismissed")).groupBy("id").agg(F.max_by(F.struct("action", "at"), "at").alias("a"))
    joined = pending.join(known, "id", "left")
    return joined.withColumn("status", F.coalesce("a.action", "status")).withColumn("acted_at", F.coalesce("a.at", "acted_at")).drop("a")


def mark_progress(progress: DataFrame, done: DataFrame) -> DataFrame:
    """Phase flags (simple, complex) set from (doi, phase); complete if both are."""
    flags = done.groupBy("doi").agg(F.bool_or(F.col("phase") == "simple").alias("_s"), F.bool_or(F.col("phase") == "complex").alias("_c"))
    out = progress.join(flags, "doi", "left")
    for flag, new in (("simple", "_s"), ("complex", "_c")):
        out = out.withColumn(flag, F.coalesce(flag, F.lit(False)) | F.coalesce(new, F.lit(False)))
    return out.withColumn("complete", F.col("simple") & F.col("complex")).drop("_s", "_c")


def reset_extractions(papers: DataFrame, flags: tuple[str, ...] = ("graph_indexed", "chunks_indexed", "notes_synced", "embeddings_indexed")) -> DataFrame:
    reset = papers.withColumn("extraction", F.lit(None).cast("string")).withColumn("status", F.lit("pending"))
    return reset.withColumns({f: F.lit(False) for f in flags if f in papers.columns})


def purge_types(rows: DataFrame, retired: tuple[str, ...]) -> DataFrame:
    """Rows of other source types than the retired ones; a null type stays."""
    return rows.filter(F.col("source_type").isNull() | ~F.col("source_type").isin(*retired))


def _pointers(spark: SparkSession, root: str) -> tuple[object, object, list[int]]:
    """File system, root path and the numbers of the pointer files below ``root``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return fs, jvm, sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-") and n[8:].isdigit())


def has_snapshot(spark: SparkSession, root: str) -> bool:
    return bool(_pointers(spark, root)[2])


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a version below ``root`` and then a pointer file of the next number; returns the version's path."""
    import uuid

    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    publish(df.sparkSession, root, path)
    return path


def publish(spark: SparkSession, root: str, text: str, after: int | None = None) -> None:
    """Add a pointer file with ``text``, of the number after the last (or after ``after``, which must be the last).

    Pointers are never changed or deleted, only added, by a rename from a name that readers ignore: at any time
    the highest number is a whole pointer. Of two writers at once the second one's rename fails.
    """
    import uuid

    fs, jvm, numbers = _pointers(spark, root)
    last = numbers[-1] if numbers else 0
    if after is not None and after != last:
        raise RuntimeError(f"another writer has published number {last}")
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(root))
    temp = jvm.org.apache.hadoop.fs.Path(f"{root}/.next-{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/current-{last + 1:012d}")
    if not fs.rename(temp, target):
        raise RuntimeError(f"another writer has published {target}")


def pointer(spark: SparkSession, root: str) -> tuple[int, str]:
    """Number and text of the last pointer."""
    number = _pointers(spark, root)[2][-1]
    return number, "\n".join(r.value for r in spark.read.text(f"{root}/current-{number:012d}").collect())


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The version that the highest pointer names."""
    return spark.read.parquet(pointer(spark, root)[1])
