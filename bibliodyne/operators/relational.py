"""Filters, joins, aggregations, windows and set operations over papers, runs, results and events.

All are DataFrame to DataFrame; ``now`` and limits are parameters, and every order has a key tiebreak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliodyne.functions.scalar import normalize_doi, overall_confidence, parse_year

SORTABLE = ("doi", "title", "year", "journal", "status", "source_type", "last_updated")
BACKLOGS = {
    "graph": "graph_indexed = false",
    "chunks": "chunks_indexed = false AND embeddings_indexed = true",
    "notes": "notes_synced = false",
}
SIGNALS = ("saved", "thumbs_up", "thumbs_down", "dismissed", "opened", "rated")


# ---------------------------------------------------------------- filters

def corpus_search(papers: DataFrame, text: str | None = None, source_type: str | None = None, exclude_status: tuple[str, ...] = (), missing: tuple[str, ...] = (), sort: str = "doi", descending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Papers whose title or doi contains the text, of a source type, not of the statuses (a null status
    is not excluded), with the named flags false; sorted by a listed column with doi as tiebreak."""
    if sort not in SORTABLE:
        raise ValueError(f"cannot sort by {sort!r}")
    out = papers
    if text:
        out = out.filter(F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("doi"), F.lit(text.lower())))
    if source_type is not None:
        out = out.filter(F.col("source_type") == source_type)
    if exclude_status:
        out = out.filter(F.col("status").isNull() | ~F.col("status").isin(*exclude_status))
    for flag in missing:
        out = out.filter(~F.coalesce(F.col(flag), F.lit(False)))
    order = F.col(sort).desc() if descending else F.col(sort).asc()
    out = out.orderBy(order, "doi").offset(offset)
    return out if limit is None else out.limit(limit)


def low_confidence(papers: DataFrame, below: float = 0.5) -> DataFrame:
    return papers.withColumn("overall_confidence", overall_confidence(F.col("extraction"))).filter(F.col("overall_confidence") < below)


def library(papers: DataFrame) -> DataFrame:
    return papers.filter(F.col("status").isNull() | (F.col("status") != "discovered"))


def indexable(papers: DataFrame) -> DataFrame:
    return papers.filter(F.col("extraction").isNotNull())


def backlog(papers: DataFrame, kind: str, since: str | None = None, limit: int | None = None) -> DataFrame:
    """A work queue, with a limit its first keys; ``since`` keeps rows not updated before it (or never)."""
    out = papers.filter(BACKLOGS[kind])
    if since is not None:
        out = out.filter(F.col("last_updated").isNull() | (F.col("last_updated") >= F.lit(since).cast("timestamp_ntz")))
    return out if limit is None else out.orderBy("doi").limit(limit)


def item_quality(items: DataFrame) -> DataFrame:
    """Adds ``accepted`` and ``warnings``: a blank title rejects; no author or editor, no abstract and a date that
    has no year warn (a missing date does not)."""
    warn = lambda cond, name: F.when(cond, F.lit(name))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    no_creator = F.col("author").isNull() & (F.col("editor").isNull() if "editor" in items.columns else F.lit(True))
    warnings = F.array_compact(F.array(warn(no_creator, "author"), warn(blank(F.col("abstract")), "abstract"), warn((F.coalesce("date", F.lit("")) != "") & (parse_year(F.col("date")) == 0), "date")))
    return items.withColumn("accepted", ~blank(F.col("title"))).withColumn("warnings", F.array_join(warnings, ","))


def date_window(rows: DataFrame, column: str, since: str, until: str | None = None) -> DataFrame:
    c = F.col(column)
    out = rows.filter(c >= F.lit(since).cast("timestamp_ntz"))
    return out if until is None else out.filter(c <= F.lit(until).cast("timestamp_ntz"))


def min_relevance(hits: DataFrame, least: float, score: str = "score") -> DataFrame:
    return hits.filter(F.coalesce(F.col(score), F.lit(1.0)) >= least)


def low_confidence_mentions(mentions: DataFrame, below: float = 0.65) -> DataFrame:
    return mentions.filter(F.col("confidence") < below)


def valid_spans(spans: DataFrame) -> DataFrame:
    """Rows whose surface is what the text has at start:end (0 <= start < end <= length)."""
    s, e = F.col("start"), F.col("end")
    return spans.filter((s >= 0) & (s < e) & (e <= F.length("text")) & (F.substring("text", s + 1, e - s) == F.col("surface")))


# ---------------------------------------------------------------- joins

def run_history(runs: DataFrame, run_log: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with their log entry, and counts of results and ingested ones (0 if none)."""
    counts = results.groupBy("run_id").agg(F.count("*").alias("n_results"), F.count_if("ingested").alias("n_ingested"))
    log = run_log.withColumnRenamed("id", "log_id")
    out = runs.join(log, F.col("id") == F.col("log_id"), "left").join(counts, F.col("id") == F.col("run_id"), "left").drop("run_id", "log_id")
    return out.fillna(0, ["n_results", "n_ingested"])


def progress_papers(progress: DataFrame, papers: DataFrame) -> DataFrame:
    return progress.join(papers.select("doi", "title"), "doi", "left")


def cluster_members(assignments: DataFrame, papers: DataFrame) -> DataFrame:
    """Assignments with titles, and the place of each paper in its cluster by distance."""
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy("distance", "doi"))
    return assignments.join(papers.select("doi", "title"), "doi", "left").withColumn("place", place)


def with_theme(papers: DataFrame, assignments: DataFrame, clusters: DataFrame, name: str) -> DataFrame:
    active = clusters.filter(~F.col("archived") & (F.col("display_name") == name)).select(F.col("id").alias("cluster_id"))
    return papers.join(assignments.join(active, "cluster_id", "left_semi").select("doi"), "doi", "left_semi")


def unknown_candidates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose normalised doi is not known; those without a doi are kept."""
    keyed = candidates.withColumn("_key", normalize_doi(F.col("doi")))
    seen = known.select(normalize_doi(F.col("doi")).alias("_key")).filter("_key <> ''").distinct()
    return keyed.filter("_key <> ''").join(seen, "_key", "left_anti").unionByName(keyed.filter("_key = ''")).drop("_key")


def exploration_extra(explored: DataFrame, pool: DataFrame, share: float) -> DataFrame:
    """Explored hits that the pool lacks, capped at a share (clamped to 0..1) of the pool's size."""
    share = min(1.0, max(0.0, share)) if share == share and abs(share) != float("inf") else 0.0
    cap = -int(-pool.count() * share // 1)
    return unknown_candidates(explored, pool).orderBy("position", "doi").limit(cap)


def last_surfaced(clusters: DataFrame, assignments: DataFrame, results: DataFrame, runs: DataFrame) -> DataFrame:
    """Active clusters with the last start of a run that surfaced one of their papers, if any."""
    seen = results.filter(F.coalesce(F.trim("doi"), F.lit("")) != "").join(runs.select(F.col("id").alias("run_id"), "started_at"), "run_id")
    last = seen.groupBy("doi").agg(F.max("started_at").alias("at")).join(assignments.select("doi", "cluster_id"), "doi").groupBy("cluster_id").agg(F.max("at").alias("last_at"))
    active = clusters.filter(~F.col("archived"))
    return active.join(last, active["id"] == last["cluster_id"], "left").drop("cluster_id")


def first_surfaced(results: DataFrame, runs: DataFrame) -> DataFrame:
    seen = results.filter(F.coalesce(F.trim("doi"), F.lit("")) != "").join(runs.select(F.col("id").alias("run_id"), "started_at"), "run_id")
    return seen.groupBy("doi").agg(F.to_date(F.min("started_at")).alias("first_on"))


def implicit_saves(ingested: DataFrame, surfaced: DataFrame, events: DataFrame) -> DataFrame:
    """Ingested papers that had been surfaced and have no implicit save yet."""
    done = events.filter("signal_type = 'saved' AND source = 'implicit'").select("doi")
    return ingested.select("doi").distinct().join(surfaced.select("doi"), "doi", "left_semi").join(done, "doi", "left_anti")


def mark_ingested(results: DataFrame, papers: DataFrame) -> DataFrame:
    """Results whose normalised doi is in the library become ingested; a first time is never changed."""
    owned = papers.select(normalize_doi(F.col("doi")).alias("_key"), F.col("last_updated").alias("_at")).groupBy("_key").agg(F.min("_at").alias("_at"))
    out = results.withColumn("_key", normalize_doi(F.col("doi"))).join(owned.filter("_key <> ''").withColumn("_in", F.lit(True)), "_key", "left")
    hit = F.coalesce("_in", F.lit(False))
    return out.withColumn("ingested_at", F.when(hit, F.coalesce("ingested_at", "_at")).otherwise(F.col("ingested_at"))).withColumn("ingested", F.col("ingested") | hit).drop("_key", "_at", "_in")


def mirror_citations(edges: DataFrame, papers: DataFrame, existing: DataFrame) -> DataFrame:
    """Resolved edges with both ends present that the graph lacks."""
    doi = papers.select("doi")
    new = edges.filter("target IS NOT NULL").join(doi.withColumnRenamed("doi", "source"), "source", "left_semi").join(doi.withColumnRenamed("doi", "target"), "target", "left_semi")
    return new.join(existing.select("source", "target"), ["source", "target"], "left_anti").dropDuplicates(["source", "target"])


def cited_papers(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(source, target, title) of titled cited papers, each target once per source."""
    titled = papers.filter("title IS NOT NULL").select(F.col("doi").alias("target"), "title")
    return edges.select("source", "target").distinct().join(titled, "target")


def citing_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.countDistinct("source").alias("n_citing"))


def related_work(cited: DataFrame, similar: DataFrame) -> DataFrame:
    """Per paper the cited list first, then similar papers that are not cited, in order; rows (doi, place,
    other). ``cited`` and ``similar`` have doi, other, position."""
    first = cited.withColumn("part", F.lit(0))
    second = similar.join(cited.select("doi", "other"), ["doi", "other"], "left_anti").withColumn("part", F.lit(1))
    order = W.partitionBy("doi").orderBy("part", "position", "other")
    return first.unionByName(second).select("doi", "other", F.row_number().over(order).alias("place"))


def unmapped(keywords: DataFrame, themes: DataFrame, key: str = "keyword") -> DataFrame:
    return keywords.join(themes.select(key), key, "left_anti")


def hydrate(ranked: DataFrame, papers: DataFrame) -> DataFrame:
    return ranked.join(papers.select("doi", "title", "year", "journal"), "doi", "left")


# ---------------------------------------------------------------- aggregations

def status_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("status").agg(F.count("*").alias("n"))


def index_coverage(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count_if(F.col("extraction").isNotNull()).alias("extracted"), F.count_if("embeddings_indexed").alias("embedded"), F.count_if("graph_indexed").alias("graphed"))


def graph_health(papers: DataFrame) -> DataFrame:
    """Ingested papers (those with a status other than discovered) and the indexed ones of them: a warning while
    there are none of either, ok from the first indexed paper on."""
    ingested = F.coalesce(F.col("status") != "discovered", F.lit(False))
    counted = papers.agg(F.count_if(ingested).alias("total"), F.count_if(ingested & F.col("graph_indexed")).alias("indexed"))
    return counted.withColumn("health", F.when(F.col("indexed") > 0, "ok").otherwise("warn"))


def zero_filled_counts(rows: DataFrame, column: str, vocabulary: tuple[str, ...]) -> DataFrame:
    """Rows per value of a closed vocabulary, 0 where there is none."""
    known = rows.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(counts, column, "left").fillna(0, ["n"])


def counts_by(rows: DataFrame, *columns: str, drop_null: bool = False, unknown: str | None = None) -> DataFrame:
    if drop_null:
        rows = rows.filter(F.col(columns[0]).isNotNull())
    if unknown is not None:
        rows = rows.withColumn(columns[0], F.coalesce(columns[0], F.lit(unknown)))
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def week_label(at: Column) -> Column:
    """Year and Monday-first week of the year, as %Y-W%W."""
    week = F.floor((F.dayofyear(at) + 6 - F.weekday(at)) / 7)
    return F.concat(F.date_format(at, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def feedback_timeline(events: DataFrame, by: str = "signal_type", weekly: bool = False, since: str | None = None) -> DataFrame:
    if since is not None:
        events = events.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    bucket = week_label(F.col("created_at")) if weekly else F.date_format("created_at", "yyyy-MM-dd")
    return events.groupBy(bucket.alias("bucket"), by).agg(F.count("*").alias("n"))


def run_conversion(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(F.count("*").alias("n_results"), F.count_if("ingested").alias("n_ingested"))


def trending_counts(mentions: DataFrame, now: str, days: int = 60, top: int | None = 500) -> DataFrame:
    """Mentions per entity in the last ``days`` days and in as many before, by time of extraction."""
    at, end = F.col("extracted_at"), F.lit(now).cast("timestamp_ntz")
    edge = lambda n: F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(n))
    recent = mentions.filter((at >= edge(2 * days)) & (at < end))
    counted = recent.groupBy("canonical_id").agg(F.count_if(at >= edge(days)).alias("n_new"), F.count_if(at < edge(days)).alias("n_prev")).filter("n_new > 0")
    return counted if top is None else counted.orderBy(F.desc("n_new"), "canonical_id").limit(top)


def keyword_pairs(items: DataFrame) -> DataFrame:
    """Distinct (keyword, doi) of rows with an array ``tags``."""
    return items.select("doi", F.explode("tags").alias("keyword")).filter(F.trim("keyword") != "").distinct()


def merge_passes(passes: DataFrame) -> DataFrame:
    """Per (doi, field) the value of highest confidence, the earliest chunk among equals."""
    rank = F.when(F.col("confidence") == "explicit", 2).when(F.col("confidence") == "inferred", 1).otherwise(0)
    best = F.max_by(F.struct("value", "confidence"), F.struct(rank.alias("r"), (-F.col("chunk")).alias("c")))
    return passes.groupBy("doi", "field").agg(best.alias("b")).select("doi", "field", "b.value", "b.confidence")


def merge_themes(themes: DataFrame) -> DataFrame:
    """One keyword list per theme, in the order of first sight (rows theme, position, keywords)."""
    words = themes.select("theme", "position", F.posexplode("keywords").alias("i", "keyword"))
    first = words.groupBy("theme", "keyword").agg(F.min(F.struct("position", "i")).alias("at"))
    listed = first.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("at", "keyword"))).alias("k"))
    return listed.select("theme", F.transform("k", lambda x: x["keyword"]).alias("keywords"))


# ---------------------------------------------------------------- windows, top-k, pages

def same_day_ordinal(runs: DataFrame) -> DataFrame:
    return runs.withColumn("ordinal", F.row_number().over(W.partitionBy(F.to_date("started_at")).orderBy("id")))


def snapshot_delta(snapshots: DataFrame, at: str, values: tuple[str, ...]) -> DataFrame:
    """The latest snapshot with each value's change since the one before (null for a single one)."""
    latest = snapshots.orderBy(F.desc(at)).limit(2)
    order = W.orderBy(at)
    for v in values:
        latest = latest.withColumn(f"{v}_delta", F.col(v) - F.lag(v).over(order))
    return latest.orderBy(F.desc(at)).limit(1)


def nearest_cluster(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    active = clusters.filter(~F.col("archived")).select(F.col("id").alias("cluster_id"))
    live = assignments.join(active, "cluster_id", "left_semi")
    return live.groupBy("doi").agg(F.min(F.struct("distance", "cluster_id")).alias("b")).select("doi", "b.cluster_id", "b.distance")


def latest_breakdown(results: DataFrame) -> DataFrame:
    live = results.filter("breakdown IS NOT NULL AND doi IS NOT NULL")
    return live.groupBy("doi").agg(F.max_by("breakdown", F.struct("run_id", "id")).alias("breakdown"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def top_entities(mentions: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """Per type the entities with most distinct papers."""
    counted = mentions.groupBy("canonical_id").agg(F.countDistinct("doi").alias("n_papers")).join(entities.filter("type IS NOT NULL").select("canonical_id", "type", "surface"), "canonical_id")
    return top_per_group(counted, ["type"], [F.desc("n_papers"), F.col("canonical_id")], k)


def query_terms(themes: DataFrame, k: int = 4) -> DataFrame:
    """(theme, query): at most k terms, phrases of two or three words first and shortest first, else the
    longest words; joined by OR with quoted phrases. Rows theme, pos, term; a theme of blanks gives its name."""
    words = F.size(F.split(F.trim("term"), r"\s+"))
    phrase = words.between(2, 3)
    live = themes.filter(F.trim("term") != "").withColumn("phrase", phrase)
    some = F.max(F.col("phrase").cast("int")).over(W.partitionBy("theme"))
    live = live.withColumn("some", some).filter((F.col("some") == 0) | F.col("phrase"))
    length = F.when(F.col("some") == 1, F.length("term")).otherwise(-F.length("term"))
    best = top_per_group(live, ["theme"], [length, F.col("pos")], k)
    quoted = F.when(F.contains("term", F.lit(" ")), F.concat(F.lit('"'), F.col("term"), F.lit('"'))).otherwise(F.col("term"))
    found = best.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("place", quoted.alias("q")))).alias("t")).select("theme", F.array_join(F.transform("t", lambda x: x["q"]), " OR ").alias("query"))
    name = F.lower("theme")
    bare = themes.select("theme").distinct().join(found, "theme", "left_anti").withColumn("query", F.when(F.contains("theme", F.lit(" ")), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name))
    return found.unionByName(bare)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


# ---------------------------------------------------------------- sets

def search_dedup(hits: DataFrame, title_chars: int = 60) -> DataFrame:
    """First hit per normalised doi, in order of source then position. A hit without doi is keyed by the
    start of its title in the primary source (source_order 0) and dropped in the others."""
    doi = normalize_doi(F.col("doi"))
    key = F.when(doi != "", F.concat(F.lit("d:"), doi)).when(F.col("source_order") == 0, F.concat(F.lit("t:"), F.lower(F.substring("title", 1, title_chars))))
    # Generating the key from a list keeps the optimizer from repeating its expression in filter and grouping;
    # the first hit is a minimum, so hits combine before the shuffle.
    keyed = hits.select(F.explode(F.filter(F.array(key), lambda k: k.isNotNull())).alias("_key"), F.struct("source_order", "position").alias("_at"), F.struct(*[F.col(f"`{c}`") for c in hits.columns]).alias("_row"))
    return keyed.groupBy("_key").agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")


def relation_union(to_entities: DataFrame, to_papers: DataFrame) -> DataFrame:
    return to_entities.select("doi").union(to_papers.select("doi")).distinct()


def mentions_merge(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(["doi", "canonical_id", "source", "span_start", "span_end", "field"])


def case_dedup(rows: DataFrame, value: str, group: str, per_group: int, overall: int) -> DataFrame:
    """First-seen values regardless of case, capped per group and then overall."""
    first = top_per_group(rows, [group, F.lower(value)], [F.col("position")], 1).drop("place")
    kept = top_per_group(first, [group], [F.col("position")], per_group).drop("place")
    once = top_per_group(kept, [F.lower(value)], [F.col(group), F.col("position")], 1).drop("place")
    return once.orderBy(group, "position").limit(overall)
