"""Entity and citation graph jobs over mention and relation tables; traversals are equality joins.

Entities that stand in very many papers make a shared-entity join grow with the square of their degree.
``similar_papers`` avoids that join; ``shared_entity_pairs``, which lists all pairs, takes ``max_degree`` to leave such
hubs out (off by default, since it changes results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliodyne.session import dealt


def shared_entity_pairs(mentions: DataFrame, seeds: DataFrame | None = None, max_degree: int | None = None) -> DataFrame:
    """(doi, other, n_shared): papers by the number of distinct entities that both mention."""
    edges = mentions.select("doi", "canonical_id").distinct()
    if max_degree is not None:
        small = edges.groupBy("canonical_id").agg(F.count("*").alias("n")).filter(F.col("n") <= max_degree)
        edges = edges.join(small, "canonical_id", "left_semi")
    left = edges if seeds is None else edges.join(seeds.select("doi"), "doi", "left_semi")
    right = edges.withColumnRenamed("doi", "other")
    return left.join(right, "canonical_id").filter("doi <> other").groupBy("doi", "other").agg(F.count("*").alias("n_shared"))


#: Entities of a paper beyond which its pairs are not listed: such a paper meets others by single entities.
WIDE = 64
#: Papers of an entity pair that meet in one task.
MEETING = 2048


def similar_papers(mentions: DataFrame, k: int = 10, seeds: DataFrame | None = None, max_degree: int | None = None) -> DataFrame:
    """(doi, other, n_shared, rank): the k papers that share most entities with each paper, ties by doi.

    A paper that shares one entity only can be among the first k through the first k + 1 papers (by doi) of that entity:
    whoever comes later in the list has k rivals with smaller dois and as much in common. So each entity gives
    that short list to its papers, and nothing more. Papers with two or more entities in common meet under a pair of
    entities, c * (c - 1) / 2 times if they share c, which gives c; pairs that one paper alone has are dropped before. So
    an entity in half of all papers costs a row per paper; papers of over ``WIDE`` entities meet others entity by entity.
    Hot entities and pairs are dealt over tasks."""
    from bibliodyne.operators.skew import join_keys
    from bibliodyne.session import materialize

    rows = mentions.select("doi", F.col("canonical_id").alias("e")).filter("doi IS NOT NULL AND e IS NOT NULL")
    if max_degree is not None:
        small = rows.distinct().groupBy("e").agg(F.count("*").alias("n")).filter(F.col("n") <= max_degree)
        rows = rows.join(small, "e", "left_semi")
    n = mentions.count()
    if seeds is not None:
        # What is not an entity of a seed can be shared with none.
        rows = materialize(rows.join(rows.join(seeds.select("doi"), "doi", "left_semi").select("e").distinct(), "e", "left_semi"), "mentions-met")
        n = rows.count()
    papers = dealt(rows, n, "doi").groupBy("doi").agg(F.array_sort(F.collect_set("e")).alias("es"))
    papers = materialize(papers.withColumn("no", F.monotonically_increasing_id()), "papers")
    edges = papers.select("doi", F.explode("es").alias("e"))
    asked = edges if seeds is None else edges.join(seeds.select("doi"), "doi", "left_semi")

    # One entity in common: the first papers of each entity.
    place = F.row_number().over(W.partitionBy("e").orderBy("doi"))
    first = edges.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("e").agg(F.collect_list("doi").alias("first"))
    lists = materialize(first.join(edges.groupBy("e").agg(F.count("*").alias("n")), "e").filter("n > 1"), "entity-lists")
    met = join_keys(asked, lists, "e", "doi", "n").groupBy("doi").agg(F.flatten(F.collect_list("first")).alias("others")).select("doi", F.sort_array("others").alias("others"))
    fresh = lambda o, i: (o != F.col("doi")) & ((i == 0) | (o != F.get("others", i - 1)))
    singles = met.select("doi", F.slice(F.filter("others", fresh), 1, k).alias("singles"))

    # Two or more: papers, by their numbers, under each pair of entities. A pair of two papers is settled by its least and
    # greatest number; only what more papers have is joined.
    narrow = papers.filter((F.size("es") <= WIDE) & (F.size("es") > 1))
    pairs = F.flatten(F.transform("es", lambda a, i: F.transform(F.slice("es", i + 2, F.size("es")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    under = narrow.select("no", F.explode(pairs).alias("p"))
    shared = materialize(under.select("no", "p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("no").alias("low"), F.max("no").alias("high")).filter("n > 1"), "entity-pairs")
    ways = F.explode(F.array(F.struct(F.col("low").alias("x"), F.col("high").alias("y")), F.struct(F.col("high").alias("x"), F.col("low").alias("y"))))
    times = shared.filter("n = 2").select(ways.alias("w")).select("w.x", "w.y")
    many = shared.filter("n > 2").select(F.struct("a", "b").alias("p"), "n", F.ceil(F.col("n") / MEETING).alias("cuts"))
    if not many.isEmpty():
        kept = materialize(join_keys(under, many, "p", "no", "n").select("no", "p", "cuts"), "paper-pairs")
        left = kept.select(F.col("no").alias("x"), "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))
        right = kept.select(F.col("no").alias("y"), F.col("p").alias("q"), F.pmod(F.xxhash64("no"), F.col("cuts")).alias("cut_q"))
        times = times.unionByName(left.join(right, (F.col("p") == F.col("q")) & (F.col("cut") == F.col("cut_q")) & (F.col("x") != F.col("y"))).select("x", "y"))
    if seeds is not None:
        times = times.join(papers.join(seeds.select("doi"), "doi", "left_semi").select(F.col("no").alias("x")), "x", "left_semi")
    times = materialize(times.groupBy("x", "y").agg(F.count("*").alias("t")), "paper-pairs-met")
    named = lambda no, doi: papers.select(F.col("no").alias(no), F.col("doi").alias(doi))
    more = times.join(named("x", "doi"), "x").join(named("y", "other"), "y").select("doi", "other", F.round((1 + F.sqrt(1 + 8 * F.col("t"))) / 2).cast("long").alias("n_shared"))

    # Papers of very many entities, with everybody.
    wide = papers.filter(F.size("es") > WIDE).select("doi", F.explode("es").alias("e"))
    wide = materialize(wide, "wide-papers")
    if not wide.isEmpty():
        lists_of = wide.groupBy("e").agg(F.count("*").alias("w"))
        sized = materialize(edges.groupBy("e").agg(F.count("*").alias("n")).join(lists_of, "e").select("e", "n", F.ceil(F.col("n") / MEETING).alias("cuts")), "wide-entities")
        wide_side = join_keys(wide, sized, "e", "doi", "n").select(F.col("doi").alias("wide"), F.col("e").alias("we"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("wcut"))
        rest = join_keys(edges, sized, "e", "doi", "n").select("doi", "e", F.pmod(F.xxhash64("doi"), F.col("cuts")).alias("cut"))
        both = rest.join(wide_side, (F.col("e") == F.col("we")) & (F.col("cut") == F.col("wcut")) & (F.col("doi") != F.col("wide"))).groupBy("wide", "doi").agg(F.count("*").alias("n_shared"))
        both = materialize(both, "wide-pairs")
        narrow_side = both.join(wide.select("doi").distinct(), "doi", "left_anti").select("doi", F.col("wide").alias("other"), "n_shared")
        met_wide = both.select(F.col("wide").alias("doi"), F.col("doi").alias("other"), "n_shared").unionByName(narrow_side)
        more = more.unionByName(met_wide if seeds is None else met_wide.join(seeds.select("doi"), "doi", "left_semi"))

    # A paper's own best k suffice of each kind; the two lists meet as arrays, so that no row a pair is shuffled for them.
    order = W.partitionBy("doi").orderBy(F.desc("n_shared"), "other")
    best = more.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("doi").agg(F.collect_list(F.struct((-F.col("n_shared")).alias("less"), "other")).alias("best"))
    both = singles.join(best, "doi", "left").withColumn("best", F.coalesce("best", F.expr("cast(array() as array<struct<less:bigint,other:string>>)")))
    seen = F.transform("best", lambda b: b["other"])
    rest = F.transform(F.filter("singles", lambda o: ~F.array_contains(seen, o)), lambda o: F.struct(F.lit(-1).cast("long").alias("less"), o.alias("other")))
    ranked = both.select("doi", F.posexplode(F.slice(F.sort_array(F.concat("best", rest)), 1, k)).alias("place", "o"))
    return ranked.select("doi", F.col("o.other").alias("other"), (-F.col("o.less")).alias("n_shared"), (F.col("place") + 1).alias("rank"))


def containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text, term) of all lower-case texts (column text) that contain a lower-case term (column term).

    A term is looked up by the rarest of its grams of three characters (of its own length if it is shorter), in
    an equality join, and verified. Blank terms are in no text."""
    t = texts.select(F.lower("text").alias("text")).filter("text <> ''").distinct()
    q = terms.select(F.lower("term").alias("term")).filter("trim(term) <> ''").distinct()
    grams = lambda x, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, n)))
    by_length = F.flatten(F.array(*[F.when(F.length("text") >= n, grams(F.col("text"), F.lit(n))).otherwise(F.expr("cast(array() as array<string>)")) for n in (1, 2, 3)]))
    index = t.select("text", F.explode(by_length).alias("gram"))
    rarity = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = q.select("term", F.explode(grams(F.col("term"), F.least(F.length("term"), F.lit(3)))).alias("gram"))
    key = own.join(rarity, "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return index.join(key, "gram").filter(F.contains("text", F.col("term"))).select("text", "term")


def papers_by_entities(mentions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doi, n_shared) for a table of wanted entities (query_id, canonical_id). Tasks hold some papers each, and
    their number follows the mentions."""
    met = mentions.select("doi", "canonical_id").join(wanted.select("query_id", "canonical_id").distinct(), "canonical_id")
    return dealt(met, mentions.count(), "doi").distinct().groupBy("query_id", "doi").agg(F.count("*").alias("n_shared"))


def find_by_entity(mentions: DataFrame, entities: DataFrame, papers: DataFrame, surface: str) -> DataFrame:
    hit = entities.filter(F.lower("surface") == surface.lower()).select("canonical_id")
    return papers.join(mentions.join(hit, "canonical_id", "left_semi").select("doi"), "doi", "left_semi")


def neighborhood(mentions: DataFrame, entities: DataFrame, k: int = 25) -> DataFrame:
    """(canonical_id, other, n_paths): co-entities of given entities by edge paths, not distinct papers."""
    mine = mentions.join(entities.select("canonical_id"), "canonical_id", "left_semi").select("canonical_id", "doi")
    others = mentions.select(F.col("canonical_id").alias("other"), "doi")
    # Some four pairs a mention; tasks hold a bounded number of them, and their number follows the mentions.
    n = 4 * mentions.count()
    pairs = dealt(mine.join(others, "doi").filter("canonical_id <> other").select("canonical_id", "other"), n, "canonical_id", "other")
    paths = dealt(pairs.groupBy("canonical_id", "other").agg(F.count("*").alias("n_paths")), n, "canonical_id")
    return paths.withColumn("place", F.row_number().over(W.partitionBy("canonical_id").orderBy(F.desc("n_paths"), "other"))).filter(F.col("place") <= k)


def co_occurrence(mentions: DataFrame, entities: DataFrame, terms: DataFrame, k: int = 3) -> DataFrame:
    """(term, other, n_papers): the co-entities of the entity whose surface contains the term (the one
    with most papers, then the smallest id), by distinct papers."""
    edges = mentions.select("doi", "canonical_id").distinct()
    degree = edges.groupBy("canonical_id").agg(F.count("*").alias("n"))
    met = containing(entities.select(F.col("surface").alias("text")), terms).withColumnsRenamed({"text": "_text", "term": "_term"})
    asked = terms.select("term").distinct().join(met, F.lower("term") == F.col("_term"))
    hit = entities.join(asked, F.lower("surface") == F.col("_text")).join(degree, "canonical_id")
    seed = hit.groupBy("term").agg(F.max_by("canonical_id", F.struct("n", (-F.col("canonical_id")).alias("i"))).alias("canonical_id"))
    others = edges.withColumnRenamed("canonical_id", "other")
    pairs = edges.join(seed, "canonical_id").join(others, "doi").filter("canonical_id <> other")
    counted = pairs.groupBy("term", "other").agg(F.countDistinct("doi").alias("n_papers"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy("term").orderBy(F.desc("n_papers"), "other"))).filter(F.col("place") <= k)


def central_entities(mentions: DataFrame, assignments: DataFrame, k: int = 5) -> DataFrame:
    """Per cluster the entities that most of its papers mention."""
    counted = mentions.select("doi", "canonical_id").distinct().join(assignments.select("doi", "cluster_id"), "doi").groupBy("cluster_id", "canonical_id").agg(F.countDistinct("doi").alias("n_papers"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("n_papers"), "canonical_id"))).filter(F.col("place") <= k)


def exploration_queries(mentions: DataFrame, entities: DataFrame, assignments: DataFrame, central: int = 3, cap: int = 5) -> DataFrame:
    """(cluster_id, place, query): central surfaces of a cluster, then what co-occurs with them, once each
    regardless of case, ``cap`` at most."""
    from bibliodyne.operators.relational import top_per_group

    surfaces = entities.select("canonical_id", "surface")
    seeds = central_entities(mentions, assignments, central).select("cluster_id", "canonical_id", F.col("place").alias("seed_place"))
    near = neighborhood(mentions, seeds.select("canonical_id").distinct(), 3).select("canonical_id", "other", F.col("place").alias("near_place"))
    first = seeds.join(surfaces, "canonical_id").select("cluster_id", "seed_place", F.lit(0).alias("near_place"), "surface")
    second = seeds.join(near, "canonical_id").select("cluster_id", "seed_place", "near_place", F.col("other").alias("canonical_id")).join(surfaces, "canonical_id").select("cluster_id", "seed_place", "near_place", "surface")
    both = first.unionByName(second).withColumn("part", F.least("near_place", F.lit(1)))
    order = [F.col("part"), F.col("seed_place"), F.col("near_place")]
    once = top_per_group(both.withColumn("q", F.lower("surface")), ["cluster_id", "q"], order, 1).drop("place")
    return top_per_group(once, ["cluster_id"], order, cap).select("cluster_id", "place", F.col("q").alias("query"))


def paper_snapshot(papers: DataFrame, mentions: DataFrame, entities: DataFrame, cites: DataFrame) -> DataFrame:
    """Papers with their entities per type (map of sorted lists) and citation lists."""
    by_type = mentions.select("doi", "canonical_id").distinct().join(entities.filter("type IS NOT NULL").select("canonical_id", "type"), "canonical_id")
    lists = by_type.groupBy("doi", "type").agg(F.array_sort(F.collect_list("canonical_id")).alias("ids"))
    maps = lists.groupBy("doi").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "ids")))).alias("entities"))
    out = cites.groupBy(F.col("source").alias("doi")).agg(F.array_sort(F.collect_set("target")).alias("cites"))
    into = cites.groupBy(F.col("target").alias("doi")).agg(F.array_sort(F.collect_set("source")).alias("cited_by"))
    return papers.join(maps, "doi", "left").join(out, "doi", "left").join(into, "doi", "left")


def candidate_signals(candidates: DataFrame, mentions: DataFrame, cites: DataFrame, library: DataFrame, authorship: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Per candidate: entities shared with the library, citations to and from it, its papers that the candidate
    extends or compares to (``relations``: doi, predicate, target_id), authors shared regardless of case and the
    first three of their names; 0 or empty where there is none."""
    cand, lib = candidates.select("doi"), library.select("doi")
    # Nulls meet nothing; left out for both sides alike, so that the mentions are dealt by paper once. A paper's rows are made
    # distinct where they are counted, in one shuffle, and those of candidates only.
    edges = mentions.select("doi", "canonical_id").filter("doi IS NOT NULL AND canonical_id IS NOT NULL")
    known = edges.join(lib, "doi", "left_semi").select("canonical_id").distinct()
    met = edges.join(cand, "doi", "left_semi").join(known, "canonical_id", "left_semi").select("doi", "canonical_id")
    shared = dealt(met, mentions.count(), "doi").distinct().groupBy("doi").agg(F.count("*").alias("n_shared_entities"))
    lib_target, lib_source = lib.withColumnRenamed("doi", "target"), lib.withColumnRenamed("doi", "source")
    out = cites.join(lib_target, "target", "left_semi").groupBy(F.col("source").alias("doi")).agg(F.count("*").alias("n_cites_out"))
    into = cites.join(lib_source, "source", "left_semi").groupBy(F.col("target").alias("doi")).agg(F.count("*").alias("n_cites_in"))
    folded = authorship.select("doi", "author").filter("doi IS NOT NULL AND author IS NOT NULL").withColumn("_a", F.lower(F.col("author").cast("string")))
    lib_authors = folded.join(lib, "doi", "left_semi").select("_a").distinct()
    names = folded.join(cand, "doi", "left_semi").join(lib_authors, "_a", "left_semi").groupBy("doi").agg(F.array_sort(F.collect_set("author")).alias("names"))
    authors = names.select("doi", F.size("names").cast("long").alias("n_shared_authors"), F.slice("names", 1, 3).alias("shared_authors_sample"))
    parts = [shared, out, into, authors]
    kinds = {"n_extends": "EXTENDS", "n_compares": "COMPARES_TO"}
    if relations is None:
        parts.append(cand.distinct().select("doi", *[F.lit(0).cast("long").alias(name) for name in kinds]))
    else:
        hit = relations.filter(F.col("predicate").isin(*kinds.values())).join(lib.withColumnRenamed("doi", "target_id"), "target_id", "left_semi")
        parts.append(hit.groupBy("doi").agg(*[F.count_if(F.col("predicate") == predicate).alias(name) for name, predicate in kinds.items()]))
    joined = cand.distinct()
    for part in parts:
        joined = joined.join(part, "doi", "left")
    none = F.array().cast(f"array<{authorship.schema['author'].dataType.simpleString()}>")
    return joined.fillna(0).withColumn("shared_authors_sample", F.coalesce("shared_authors_sample", none))


def researcher_gate(authorship: DataFrame, mentions: DataFrame, topics: DataFrame, least: int = 1, researchers: DataFrame | None = None) -> DataFrame:
    """Researchers (column author) of whose papers' entities at least ``least`` are topic entities; all if no topics are
    given or none are asked for.

    A paper is a researcher's if one of its author texts (``authorship``: doi, author) contains the name as
    it is written. Names are those of ``researchers``, by default the author texts themselves."""
    names = (authorship if researchers is None else researchers).select("author").filter("author IS NOT NULL").distinct()
    if least <= 0 or topics.isEmpty():
        return names
    edges = mentions.select("doi", "canonical_id").distinct().join(topics.select("canonical_id"), "canonical_id", "left_semi")
    # Which texts hold which names is asked of distinct texts only; papers come in by their text.
    texts = authorship.select(F.col("author").cast("string").alias("text")).distinct()
    met = containing(texts, names.select(F.col("author").cast("string").alias("term"))).withColumnsRenamed({"text": "_text", "term": "_term"})
    cased = texts.join(met, F.lower("text") == F.col("_text")).join(names.select("author"), F.lower(F.col("author").cast("string")) == F.col("_term"))
    holds = cased.filter(F.contains("text", F.col("author").cast("string"))).select("text", "author").distinct()
    by_text = authorship.select(F.col("author").cast("string").alias("text"), "doi").distinct().join(edges, "doi").select("text", "canonical_id").distinct()
    counted = holds.join(by_text, "text").groupBy("author").agg(F.countDistinct("canonical_id").alias("n"))
    return counted.filter(F.col("n") >= least).select("author")


def trending(counts: DataFrame, entities: DataFrame, dismissed: DataFrame, topics: DataFrame, least_new: int = 5, least_growth: float = 0.3) -> DataFrame:
    """Rising entities: enough recent mentions and growth, not dismissed, with a flag whether a topic's
    text contains them. ``dismissed`` has concept_text, ``topics`` topic."""
    from bibliodyne.functions.scalar import growth_rate

    rising = counts.withColumn("growth", growth_rate(F.col("n_new"), F.col("n_prev"))).filter((F.col("n_new") >= least_new) & (F.col("growth") >= least_growth))
    named = rising.join(entities.select("canonical_id", "type", "surface"), "canonical_id")
    live = named.join(dismissed.select(F.lower("concept_text").alias("_d")).distinct(), F.lower("surface") == F.col("_d"), "left_anti")
    met = containing(topics.select(F.col("topic").alias("text")), live.select(F.col("surface").alias("term")))
    known = met.select(F.col("term").alias("_s")).distinct().withColumn("in_topics", F.lit(True))
    return live.join(known, F.lower("surface") == F.col("_s"), "left").drop("_s").fillna(False, ["in_topics"])


#: Fields of an extraction and the entity type each gives.
SCHEMA_FIELDS = {"methods_summary": "method", "materials_systems": "material", "discovered_topics": "topic", "novelty_statement": "topic"}


def canonical_names(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``canonical_id`` to rows with type and surface: the alias of the lower-case surface or of its normal
    form within the type, else the normal form; rows whose name is empty go. ``aliases`` has type, surface
    (lower case), canonical."""
    from bibliodyne.functions.text import basic_normalize

    named = basic_normalize(rows, "surface", "_normal").withColumn("_raw", F.lower(F.trim("surface")))
    canonical = F.col("_normal")
    if aliases is not None:
        for key, to in (("_normal", "_by_normal"), ("_raw", "_by_raw")):
            known = aliases.select(F.col("type").alias("_t"), F.col("surface").alias("_a"), F.col("canonical").alias(to)).dropDuplicates(["_t", "_a"])
            named = named.join(known, (F.col("type") == F.col("_t")) & (F.col(key) == F.col("_a")), "left").drop("_t", "_a")
            canonical = F.coalesce(to, canonical)
    out = named.withColumn("canonical_id", canonical).filter(F.coalesce("canonical_id", F.lit("")) != "")
    return out.select(*rows.columns, "canonical_id")


def extract_entities(papers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Typed mentions of papers (doi, extraction JSON, keywords, authors, journal), once per (doi, canonical_id, type,
    field): the first in order of field, place and then keywords, authors, journal.

    A text field is one entity with the whole field as its span; items of lists and the paper's own metadata
    have no span, and the latter no field.
    """
    from bibliodyne.functions.scalar import strip

    text, none = "struct<surface:string,span_start:int,span_end:int>", F.lit(None).cast("int")
    item = lambda x: F.struct(strip(x).alias("surface"), none.alias("span_start"), none.alias("span_end"))

    def schema_field(field: str) -> Column:
        raw = F.col(f"_{field}")
        listed = F.transform(F.from_json(raw, "array<string>"), item)
        whole = F.array(F.struct(strip(raw).alias("surface"), F.lit(0).alias("span_start"), F.length(strip(raw)).alias("span_end")))
        return F.when(raw.isNull() | F.startswith(F.ltrim(raw), F.lit("{")), F.expr(f"cast(array() as array<{text}>)")).when(F.startswith(F.ltrim(raw), F.lit("[")), listed).otherwise(whole)

    metadata = {"keyword": F.transform("keywords", item), "author": F.transform("authors", item), "journal": F.array(item(F.col("journal")))}
    parts = [(field, kind, schema_field(field)) for field, kind in SCHEMA_FIELDS.items()] + [(None, kind, items) for kind, items in metadata.items()]
    every = F.array(*[F.struct(F.lit(n).alias("part"), F.lit(kind).alias("type"), F.lit(field).cast("string").alias("field"), F.coalesce(items, F.expr(f"cast(array() as array<{text}>)")).alias("items")) for n, (field, kind, items) in enumerate(parts)])
    # The JSON is read once for all fields, and not again for each use of one.
    read = papers.select("doi", "keywords", "authors", "journal", F.json_tuple("extraction", *SCHEMA_FIELDS).alias(*[f"_{c}" for c in SCHEMA_FIELDS]))
    rows = read.select("doi", F.explode(every).alias("p")).select("doi", "p.part", "p.type", "p.field", F.posexplode("p.items").alias("place", "x"))
    live = rows.select("doi", "part", "type", "field", "place", "x.surface", "x.span_start", "x.span_end").filter(F.coalesce("surface", F.lit("")) != "")
    named = canonical_names(live, aliases)
    first = F.min_by(F.struct("surface", "span_start", "span_end"), F.struct("part", "place"))
    return named.groupBy("doi", "canonical_id", "type", "field").agg(first.alias("f")).select("doi", "canonical_id", "type", "field", "f.surface", "f.span_start", "f.span_end", F.lit("schema").alias("source"))


#: What a recogniser's label contains and the entity type it stands for, in order.
NER_TYPES = {"DISEASE": "topic", "CONDITION": "topic", "METHOD": "method", "TECHNIQUE": "method"}


def ner_mentions(spans: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Mentions of recogniser spans (doi, text, label, start, end, confidence); other labels are dropped."""
    kind = F.coalesce(*[F.when(F.contains(F.upper("label"), F.lit(x)), F.lit(t)) for x, t in NER_TYPES.items()])
    typed = spans.select("doi", F.col("text").alias("surface"), kind.alias("type"), "start", "end", "confidence").filter("type IS NOT NULL")
    return canonical_names(typed, aliases).select("doi", "canonical_id", "type", F.lit("biobert").alias("source"), F.lit(None).cast("string").alias("field"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), "confidence")


#: The keys of a model's answer.
MODEL_ANSWER = "new_entities array<struct<surface:string,type:string,span_start:int,span_end:int>>, validations array<struct<surface:string,keep:boolean,reason:string>>"


def model_mentions(answers: DataFrame, aliases: DataFrame | None = None, confidence: float = 0.85) -> DataFrame:
    """Mentions of a model's answers (doi, answer JSON): its new entities with their spans (if both ends are given),
    and the surfaces it confirms, as materials without a span. Answers that are no JSON give none."""
    parsed = answers.select("doi", F.from_json("answer", MODEL_ANSWER).alias("a"))
    none = F.lit(None).cast("int")
    empty = F.expr("cast(array() as array<struct<surface:string,type:string,span_start:int,span_end:int>>)")
    # One list an answer, so that answers are made and parsed once.
    both = lambda x: x["span_start"].isNotNull() & x["span_end"].isNotNull()
    new = F.transform("a.new_entities", lambda x: F.struct(x["surface"].alias("surface"), x["type"].alias("type"), F.when(both(x), x["span_start"]).alias("span_start"), F.when(both(x), x["span_end"]).alias("span_end")))
    kept = F.transform(F.filter("a.validations", lambda x: x["keep"]), lambda x: F.struct(x["surface"].alias("surface"), F.lit("material").alias("type"), none.alias("span_start"), none.alias("span_end")))
    items = F.concat(F.coalesce(F.filter(new, lambda x: x["type"] != ""), empty), F.coalesce(kept, empty))
    live = parsed.select("doi", F.explode(items).alias("x")).select("doi", "x.*").filter("surface <> ''")
    return canonical_names(live, aliases).select("doi", "canonical_id", "type", F.lit("llm_cloud").alias("source"), F.lit(None).cast("string").alias("field"), "span_start", "span_end", F.lit(confidence).alias("confidence"))


def build_mentions(schema_mentions: DataFrame, spans: DataFrame, answers: DataFrame) -> DataFrame:
    """Mentions of all three makers, repeats dropped."""
    from bibliodyne.operators.relational import mentions_merge

    none = F.lit(None)
    first = schema_mentions.select("doi", F.col("canonical_id").cast("string").alias("canonical_id"), "type", "source", "field", none.cast("int").alias("span_start"), none.cast("int").alias("span_end"), F.lit(1.0).alias("confidence"))
    return mentions_merge(first, ner_mentions(spans), model_mentions(answers))


#: Extraction fields and the predicate each gives.
FIELD_PREDICATES = {"assumptions": "DEPENDS_ON", "future_work": "PROPOSES", "limitations": "LIMITED_BY", "novelty_statement": "INTRODUCES", "open_questions": "RAISES_QUESTION"}
TYPE_PRIORITY = ("method", "material", "topic", "keyword")


def relation_targets(wanted: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doi, surface, target_id): the mention of the same paper with that surface, by type priority."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPE_PRIORITY]), F.col("type"))
    typed = mentions.filter(F.col("type").isin(*TYPE_PRIORITY)).select("doi", F.lower("surface").alias("_s"), "canonical_id", rank.alias("r"))
    met = wanted.join(typed, (wanted["doi"] == typed["doi"]) & (F.lower(wanted["surface"]) == typed["_s"])).select(wanted["doi"], wanted["surface"], "canonical_id", "r")
    return met.groupBy("doi", "surface").agg(F.min_by("canonical_id", F.struct("r", "canonical_id")).alias("target_id"))


def relations_from_fields(fields: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations of extraction fields (doi, field, surface): (doi, predicate, target_id, target_kind)."""
    to = F.create_map(*[F.lit(x) for kv in FIELD_PREDICATES.items() for x in kv])
    rows = fields.withColumn("predicate", F.try_element_at(to, F.col("field"))).filter("predicate IS NOT NULL AND trim(surface) <> ''")
    targets = relation_targets(rows.select("doi", "surface").distinct(), mentions)
    return rows.join(targets, ["doi", "surface"]).select("doi", "predicate", "target_id", F.lit("Entity").alias("target_kind")).distinct()


def merge_relations(*parts: tuple[DataFrame, str]) -> DataFrame:
    """Relations of several makers side by side, told apart by prompt_version."""
    out = None
    for rows, version in parts:
        tagged = rows.withColumn("prompt_version", F.lit(version))
        out = tagged if out is None else out.unionByName(tagged)
    return out.dropDuplicates(["doi", "predicate", "target_id", "prompt_version"])


def compares_to(extractions: DataFrame, cites: DataFrame) -> DataFrame:
    """Papers whose comparison field is filled compare to what they cite."""
    live = extractions.filter(F.coalesce(F.trim("comparison_to_prior"), F.lit("")) != "").select("doi")
    return cites.join(live, cites["source"] == live["doi"], "left_semi").select(F.col("source").alias("doi"), F.lit("COMPARES_TO").alias("predicate"), F.col("target").alias("target_id")).distinct()


#: The relation vocabulary.
PREDICATES = ("DEPENDS_ON", "PROPOSES", "LIMITED_BY", "INTRODUCES", "RAISES_QUESTION", "CITES", "EXTENDS", "CONTRADICTS", "COMPARES_TO", "MENTIONS")


def valid_relations(relations: DataFrame) -> DataFrame:
    filled = (F.coalesce(F.trim("source_doi"), F.lit("")) != "") & (F.coalesce(F.trim("target_id"), F.lit("")) != "")
    return relations.filter(filled & F.col("predicate").isin(*PREDICATES) & F.col("target_kind").isin("Entity", "Paper"))


#: Characters of evidence kept with a relation.
EVIDENCE = 200


def judge_triples(triples: DataFrame, per_paper: int = 25) -> DataFrame:
    """Adds ``reject`` to model-made triples (doi, pos, subject, predicate, object, kind, confidence): null
    for the accepted ones, of which each paper keeps the first ``per_paper``. An ``evidence`` column is cut to
    200 characters at a word."""
    paper = F.col("predicate").isin("EXTENDS", "CONTRADICTS", "COMPARES_TO") & (F.col("kind") == "Paper")
    target = F.regexp_replace(F.trim("object"), r"[.,;:)\]}]+$", "")
    reason = (
        F.when(F.lower(F.trim("subject")) != F.lower(F.trim("doi")), "subject").when(~F.col("predicate").isin(*PREDICATES), "predicate").when(F.coalesce(F.trim("object"), F.lit("")) == "", "object")
        .when(~F.col("kind").isin("Entity", "Paper"), "kind").when(paper & ~target.rlike(r"^10\.\d+/\S+$"), "not a doi").when(~F.col("confidence").between(0.5, 1.0) | F.col("confidence").isNull(), "confidence")
    )
    judged = triples.withColumn("reject", reason).withColumn("object", F.when(paper, target).otherwise(F.trim("object")))
    if "evidence" in triples.columns:
        cut = F.regexp_replace(F.substring("evidence", 1, EVIDENCE), r" [^ ]*$", "")
        judged = judged.withColumn("evidence", F.when(F.length("evidence") > EVIDENCE, F.concat(cut, F.lit("…"))).otherwise(F.coalesce("evidence", F.lit(""))))
    place = F.row_number().over(W.partitionBy("doi", F.col("reject").isNull()).orderBy("pos"))
    return judged.withColumn("reject", F.when(F.col("reject").isNull() & (place > per_paper), "too many").otherwise(F.col("reject")))


def graph_rebuild(papers: DataFrame, mentions: DataFrame, cites: DataFrame) -> dict[str, DataFrame]:
    """All graph tables anew from papers, mentions and citations of known papers. Mentions are told apart in tasks that hold
    some papers each, and their number follows the mentions."""
    doi = papers.select("doi").distinct()
    known = dealt(mentions.join(doi, "doi", "left_semi"), mentions.count(), "doi")
    return {
        "graph_papers": papers.dropDuplicates(["doi"]),
        "mentions": known.dropDuplicates(["doi", "canonical_id", "field"]),
        "relations": cites.join(doi.withColumnRenamed("doi", "source"), "source", "left_semi").join(doi.withColumnRenamed("doi", "target"), "target", "left_semi").distinct(),
    }
