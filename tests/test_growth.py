"""Queries that have to keep to their limits on larger tables, and do their whole job."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from bibliodyne.operators import fuzzy as Z
from bibliodyne.operators import graph as G
from bibliodyne.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unmapped_keywords_meet_the_whole_vocabulary(spark):
    names = duckdb.sql(f"select p_partkey, p_name from '{SF}/part.parquet'").fetchall()
    known = {name for key, name in names if key % 4 == 0}
    assert {r.keyword for r in catalog.QUERIES["jn_unmapped"](spark, SF).collect()} == {name for _, name in names} - known


def test_renames_are_not_broadcast(spark):
    entities = spark.createDataFrame([("a", "A"), ("b", "B")], "canonical_id string, surface string")
    mentions = spark.createDataFrame([("p", "a"), ("q", None)], "doi string, canonical_id string")
    relations = spark.createDataFrame([("p", "CITES", "a")], "doi string, predicate string, target_id string")
    renames = spark.createDataFrame([("a", "b")], "old string, new string")
    out = Z.fold_renamed(entities, mentions, relations, renames)
    assert "Broadcast" not in plan(Z.final_names(renames)) and not any("Broadcast" in plan(df) for df in out.values())
    assert {tuple(r) for r in out["mentions"].collect()} == {("p", "b"), ("q", None)}


def some_mentions(spark):
    return spark.range(200).selectExpr("concat('d', id % 37) as doi", "id % 11 as canonical_id", "concat('f', id % 2) as field").union(spark.sql("select 'd1', 3L, null"))


def test_tasks_of_papers_by_entities_follow_the_mentions(spark, monkeypatch):
    monkeypatch.setattr("bibliodyne.session.TASK_ROWS", 20)
    mentions = some_mentions(spark)
    wanted = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2), (None, 3)], "query_id string, canonical_id long")
    got = G.papers_by_entities(mentions, wanted)
    assert got.rdd.getNumPartitions() == 11  # 201 mentions
    edges = {(r.doi, r.canonical_id) for r in mentions.collect()}
    want = {}
    for q, e in {("a", 1), ("a", 2), ("b", 2), (None, 3)}:
        for d in {d for d, x in edges if x == e}:
            want[q, d] = want.get((q, d), 0) + 1
    assert {(r.query_id, r.doi): r.n_shared for r in got.collect()} == want


def test_tasks_of_a_rebuilt_graph_follow_the_mentions(spark, monkeypatch):
    monkeypatch.setattr("bibliodyne.session.TASK_ROWS", 20)
    mentions = some_mentions(spark)
    papers = spark.range(20).selectExpr("concat('d', id) as doi")
    cites = spark.createDataFrame([("d1", "d2"), ("d1", "d99")], "source string, target string")
    out = G.graph_rebuild(papers, mentions, cites)
    assert out["mentions"].rdd.getNumPartitions() == 11
    want = {(r.doi, r.canonical_id, r.field) for r in mentions.collect() if int(r.doi[1:]) < 20}
    got = [tuple(r) for r in out["mentions"].collect()]
    assert set(got) == want and len(got) == len(want) and {tuple(sorted(r)) for r in out["relations"].collect()} == {("d1", "d2")}


def test_similar_papers_of_seeds_read_what_seeds_mention(spark, monkeypatch):
    import bibliodyne.session as session

    kept, write = {}, session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    mentions = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), ("x", 8), ("y", 8), ("y", 9), ("x", 9)], "doi string, canonical_id long")
    got = {tuple(r) for r in G.similar_papers(mentions, 4, spark.createDataFrame([("a",)], "doi string")).collect()}
    assert got == {("a", "b", 2, 1), ("a", "c", 1, 2)} and {r.doi for r in kept["papers"].collect()} == {"a", "b", "c"}


def test_pairs_of_two_papers_are_settled_without_a_join(spark, monkeypatch):
    import bibliodyne.session as session

    kept, write = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, name: kept.append(name) or write(df, name))
    mentions = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2)], "doi string, canonical_id long")
    got = {tuple(r) for r in G.similar_papers(mentions, 4).collect()}
    assert got == {("a", "b", 2, 1), ("a", "c", 1, 2), ("b", "a", 2, 1), ("b", "c", 1, 2), ("c", "a", 1, 1), ("c", "b", 1, 2)} and "paper-pairs" not in kept


def test_a_block_of_neighbours_is_compared_in_slabs():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from bibliodyne.operators import vectors as V

    x = np.random.default_rng(3).normal(size=(5000, 8))
    rows = pd.DataFrame({"l_doi": [f"d{i}" for i in range(4000)], "l_v": list(x[:4000])})
    asked = pd.DataFrame({"q_doi": [f"d{i}" for i in range(3900, 4900)], "q_v": list(x[3900:4900])})
    tracemalloc.start()
    got = V.best_of(rows, asked, 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # all products at once are 32 MB, and a copy each of them
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for n in (3900, 3999, 4000, 4899):
        want = sorted((-round(float((u[j] * u[n]).sum()), 4), f"d{j}") for j in range(4000) if j != n)[:5]
        assert [(-r.score, r.doi) for r in got[got["query"] == f"d{n}"].itertuples()] == want


def test_answers_and_extractions_are_read_once(spark):
    answers = spark.createDataFrame([("p", '{"new_entities": [{"surface": "Resins", "type": "topic", "span_start": 1, "span_end": 7}], "validations": null}'), ("q", '{"validations": [{"surface": "Gels.", "keep": true}, {"surface": "x", "keep": null}]}'), ("r", None)], "doi string, answer string")
    made = G.model_mentions(answers)
    assert plan(made).count("ArrowEvalPython") == 1 and plan(made).count("Generate explode") == 1
    assert {(r.doi, r.canonical_id, r.type, r.span_start) for r in made.collect()} == {("p", "resin", "topic", 1), ("q", "gel", "material", None)}
    papers = spark.createDataFrame([("p", '{"methods_summary": "Assays", "discovered_topics": ["PCR"]}', ["k"], None, None), ("q", "{bad", None, ["A"], "J"), ("r", None, None, None, "K")], "doi string, extraction string, keywords array<string>, authors array<string>, journal string")
    found = G.extract_entities(papers)
    assert plan(found).count("json_tuple") == 1 and "get_json_object" not in plan(found)
    assert {(r.doi, r.type, r.canonical_id) for r in found.collect()} == {("p", "method", "assay"), ("p", "topic", "pcr"), ("p", "keyword", "k"), ("q", "author", "a"), ("q", "journal", "j"), ("r", "journal", "k")}


def test_tasks_of_the_neighbourhood_follow_the_mentions(spark, monkeypatch):
    monkeypatch.setattr("bibliodyne.session.TASK_ROWS", 20)
    mentions = some_mentions(spark).select("doi", "canonical_id")
    tasks = -(-4 * mentions.count() // 20)
    out = G.neighborhood(mentions, mentions.select("canonical_id").distinct(), 3)
    assert plan(out).count(f", {tasks}), REPARTITION_BY_NUM") == 2
    rows, pairs = [tuple(r) for r in mentions.collect()], {}
    for d, a in rows:
        for e, b in rows:
            if d == e and a != b:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    want = {(a, b, n, p) for x in {a for a, _ in pairs} for p, (a, b, n) in enumerate(sorted(((a, b, n) for (a, b), n in pairs.items() if a == x), key=lambda t: (-t[2], t[1]))[:3], 1)}
    assert {(r.canonical_id, r.other, r.n_paths, r.place) for r in out.collect()} == want


def test_references_are_resolved_in_steps_that_run_once(spark):
    citations = spark.createDataFrame([("p", "[1]"), ("p", "Smith & Jones (2002)"), ("p", "Nobody 1951"), (None, "[1]")], "doi string, ref_id string")
    references = spark.createDataFrame([("p", 1, "x", "Adams", 2001), ("p", 2, "y", "Smith", 2002)], "doi string, pos int, ref_doi string, surname string, year int")
    out = Z.resolve_references(citations, references)
    # No step reads the input, or what comes before it, again.
    assert "ExistingRDD" not in plan(out) and "LocalTableScan" not in plan(out) and "Python" not in plan(out)
    assert {(r.doi, r.ref_id): (r.target, r.resolution) for r in out.collect()} == {("p", "[1]"): ("x", "numeric"), ("p", "Smith & Jones (2002)"): ("y", "fuzzy"), ("p", "Nobody 1951"): (None, "unresolved"), (None, "[1]"): (None, "unresolved")}


def test_the_breakdown_finds_its_signals_once(spark):
    out = catalog.QUERIES["rank_breakdown"](spark, SF)
    assert "testdata" not in plan(out) and out.count() == catalog.QUERIES["rank_graph_leg"](spark, SF).count()


def test_queries_of_many_small_cells_are_sent_to_bins_of_them(spark, monkeypatch):
    from bibliodyne.operators import neighbours as N
    from bibliodyne.operators.vectors import knn

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"d{i}", rng.normal(size=8).tolist()) for i in range(600)], "doi string, embedding array<double>")
    asked = rows.limit(100)
    index = N.build_index(rows, 20)
    sent, searched = [], N._searched

    def counted(index, asked, k, exclude_self):
        near = searched(index, asked, k, exclude_self)
        sent.append((asked.count(), near.count()))
        return near

    monkeypatch.setattr(N, "_searched", counted)
    found = sorted(map(tuple, N.search(index, asked, 5).select("query", "doi", "score", "rank").collect()))
    assert found == sorted(map(tuple, knn(asked, rows, 5).select("query", "doi", "score", "rank").collect()))
    # All 20 cells are probed, in 4 to 8 bins; behind the nearest only rows that may be among the 5 are written.
    assert sent[0] == (100, 500) and sent[1][0] <= 700 and sent[1][1] < 0.6 * 5 * sent[1][0]
