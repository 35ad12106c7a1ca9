"""Paths that keep work in proportion: indexed neighbours, bounded overlap, keyed fuzzy joins, ordered blocks, buckets, commit logs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliodyne.functions import text as T
from bibliodyne.operators import fuzzy as Z
from bibliodyne.operators import graph as G
from bibliodyne.operators import neighbours as N
from bibliodyne.operators import vectors as V
from bibliodyne.session import shared_path
from bibliodyne.sources import readers as R
from bibliodyne.sources.buckets import BucketTable
from bibliodyne.streaming import commit_log as C


# ---------------------------------------------------------------- neighbours

def test_index_finds_neighbours_with_less_work(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    v = [[float(x) for x in centres[i % 30] + rng.normal(0, 0.25, 16)] for i in range(1500)]
    v[7], v[8], v[9], v[11] = [0.0] * 16, [float("nan")] * 16, [1.0] * 4, v[10]
    rows = spark.createDataFrame([(f"d{i:04d}", x) for i, x in enumerate(v)] + [("none", None)], "doi string, embedding array<float>")
    asked = rows.filter("doi like '%3' or doi like '%9'")
    index = N.tuned(N.build_index(rows), asked, 10)
    exact = {(r.query, r.doi): r.score for r in V.knn(asked, rows, 10).collect()}
    found = {(r.query, r.doi): r.score for r in N.search(index, asked, 10).collect()}
    assert len(set(found) & set(exact)) >= 0.95 * len(exact) and all(exact[p] == s for p, s in found.items() if p in exact)
    assert N.compared(index, asked) < 0.5 * 300 * 1497 and index.rows.count() == 1497
    path = shared_path(spark, "index")
    index.write(path)
    again = N.search(N.read_index(spark, path), asked, 10)
    assert {(r.query, r.doi): r.score for r in again.collect()} == found
    # With all cells probed the search is the exact one.
    every = N.search(N.build_index(rows, 5), asked, 10)
    assert {tuple(r) for r in every.collect()} == {tuple(r) for r in V.knn(asked, rows, 10).collect()}
    assert N.search(N.build_index(rows.limit(0)), asked, 10).count() == 0


def test_a_large_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 7)
    same = [(f"s{i:03d}", [1.0, 0.0, 0.0]) for i in range(300)] + [(f"t{i:03d}", [0.0, 1.0, float(i)]) for i in range(100)]
    rows = spark.createDataFrame(same, "doi string, embedding array<float>")
    index = N.build_index(rows, 4)
    assert index.rows.groupBy("cell", "block").count().agg(F.max("count")).first()[0] <= 100
    assert {tuple(r) for r in N.search(index, rows.limit(40), 5).collect()} == {tuple(r) for r in V.knn(rows.limit(40), rows, 5).collect()}


# ---------------------------------------------------------------- papers with entities in common

def brute_similar(edges, k):
    by = {}
    for d, e in set(edges):
        by.setdefault(d, set()).add(e)
    out = set()
    for d in by:
        near = sorted((-len(by[d] & by[o]), o) for o in by if o != d and by[d] & by[o])[:k]
        out |= {(d, o, -n, r) for r, (n, o) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize(("wide", "meeting"), [(64, 2048), (5, 4)])
def test_similar_papers_equal_brute_force(spark, monkeypatch, wide, meeting):
    monkeypatch.setattr(G, "WIDE", wide)
    monkeypatch.setattr(G, "MEETING", meeting)
    rng = random.Random(wide)
    edges = [(f"d{rng.randrange(90)}", int(rng.paretovariate(0.7)) % 60) for _ in range(500)] + [(f"d{i}", -1) for i in range(45)] + [(f"d{i}", -2) for i in range(20, 40)]
    df = spark.createDataFrame([*edges, edges[0], (None, 1), ("x", None)], "doi string, canonical_id long")
    assert {tuple(r) for r in G.similar_papers(df, 4).collect()} == brute_similar(edges, 4)
    seeds = spark.createDataFrame([("d1",), ("d2",), ("none",)], "doi string")
    assert {tuple(r) for r in G.similar_papers(df, 4, seeds).collect()} == {x for x in brute_similar(edges, 4) if x[0] in ("d1", "d2")}


# ---------------------------------------------------------------- fuzzy matching

@pytest.mark.parametrize("least", [60.0, 72.0, 75.0, 80.0, 85.0, 90.0])
def test_keyed_join_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(Z, "MEETING", 3)
    rng = random.Random(int(least))
    names = set()
    for _ in range(25):
        base = "".join(rng.choices("abcdeé ", k=rng.choice([1, 2, 3, 5, 8, 12, 20, 45])))
        names.add(base)
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 3))):
                if rng.random() < 0.5 and t:
                    t.pop(rng.randrange(len(t)))
                else:
                    t.insert(rng.randint(0, len(t)), rng.choice("abcdeé "))
            names.add("".join(t))
    names = sorted(names)
    want = {(a, b) for a, b in itertools.combinations(names, 2) if T.indel_ratio(a, b) >= least}
    one = lambda c, some: spark.createDataFrame([(x,) for x in some], f"{c} string")
    assert {(r.a, r.b) for r in Z.fuzzy_pairs(one("a", names), one("b", names), least, same=True).collect()} == want
    left, right = names[::2] + [None], names[1::3] + names[:3] + ["", None]
    got = {(r.a, r.b) for r in Z.fuzzy_pairs(one("a", left), one("b", right), least).collect()}
    assert got == {(a, b) for a in left for b in right if a is not None and b is not None and T.indel_ratio(a, b) >= least}


def test_long_names_meet_by_few_keys():
    """A title of 120 letters has a bounded number of keys, and keeps one with a similar title."""
    rng = random.Random(4)
    a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=120))
    b = "".join(c for i, c in enumerate(a) if i % 4)
    numbered = lambda x: [f"1{c}{x[: i + 1].count(c)}" for i, c in enumerate(x)] + [f"2{x[i : i + 2]}{sum(x[j : j + 2] == x[i : i + 2] for j in range(i + 1))}" for i in range(len(x) - 1)]
    x, y = (set(Z._signature(sorted(numbered(t)), 80.0)) for t in (a, b))
    assert T.indel_ratio(a, b) >= 80 and x & y and max(len(x), len(y)) < 8 * Z.MOST_KEYS


def greedy(names, links, order):
    reps, out = [], {}
    for t in sorted(names, key=order):
        best = max(((links[t, r], -i) for i, r in enumerate(reps) if (t, r) in links), default=None)
        out[t] = t if best is None else reps[-best[1]]
        if best is None:
            reps.append(t)
    return out


@pytest.mark.parametrize("rounds", [1, 3, 24])
def test_ordered_choice_in_rounds_and_blocks_equals_one_pass(spark, monkeypatch, rounds):
    monkeypatch.setattr(Z, "BLOCK_LINKS", 40)
    rng = random.Random(rounds)
    names = [f"n{i:03d}" for i in range(160)]
    pairs = {(names[i], names[i + 1]) for i in range(99)} | {(names[i], names[i + 2]) for i in range(0, 90, 3)} | {tuple(sorted(rng.sample(names[100:], 2))) for _ in range(80)}
    rows = [(a, b, float(rng.randint(80, 99))) for a, b in sorted(pairs)]
    links = {(a, b): r for a, b, r in rows} | {(b, a): r for a, b, r in rows}
    ranked = spark.createDataFrame([(n, n[::-1]) for n in names], "term string, o string")
    got = {r.term: r.representative for r in Z._decided(ranked, spark.createDataFrame(rows, "a string, b string, ratio double"), False, rounds).collect()}
    assert got == greedy(names, links, lambda t: (t[::-1], t))


def test_a_chain_of_names_settles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(Z, "BLOCK_LINKS", 30_000)
    n = 100_000
    ranked = spark.range(n).selectExpr("lpad(id, 6, '0') as term", "lpad(id, 6, '0') as o")
    links = spark.range(1, n).selectExpr("lpad(id, 6, '0') as term", "lpad(id - 1, 6, '0') as earlier")
    found = Z.representatives(ranked, links, rounds=3)
    assert found.agg(F.count("*"), F.count_distinct("term"), F.count_if(F.col("rep") == (F.col("term").cast("int") % 2 == 0))).first()[:] == (n, n, n)


# ---------------------------------------------------------------- renames

def test_renames_end_at_the_newest_name_or_a_cycles_least(spark):
    kind = "old string, new string"
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    rows = [*chain, ("x", "y"), ("y", "z"), ("z", "x"), ("tail", "y"), ("long", "tail"), ("twice", "q"), ("twice", "p"), ("self", "self"), (None, "a"), ("a", None)]
    got = {r.old: r.new for r in Z.final_names(spark.createDataFrame(rows, kind)).collect()}
    assert got == {a: "c150" for a, _ in chain} | {"y": "x", "z": "x", "tail": "x", "long": "x", "twice": "p"}
    assert Z.final_names(spark.createDataFrame([], kind)).count() == 0


def test_folding_leaves_no_edge_on_a_dead_id(spark):
    entities = spark.createDataFrame([("a", "topic", "A"), ("b", "topic", "B"), ("c", "topic", "C"), ("d", "topic", "D")], "canonical_id string, type string, surface string")
    mentions = spark.createDataFrame([("p", "a", "f", 0.5), ("p", "b", "f", 0.9), ("p", "c", "g", 0.1), ("q", "d", None, 0.2), ("q", "c", None, 0.3)], "doi string, canonical_id string, field string, confidence double")
    relations = spark.createDataFrame([("p", "PROPOSES", "a", "Entity"), ("p", "PROPOSES", "b", "Entity"), ("p", "CITES", "a", "Paper")], "doi string, predicate string, target_id string, target_kind string")
    out = Z.fold_renamed(entities, mentions, relations, spark.createDataFrame([("a", "b"), ("b", "c")], "old string, new string"), F.desc("confidence"))
    assert {tuple(r) for r in out["entities"].collect()} == {("c", "topic", "C"), ("d", "topic", "D")}
    assert {tuple(r) for r in out["mentions"].collect()} == {("p", "c", "f", 0.9), ("p", "c", "g", 0.1), ("q", "d", None, 0.2), ("q", "c", None, 0.3)}
    assert {tuple(r) for r in out["relations"].collect()} == {("p", "PROPOSES", "c", "Entity"), ("p", "CITES", "a", "Paper")}


# ---------------------------------------------------------------- bucketed tables

def test_a_small_write_touches_its_buckets_only(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("id as k", "concat('t', id) as title", "cast(null as string) as journal")
    table = BucketTable.create(rows, shared_path(spark, "buckets"), ["k"], 256)
    before = table._manifest()[1]["folders"]
    batch = spark.createDataFrame([(5, None, "j5", 1), (5, "new5", None, 2), (n + 1, "born", None, 1), (7, "seven", None, 1)], "k long, title string, journal string, o int")
    assert table.upsert(batch, F.col("o")) <= 3
    after = table._manifest()[1]["folders"]
    moved = {b for b in before if before[b] != after[b]}
    assert len(moved) <= 3
    got = {r.k: (r.title, r.journal) for r in table.read().filter(f"k in (5, 6, 7, {n + 1})").collect()}
    assert got == {5: ("new5", "j5"), 6: ("t6", None), 7: ("seven", None), n + 1: ("born", None)} and table.read().count() == n + 1
    assert table.lookup(spark.createDataFrame([(5,), (n + 9,)], "k long")).count() == 1
    again = table.read().collect()
    table.upsert(batch, F.col("o"))
    assert sorted(table.read().collect()) == sorted(again)
    # The touched files alone are read, and the table's side is not shuffled.
    current = table._bucketed(table._rows(table._manifest()[1], [int(b) for b in moved]), table._manifest()[1])
    assert {f.split('_bucket=')[1].split('/')[0] for f in current.inputFiles()} <= moved
    plan = current.join(F.broadcast(batch.drop("o")), ["k"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert table.drop_unused() >= 1 and table.read().count() == n + 1


def test_a_crashed_write_leaves_the_table(spark, monkeypatch):
    from bibliodyne.sources import buckets

    table = BucketTable.create(spark.range(100).selectExpr("id as k", "'old' as v"), shared_path(spark, "buckets"), ["k"], 8)
    batch = spark.range(50, 150).selectExpr("id as k", "'new' as v", "1 as o")

    def fails(*_, **__):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(buckets, "publish", fails)
        with pytest.raises(OSError):
            table.upsert(batch, F.col("o"))
    assert table.read().groupBy("v").count().collect()[0][:] == ("old", 100)
    number, manifest = table._manifest()
    table.upsert(batch, F.col("o"))
    assert {r.v: r["count"] for r in table.read().groupBy("v").count().collect()} == {"old": 50, "new": 100}
    with pytest.raises(RuntimeError):  # a writer that read the older manifest
        table._commit(number, manifest, table._bucketed(batch.drop("o"), manifest), [0], keep=False)


def test_inserts_append_and_are_compacted(spark):
    table = BucketTable.create(spark.createDataFrame([("a", 1, "x")], "doi string, e int, source string"), shared_path(spark, "buckets"), ["doi", "e"], 4)
    for i in range(4):
        table.insert_absent(spark.createDataFrame([("a", 1, "late"), ("b", i, "z"), ("b", i, "y")], "doi string, e int, source string"), [F.col("source")])
    want = {("a", 1, "x")} | {("b", i, "y") for i in range(4)}
    assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == 5
    table.compact(1)
    assert all(len(p) == 1 for p in table._manifest()[1]["folders"].values()) and {tuple(r) for r in table.read().collect()} == want
    table.replace(spark.createDataFrame([("b", 2, "p"), ("b", 2, "q"), ("c", 9, "n")], "doi string, e int, source string"))
    assert {tuple(r) for r in table.read().collect()} == want - {("b", 2, "y")} | {("b", 2, "p"), ("b", 2, "q"), ("c", 9, "n")}


# ---------------------------------------------------------------- commit log

def test_a_crash_between_the_writes_is_replayed_once(spark):
    root, folder = shared_path(spark, "log"), shared_path(spark, "papers")
    rows = spark.createDataFrame([(f"d{i}", "t") for i in range(6)], "doi string, title string").repartition(1)
    rows.write.parquet(folder)
    pull = lambda: spark.readStream.schema("doi string, title string").parquet(folder)
    calls = []

    def dies(batch):
        raise KeyboardInterrupt  # not an exception that the graph's write may swallow

    def graph(batch):
        calls.append(batch.count())
        return batch.select("doi", F.lit("g").alias("g"))

    # The first batch of the stream, as far as a killed driver came with it.
    with pytest.raises(KeyboardInterrupt):
        C.index_batch(rows, 0, root, lambda b: b, dies)
    assert {tuple(r) for r in C.flags(spark, root).collect()} == {(f"d{i}", True, False) for i in range(6)}
    assert C.complete_batches(spark, root, "text") == [0] and C.complete_batches(spark, root, "graph") == []
    C.index_stream(pull(), root, lambda b: b, graph)
    C.index_stream(pull(), root, lambda b: b, graph)
    assert {tuple(r) for r in C.flags(spark, root).collect()} == {(f"d{i}", True, True) for i in range(6)} and calls == [6]
    assert C.indexed(spark, root, "text").count() == 6 and C.indexed(spark, root, "graph").count() == 6


def test_a_failed_graph_write_leaves_its_batch_open_until_repaired(spark):
    root = shared_path(spark, "log")
    papers = spark.createDataFrame([("a", "t"), ("b", "t")], "doi string, title string")

    def fails(batch):
        raise OSError("no graph")

    C.index_batch(papers, 0, root, lambda b: b, fails)
    C.index_batch(papers.filter("doi = 'b'").withColumn("title", F.lit("t2")), 1, root, lambda b: b, lambda b: b.select("doi"))
    assert {tuple(r) for r in C.flags(spark, root).collect()} == {("a", True, False), ("b", True, True)}
    assert {(r.doi, r.title) for r in C.indexed(spark, root, "text").collect()} == {("a", "t"), ("b", "t2")}
    assert C.repair_graph(papers, root, lambda b: b.select("doi")) == [0]
    assert C.flags(spark, root).filter("graph_indexed").count() == 2


def test_polling_takes_what_is_newer_than_the_baseline(spark):
    root, folder = shared_path(spark, "poll"), shared_path(spark, "items")
    pull = lambda: spark.readStream.schema("id int, version int").parquet(folder)
    put = lambda rows: spark.createDataFrame(rows, "id int, version int").write.mode("append").parquet(folder)
    put([(1, 3), (2, 5)])
    assert C.poll_stream(pull(), root) is None
    assert C.poll_stream(pull(), root).count() == 0
    put([(3, 4), (4, 6)])
    put([(5, 9)])
    assert {r.id for r in C.poll_stream(pull(), root).collect()} == {4, 5} and {r.id for r in C.poll_stream(pull(), root).collect()} == {4, 5}


# ---------------------------------------------------------------- provider rows, normal form, gate

def test_provider_rows(spark):
    hits = spark.createDataFrame([(" https://doi.org/10.1/AB/ ", None, ["A ", " ", None], "2020-01-02", None, None, None, ["db"])], "doi string, title string, authors array<string>, publication_date string, journal string, abstract string, keywords array<string>, databases array<string>")
    assert R.candidates(hits).first()[:] == ("10.1/ab", "", ["A"], 2020, "", "", [], ["db"], False)
    s2 = spark.createDataFrame([("i", "T", 2020, {"DOI": "10.1/X"}, None, None, None, [("n",), ("",), (None,)], 0.5)], R.S2)
    row = R.s2_results(s2).first()
    assert (row.doi, row.authors, row.journal, row.abstract, row.keywords) == ("10.1/x", ["n"], "", "", [])


def test_normal_form_strips_what_ends_the_string(spark):
    rows = spark.createDataFrame([("abc. ",), ("Antibodies.",), ("antibodies .;",), (" x  ys ",)], "surface string")
    assert {r.surface: r.n for r in T.basic_normalize(rows, "surface", "n").collect()} == {"abc. ": "abc.", "Antibodies.": "antibody", "antibodies .;": "antibody", " x  ys ": "x ys"}


def test_gate_by_containment(spark):
    authors = spark.createDataFrame([("p", "Ann Bee; Carl Dee"), ("q", "ann bee"), ("r", "Zed")], "doi string, author string")
    mentions = spark.createDataFrame([("p", "e1"), ("p", "e2"), ("q", "e1"), ("r", "e9")], "doi string, canonical_id string")
    topics = spark.createDataFrame([("e1",), ("e2",)], "canonical_id string")
    names = spark.createDataFrame([("Ann Bee",), ("Dee",), ("Zed",), ("Nobody",), ("ann",)], "author string")
    gate = lambda least: {r.author for r in G.researcher_gate(authors, mentions, topics, least, names).collect()}
    assert gate(1) == {"Ann Bee", "Dee", "ann"} and gate(2) == {"Ann Bee", "Dee"} and len(gate(0)) == 5
    assert G.researcher_gate(authors, mentions, topics.limit(0), 1, names).count() == 5
