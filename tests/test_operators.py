"""Operators on small fixtures: formulas, ties, null traps, and brute-force versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliodyne.functions import models as M
from bibliodyne.functions import scalar as S
from bibliodyne.functions import text as T
from bibliodyne.operators import fuzzy as Z
from bibliodyne.operators import graph as G
from bibliodyne.operators import quality as Q
from bibliodyne.operators import relational as R
from bibliodyne.operators import vectors as V
from bibliodyne.session import shared_path
from bibliodyne.sources import sinks as K
from bibliodyne.streaming import incremental as I


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---------------------------------------------------------------- columns

@pytest.mark.parametrize(("raw", "want"), [
    ("10.1/AbC", "10.1/abc"), ("https://doi.org/10.1/x/", "10.1/x"), ("  DOI: 10.1/x ", "10.1/x"), ("http://dx.doi.org/10.1/X//", "10.1/x"), ("", ""), (None, ""), (" \t\n", ""),
])
def test_normalize_doi(spark, raw, want):
    assert one(spark, S.normalize_doi(F.lit(raw).cast("string"))) == want


def test_decay_gate_growth(spark):
    now = F.lit("2024-04-01").cast("timestamp_ntz")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    assert one(spark, S.time_decay(now, now)) == 1.0
    assert abs(one(spark, S.time_decay(at("2024-01-02"), now)) - 0.5) < 1e-12
    assert one(spark, S.time_decay(at("2025-01-01"), now)) == 1.0 and one(spark, S.time_decay(at(None), now)) == 1.0
    assert one(spark, S.soft_gate(F.lit(9))) == 0 and one(spark, S.soft_gate(F.lit(10))) == 0.25
    assert one(spark, S.growth_rate(F.lit(20), F.lit(5))) == 3.0 and one(spark, S.growth_rate(F.lit(5), F.lit(0))) == 4.0


def test_authors_and_json(spark):
    a = lambda s: one(spark, S.parse_authors(F.lit(s)))
    assert a('["Ann B", " ", {"lastName": "Cee", "firstName": "D"}, {"last": "E"}]') == ["Ann B", "Cee, D", "E"]
    assert a("{bad") is None or a("{bad") == []
    assert one(spark, S.parse_json_strings(F.lit('[" a", 1, null, "", {"b": 2}, "c"]'))) == ["a", "c"]
    assert one(spark, S.parse_year(F.lit("2020-01"))) == 2020 and one(spark, S.parse_year(F.lit("spring"))) == 0
    assert one(spark, S.overall_confidence(F.lit('{"_overall_confidence": 0.4}'))) == 0.4 and one(spark, S.overall_confidence(F.lit("{x"))) is None


def test_strip_tail_matches_only_line_starts(spark):
    body = "word " * 60
    cut = lambda t: one(spark, S.strip_references(F.lit(t)))
    assert cut(body + "\n## References\n[1] x") == body.rstrip()
    assert cut(body + "see References\nmore").endswith("more")
    assert cut("## References\n" + body) == "## References\n" + body and cut(body + "\nCited Works :\n[1]") == body.rstrip()
    assert cut(body + "\n**References**\n[1]").endswith("[1]") and cut(body + "\n#### Citations\nx").endswith("x")
    end = lambda t: one(spark, S.strip_end_matter(F.lit(t)))
    for heading in ("Acknowledgments", "Funding information:", "## Conflict of Interest", "Competing interests", "Author contributions", "Data availability statement", "Code availability", "Supplementary data", "SUPPORTING INFORMATION"):
        assert end(body + "\n" + heading + "\nx y") == body.rstrip()
    assert end(body + "\nAppendix\nx ") == body + "\nAppendix\nx "
    assert cut("") == ""


def test_excerpt_and_confidence(spark):
    assert one(spark, S.excerpt(F.lit("abc"))) == "abc"
    long = "word " * 60
    cut = one(spark, S.excerpt(F.lit(long)))
    assert cut.endswith("word…") and len(cut) <= 201
    fields = F.create_map(*[F.lit(x) for x in ("a_confidence", "explicit", "b_confidence", "inferred", "c", "explicit")])
    assert one(spark, S.confidence_score(fields)) == 0.75


# ---------------------------------------------------------------- text

def test_chunks_slice_back_and_keep_bounds():
    text = "## One\n\nSame line.\n\n" + "A sentence about Fig. 3 that runs on. " * 30 + "\n\n## Two\n\nSame line.\n\n" + "Another one here. " * 30 + "x" * 3000
    found = T.chunks_of(text)
    assert all(0 < e - s <= 1120 for s, e, _ in found) and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    assert {h for *_, h in found} == {"## One", "## Two"} and T.chunks_of("") == [] and T.chunks_of(None) == [] and T.chunks_of(" \n ") == []
    bare = lambda t: "".join(t.replace("## One", "").replace("## Two", "").split())
    assert "".join(bare(text[s:e]) for s, e, _ in found) == bare(text)


def test_chunk_rules():
    # A digit starts no sentence, a lower-case letter does; short sections merge up to half the limit.
    long = "See Fig. 3 for it. " * 80
    assert all(text[e - 1] == "." for text in [long] for s, e, _ in T.chunks_of(long, 200)) and all(not long[s:e].startswith("3") for s, e, _ in T.chunks_of(long, 200))
    assert T.chunks_of("ab. cd", 4) == [(0, 3, ""), (4, 6, "")] and T.chunks_of("abcdefg", 3) == [(0, 3, ""), (3, 6, ""), (6, 7, "")]
    assert T.chunks_of("# A\nxx\n# B\nyyy", 20) == [(4, 14, "# B")] and T.chunks_of("# A\nxx\n# B\nyyy", 8) == [(4, 6, "# A"), (11, 14, "# B")]
    assert T.chunks_of("para one\n\npara two\n\npara three", 18) == [(0, 18, ""), (20, 30, "")]


def test_windows_join_up():
    text = ("line one\nline two\n\n" * 200) + "z" * 900
    parts = T.windows_of(text, 1000)
    assert "".join(parts) == text and all(len(p) <= 1000 for p in parts) and parts[0].endswith("\n\n") and T.windows_of("", 10) == []


def test_basic_normalize(spark):
    rows = spark.createDataFrame([("β-Catenins.",), ("Naïve  Bayes",), ("Analyses",), ("Species",), (None,)], "surface string")
    got = {r.surface: r.normalized for r in T.basic_normalize(rows, "surface").collect()}
    assert got == {"β-Catenins.": "b-catenin", "Naïve  Bayes": "naive baye", "Analyses": "analysis", "Species": "species", None: None}
    assert one(spark, S.greek_transliterated(F.lit("αβγδεζηθικλμνξοπρστυφχψω"))) == "abgdezethiklunxoprstuphchpso"


def plain_ratio(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return 200 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def words(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdef ", k=rng.randint(1, 14))).strip() or "a" for _ in range(n)]
    return sorted({*base, *["".join(c for c in w if rng.random() > 0.1) or "b" for w in base], *[w + rng.choice("abc") for w in base]})


@pytest.mark.parametrize("least", [75.0, 88.0])
def test_fuzzy_pairs_equal_brute_force(spark, least):
    terms = words(40, int(least))
    got = {(r.a, r.b) for r in Z.fuzzy_pairs(spark.createDataFrame([(t,) for t in terms], "a string"), spark.createDataFrame([(t,) for t in terms], "b string"), least, same=True).collect()}
    want = {(a, b) for i, a in enumerate(terms) for b in terms[i + 1 :] if plain_ratio(a, b) >= least}
    assert got == want
    assert all(abs(T.indel_ratio(a, b) - plain_ratio(a, b)) < 1e-9 for a in terms[:20] for b in terms[:20])


def test_greedy_groups_equal_one_pass(spark):
    terms = words(40, 9)
    reps, want = [], {}
    for t in sorted(terms):
        best = max(((T.indel_ratio(t, r), -i, r) for i, r in enumerate(reps)), default=(0, 0, ""))
        want[t] = best[2] if best[0] >= 80 else t
        if want[t] == t:
            reps.append(t)
    got = {r.term: r.representative for r in Z.greedy_groups(spark.createDataFrame([(t,) for t in terms], "term string"), 80.0).collect()}
    assert got == want


def test_keyword_groups_take_the_first_match(spark):
    terms = sorted({t.strip().lower() for t in words(40, 11)} - {""})
    reps, want = [], {}
    for t in terms:
        want[t] = next((r for r in reps if T.indel_ratio(t, r) >= 80), t)
        if want[t] == t:
            reps.append(t)
    rows = spark.createDataFrame([(f"  {t.upper()} ",) for t in terms], "keyword string")
    assert {r.term: r.representative for r in Z.keyword_groups(rows, 80.0).collect()} == want
    # With a single round, the rest is settled within components.
    pairs = Z.fuzzy_pairs(rows.select(F.lower(F.trim("keyword")).alias("a")), rows.select(F.lower(F.trim("keyword")).alias("b")), 80.0, same=True)
    ranked = rows.select(F.lower(F.trim("keyword")).alias("term")).withColumn("o", F.col("term"))
    assert {r.term: r.representative for r in Z._decided(ranked, pairs, True, 1).collect()} == want


def test_alias_proposals_stay_within_a_type(spark):
    rows = [("method", "Assay one"), ("method", "assay one"), ("method", "PCR method"), ("topic", "assay ones"), ("topic", "PCR methods"), ("topic", "PCR method")]
    known = spark.createDataFrame([("method", "pcr METHOD")], "type string, surface string")
    got = {(r.type, r.surface, r.representative) for r in Z.alias_proposals(spark.createDataFrame(rows, "type string, surface string"), known).collect()}
    assert got == {("method", "assay one", "Assay one"), ("topic", "PCR methods", "PCR method")}


def test_titles_keep_case_and_the_smallest_doi(spark):
    titles = spark.createDataFrame([("10.1/b", "Alpha beta"), ("10.1/a", "beta Alpha"), ("10.1/c", "ALPHA BETA")], "doi string, title string")
    got = Z.match_titles(spark.createDataFrame([("beta  Alpha",), (" ",)], "citation string"), titles).collect()
    assert [(r.doi, r.ratio) for r in got] == [("10.1/a", 100.0)]


def test_reference_resolution(spark):
    refs = spark.createDataFrame([("p", 1, "10.1/a", 2020, "Smith"), ("p", 2, "10.1/b", 2021, "Smyth"), ("p", 3, "10.1/c", 2021, "Jones")], "doi string, pos int, ref_doi string, year int, surname string")
    cites = spark.createDataFrame([("p", "[2]"), ("p", "Smith et al. 2020"), ("p", "Jonas 2021"), ("p", "[9]"), ("p", "Zhou 1999"), ("p", "Smith & Wesson (2020)"), ("p", "(Jones and Smith, 2021a)")], "doi string, ref_id string")
    got = {r.ref_id: (r.target, r.resolution) for r in Z.resolve_references(cites, refs).collect()}
    assert got == {"[2]": ("10.1/b", "numeric"), "Smith et al. 2020": ("10.1/a", "fuzzy"), "Jonas 2021": ("10.1/c", "fuzzy"), "[9]": (None, "unresolved"), "Zhou 1999": (None, "unresolved"), "Smith & Wesson (2020)": ("10.1/a", "fuzzy"), "(Jones and Smith, 2021a)": ("10.1/c", "fuzzy")}


def test_alias_resolution_order(spark):
    surfaces = spark.createDataFrame([("method", "PCR"), ("method", "Assays"), ("method", "chromatograpy"), ("method", "other thing")], "type string, surface string")
    aliases = spark.createDataFrame([("method", "pcr", "polymerase chain reaction"), ("method", "assay", "assay (generic)")], "type string, surface string, canonical string")
    vocabulary = spark.createDataFrame([("method", "chromatography"), ("topic", "other things")], "type string, canonical string")
    got = {r.surface: (r.canonical, r.match_via) for r in Z.resolve_aliases(surfaces, aliases, vocabulary).collect()}
    assert got == {"PCR": ("polymerase chain reaction", "alias"), "Assays": ("assay (generic)", "normalized_alias"), "chromatograpy": ("chromatography", "fuzzy"), "other thing": ("other thing", "identity")}


# ---------------------------------------------------------------- fusion, ranking, learning

def test_rrf(spark):
    rows = spark.createDataFrame([("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 1, 1, "c"), ("q", 1, 2, "b")], "query string, list_id int, rank int, doi string")
    got = V.rrf(rows).orderBy("rank").collect()
    assert [r.doi for r in got] == ["b", "a", "c"]
    assert V.rrf(rows.filter("doi = 'a'")).first().score == 1 / 61


def test_knn_ignores_degenerate_vectors_and_breaks_ties(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", None), ("f", [1.0]), ("g", [0.0, 2.0])], "doi string, embedding array<double>")
    got = V.knn(rows.filter("doi = 'a'"), rows, 5).orderBy("rank").collect()
    assert [(r.doi, r.score) for r in got] == [("b", 1.0), ("g", 0.0)]
    assert V.knn(rows.limit(0), rows, 3).count() == 0


def test_rocchio_moves_towards_liked(spark):
    axis = lambda i: [1.0 if k == i else 0.0 for k in range(8)]
    library = spark.createDataFrame([("l", axis(0))], "doi string, embedding array<double>")
    inputs = spark.createDataFrame([("x", 1, 1.0, axis(1)), ("y", 1, 1.0, axis(1)), ("z", -1, 1.0, axis(2))], "doi string, sign int, weight double, embedding array<double>")
    v = np.array(V.rocchio(inputs, library).first().vector)
    assert v[1] > 0 > v[2] and abs(np.linalg.norm(v) - 1) < 1e-9
    assert V.rocchio(inputs.limit(0), library).first().vector == axis(0)


def test_soft_floor_and_breakdown(spark):
    ranked = spark.createDataFrame([(f"d{i:03d}", i % 2 == 0, float(i)) for i in range(100)], "doi string, in_domain boolean, score double")
    kept = V.soft_floor(ranked, 20).collect()
    assert len(kept) == 20 and sum(not r.in_domain for r in kept) == 1
    assert len(V.soft_floor(ranked.filter("in_domain"), 20).collect()) == 20
    row = V.breakdown(spark.createDataFrame([("a", 0.51234, 0.1001)], "doi string, score double, domain double")).first().breakdown
    assert row["vector"] == 0.412 and row["domain"] == 0.1 and len(row) == 7


def test_stable_ids_earliest_wins(spark):
    old = spark.createDataFrame([(7, [1.0, 0.0])], "id long, centroid array<double>")
    new = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0])], "pos int, centroid array<double>")
    got = {r.pos: (r.id, r.inherited) for r in V.stable_ids(new, old).collect()}
    assert got == {1: (7, True), 0: (8, False), 2: (9, False)}


def test_cluster_weights(spark):
    events = spark.createDataFrame([(f"p{i}", "dismissed", None, "2024-01-01") for i in range(50)] + [(f"q{i}", "saved", None, "2024-01-01") for i in range(50)], "doi string, signal_type string, rating int, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    assigned = events.select("doi", F.when(F.col("doi").startswith("p"), 1).otherwise(2).alias("cluster_id"))
    clusters = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "id int, archived boolean")
    got = {r.cluster_id: r.weight for r in V.cluster_weights(events, assigned, clusters, "2024-01-01").collect()}
    assert got[2] == got[3] == 1.0 and 0.3 <= got[1] < 0.31 and 4 not in got


# ---------------------------------------------------------------- graph, sets, sinks

def test_graph_fixture(spark):
    mentions = spark.createDataFrame([("a", "mab"), ("b", "mab"), ("a", "cation"), ("c", "hts"), ("a", "J1"), ("b", "J1")], "doi string, canonical_id string")
    got = {(r.doi, r.other): r.n_shared for r in G.similar_papers(mentions).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2}
    capped = G.shared_entity_pairs(mentions.union(spark.createDataFrame([(f"x{i}", "mab") for i in range(5)], "doi string, canonical_id string")), max_degree=3)
    assert {(r.doi, r.n_shared) for r in capped.collect()} == {("a", 1), ("b", 1)}


def test_containment_equals_all_pairs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abAB c", k=rng.randint(0, 12))) for _ in range(120)]
    terms = ["".join(rng.choices("abC", k=rng.randint(0, 4))) for _ in range(60)]
    got = {tuple(r) for r in G.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(t.lower(), q.lower()) for t in texts for q in terms if q.strip() and q.lower() in t.lower()}


def test_similar_papers_equal_counted_pairs(spark):
    rng = random.Random(7)
    mentions = spark.createDataFrame([(f"p{rng.randint(0, 60)}", rng.randint(0, 15)) for _ in range(400)], "doi string, canonical_id int")
    pairs = sorted(((r.doi, -r.n_shared, r.other) for r in G.shared_entity_pairs(mentions, max_degree=20).collect()))
    want = {(d, o, -n, i + 1) for d in {p[0] for p in pairs} for i, (_, n, o) in enumerate([p for p in pairs if p[0] == d][:10])}
    assert {tuple(r) for r in G.similar_papers(mentions, max_degree=20).collect()} == want


def test_trending_rules(spark):
    counts = spark.createDataFrame([(1, 20, 5), (2, 5, 0), (3, 4, 0), (4, 10, 9), (5, 9, 1)], "canonical_id int, n_new long, n_prev long")
    entities = spark.createDataFrame([(i, "topic", f"Term {i}") for i in range(1, 6)], "canonical_id int, type string, surface string")
    dismissed, topics = spark.createDataFrame([("TERM 5",)], "concept_text string"), spark.createDataFrame([("about term 2 here",)], "topic string")
    got = {r.canonical_id: (r.growth, r.in_topics) for r in G.trending(counts, entities, dismissed, topics).collect()}
    assert got == {1: (3.0, False), 2: (4.0, True)}


def test_triples_are_judged(spark):
    rows = [("10.1/a", 1, "10.1/A", "EXTENDS", "10.1/b.", "Paper", 0.9), ("10.1/a", 2, "x", "PROPOSES", "m", "Entity", 0.9), ("10.1/a", 3, "10.1/a", "LIKES", "m", "Entity", 0.9), ("10.1/a", 4, "10.1/a", "EXTENDS", "not it", "Paper", 0.9), ("10.1/a", 5, "10.1/a", "PROPOSES", "m", "Entity", 0.4), ("10.1/a", 6, "10.1/a", "PROPOSES", " ", "Entity", 0.8)]
    got = {r.pos: (r.reject, r.object) for r in G.judge_triples(spark.createDataFrame(rows, "doi string, pos int, subject string, predicate string, object string, kind string, confidence double")).collect()}
    assert got[1] == (None, "10.1/b") and [got[i][0] for i in (2, 3, 4, 5, 6)] == ["subject", "predicate", "not a doi", "confidence", "object"]


def test_fixed_values(spark):
    weight = lambda s, r=None: one(spark, S.feedback_weight(F.lit(s), F.lit(r).cast("int")))
    assert [weight(s) for s in ("opened", "saved", "dismissed", "thumbs_up", "thumbs_down")] == [0.3, 1.0, -0.5, 0.8, -0.8] and weight("rated", 5) == 0.5 and weight("rated", 1) == -0.5
    review = lambda t: one(spark, S.detect_review(F.array(F.lit("article")), F.lit(t), F.lit(None).cast("string"), F.lit("J")))
    assert all(map(review, ("A Scoping Review of x", "narrative review", "Meta-Analysis", "a literature review", "systematic review"))) and not review("a review of things") and not review("review article")
    health = lambda rows: R.graph_health(spark.createDataFrame(rows, "doi string, status string, graph_indexed boolean")).first().health
    assert health([("a", "discovered", True)]) == "warn" and health([("a", "complete", False)]) == "warn" and health([("a", "complete", True), ("b", "complete", False)]) == "ok"
    assert one(spark, S.excerpt(F.lit("  padded  "))) == "padded"
    terms = spark.createDataFrame([("Deep Nets", 1, " "), ("Bio", 1, "")], "theme string, pos int, term string")
    assert {r.query for r in R.query_terms(terms).collect()} == {'"deep nets"', "bio"}
    items = spark.createDataFrame([("t", None, "E", "a", ""), ("t", None, None, "a", "n.d.")], "title string, author string, editor string, abstract string, date string")
    assert [r.warnings for r in R.item_quality(items).collect()] == ["", "author,date"]


def test_extraction_entities(spark):
    papers = spark.createDataFrame([("p", '{"methods_summary": " Ion-exchange Assays ", "materials_systems": ["Resin A", "", "resin a"], "discovered_topics": ["PCR"], "novelty_statement": null, "x": "y"}', ["PCR"], ["Ann B"], "J. Tests")], "doi string, extraction string, keywords array<string>, authors array<string>, journal string")
    aliases = spark.createDataFrame([("topic", "pcr", "polymerase chain reaction")], "type string, surface string, canonical string")
    got = {(r.type, r.field, r.canonical_id, r.surface, r.span_start, r.span_end) for r in G.extract_entities(papers, aliases).collect()}
    assert got == {
        ("method", "methods_summary", "ion-exchange assay", "Ion-exchange Assays", 0, 19), ("material", "materials_systems", "resin a", "Resin A", None, None),
        ("topic", "discovered_topics", "polymerase chain reaction", "PCR", None, None), ("keyword", None, "pcr", "PCR", None, None), ("author", None, "ann b", "Ann B", None, None), ("journal", None, "j. test", "J. Tests", None, None),
    }


def test_recogniser_and_model_mentions(spark):
    spans = spark.createDataFrame([("p", "Cancers", "B-DISEASE", 3, 10, 0.9), ("p", "x", "GENE", 0, 1, 0.9), ("p", "HPLC", "lab_technique", 1, 5, 0.8)], "doi string, text string, label string, start int, end int, confidence double")
    got = {(r.canonical_id, r.type, r.source, r.field, r.span_start) for r in G.ner_mentions(spans).collect()}
    assert got == {("cancer", "topic", "biobert", None, 3), ("hplc", "method", "biobert", None, 1)}
    answer = '{"new_entities": [{"surface": "Silica gels", "type": "material", "span_start": 4, "span_end": 15}, {"surface": "A", "type": "topic", "span_start": 4}, {"type": "topic"}], "validations": [{"surface": "Resins", "keep": true, "reason": "r"}, {"surface": "no", "keep": false}]}'
    got = {(r.canonical_id, r.type, r.span_start, r.span_end, r.confidence) for r in G.model_mentions(spark.createDataFrame([("p", answer), ("q", "{bad")], "doi string, answer string")).collect()}
    assert got == {("silica gel", "material", 4, 15, 0.85), ("a", "topic", None, None, 0.85), ("resin", "material", None, None, 0.85)}


def test_candidate_signals_and_gate(spark):
    mentions = spark.createDataFrame([("c", "e1"), ("l", "e1")], "doi string, canonical_id string")
    cites = spark.createDataFrame([("c", "l"), ("l", "c")], "source string, target string")
    relations = spark.createDataFrame([("c", "EXTENDS", "l"), ("c", "COMPARES_TO", "l"), ("c", "EXTENDS", "other")], "doi string, predicate string, target_id string")
    authors = spark.createDataFrame([("c", "Ann B"), ("l", "ann b"), ("c", "Zed")], "doi string, author string")
    doi = lambda x: spark.createDataFrame([(x,)], "doi string")
    signals = G.candidate_signals(doi("c"), mentions, cites, doi("l"), authors, relations)
    row = signals.first()
    assert (row.n_shared_entities, row.n_cites_in, row.n_cites_out, row.n_extends, row.n_compares, row.n_shared_authors, row.shared_authors_sample) == (1, 1, 1, 1, 1, 1, ["Ann B"])
    assert abs(V.graph_leg(signals).first().citations - 0.1) < 1e-12
    topics = spark.createDataFrame([("e1",)], "canonical_id string")
    assert {r.author for r in G.researcher_gate(authors, mentions, topics).collect()} == {"Ann B", "Zed", "ann b"}
    assert {r.author for r in G.researcher_gate(authors, mentions, topics, 2).collect()} == set() and G.researcher_gate(authors, mentions, topics, 0).count() == 3


def test_digest_lines(spark):
    rows = [
        ("10.1234/alpha", "Alpha: a study of monoclonal antibodies", ["Smith J", "Jones K", "Lee A", "Wu B"], 2024, 0.912, "Highly relevant to UFDF; novel CEX method."),
        ("10.1234/beta", "Beta: cation exchange chromatography", ["Brown C"], 2023, 0.823, "Methods overlap with corpus; consider re-extracting."), ("10.1234/gamma", "Gamma: low-score irrelevant paper", [], 2022, 0.151, None),
    ]
    df = spark.createDataFrame(rows, "doi string, title string, authors array<string>, year int, score double, rationale string")
    alpha = "- [**Alpha: a study of monoclonal antibodies**](https://doi.org/10.1234/alpha) · Smith J, Jones K, Lee A et al. (2024) · score: 0.912"
    beta = "- [**Beta: cation exchange chromatography**](https://doi.org/10.1234/beta) · Brown C (2023) · score: 0.823"
    want = [
        "---", 'date: "2026-01-15"', "new_papers: 3", "top_similarity: 0.912", "---", "# Discovery Digest — 2026-01-15", "3 new results found across 4 databases.", "Similarity threshold: >0.50", "## Top Results",
        alpha, "  > Highly relevant to UFDF; novel CEX method.", beta, "  > Methods overlap with corpus; consider re-extracting.", "", "## All New Results (3)", alpha, beta,
        "- [**Gamma: low-score irrelevant paper**](https://doi.org/10.1234/gamma) ·  (2022) · score: 0.151", "---", "*Generated by bibliodyne · 2026-01-15*",
    ]
    got = K.digest(df, "2026-01-15", 0.5).collect()
    assert [r.line for r in sorted(got, key=lambda r: r.line_no)] == want and sorted(r.line_no for r in got) == list(range(1, len(want) + 1))
    assert [r.line for r in sorted(K.digest(df.limit(0), "2026-01-15").collect(), key=lambda r: r.line_no)].count("*No results.*") == 2
    scored = df.withColumn("breakdown", F.create_map(F.lit("vector"), F.lit(0.8), F.lit("domain"), F.lit(0.112)))
    assert "  | **total** | **0.912** |" in {r.line for r in K.digest(scored, "d", 0.5, decomposition=True).collect()}


def test_null_traps(spark):
    papers = spark.createDataFrame([("a", None), ("b", "discovered"), ("c", "complete")], "doi string, status string")
    assert {r.doi for r in R.library(papers).collect()} == {"a", "c"}
    candidates = spark.createDataFrame([(None,), ("",), ("A",), ("z",)], "doi string")
    assert sorted(str(r.doi) for r in R.unknown_candidates(candidates, papers).collect()) == ["", "None", "z"]
    hits = spark.createDataFrame([("a", "T", 0, 1), ("A/", "T", 1, 2), ("", "Title x", 0, 3), ("", "title X", 0, 4), ("", "Title y", 1, 5)], "doi string, title string, source_order int, position int")
    assert sorted(r.position for r in R.search_dedup(hits).collect()) == [1, 3]


def test_upserts(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, t string, j string")
    batch = spark.createDataFrame([(1, None, "y", 1), (2, "c", None, 1), (2, None, "z", 2), (3, "n", None, 1)], "k int, t string, j string, o int")
    up = lambda t: K.upsert_coalesce(t, batch, ["k"], F.col("o")).select("k", "t", "j")
    once = sorted(map(tuple, up(table).collect()))
    assert once == [(1, "a", "y"), (2, "c", "z"), (3, "n", None)]
    assert sorted(map(tuple, up(up(table)).collect())) == once


def test_snapshot_pointer_and_poll(spark):
    root = shared_path(spark, "snap")
    df = spark.createDataFrame([(1, 5), (2, 7)], "id int, version int")
    assert I.poll(spark, df, root).count() == 0 and I.poll(spark, df, root).count() == 0
    assert [r.id for r in I.poll(spark, df.union(spark.createDataFrame([(3, 9)], "id int, version int")), root).collect()] == [3]
    seen = []

    def fails(rows):
        seen.append(rows.count())
        raise RuntimeError("not processed")

    more = df.union(spark.createDataFrame([(3, 9), (4, 11)], "id int, version int"))
    for _ in range(2):
        with pytest.raises(RuntimeError):
            I.poll(spark, more, root, process=fails)
    assert seen == [1, 1] and I.poll(spark, more, root, process=lambda rows: seen.append(rows.count())).count() == 1 and seen == [1, 1, 1]
    K.write_snapshot(df, root + "x")
    K.write_snapshot(df.limit(1), root + "x")
    assert K.read_snapshot(spark, root + "x").count() == 1


def test_flags_follow_writes(spark):
    papers = spark.createDataFrame([("a",)], "doi string")

    def fails(_):
        raise RuntimeError("no graph")

    assert I.index_then_flag(papers, shared_path(spark, "f"), lambda p: p, fails).first().graph_indexed is False
    with pytest.raises(RuntimeError):
        I.index_then_flag(papers, shared_path(spark, "f"), fails)


def test_embedding_rules(spark):
    rows = spark.createDataFrame([("a", "some text"), ("b", "")], "doi string, text string")
    with pytest.raises(Exception, match="empty text"):
        M.embed(rows, M.hashing_embedder()).collect()
    stored = spark.createDataFrame([("a", "old")], "doi string, model string")
    assert I.embed_due(rows, stored, "old", M.hashing_embedder()).count() == 0 and I.embed_due(rows, stored, "new", M.hashing_embedder()).count() == 1


def test_schema_guard(spark):
    live = spark.createDataFrame([], "a int, b string").schema
    with pytest.raises(ValueError, match="unknown"):
        Q.require_schema(spark.createDataFrame([(1, "x", 2)], "a int, b string, c int"), live)
    assert Q.require_schema(spark.createDataFrame([(1, "x")], "a int, b string"), live).count() == 1


def test_domain_edge_shares(spark):
    pool = spark.createDataFrame([(f"p{i}",) for i in range(10)], "doi string")
    extra = spark.createDataFrame([(f"n{i}", i) for i in range(10)], "doi string, position int")
    n = lambda share: R.exploration_extra(extra, pool, share).count()
    assert [n(0.15), n(2.0), n(-1.0), n(math.nan)] == [2, 10, 0, 0]
