"""Null, large and repeated ids, and families of near copies around one text."""

import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bibliodyne.llm import nndescent, simhash, warc

PAGES = "page_id long, url string, html string, bundle string"


def test_archive_keeps_large_ids_beside_a_null_one(spark):
    big = 1 << 60
    rows = [(big + 1, "u", "same", "x"), (big + 3, "u", "same", "x"), (None, "u", "same", None), (big + 5, None, "other", "x"), (-(big + 7), "u", None, "x"), (3, "u", "", "x"), (None, "u", "alone", "x")]
    found = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.warc_table(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()}
    assert found == {
        (big + 1, "response", None, 4), (big + 3, "revisit", big + 1, 4), (None, "revisit", big + 1, 4), (big + 5, "response", None, 5),
        (-(big + 7), "response", None, 0), (3, "revisit", -(big + 7), 0), (None, "response", None, 5),
    }
    archive = warc.write_archive(spark.createDataFrame(rows, PAGES))
    asked = spark.createDataFrame([(big + 3,), (None,)], "page_id long")
    assert Counter((r.page_id, r.html) for r in warc.fetch(archive, asked).collect()) == Counter([(big + 3, None), (None, None), (None, "alone")])
    assert sorted(r.offset for r in archive.index.collect() if r.page_id is None)


def brute_links(rows, threshold=0.93):
    """(id, links, component, kept) of each row, with rows as nodes."""
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(v) for _, v, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= threshold:
            links[i] += 1
            links[j] += 1
            root[find(j)] = find(i)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    return Counter((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def test_links_of_repeated_ids(spark):
    kind = "vec_id long, embedding array<float>, label int"
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(1, a, 0), (1, b, 1), (2, a, 0), (3, b, 1), (4, a, 2), (4, b, 2), (5, b, 2), (4, a, 2), (4, a, 2)]
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows2 = [(int(rng.integers(30)), [float(x) for x in np.float32(base[rng.integers(6)] + rng.normal(0, 0.12, 8))], int(rng.integers(3))) for _ in range(300)]
    for some in (rows, rows2):
        found = nndescent.links_table(spark.createDataFrame(some, kind).repartition(3)).collect()
        assert Counter(map(tuple, found)) == brute_links(some)


def test_a_family_of_fingerprints_writes_few_links(spark):
    """2,017 fingerprints within two bits of one: a star, not all pairs."""
    centre = 0x0123456789ABCDEF
    prints = {centre} | {centre ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(64), 2)}
    other = 0x7EDCBA9876543210
    prints |= {other, other ^ 0b111, other ^ 0b111 ^ (0b1111 << 20)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for narrow in (False, True):
        links, roots = simhash.print_components(df, narrow)
        assert links.count() < 10_000
        groups = Counter(r.root for r in roots.collect())
        assert sorted(groups.values()) == [3, 2017]


def test_star_components_equal_all_pairs(spark):
    rng = random.Random(7)
    prints = set()
    for _ in range(15):
        p = rng.getrandbits(64)
        for _ in range(40):  # chains: each within 4 bits of the one before
            prints.add(p)
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    want = {r.node: r.root for r in simhash.components(simhash.link_pairs(df)).collect()}
    assert {r.fp: r.root for r in simhash.print_components(df)[1].collect()} == want


def test_near_copies_of_one_original(spark):
    """Copies are similar to their original only, not to each other; a second family is just not similar."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))

    def changed(base, n):
        out = list(base)
        for at in rng.sample(range(0, len(base), 6), n):
            out[at] = word()
        return " ".join(out)

    one, two = [word() for _ in range(300)], [word() for _ in range(300)]
    texts = [changed(one, 6) for _ in range(60)] + [" ".join(one)] + [changed(two, 12) for _ in range(30)] + ["  ", " \t\n", None, ""]
    rows = list(enumerate(texts))
    jaccard = lambda a, b: len(a & b) / max(1, len(a | b))
    sets = [simhash.shingles(t) for t in texts]
    assert all(jaccard(sets[i], sets[60]) >= 0.8 for i in range(60)) and jaccard(sets[0], sets[1]) < 0.8
    placed = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    roots = {r.doc_id: r.root for r in placed.collect()}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in range(61, 91)}) == 30 and len({roots[i] for i in range(91, 95)}) == 1
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(61, 92)]


def test_sketch_keys_meet_pairs_at_the_bound(spark):
    """Of pairs with a coefficient of just under 0.8 nearly all share a key; of those at 0.24 about 2.4%."""
    rng = random.Random(10)
    near, far = 0, 0
    for _ in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(404)]
        copy = list(words)
        for at in range(4, 404, 45):  # 9 words of 404 change 45 shingles: 355 of 445 stay
            copy[at] = f"v{rng.randrange(10**9)}"
        other = words[:160] + [f"u{rng.randrange(10**9)}" for _ in range(244)]
        a, b, c = (simhash.sketch_of(" ".join(x))[1][:36].reshape(6, 6) for x in (words, copy, other))
        near += bool(((a == b).sum(axis=1) >= 5).any())
        far += bool(((a == c).sum(axis=1) >= 5).any())
    assert near >= 390 and far <= 24


def test_nodes_that_share_buckets_meet_in_the_first_one_only(spark):
    rng = random.Random(12)
    base = [rng.randrange(1000) for _ in range(36)]
    sketches = [[v if rng.random() > share else rng.randrange(1000) for v in base] for share in (0, 0, 0.05, 0.1, 0.2, 0.3, 1) for _ in range(4)]
    nodes = spark.createDataFrame([(i, 9, m) for i, m in enumerate(sketches)], "nid long, n int, m array<int>")
    keys = {}
    for r in simhash._sketch_index(nodes).collect():
        keys.setdefault(r.nid, []).append(r.key)
    p, q = (nodes.select(F.struct("nid", "m").alias(c)) for c in "pq")
    for r in p.crossJoin(q).select("p.nid", F.col("q.nid").alias("other"), simhash._first_key("p", "q").alias("first")).collect():
        both = set(keys[r.nid]) & set(keys[r.other])
        assert r.first == next((k for k in keys[r.nid] if k in both), None)


def test_rows_meet_their_class_with_large_ones_apart(spark):
    from bibliodyne.llm.hot import join_class
    from bibliodyne.session import materialize

    rows = spark.createDataFrame([(1 if i < 40 else i, i) for i in range(60)] + [(None, 99)], "key long, nid long")
    classes = materialize(spark.createDataFrame([(1, "a", 4000), *[(k, "b", 1) for k in range(40, 50)]], "key long, v string, copies long"), "classes")
    plain, apart = (join_class(rows, classes, "key", "nid", twice=t) for t in (False, True))
    assert sorted(map(str, plain.collect())) == sorted(map(str, apart.collect())) and apart.count() == 61
    # The broadcast join no longer writes a row for every row that belongs to no large class.
    assert not [x for x in apart._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x and "_large_key" in x]


def test_texts_are_fetched_once_and_whole_rows_are_dealt_for_repeated_ones_only(spark, monkeypatch):
    fetched, fetch = [], simhash._texts
    monkeypatch.setattr(simhash, "_texts", lambda *x: fetched.append(1) or fetch(*x))
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in (0, 59)]
    rows = [(1, " ".join(words)), (2, near[0]), (3, near[1]), (4, "alone"), (None, "alone too"), (None, "alone too"), (None, near[0])]
    once = simhash.keep_one(spark.createDataFrame([r for r in rows if r[0]], "doc_id long, text string"))
    assert sorted(r.doc_id for r in once.collect()) == [1, 4] and len(fetched) == 1
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, rows[0][1]), (4, "alone"), (0, "alone too")])


def test_signatures_tell_pairs_just_below_the_bound(spark):
    """Of pairs at 0.72 few are candidates, which 91 of 128 equal min-hashes let through in most cases; at 0.8 nearly all are."""
    rng = random.Random(14)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**9)}" for _ in range(404)]
        near, below = list(words), list(words)
        for at in range(4, 404, 45):
            near[at] = f"v{rng.randrange(10**9)}"
        for at in range(4, 404, 30):
            below[at] = f"v{rng.randrange(10**9)}"
        rows += [(i, kind, " ".join(x)) for kind, x in (("base", words), ("near", near), ("below", below))]
    assert 0.79 < len(simhash.shingles(rows[0][2]) & simhash.shingles(rows[1][2])) / len(simhash.shingles(rows[0][2]) | simhash.shingles(rows[1][2])) < 0.8
    assert 0.69 < len(simhash.shingles(rows[0][2]) & simhash.shingles(rows[2][2])) / len(simhash.shingles(rows[0][2]) | simhash.shingles(rows[2][2])) < 0.73
    signed = spark.createDataFrame(rows, "i long, kind string, text string").select("i", "kind", simhash.sketch(F.col("text")).alias("k"), simhash.signature(F.col("text")).alias("s")).select("i", "kind", F.struct("k.n", "s.e", "s.f").alias("p"))
    base = signed.filter("kind = 'base'").select("i", F.col("p").alias("q"))
    found = signed.join(base, "i").filter(simhash._alike(0.8)("p", "q")).groupBy("kind").count()
    count = {r["kind"]: r["count"] for r in found.collect()}
    assert count["base"] == 60 and count["near"] >= 58 and count.get("below", 0) <= 6


def test_sieve_keeps_what_a_join_keeps_and_most_others_out(spark):
    from bibliodyne.llm.hot import sieved
    from bibliodyne.session import materialize

    rows = spark.createDataFrame([*[(i, "t") for i in range(3000)], (None, "t")], "id long, text string")
    wanted = materialize(spark.createDataFrame([*[(i,) for i in range(0, 3000, 30)], (None,)], "w long"), "wanted")
    maybe, never = sieved(rows, "id", wanted, "w")
    inside = {r.id for r in maybe.collect()}
    assert {None, *range(0, 3000, 30)} <= inside and len(inside) < 400
    assert len(inside) + never.count() == 3001 and not inside & {r.id for r in never.collect()}
    assert sieved(rows, "id", wanted.limit(0), "w")[1].count() == 3001


def test_whole_rows_of_ids_that_are_not_named_are_not_moved(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join(["other", *words[1:]])), *[(i, f"alone {i}") for i in range(2, 400)]]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(2, 400)]
    assert "Union" in (plan := kept._jdf.queryExecution().optimizedPlan().toString()) and "_bits" in plan
