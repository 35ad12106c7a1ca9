"""Token counts, periodic runs and hard negatives against brute force or the library itself, and odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliodyne.llm import gnat, periodic_runs, token_counts
from bibliodyne.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, counts string, runs string, n_tokens string"


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns named like new ones."""
    rows = [
        (1, "the cat sat  on <s>the</s> mat\n\tagain ", "en", "c", "r", "t"), (1, "the cat sat  on <s>the</s> mat\n\tagain ", "en", "c", "r", "t"), (2, None, None, None, None, None), (3, "", "en", "c", "r", "t"),
        (4, "word " * 30000, "en", "c", "r", "t"), (None, "null id null id null id null id null id", "en", "c", "r", "t"), (5, "x" * 50000, "en", "c", "r", "t"), (6, "   ", "en", "c", "r", "t"), (7, "日本語 𝄞 ñandú ▁▁x", "ja", "c", "r", "t"),
    ]
    return spark.createDataFrame(rows, DOCS)


# ---------------------------------------------------------------- token counts

def test_counts_at_every_prefix_equal_the_library(path, library):
    rng = random.Random(11)
    pieces = sorted(token_counts.counts(path, False).pieces.score)
    texts = ["", " ", "  ", "a", "▁", "don't  stop...\n\n\nnow", "<s>x</s> <unk>", "\x00\x01", "Ωmega ﬁ é é 𝄞𝄞"]
    for _ in range(400):
        drawn = "".join(rng.choices(pieces, k=rng.randint(1, 8))).replace("▁", " ")
        texts.append(drawn if rng.random() < 0.5 else "".join(rng.choices("ab e\n\t  ,.'1éß日𝄞▁<s>THe#)(;_=", k=rng.randint(0, 40))))
    for text, counts in zip(texts, token_counts.counts(path, False).prefixes(texts), strict=True):
        assert counts.tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text
    assert token_counts.counts(path, True).totals(texts) == [len(library.encode(t)) for t in texts]


def test_adjacent_pairs_follow_the_definition(path):
    pieces = token_counts.Pieces(path)
    rng = random.Random(12)
    known = sorted(pieces.score)
    for _ in range(3000):
        a, b = rng.choice(known), rng.choice(known)
        if b[0] != token_counts.BLANK:
            assert pieces.adjacent(a, b) == (pieces.merged(a + b) == [a, b])


def test_token_table_on_documents_and_odd_rows(spark, path, library, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = token_counts.token_table(docs, path).collect()
    assert len(found) == len(texts)
    for r in found:
        n = len(library.encode(texts[r.doc_id] or ""))
        assert tuple(r) == (r.doc_id, len((texts[r.doc_id] or "").encode()), n, n > 4096)
    rows = token_counts.token_table(odd, path).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((r.doc_id, len(library.encode(r.text or ""))) for r in odd.collect())
    assert token_counts.token_table(odd.limit(0), path).count() == 0


def test_prefix_table_answers_budgets_without_texts(spark, path, library, odd):
    rows = odd.filter("doc_id not in (4, 5)")
    table = token_counts.prefix_table(rows, path)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for budget in (0, 1, 3, 7, 1000):
        asked = table.select("doc_id", token_counts.longest_prefix(F.col("counts"), budget).alias("cut"), token_counts.tokens_at(F.col("counts"), 5).alias("five")).collect()
        for r in asked:
            text = texts[r.doc_id]
            assert r.cut == max(i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= budget)
            assert r.five == len(library.encode(text[:5]))
    cut = token_counts.truncate(rows.dropDuplicates(["doc_id"]), token_counts.prefix_table(rows.dropDuplicates(["doc_id"]), path), 3)
    assert cut.columns == rows.columns
    assert all(len(library.encode(r.text or "")) <= 3 for r in cut.collect())


# ---------------------------------------------------------------- periodic runs

def brute_runs(w):
    """Every stretch with a period, extended word by word; the smallest period of equal stretches."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(13)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 5)):
            k, t, size = rng.choice([1, 2, 2, 3, 5]), [], rng.randint(0, 70)
            while len(t) < size:
                t += ([rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 9))[: rng.randint(1, 40)]
            texts.append(t)
        assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]


def test_maximal_pairs_are_all_close_ones():
    """Every pair within a third of its match is found, and no other."""
    rng = random.Random(14)
    for _ in range(200):
        w = [rng.randrange(2) for _ in range(rng.randint(1, 60))]
        order, match = periodic_runs.suffix_tree(np.array(w), np.zeros(len(w), dtype=np.int64))
        before = np.array([-1, *w[:-1]])
        found = set(periodic_runs.maximal_pairs(order, match, before)) if len(order) else set()
        want = set()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                n = 0
                while j + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                if n >= 5 and j - i <= n // 3 and (i == 0 or w[i - 1] != w[j - 1]):
                    want.add((i, j, n))
        assert found == want


def test_runs_of_very_long_texts_take_little_time():
    import time

    began = time.time()
    for w in ([1] * 200_000, [i % 7 for i in range(200_000)], ([*range(50)] * 3 + [99]) * 1000, [x for i in range(20000) for x in (1, 2, 3, 4, 5, 6, 7, i + 10)]):
        runs = periodic_runs.runs_of([w])[0]
        assert all(w[s : s + n - q] == w[s + q : s + n] for s, n, q in runs)
    assert time.time() - began < 60


def brute_row(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_table_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sorted(map(tuple, periodic_runs.runs_table(docs.repartition(3)).collect()))
    short = {r.doc_id: r.text for r in docs.filter("n_chars < 20000").collect()}
    assert len(found) == docs.count()
    assert [r for r in found if r[0] in short] == sorted(brute_row(i, t) for i, t in short.items())
    assert sum(r[1] > 0 for r in found) >= 10


def test_runs_on_odd_rows(spark, odd):
    found = Counter(map(tuple, periodic_runs.runs_table(odd).collect()))
    assert found == Counter(brute_row(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 4) + Counter([next(r for r in found if r[0] == 4)])
    assert next(r for r in found if r[0] == 4)[1:6] == (1, 0, 30000, 1, 30_000_000)
    rows = {r.doc_id: r for r in periodic_runs.document_runs(odd).collect()}
    assert rows[None].collapsed == "null id" and [tuple(x) for x in rows[None].runs] == [(0, 10, 2)]
    assert rows[2].collapsed == "" and rows[2].runs == []
    assert periodic_runs.runs_table(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, node string, x string"


def brute_negatives(rows, k=5):
    """From rows (vec_id, embedding, label), by comparing all."""
    ok = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = Counter(len(v) for _, v, _ in ok)
    size = min(size, key=lambda s: (-size[s], s), default=0)
    ok = [r for r in ok if len(r[1]) == size]
    out = []
    for n, (i, v, c) in enumerate(ok):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for m, (j, w, d) in enumerate(ok) if m != n]
        for p, pid, _ in sorted(x for x in scored if x[2] == c)[:k]:
            fit = sorted(x for x in scored if x[2] != c and 80 * -p <= 100 * -x[0] <= 100 * -p)[:k]
            out += [(i, pid, r, j, -p, -s) for r, (s, j, _) in enumerate(fit, 1)]
    return Counter(out)


@pytest.mark.parametrize(("n", "leaf", "shift", "labels"), [(700, 512, 0.0, 10), (700, 8, 0.3, 10), (900, 16, 0.0, 2), (400, 4, -0.2, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, leaf, shift, labels):
    rng = np.random.default_rng(n + leaf)
    v = rng.normal(shift, 0.2, (n, 6)).astype(np.float32)
    v[n // 2 : n // 2 + n // 5] = v[n // 2]  # a large group of copies
    v[5:60] = np.round(v[5:60], 1)  # ties
    rows = [(int(i), [float(x) for x in v[i]], int(rng.integers(labels)), "n", "x") for i in range(n)]
    build = gnat.build
    depths = []
    monkeypatch.setattr(gnat, "build", lambda p: depths.append(t := build(p, leaf)) or t)
    monkeypatch.setattr(gnat, "QUERIES", 3)
    monkeypatch.setattr(gnat, "ROWS", 64)
    found = Counter(tuple(r) for r in gnat.negatives_table(spark.createDataFrame(rows, VECTORS)).collect())
    assert found == brute_negatives([r[:3] for r in rows])
    assert leaf > 8 or len(depths[0].levels) >= 2
    assert depths[0].rows.count() == n


def test_the_tree_keeps_ranges_of_siblings_and_prunes(spark):
    """Ranges hold for every row, and a query in one of many clusters does not visit all leaves."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 8))
    v = np.round((np.repeat(centres, 50, axis=0) + rng.normal(0, 0.01, (2000, 8))) * 256).astype(int)
    rows = spark.createDataFrame([(int(i), int(i), i % 3, [int(a) for a in x]) for i, x in enumerate(v)], "rid long, vec_id long, label long, x array<long>")
    tree = gnat.build(rows, 20)
    level = {r.node: r for r in tree.levels[-1].collect()}
    by_leaf = {}
    for r in tree.rows.collect():
        by_leaf.setdefault(r.node, []).append(r.x)
    for node in level.values():
        for child in node.children:
            d = gnat._lifted(np.array(by_leaf[child.child]), np.array(node.splits), tree.square)
            assert np.allclose(d.min(axis=0), child.lo[: d.shape[1]]) and np.allclose(d.max(axis=0), child.hi[: d.shape[1]])
    queries = tree.rows.filter("rid % 100 = 0").withColumn("lows", F.array(F.lit(-gnat.FAR))).withColumn("highs", F.array(F.lit(gnat.FAR)))
    near = gnat.search(tree, queries, True, 5).filter("rank = 5").select("rid", F.array("score").alias("lows"))
    visits = gnat._descended(tree, gnat.materialize(queries.drop("lows").join(near, "rid"), "test-queries")).count()
    assert visits < 0.35 * 20 * len(by_leaf)


def test_negatives_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    some = lambda: [float(x) for x in rng.normal(0.2, 0.2, 4).astype(np.float32)]
    rows = [(i, some(), i % 3, "n", "x") for i in range(150)]
    rows += [(100, rows[100][1], 1, "n", "x"), (100, some(), 1, None, None), (200, None, 1, "n", "x"), (300, some(), None, "n", "x"), (400, [0.1, None, 0.2, 0.3], 1, "n", "x"), (500, [0.1, float("nan"), 0.2, 0.3], 1, "n", "x")]
    rows += [(600, [0.0, 0.0, 0.0, 0.0], 2, "n", "x"), (700, [float("inf"), 0.0, 0.0, 0.0], 1, "n", "x"), (800, [0.1, 0.2], 1, "n", "x"), (900, [], 1, "n", "x"), (None, some(), 1, "n", "x"), (-100, [-x for x in rows[0][1]], 0, "n", "x")]
    df = spark.createDataFrame(rows, VECTORS)
    found = Counter(tuple(r) for r in gnat.negatives_table(df.repartition(3)).collect())
    assert found == brute_negatives([r[:3] for r in rows])
    assert gnat.negatives_table(df.limit(0)).count() == 0
    assert gnat.negatives_table(df.filter("vec_id % 100 <> 0")).count() == 0
