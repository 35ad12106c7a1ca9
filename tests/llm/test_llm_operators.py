"""Each operator against a brute-force version or an exact round trip, and its edge cases."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliodyne.llm import ann, bpe, langid, mixing, nndescent, pii, quality, secret_scan, simhash, warc
from bibliodyne.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, fp string, size string, component_id string"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, null ids, and columns whose names the operators use."""
    base = "call me at +1 (375) 555-4393 or mail ann.b@mail.example.com today please, dear friend of mine"
    rows = [
        (1, base, "en", "s1", "x", "y", "z"), (1, base, "en", "s1", "x", "y", "z"), (2, base, "en", None, "x", "y", "z"), (3, None, None, "s1", None, None, None), (4, "", "en", "s2", "x", "y", "z"),
        (5, "word " * 30000, "en", "s2", "x", "y", "z"), (None, "no id here but some words", "en", "s1", "x", "y", "z"), (6, "12345 !!! ...", "de", "s3", "x", "y", "z"), (7, base + " ok", "en", "s3", "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(df):
    return df.limit(0)


# ---------------------------------------------------------------- personal data

FORMATS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in FORMATS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_spans_equal_plain_patterns(spark, odd_docs):
    random.seed(3)
    parts = list("0123456789") * 3 + list(" -.+()@@..aZ_%é😀\n") + ["4111111111111111", "192.168.1.", "a@b.c", "+1 (375) 555-4393", "255."]
    texts = ["".join(random.choices(parts, k=random.randint(0, 50))) for _ in range(1500)] + [None, "", "1 2" * 20000 + "x", "a.b@" * 5000, "x@y." + "a." * 5000, "5" * 30000, "a@b.c_d@e.f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pii_table(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = plain_spans(text)
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert rows[i].spans == want or rows[i].spans.startswith((want + ",term", "term"))
    assert pii.pii_table(odd_docs).count() == 9
    assert pii.pii_table(empty(odd_docs)).count() == 0


def test_pii_terms_disclose_and_clean_texts_stay(spark):
    filler = lambda i: " ".join(f"w{(i * 7 + k) % 90}x" for k in range(40))
    rows = [(i, f"{filler(i)} zanzibar bo@mail.example.com {filler(i + 3)}") for i in range(6)] + [(i, filler(i)) for i in range(6, 120)] + [(200, "zanzibar alone is left")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.pii_table(df).collect()}
    text = dict(rows)[0]
    at = text.index("zanzibar")
    assert f"term:{at}:{at + 8}" in found[0].spans
    clean = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert "zanzibar" not in clean[0] and "<EMAIL>" in clean[0]
    assert all(clean[i] == t for i, t in rows if i >= 6)


def test_pii_sanitize_keeps_columns_and_rows(odd_docs):
    out = pii.sanitize(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 9
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (3, None) in texts and (4, "") in texts and not any(t and "@" in t for _, t in texts)


# ---------------------------------------------------------------- archives

def test_warc_round_trip_and_fetch(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = spark.createDataFrame([(9000, None, None), (9001, "a\r\nb é", ""), (9002, "q", "x" * 3_000_000), (9002, "q", "x" * 3_000_000), (None, "u", "")], "page_id long, url string, html string")
    both = pages.unionByName(pages.selectExpr("page_id + 1000 as page_id", "url", "html")).unionByName(more)
    rows = both.collect()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", 1 << 60), r.page_id)
    want = []
    for r in rows:
        data, f = (r.html or "").encode(), first[r.html or ""]
        want.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if r.page_id == f else "revisit", None if r.page_id == f else f))
    archive = warc.write_archive(both, bundle_bytes=100)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(archive).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert archive.index.count() == len(rows) and archive.index.select("bundle").distinct().count() > 1
    one = warc.fetch(archive, spark.createDataFrame([(0,), (9002,)], "page_id long")).collect()
    assert sorted(r.page_id for r in one) == [0, 9002, 9002]
    assert {r.html for r in one if r.page_id == 0} == {r.html for r in rows if r.page_id == 0}
    assert warc.warc_table(empty(both)).count() == 0


def test_warc_frames_are_independent_and_table_is_a_skippable_frame():
    import io

    import zstandard

    frames = [zstandard.ZstdCompressor().compress(x) for x in (b"a" * 100, b"b" * 50)]
    data = b"".join(frames) + warc.seek_table([(len(frames[0]), 100), (len(frames[1]), 50)])
    import pyarrow as pa

    f = pa.BufferReader(data)
    table = warc.read_seek_table(f)
    assert [warc.read_frame(f, o, c) for o, c, _ in table] == [b"a" * 100, b"b" * 50]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"a" * 100 + b"b" * 50


# ---------------------------------------------------------------- near copies

def brute_components(values, linked):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vs = list(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


@pytest.mark.parametrize("narrow", [False, True])
def test_simhash_links_equal_brute_force(spark, narrow):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds:
        for k in (1, 2, 3, 4, 5, 6):
            for _ in range(6):
                prints.add(s ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = [(r.a, r.b) for r in simhash.link_pairs(df, narrow).collect()]
    vs = [signed(p) for p in prints]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(vs) for b in vs[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_fingerprint_by_definition():
    import xxhash

    for text in ("One two  three\tFOUR five six É", "a b", "x", "", None, "same same same same same same", "ÄB c d e f g"):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint_of(text) == sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def test_simhash_table(spark, odd_docs, documents):
    rows = simhash.simhash_table(documents).collect()
    prints = {r.fingerprint: int(r.fingerprint, 16) for r in rows}
    root = brute_components(prints.values(), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(lambda: 1 << 60)
    for r in rows:
        least[root[prints[r.fingerprint]]] = min(least[root[prints[r.fingerprint]]], r.doc_id)
    assert all(r.component_id == least[root[prints[r.fingerprint]]] for r in rows)
    odd = simhash.simhash_table(odd_docs).collect()
    assert len(odd) == 9
    by = {r.doc_id: r for r in odd}
    assert by[3].fingerprint == "0" * 16 and by[3].component_id == by[4].component_id == 3 and by[2].component_id == 1
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 not in ids and None in ids
    assert simhash.simhash_table(empty(odd_docs)).count() == 0 and simhash.keep_one(empty(odd_docs)).count() == 0


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200


# ---------------------------------------------------------------- secrets

def test_secrets_base_equals_plain_patterns_and_weak_parts_need_each_other(odd_docs):
    random.seed(4)
    parts = ["password", "Token", "api_key", "apikey", " ", " = ", ":", '"', "'", "AKIA", "ABCD1234", "abcdef01", "0123", "ſecret", "xyz-._+/", "\n", "é"]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 25)))
        want = [("assign", *m.span()) for m in assign.finditer(text) if len(m.group(2)) >= 8]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
        assert secret_scan.base_spans(text) == sorted(want, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
    together = "user = maria\npass = s3cr3t!pw\nhost: db.example.com:5432"
    assert [k for k, _, _ in secret_scan.all_spans(together)[1]] == ["weak_id", "weak_secret", "endpoint"]
    for alone in ("user = maria", "pass = s3cr3t!pw", "see https://example.com/x", "user = maria\n\n" + "pass = s3cr3t!pw", "user = maria " + "x " * 200 + "pass = s3cr3t!pw"):
        assert secret_scan.all_spans(alone) == ([], [])
    assert secret_scan.secret_table(odd_docs).count() == 9 and secret_scan.secret_table(empty(odd_docs)).count() == 0
    assert secret_scan.redact(odd_docs).columns == odd_docs.columns


# ---------------------------------------------------------------- mixing

def check_mix(rows, tolerance):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sizes = {k: sum(r["size"] for r in v) for k, v in by.items()}
    order = sorted((k for k in by if k is not None)) + ([None] if None in by else [])
    weight, fixed = {k: (1, 2, 3)[i % 3] for i, k in enumerate(order)}, {}
    while True:
        free = sum(weight[k] for k in by if k not in fixed)
        rest = sum(sizes.values()) - sum(fixed.values())
        goal = {k: fixed[k] if k in fixed else rest * weight[k] / free for k in by}
        over = [k for k in by if k not in fixed and goal[k] > 3 * sizes[k]]
        if not over:
            break
        fixed |= {k: 3.0 * sizes[k] for k in over}
    for k, v in by.items():
        assert v[0].source_size == sizes[k] and abs(v[0].target - goal[k]) < 1e-6 * max(1, goal[k])
        assert all(0 <= r.taken <= 3 * r["size"] and (r.taken == 0 if not r["size"] else r.taken % r["size"] == 0) for r in v)
        assert abs(sum(r.taken for r in v) - goal[k]) <= tolerance(v) + 1e-6


def test_mix_meets_targets_and_repeats(spark, odd_docs, documents):
    rows = mixing.mix_table(documents).collect()
    check_mix(rows, lambda v: max(r["size"] for r in v))
    again = mixing.mix_table(documents.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == documents.count()
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source")
    got = mixing.mix_table(many).collect()
    check_mix(got, lambda v: max(r["size"] for r in v))
    assert mixing.mix(many).count() == sum(r.taken // r["size"] for r in got)
    odd = mixing.mix_table(odd_docs).collect()
    assert len(odd) == 9 and mixing.mix(odd_docs).columns == odd_docs.columns
    assert mixing.mix_table(empty(odd_docs)).count() == 0 and mixing.mix(empty(odd_docs)).count() == 0


# ---------------------------------------------------------------- tokens

def test_bpe_equals_library(odd_docs, documents):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    random.seed(1)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600, 0x180E, 0x660, 0x4E00, 0x301]] + ["<|endoftext|>", "'s", "'ll", "  ", "\n\n", " the", "ing", " 4041"] * 12
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(4000)] + ["a" * 20000, "", " " * 5000]
    texts += [r.text for r in documents.limit(60).collect()]
    coder, vocab = bpe.encoder(path), bpe.vocabulary(path)
    packed = coder.batch(texts)
    for text, want, got in zip(texts, library.encode_batch(texts, add_special_tokens=False), packed, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids
        assert bpe.decode_ids(vocab, got) == library.decode(want.ids, skip_special_tokens=False) == text
    rows = bpe.bpe_table(odd_docs, path).collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    ids = odd_docs.select("doc_id", bpe.decode(bpe.encode(F.col("text"), path), path).alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    assert ids.filter("t <> text").count() == 0
    assert bpe.bpe_table(empty(odd_docs), path).count() == 0
    assert set(bpe.encode_documents(odd_docs, path).columns) == {*odd_docs.columns, "ids", "n_tokens", "decoded_sha256"} - {"text"}


def test_bpe_neighbour_test_equals_definition():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng, tokens = random.Random(2), sorted(vocab.ids)
    short = [t for t in tokens if len(t) <= 4]
    for _ in range(20000):
        a, b = rng.choice(short), rng.choice(short)
        if vocab.whole(a) and vocab.whole(b):
            assert vocab._adjacent(a, b) == (vocab.merged(a + b) == [a, b])


# ---------------------------------------------------------------- languages, quality

def test_language_held_out_accuracy(documents, odd_docs):
    rows = langid.langid_table(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in langid.langid_table(odd_docs).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[6].lang_pred == "und" and odd[None].held_out
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 7, None}
    assert langid.langid_table(empty(odd_docs)).count() == 0


def test_language_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    post, pairs = langid.forward_backward(e, np.array([4, 3]), t, True)
    want_pairs = np.zeros((3, 3))
    for i, n in enumerate((4, 3)):
        weight, marginal = {}, np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            weight[path] = np.exp(sum(e[i, k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(weight.values())
        for path, w in weight.items():
            for k, y in enumerate(path):
                marginal[k, y] += w / z
            for a, b in zip(path, path[1:], strict=False):
                want_pairs[a, b] += w / z
        assert np.allclose(post[i, :n], marginal)
    assert np.allclose(pairs, want_pairs)


def test_language_segments_equal_one_pass():
    rng = np.random.default_rng(0)
    for labels in (1, 2, 4):
        emissions = [(3 * rng.normal(size=(n, labels))).astype(np.float32) for n in (1, 5, 48, 49, 96, 97, 300, 2)]
        t = rng.normal(size=(labels, labels))
        for x, got in zip(emissions, langid.segmented_posteriors(emissions, t), strict=True):
            want, _ = langid.forward_backward(x[None].astype(float), np.array([len(x)]), t)
            assert np.allclose(want[0], got, atol=1e-9)
    assert langid.segmented_posteriors([], np.zeros((4, 4))) == []


def test_language_of_switched_words(documents):
    model = langid.fit(documents)
    found = dict(langid.label_words(model, "the and of that with schlich ungkeit verschlich der und"))
    assert found["the"] == "en" and found["schlich"] == "de" and langid.label_words(model, "12 34") == []


def test_quality_separates_held_out_labels(spark, odd_docs):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_table(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = quality.quality_table(odd_docs, labels)
    assert odd.count() == 9 and quality.quality_table(empty(odd_docs), labels).count() == 0
    assert quality.quality_table(odd_docs, empty(labels)).filter("score = 0.5").count() == 9
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_discriminant_equals_direct_densities():
    rng = np.random.default_rng(3)
    d = len(quality.STATS)
    x = [rng.normal(size=(400, d)) + c * 0.3 for c in (0, 1)]
    n = np.array([400.0, 400.0])
    model = quality.Discriminant(n, np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), shrink=0.1, ridge=0.05)
    cov = [np.cov(a.T, bias=True) for a in x]
    pooled = (cov[0] + cov[1]) / 2
    w = 0.1 + d / (d + 400)
    kept = [(1 - w) * c + w * pooled + 0.05 * np.trace(pooled) / d * np.eye(d) for c in cov]
    p = rng.normal(size=(5, d))
    log = [-0.5 * np.einsum("ij,jk,ik->i", p - x[c].mean(0), np.linalg.inv(kept[c]), p - x[c].mean(0)) - 0.5 * np.linalg.slogdet(kept[c])[1] for c in (0, 1)]
    assert np.allclose(model.difference(p), log[1] - log[0])


# ---------------------------------------------------------------- vectors

VECTORS = "vec_id long, embedding array<float>, label int, rank int, part int, score string"


def test_neighbours_exact_on_small_tables_and_edge_rows(spark):
    bad = [(20, None), (40, [0.0] * 8), (60, [float("nan")] * 8), (80, [1.0, None] + [0.0] * 6), (100, [1.0] * 3)]
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200, 300)]
    tie = [(i, [1.0] * 8) for i in range(400, 430)]
    rows = [(i, v, 0, 1, 2, "x") for i, v in [*bad, *good, *tie, tie[0]]]
    got = defaultdict(list)
    for r in ann.neighbours_table(spark.createDataFrame(rows, VECTORS)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    table = {i: np.array(v, dtype=np.float32).astype(float) for i, v in [*good, *tie]}
    assert set(got) == {i for i in table if i % 20 == 0}
    for q, found in got.items():
        ids = [i for i in table if i != q]
        want = sorted(ids, key=lambda i: (-float((table[q] * table[i]).sum()), i))[:20]
        # The repeated row 400 is a candidate twice.
        assert [i for _, i, _ in sorted(found)][:5] == [i for i in want for _ in range(2 if i == 400 else 1)][:5] and len(found) == 20
    few = spark.createDataFrame([(r[0], r[1], 0, 1, 2, "x") for r in good[:3]], VECTORS)
    assert ann.neighbours_table(few).count() == 2
    assert ann.neighbours_table(empty(few)).count() == 0


def test_neighbours_recall_with_learned_parts(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16))
    x = (centers[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got[r.query_id].add(r.vec_id)
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    recall = np.mean([len(got[i] & set(np.argsort(-s[i])[:20].tolist())) / 20 for i in range(0, 3000, 20)])
    assert recall >= 0.9


def test_balanced_parts_are_equal_and_follow_the_graph():
    rng = np.random.default_rng(4)
    centers = 8 * rng.normal(size=(4, 6))
    truth = np.repeat(np.arange(4), 64)
    x = centers[truth] + rng.normal(size=(256, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.neighbour_graph(x, 8)
    label = ann.balanced_parts(graph, 4)
    assert np.bincount(label).tolist() == [64] * 4
    assert (label[graph] == label[:, None]).mean() > 0.9


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 16))
    rows = [(i, v, i % 2) for i, v in enumerate(base)]
    rows += [(1000 + i, base[i] + 0.02 * rng.normal(size=16), i % 2) for i in range(40)]
    rows += [(2000 + i, base[3] + 0.1 * rng.normal(size=16), 1) for i in range(130)]
    rows += [(3000 + i, base[5], 1) for i in range(4)] + [(4000, 2 * base[5], 1), (4001, base[5], 0)]
    table = [(i, [float(x) for x in np.float32(v)], lab, 0, 0, "c") for i, v, lab in rows]
    odd = [(9000, None, 1, 0, 0, "c"), (9001, [0.0] * 16, 1, 0, 0, "c"), (9002, [float("inf")] * 16, 1, 0, 0, "c"), (9003, table[0][1], None, 0, 0, "c")]
    df = spark.createDataFrame([*table, *odd, table[7]], VECTORS)
    got = {}
    for r in nndescent.links_table(df).collect():
        got[r.vec_id] = r
        assert r.kept == (r.vec_id == r.component_id)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in table}
    label = {i: lab for i, _, lab, *_ in table}
    linked = lambda a, b: label[a] == label[b] and float(unit[a] @ unit[b]) >= 0.93
    root = brute_components(unit, linked)
    repeated = table[7][0]
    for i in unit:
        n = sum(linked(i, j) * (2 if j == repeated else 1) for j in unit if j != i) + (i == repeated)
        assert (got[i].n_links, got[i].component_id) == (n, root[i]), i
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (9000, 9001, 9002, 9003))
    assert nndescent.links_table(empty(df)).count() == 0
