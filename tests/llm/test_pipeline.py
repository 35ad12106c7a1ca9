"""The pipeline's stages, each on its own input, and their registration."""

import hashlib
import itertools
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from bibliodyne.llm import langid, simhash
from bibliodyne.llm.queries import QUERIES, tokenizer_path
from bibliodyne.session import materialize

SF = "/root/testdata/sf0.001"


def first_of_similar(texts):
    """The smallest id of each component of texts with a Jaccard coefficient of 0.8 or more, by comparing all."""
    sets = {i: simhash.shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {find(i) for i in texts}


def test_stages_in_order_keep_columns_and_take_effect(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        if name != "bpe_tokens":
            assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    before, after = seen["language_id"]
    model = langid.fit(before)
    kept = before.withColumn("p", langid.predict(before, model)).filter("p.lang_pred <> 'und' and p.score >= 0.35")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in after.collect())
    before, after = seen["simhash_dedup"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(first_of_similar({r.doc_id: r.text for r in before.collect()}))
    before, after = seen["pii"]
    assert before.count() == after.count()
    assert after.filter("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z]'").count() == 0
    before, after = seen["mix_sources"]
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 3
    assert {(r.doc_id, r.text) for r in after.collect()} <= {(r.doc_id, r.text) for r in before.collect()}
    before, after = seen["bpe_tokens"]
    library = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_repeats_and_queries_are_registered(spark):
    key = lambda rows: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(corpus_pipeline.run(spark, SF).collect())
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and corpus_pipeline.ORACLE_SQL is None
