"""Embedding links in labels whose blocks have to be cut."""

import numpy as np
import pytest

from bibliodyne.llm import nndescent

THRESHOLD = 0.9999


@pytest.fixture(scope="module")
def one_direction(spark):
    """600 unit vectors of one label and one block in every table; i and i + 300 alone reach the threshold."""
    rng = np.random.default_rng(5)
    noise = rng.standard_normal((300, 32))
    x = np.ones(32) + 0.02 * np.concatenate([noise, noise + 0.1 * rng.standard_normal((300, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= THRESHOLD
    assert (hit.sum(axis=1) == 2).all() and hit[np.arange(300), np.arange(300) + 300].all()
    return spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, label int, v array<double>")


def test_tables_cut_a_block_in_different_pieces(one_direction):
    met = {i: set() for i in range(600)}
    for r in nndescent._starting_lists(one_direction, 0, nndescent.TABLES).collect():
        met[r.id] |= {e.id for e in r.nb}
    assert sum((i + 300) % 600 in met[i] for i in range(600)) > 300  # one cut for all tables leaves about 90


def test_a_label_that_fails_the_audit_is_counted_exactly(one_direction):
    lists = nndescent.neighbour_lists(one_direction, THRESHOLD, rounds=1, attempts=1).collect()
    assert len(lists) == 600
    assert all(r.room == 0 or (r.id + 300) % 600 in {e.id for e in r.nb} for r in lists)
    exact = nndescent._dense(one_direction.selectExpr("*", "1L as c"), one_direction.select("id"), THRESHOLD)
    assert {r.a: r.n for r in exact.filter("kind = 0").groupBy("a").agg({"n": "sum"}).toDF("a", "n").collect()} == dict.fromkeys(range(600), 1)
