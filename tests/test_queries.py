"""Registered queries against their SQL in DuckDB; ALL_QUERIES=1 runs every one of them."""

import glob
import math
import os

import duckdb
import pytest

from bibliodyne.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = (
    "gr_similar_papers", "gr_candidate_signals", "rrf_fuse", "vec_knn_papers", "jn_run_history", "jn_known_filter", "agg_feedback_timeline", "agg_merge_passes", "win_snapshot_delta", "topk_query_terms",
    "set_search_dedup", "sink_citation_upsert", "sink_atomic_replace", "fn_normalise_extraction", "learn_rocchio", "str_cluster_mass", "str_dedup", "inc_version_poll", "er_build_mentions", "flt_triple_valid",
)
NAMES = sorted(catalog.ORACLE_SQL) if os.environ.get("ALL_QUERIES") else SOME


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    try:
        return float(f"{float(v):.9g}")
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
