"""Tables by day, quarantine of bad rows, mergeable distinct counts, k-means by shared scans with true silhouettes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliodyne.functions.scalar import whole_json
from bibliodyne.operators import clustering as C
from bibliodyne.operators import quarantine as Q
from bibliodyne.operators import sketches as K
from bibliodyne.operators import vectors as V
from bibliodyne.plans import catalog
from bibliodyne.session import shared_path
from bibliodyne.sources import days as D

NEW = ("flt_window_days", "inc_newest_day", "flt_feedback_quarantine", "flt_answer_quarantine", "flt_item_quarantine", "jn_unmapped")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("orders", "part", "lineitem", "events", "embeddings", "nation"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- days

def timed(spark, n, start="2024-01-01"):
    at = F.expr(f"timestamp_ntz '{start}' + make_dt_interval(cast(id % 100 as int), cast(id % 24 as int))")
    return spark.range(n).select("id", F.when(F.col("id") != 7, at).alias("at"))


def test_a_window_reads_the_files_of_its_days(spark):
    rows, path = timed(spark, 4000), shared_path(spark, "days")
    D.write_days(rows, "at", path, files=4)
    found = D.read_days(spark, path, "at", "2024-01-10T12:00:00", "2024-01-12T06:00:00")
    plan = found._jdf.queryExecution().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert D.DAY in filters.split("PartitionFilters: [")[1].split("]")[0]
    want = rows.filter("at between timestamp_ntz '2024-01-10 12:00:00' and timestamp_ntz '2024-01-12 06:00:00'")
    assert sorted(found.collect()) == sorted(want.collect()) and want.count() > 10
    read = found.select(F.input_file_name().alias("f")).distinct().count()
    assert read < 0.1 * len(spark.read.parquet(path).inputFiles())
    assert D.read_days(spark, path, "at").count() == 4000 and D.newest(spark, path, "at").first().at == rows.agg(F.max("at")).first()[0]


def test_days_are_replaced_or_added(spark):
    path = shared_path(spark, "days")
    D.write_days(timed(spark, 300), "at", path)
    again = timed(spark, 300).filter("at < timestamp_ntz '2024-01-04'").withColumn("id", F.col("id") + 1000)
    for _ in range(2):
        D.write_days(again, "at", path, replace=True)
    stored = D.read_days(spark, path, "at")
    assert stored.count() == 300 and stored.filter("id >= 1000").count() == again.count() > 0
    D.write_days(again, "at", path)
    assert D.read_days(spark, path, "at").count() == 300 + again.count()
    with pytest.raises(ValueError):
        D.write_days(again.withColumn(D.DAY, F.lit(1)), "at", path)


def test_days_of_an_empty_table_and_of_rows_without_a_time(spark):
    path = shared_path(spark, "days")
    D.write_days(timed(spark, 8).filter("id = 7"), "at", path)
    assert D.newest(spark, path, "at").first().at is None and D.read_days(spark, path, "at", "2024-01-01").count() == 0


# ---------------------------------------------------------------- quarantine

def test_both_tables_partition_the_input(spark):
    rows = [(1, "rated", 5), (2, "rated", 9), (3, "rated", None), (4, "saved", None), (5, "saved", 3), (6, "liked", 3), (7, None, None), (7, None, None)]
    found = Q.divide(spark.createDataFrame(rows, "id int, signal_type string, rating int").withColumn("_row", F.lit("x")), Q.feedback_rules())
    assert sorted(found.accepted.collect()) == [(1, "rated", 5, "x"), (4, "saved", None, "x")]
    assert sorted((r.id, tuple(r._reasons)) for r in found.rejected.collect()) == [(2, ("rating",)), (3, ("rating",)), (5, ("stray_rating",)), (6, ("signal",)), (7, ("signal",)), (7, ("signal",))]
    assert found.counts == {"rows": 8, "rejected": 6, "rule_signal": 3, "rule_rating": 2, "rule_stray_rating": 1}
    assert found.accepted.columns == ["id", "signal_type", "rating", "_row"] and found.rejected.columns == [*found.accepted.columns, "_reasons"]


def test_answers_and_items(spark):
    answers = [("a", '{"x": 1}'), ("b", "<think>hm</think>```json\n[1]\n```"), ("c", "{broken"), ("d", " "), ("e", None)]
    found = Q.divide(spark.createDataFrame(answers, "key string, answer string"), Q.answer_rules())
    assert {r.key: r.reasons for r in found.labelled("key").collect()} == {"a": "", "b": "", "c": "invalid", "d": "empty", "e": "empty"}
    empty = Q.divide(spark.createDataFrame([], "key string, title string"), Q.item_rules())
    assert empty.accepted.count() == empty.rejected.count() == 0 and empty.counts["rows"] == 0


def test_json_is_one_whole_value(spark):
    good = ['{"a": [1, {"b": "]}"}]}', " [1] ", '"x"', "3", "null", "true"]
    bad = ["{} and more", "[1] [2]", "1, 2", '1, "b": 2', "1} {", "1] [2", '{"a": 1}}', "", " ", "{", "nope", '1}, "w": {"v": 2']
    rows = spark.createDataFrame([(t,) for t in good + bad] + [(None,)], "t string").withColumn("ok", whole_json(F.col("t")).isNotNull())
    assert [r.ok for r in rows.collect()] == [True] * len(good) + [False] * (len(bad) + 1)


# ---------------------------------------------------------------- sketches

def test_merged_sketches_are_near_the_exact_counts(spark):
    rows = spark.range(300_000).select(F.expr("date_add(date '2024-01-01', cast(id % 30 as int))").alias("at"), F.expr("concat('s', id % 3)").alias("source"), F.expr("if(id % 1000 = 0, null, id * 7919 % 120011)").alias("v"))
    stored = K.daily_sketches(rows.filter("at < '2024-01-20'"), "at", "v", ["source"])
    stored = K.add_batch(stored, K.daily_sketches(rows.filter("at >= '2024-01-15'").filter("at >= '2024-01-20'"), "at", "v", ["source"]), ["source"])
    path = shared_path(spark, "sketches")
    stored.write.parquet(path)
    stored = spark.read.parquet(path)
    for groups, since, until in ((["source"], None, None), ([], "2024-01-05", "2024-01-25")):
        some = rows if since is None else rows.filter(F.col("at").between(since, until))
        exact = {tuple(r[g] for g in groups): r for r in some.groupBy(*groups).agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()}
        found = K.distinct_counts(stored, groups, "d", since, until).collect()
        assert len(found) == len(exact)
        for r in found:
            want = exact[tuple(r[g] for g in groups)]
            assert r.n == want.n and abs(r.d - want.d) <= 0.03 * want.d
    twice = K.add_batch(stored, stored, ["source"])
    assert K.distinct_counts(twice, []).first().n_distinct == K.distinct_counts(stored, []).first().n_distinct


# ---------------------------------------------------------------- clusters

def blobs(spark, n=500, k=6, dims=8):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, size=(k, dims))
    x = [[float(c) for c in centres[i % k] + rng.normal(0, 0.6, dims)] for i in range(n)]
    odd = [("none", None), ("nan", [float("nan")] * dims), ("short", [1.0]), ("hole", [None] * dims), ("empty", [])]
    return x, spark.createDataFrame([(f"d{i:03d}", v) for i, v in enumerate(x)] + odd, "doi string, embedding array<double>")


def plain_silhouette(x, labels, power):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) ** power
    values = []
    for i, own in enumerate(labels):
        mean = {c: d[i, labels == c].sum() / ((labels == c).sum() - (c == own) or 1) for c in set(labels)}
        a, b = mean.pop(own), min(mean.values())
        values.append((b - a) / max(a, b) if (labels == own).sum() > 1 else 0.0)
    return float(np.mean(values))


def test_silhouettes_equal_brute_force(spark):
    x, rows = blobs(spark)
    rows = C.usable(rows)
    parts, passes = C.fit_grid(rows, [3, 6, 8], inits=4)
    assert passes <= 21 and sorted(parts) == [3, 6, 8]
    x = np.array(x)
    for r in C.silhouettes(rows, parts).collect():
        labels = C.squares(x, parts[r.k].centers).argmin(1)
        assert r.n_clusters == len(set(labels)) == r.k
        assert r.euclidean == pytest.approx(plain_silhouette(x, labels, 1), abs=1e-6)
        assert r.squared == pytest.approx(plain_silhouette(x, labels, 2), abs=1e-6)
        cost = ((x - parts[r.k].centers[labels]) ** 2).sum()
        assert parts[r.k].cost == pytest.approx(cost, rel=1e-9)
    # Fewer points than rows: against all rows still.
    some = {r.k: r.euclidean for r in C.silhouettes(rows, parts, most=200).collect()}
    assert all(abs(some[r.k] - r.euclidean) < 0.1 for r in C.silhouettes(rows, parts).collect())


def test_the_number_of_clusters_is_found(spark):
    x, rows = blobs(spark)
    k, centroids, members = V.kmeans_auto(rows, 4, 9, inits=5)
    assert k == 6 and centroids.count() == 6
    groups = {}
    for r in members.collect():
        groups.setdefault(r.pos, set()).add(int(r.doi[1:]) % 6)
    assert len(groups) == 6 and all(len(g) == 1 for g in groups.values()) and members.count() == len(x)


def test_too_few_or_equal_vectors_give_no_clusters(spark):
    same = spark.createDataFrame([(f"d{i}", [1.0, 2.0]) for i in range(40)], "doi string, embedding array<float>")
    assert V.kmeans_auto(same, 2, 4, inits=2) is None and V.kmeans_auto(same.limit(3), 5) is None
    assert V.kmeans_auto(same.limit(0), 2) is None
