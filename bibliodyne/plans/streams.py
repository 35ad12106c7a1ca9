"""Registered queries of streaming and incremental jobs: streams run over what the tables hold now."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibliodyne.functions import models as M
from bibliodyne.functions.text import CHUNK
from bibliodyne.operators.vectors import two_stage
from bibliodyne.plans.registry import Tables, query
from bibliodyne.plans.standins import CONCEPTS
from bibliodyne.plans.vectors import NOW, SIGN, vecs
from bibliodyne.session import shared_path
from bibliodyne.streaming import commit_log as C
from bibliodyne.streaming import incremental as I
from bibliodyne.streaming import jobs as J


def stream(t: Tables, name: str):
    table, columns, _ = CONCEPTS[name]
    return J.stream_table(t.spark, f"{t.sf_dir}/{table}.parquet").selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


query("str_feedback_counts", "select strftime(created_at, '%Y-%m-%d') as bucket, signal_type, count(*) as n from feedback group by 1, 2")(
    lambda t: J.run_to_table(J.daily_counts(stream(t, "feedback"), "created_at", ["signal_type"]), "complete", "feedback-counts").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd")))
query("str_trending", """select canonical_id, count(*) filter (extracted_at >= timestamp '2000-06-01' - interval 60 day) as n_new, count(*) filter (extracted_at < timestamp '2000-06-01' - interval 60 day) as n_prev
from mentions where extracted_at >= timestamp '2000-06-01' - interval 120 day and extracted_at < timestamp '2000-06-01' group by 1 having n_new > 0""")(
    lambda t: _rolled(J.run_to_table(J.daily_counts(stream(t, "mentions"), "extracted_at", ["canonical_id"], "60 days"), "complete", "trending"), "2000-06-01"))
query("str_dedup", "select distinct doi from feedback")(lambda t: J.run_to_table(J.dedup_stream(stream(t, "feedback"), "created_at", "doi", "60 days").select("doi"), "append", "dedup"))
query("str_cluster_mass", f"""select cluster_id, round(sum(case when {SIGN} < 0 then pow(0.5, (epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 86400e6 / 90) else 0 end), 6) as disliked,
round(sum(case when {SIGN} > 0 then pow(0.5, (epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 86400e6 / 90) else 0 end), 6) as liked from feedback join assignments using (doi) where {SIGN} <> 0 group by 1""")(lambda t: _masses(t))


def _rolled(buckets, now, days=60):
    end = F.lit(now).cast("timestamp")
    edge = lambda n: end - F.make_interval(days=F.lit(n))
    new, prev = F.col("bucket") >= edge(days), F.col("bucket") < edge(days)
    live = buckets.filter((F.col("bucket") >= edge(2 * days)) & (F.col("bucket") < end))
    return live.groupBy("canonical_id").agg(F.sum(F.when(new, F.col("n")).otherwise(0)).alias("n_new"), F.sum(F.when(prev, F.col("n")).otherwise(0)).alias("n_prev")).filter("n_new > 0")


def _masses(t):
    from bibliodyne.functions.scalar import signal_sign

    signed = stream(t, "feedback").withColumn("sign", signal_sign(F.col("signal_type"), F.col("rating"))).filter("sign <> 0")
    placed = signed.join(t.assignments.select("doi", F.col("cluster_id").cast("long").alias("cluster_id")), "doi")
    seconds = (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("at")
    last = J.last_state(J.run_to_table(J.cluster_mass(placed.select("cluster_id", "sign", seconds)), "update", "mass"), ["cluster_id"])
    decay = F.pow(F.lit(0.5), (F.unix_micros(F.lit(NOW).cast("timestamp")) / 1e6 - F.col("at")) / 86400.0 / 90.0)
    return last.select("cluster_id", F.round(F.col("disliked") * decay, 6).alias("disliked"), F.round(F.col("liked") * decay, 6).alias("liked"))


query("inc_frontier", "select id, case when status = 'F' and id % 60 <> 0 then greatest(started_at, timestamp '1998-01-01') else timestamp '1998-01-01' end as next_frontier from runs")(
    lambda t: I.next_frontier(t.runs.selectExpr("id", "timestamp_ntz '1998-01-01' as frontier", "started_at as covered_to", "status = 'F' as clean", "id % 60 = 0 as dry_run")).select("id", "next_frontier"))
query("inc_version_poll", "select doi, key as version from papers where key > (select max(key) from papers where key % 5 = 0 and year < 1998)")(lambda t: _polled(t))
query("inc_version_poll_snapshot", "select doi, key as version from papers where key > (select max(key) from papers where key % 5 = 0 and year < 1998)")(lambda t: _polled_snapshot(t))
# What is due is indexed by micro-batches, then once more by a replay of the same batches.
query("inc_phase_flags", "select doi, true as text_indexed, true as graph_indexed from papers where chunks_indexed = false and embeddings_indexed = true")(lambda t: _indexed(t))
query("inc_phase_flags_snapshot", "select doi, true as text_indexed, true as graph_indexed from papers where chunks_indexed = false and embeddings_indexed = true")(
    lambda t: I.index_then_flag(t.papers.filter("chunks_indexed = false and embeddings_indexed = true"), shared_path(t.spark, "phases"), lambda p: p.select("doi", "title"), lambda p: p.select("doi", "author")))
query("inc_embed_job", "select concat('10.1/', doc_id) as doi, 'm2' as model, 32 as dim from documents where trim(text) <> '' and doc_id % 3 <> 0")(
    lambda t: I.embed_due(t.raw("documents").select(F.concat(F.lit("10.1/"), "doc_id").alias("doi"), "text"), t.raw("documents").select(F.concat(F.lit("10.1/"), "doc_id").alias("doi"), F.expr("case when doc_id % 3 = 0 then 'm2' else 'm1' end").alias("model")), "m2", M.hashing_embedder()).select("doi", "model", F.size("embedding").alias("dim")))
query("inc_chunk_job")(lambda t: I.chunk_due(t.papers, t.raw("documents").select(F.concat(F.lit("10.1/"), "doc_id").alias("doi"), "text"), t.spark.createDataFrame([], CHUNK)).select("doi", "chunk_index", "char_start", "char_end"))
query("udf_embed", "select concat('10.1/', doc_id) as doi, 16 as dim from documents where trim(text) <> ''")(
    lambda t: M.embed(t.raw("documents").filter("trim(text) <> ''").select(F.concat(F.lit("10.1/"), "doc_id").alias("doi"), "text"), M.hashing_embedder(16)).select("doi", F.size("embedding").alias("dim")))
query("udf_ner")(lambda t: M.recognise(t.raw("documents").select(F.concat(F.lit("10.1/"), "doc_id").alias("doi"), "text"), M.word_recogniser({"the": "METHOD", "der": "DISEASE"})))
query("udf_rerank")(lambda t: two_stage(vecs(t, 1), vecs(t, 0), t.raw("documents").select(F.concat(F.lit("10.1/"), "doc_id").alias("doi"), "text"), M.reranker(lambda q, d: [float(len(set(a.split()) & set(b.split()))) for a, b in zip(q, d, strict=True)]), 5))


def _polled(t):
    """Two pulls of a folder of item files: the first gives the baseline, the second what is newer."""
    root, folder = shared_path(t.spark, "poll"), shared_path(t.spark, "items")
    items = t.papers.select("doi", F.col("key").alias("version"))
    pull = lambda: t.spark.readStream.schema(items.schema).parquet(folder)
    t.papers.filter("key % 5 = 0 and year < 1998").select("doi", F.col("key").alias("version")).write.mode("append").parquet(folder)
    C.poll_stream(pull(), root)
    items.write.mode("append").parquet(folder)
    return C.poll_stream(pull(), root).select("doi", "version")


def _indexed(t):
    root = shared_path(t.spark, "phases")
    for _ in range(2):
        due = stream(t, "papers").filter("chunks_indexed = false and embeddings_indexed = true")
        C.index_stream(due, root, lambda p: p.select("doi", "title"), lambda p: p.select("doi", "author"))
    return C.flags(t.spark, root)


def _polled_snapshot(t):
    root = shared_path(t.spark, "poll")
    items = t.papers.select("doi", F.col("key").alias("version"))
    I.poll(t.spark, t.papers.filter("key % 5 = 0 and year < 1998").select("doi", F.col("key").alias("version")), root)
    return I.poll(t.spark, items, root)
