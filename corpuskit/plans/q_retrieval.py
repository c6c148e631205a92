"""Queries for the embedding store and retrieval."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from corpuskit.functions.hashing import sql_u
from corpuskit.operators import retrieval as R
from corpuskit.operators.embedding_store import EmbeddingStore
from corpuskit.plans.inputs import table
from corpuskit.plans.registry import query
from corpuskit.session import ensure_checkpoint_dir

SEED = 1234
K = 10


def emb(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding", "label")


def norm(c):
    return F.round(F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)), 6)


NORM_SQL = "round(sqrt(list_sum(list_transform(CAST({v} AS DOUBLE[]), lambda x: x * x))), 6)"

PAIRS = """s AS (SELECT q.vec_id AS query_id, e.vec_id, q.label AS qlabel, e.label AS vlabel,
  list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e)"""


def topk(spark, d, k=K):
    e = emb(spark, d)
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.mips_topk(e, q, k)


@query("mips_topk", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {K}""")
def q_mips_topk(spark, d):
    return topk(spark, d).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("mips_topk_vectors", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, r.vec_id, {NORM_SQL.format(v='e.embedding')} AS norm FROM r JOIN embeddings e ON e.vec_id = r.vec_id WHERE rank <= {K}""")
def q_mips_topk_vectors(spark, d):
    t = R.mips_topk_vectors(topk(spark, d), emb(spark, d))
    return t.select("query_id", "rank", "vec_id", norm("embedding").alias("norm"))


@query("retrieval_topk_accuracy", f"""WITH {PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE vec_id <> query_id),
h AS (SELECT query_id, max(CASE WHEN rank <= 1 AND qlabel = vlabel THEN 1 ELSE 0 END) AS h1, max(CASE WHEN rank <= 5 AND qlabel = vlabel THEN 1 ELSE 0 END) AS h5,
             max(CASE WHEN rank <= 10 AND qlabel = vlabel THEN 1 ELSE 0 END) AS h10 FROM r WHERE rank <= 10 GROUP BY query_id)
SELECT round(avg(h1), 6) AS top1_accuracy, round(avg(h5), 6) AS top5_accuracy, round(avg(h10), 6) AS top10_accuracy FROM h""")
def q_retrieval_topk_accuracy(spark, d):
    """Answer = any other vector with the query's label; the query itself is excluded."""
    t = topk(spark, d, K + 1).filter(F.col("vec_id") != F.col("query_id"))
    from pyspark.sql import Window
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank"))))
    lab = emb(spark, d).select("vec_id", "label")
    j = t.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel")), "query_id")
    a = R.topk_accuracy(j.withColumn("hit", F.col("label") == F.col("qlabel")), "query_id", "hit", [1, 5, 10])
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


#: A double rounded to IEEE half precision (ties to even; the smallest step is 2^-24).
HALF_SQL = ("(CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END)")


@query("store_embeddings", f"""WITH h AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: {HALF_SQL}) AS v FROM embeddings)
SELECT vec_id, label, {NORM_SQL.format(v='v')} AS norm, round(list_sum(list_transform(v, lambda x, i: x * i)), 6) AS weighted FROM h""")
def q_store_embeddings(spark, d):
    """Vectors added to a half-precision store in two adds, and a third that overwrites some, read back."""
    e = emb(spark, d)
    store = EmbeddingStore(spark, os.path.join(ensure_checkpoint_dir(spark), "embedding-store-" + uuid.uuid4().hex))
    store.add(e.filter(F.col("label") < 5).withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.add(e.filter((F.col("label") >= 5) | F.col("label").isNull()))
    store.add(e.filter(F.col("label") < 5), allow_overwrite=True)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return store.read().select("vec_id", "label", norm("embedding").alias("norm"), F.round(weighted, 6).alias("weighted"))


def _shards(spark, d):
    base = os.path.join(ensure_checkpoint_dir(spark), "embedding-shards-" + uuid.uuid4().hex)
    e = emb(spark, d).withColumn("worker", F.pmod(F.col("vec_id"), F.lit(4)))
    paths = []
    for w in range(4):
        p = f"{base}/worker={w}"
        e.filter(F.col("worker") == w).drop("worker").write.mode("overwrite").parquet(p)
        paths.append(p)
    return R.merge_shards(paths, spark)


@query("merge_embedding_shards", f"SELECT vec_id, label, {NORM_SQL.format(v='embedding')} AS norm FROM embeddings")
def q_merge_embedding_shards(spark, d):
    """Four worker shards written to the shared checkpoint folder, read back as one table."""
    return _shards(spark, d).select("vec_id", "label", norm("embedding").alias("norm"))


@query("assert_no_overlap", "SELECT vec_id, count(*) AS n FROM embeddings GROUP BY vec_id HAVING count(*) > 1")
def q_assert_no_overlap(spark, d):
    return R.overlapping_ids(_shards(spark, d))


@query("assert_full_coverage", """
SELECT doc_id AS id, 'embedding' AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'evidence' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def q_assert_full_coverage(spark, d):
    return R.coverage_gaps(table(spark, d, "documents", "doc_id"), "doc_id", emb(spark, d), "vec_id")


@query("collect_references", """
SELECT conv_id, arg_min(text, turn) AS input, string_agg(text, ' ||| ' ORDER BY turn) AS outputs FROM conversations GROUP BY conv_id""")
def q_collect_references(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    r = R.collect_references(c.withColumn("out", F.col("text")), "conv_id", "turn", "text", "out")
    return r.select("conv_id", F.col("text").alias("input"), F.array_join("outputs", " ||| ").alias("outputs"))


@query("attach_text", """
SELECT l.doc_id, split_part(d.text, chr(10), 1) AS title, CAST(length(d.text) AS INTEGER) AS n_chars FROM labels l LEFT JOIN documents d USING (doc_id)""")
def q_attach_text(spark, d):
    ev = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.substring_index("text", "\n", 1).alias("title"),
                                                                 F.length("text").cast("int").alias("n_chars"))
    return R.attach_text(table(spark, d, "labels", "doc_id"), ev, "doc_id")


@query("topk_filter", """
SELECT user_id, event_id, value FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events) WHERE r <= 5""")
def q_topk_filter(spark, d):
    return R.topk_filter(table(spark, d, "events", "user_id", "event_id", "value"), "user_id", "value", 5)


SOFT = """p AS (SELECT user_id, event_id, exp(value / 10.0 - max(value / 10.0) OVER (PARTITION BY user_id)) AS e FROM events),
pr AS (SELECT user_id, event_id, e / sum(e) OVER (PARTITION BY user_id) AS prob FROM p)"""


@query("nucleus_filter", f"""WITH {SOFT},
c AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY user_id ORDER BY prob DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cb FROM pr)
SELECT user_id, event_id, round(prob, 6) AS prob FROM c WHERE cb <= 0.5""")
def q_nucleus_filter(spark, d):
    n = R.nucleus_filter(table(spark, d, "events", "user_id", "event_id", "value"), "user_id", "value", "event_id", 0.5, 10.0)
    return n.select("user_id", "event_id", F.round("prob", 6).alias("prob"))


@query("greedy_pick", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def q_greedy_pick(spark, d):
    return R.greedy_pick(table(spark, d, "events", "user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("sample_pick", f"""
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
   value / 10.0 - ln(-ln(({sql_u(SEED, 'user_id', 'event_id')} + 0.5) / 4294967296.0)) DESC, event_id) AS r FROM events) WHERE r = 1""")
def q_sample_pick(spark, d):
    s = R.sample_pick(table(spark, d, "events", "user_id", "event_id", "value"), "user_id", "value", "event_id", SEED, 10.0)
    return s.select("user_id", "event_id")


@query("sequence_logprob", """
WITH m AS (SELECT user_id, max(value) AS mx FROM events GROUP BY user_id),
l AS (SELECT e.user_id, m.mx + ln(sum(exp(e.value - m.mx))) AS lse FROM events e JOIN m USING (user_id) GROUP BY e.user_id, m.mx),
a AS (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(v - lse, 6) + 0.0 AS logprob FROM a JOIN l USING (user_id)""")
def q_sequence_logprob(spark, d):
    """Per user (a position), candidates = its events (logit = value); the actual token = its last event."""
    e = table(spark, d, "events", "user_id", "event_id", "value")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("_last"))
    e = e.join(last, "user_id").withColumn("actual", F.col("event_id") == F.col("_last"))
    r = R.sequence_logprob(e, "user_id", "value", "actual")
    return r.select("user_id", (F.round("logprob", 6) + F.lit(0.0)).alias("logprob"))
