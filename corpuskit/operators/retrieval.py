"""Embedding store and exact retrieval.

``mips_topk`` (``mips``) never forms all (query, vector) pairs as rows: blocks of
bounded bytes meet blocks of queries, and blocks whose bound is too low are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.operators.mips import MipsSearch

def merge_shards(paths: list[str], spark) -> DataFrame:
    """H2: union of worker shards written as separate Parquet folders."""
    return spark.read.parquet(*paths)


def overlapping_ids(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """H3: ids present more than once (empty when shards are disjoint)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def coverage_gaps(evidence: DataFrame, ekey: str, emb: DataFrame, vkey: str) -> DataFrame:
    """H4: evidence rows without an embedding and embeddings without evidence (two anti joins)."""
    a = evidence.select(F.col(ekey).alias("id")).join(emb.select(F.col(vkey).alias("id")), "id", "left_anti").withColumn("missing", F.lit("embedding"))
    b = emb.select(F.col(vkey).alias("id")).join(evidence.select(F.col(ekey).alias("id")), "id", "left_anti").withColumn("missing", F.lit("evidence"))
    return a.unionByName(b)


def mips_topk(corpus: DataFrame, queries: DataFrame, k: int, vid: str = "vec_id", vvec: str = "embedding",
              qid: str = "query_id", qvec: str = "query", **sizes) -> DataFrame:
    """H5: exact inner-product top-k per query: ``(query_id, rank, vec_id, score)``; ties by the smaller vector id.

    See ``mips.MipsSearch``, which also takes ``sizes``.
    """
    return MipsSearch(corpus, queries, k, vid, vvec, qid, qvec, **sizes).topk()


def mips_topk_vectors(top: DataFrame, corpus: DataFrame, vid: str = "vec_id", vvec: str = "embedding") -> DataFrame:
    """H6: H5 with the vectors attached (equi join on id)."""
    return top.join(corpus.select(vid, vvec), vid)


def topk_accuracy(top: DataFrame, qid: str, hit: str, ks: list[int]) -> DataFrame:
    """H7: share of queries with a hit among the first k results, for several k."""
    per = top.groupBy(qid).agg(*[F.max(F.when((F.col("rank") <= k) & F.col(hit), 1).otherwise(0)).alias(f"hit{k}") for k in ks])
    return per.agg(*[F.avg(f"hit{k}").alias(f"top{k}_accuracy") for k in ks])


def collect_references(df: DataFrame, key: str, order: str, inp: str, out: str) -> DataFrame:
    """H8: one row per id; the first occurrence's input, all outputs in order."""
    g = df.groupBy(key).agg(F.min_by(inp, order).alias(inp),
                            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(out).alias("v")))).alias("_x"))
    return g.select(key, inp, F.transform("_x", lambda s: s["v"]).alias("outputs"))


def attach_text(ids: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """H9: id -> (text, title) lookup; Spark/AQE picks broadcast when the evidence side is small."""
    return ids.join(evidence, key, "left")


def topk_filter(scores: DataFrame, row: str, score: str, k: int) -> DataFrame:
    """Keep candidates whose score is >= the k-th largest of their row (ties kept)."""
    w = Window.partitionBy(row).orderBy(F.col(score).desc())
    return scores.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= k).drop("_r")


def softmax_cols(scores: DataFrame, row: str, score: str, temperature: float = 1.0) -> DataFrame:
    z = F.col(score) / F.lit(temperature)
    w = Window.partitionBy(row)
    d = scores.withColumn("_z", z).withColumn("_m", F.max("_z").over(w))
    d = d.withColumn("_e", F.exp(F.col("_z") - F.col("_m")))
    return d.withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_z", "_m", "_e")


def nucleus_filter(scores: DataFrame, row: str, score: str, key: str, p: float, temperature: float = 1.0) -> DataFrame:
    """Drop candidates whose cumulative probability *before* them exceeds p; the best is kept."""
    d = softmax_cols(scores, row, score, temperature)
    w = Window.partitionBy(row).orderBy(F.col("prob").desc(), F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("cum_before", F.coalesce(F.sum("prob").over(w), F.lit(0.0)))
    return d.filter(F.col("cum_before") <= p)


def greedy_pick(scores: DataFrame, row: str, score: str, key: str) -> DataFrame:
    """H12 greedy: argmax per row (ties: smallest key)."""
    w = Window.partitionBy(row).orderBy(F.col(score).desc(), F.col(key))
    return scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def sample_pick(scores: DataFrame, row: str, score: str, key: str, seed: int, temperature: float = 1.0) -> DataFrame:
    """H12 sampling: one draw from softmax(score / T) per row via the Gumbel-max trick with hash noise."""
    from corpuskit.functions import hashing as H

    uu = (H.u(seed, row, key) + F.lit(0.5)) / F.lit(H.TWO32)
    g = -F.log(-F.log(uu))
    d = scores.withColumn("_g", F.col(score) / F.lit(temperature) + g)
    w = Window.partitionBy(row).orderBy(F.col("_g").desc(), F.col(key))
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "_g")


def sequence_logprob(scores: DataFrame, row: str, score: str, actual: str) -> DataFrame:
    """Log-softmax of the actual next token: ``logit(actual) - logsumexp(logits)`` per position."""
    w = Window.partitionBy(row)
    d = scores.withColumn("_m", F.max(score).over(w))
    d = d.withColumn("_lse", F.col("_m") + F.log(F.sum(F.exp(F.col(score) - F.col("_m"))).over(w)))
    return d.filter(F.col(actual)).select(row, (F.col(score) - F.col("_lse")).alias("logprob"))
