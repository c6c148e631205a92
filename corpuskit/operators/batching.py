"""Batching and sampling order.

Batches are arithmetic on a global position (``pos`` 0..N-1): no row moves
except for the random orders, which are hash permutations ranked with the
two-level prefix.  Padding uses per-batch maxima (window over a batch, bounded
by the batch size) or a global maximum (one aggregate row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import hashing as H
from corpuskit.functions import prefix as P
from corpuskit.functions import specials as S


def _with_n(df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_N"))))


def sequential_batches(samples: DataFrame, consumed: int, micro: int, workers: int, drop_last: bool = True,
                       pos: str = "pos") -> DataFrame:
    """From ``consumed``, global batches of ``micro*workers``; worker r takes slice r."""
    mw = micro * workers
    d = _with_n(samples).filter(F.col(pos) >= consumed)
    j = F.col(pos) - consumed
    d = d.withColumn("batch", F.floor(j / mw).cast("bigint")).withColumn("worker", F.floor((j % mw) / micro).cast("int"))
    if drop_last:
        d = d.filter((F.col("batch") + 1) * mw <= F.col("_N") - consumed)
    return d.drop("_N")


def _perm(spark, size: int, seed, epoch: int, n_buckets: int | None):
    """Hash permutation of ``range(size)``: ``(x, rank)``; the range is made by all tasks."""
    r = spark.range(size).withColumnRenamed("id", "x")
    r = r.withColumn("_h", H.u(seed, F.lit(epoch), "x"))
    nb = n_buckets or P.default_buckets(spark)
    return P.global_positions(r, [F.col("_h"), F.col("x")], P.hash_bucket(F.col("_h"), nb), rank_col="rank").drop("_h")


def cyclic_batches(samples: DataFrame, consumed: int, micro: int, workers: int, seed: int, data_sharding: bool = True,
                   n_buckets: int | None = None) -> DataFrame:
    """Random order per epoch, resumable from ``consumed``.

    active = N - N % (micro*workers); epoch = consumed // active.  Sharded mode:
    worker r owns the bucket ``[r*B, (r+1)*B)``, ``B = (N // (micro*workers)) * micro``,
    permuted, from offset ``(consumed % active) // workers``.  Otherwise a permutation
    of ``(N // micro) * micro`` indices, from offset ``consumed % active``, strided by worker.
    Output ``(worker, step, idx)``; ``idx`` is the sample position.  The
    permutation range has at most N rows and is generated from the table's count.
    """
    spark = samples.sparkSession
    mw = micro * workers
    nrow = samples.count()  # one scalar to pick the epoch seed; the data stay distributed
    active = nrow - nrow % mw
    epoch = consumed // active if active else 0
    cur = consumed % active if active else 0
    if data_sharding:
        bsize = (nrow // mw) * micro
        p = _perm(spark, bsize, seed, epoch, n_buckets)
        offset = cur // workers
        ws = spark.range(workers).select(F.col("id").cast("int").alias("worker"))
        d = p.filter(F.col("rank") >= offset).crossJoin(F.broadcast(ws))
        d = d.select("worker", ((F.col("rank") - offset) / micro).cast("bigint").alias("step"),
                     (F.col("worker") * bsize + F.col("x")).alias("idx"), (F.col("rank") - offset).alias("_o"))
        full = F.floor((F.lit(bsize) - offset) / micro) * micro
        return d.filter(F.col("_o") < full).drop("_o")
    fsize = (nrow // micro) * micro
    p = _perm(spark, fsize, seed, epoch, n_buckets)
    a = p.filter(F.col("rank") >= cur).withColumn("_a", F.col("rank") - cur)
    a = a.withColumn("worker", F.pmod(F.col("_a"), F.lit(workers)).cast("int")).withColumn("_j", F.floor(F.col("_a") / workers))
    per_worker = a.groupBy("worker").agg(F.count(F.lit(1)).alias("_c"))
    a = a.join(F.broadcast(per_worker), "worker")
    a = a.filter(F.col("_j") < F.floor(F.col("_c") / micro) * micro)
    return a.select("worker", F.floor(F.col("_j") / micro).cast("bigint").alias("step"), F.col("x").alias("idx"))


def distributed_order(samples: DataFrame, key: str, workers: int, seed: int, epoch: int, drop_last: bool = False,
                      n_buckets: int | None = None) -> DataFrame:
    """J3 [spec]: shuffled per epoch, split over workers; remainder dropped, or padded by wrapping.

    Output ``(worker, step, key)``.
    """
    h = H.u(seed, F.lit(epoch), key)
    d = samples.select(key).withColumn("_h", h)
    nb = n_buckets or P.default_buckets(samples.sparkSession)
    r = P.global_positions(d, [F.col("_h"), F.col(key)], P.hash_bucket(F.col("_h"), nb), rank_col="_r")
    r = _with_n(r)
    if drop_last:
        total = F.floor(F.col("_N") / workers) * workers
        r = r.filter(F.col("_r") < total)
        slot = F.col("_r")
        out = r.select(key, slot.alias("_s"))
    else:
        total = F.ceil(F.col("_N") / workers) * workers
        # rows at rank < pad also fill slots N .. total-1 (wrap-around)
        copies = F.when(F.col("_r") < total - F.col("_N"), F.array(F.col("_r"), F.col("_r") + F.col("_N"))).otherwise(F.array(F.col("_r")))
        out = r.select(key, F.explode(copies).alias("_s"))
    return out.select(F.pmod(F.col("_s"), F.lit(workers)).cast("int").alias("worker"),
                      F.floor(F.col("_s") / workers).cast("bigint").alias("step"), key)


def batches_with_remainder(ranked: DataFrame, batch_size: int, pos: str = "pos") -> DataFrame:
    """Fixed-size batches, the remainder kept as a last short batch."""
    return ranked.withColumn("batch", F.floor(F.col(pos) / batch_size).cast("bigint"))


def pad_batch(batched: DataFrame, tokens: str = "tokens", batch: str = "batch", max_len: int | None = None,
              multiple: int = 64, pad: int = S.PAD) -> DataFrame:
    """Truncate to ``max_len`` (if given), pad to the longest in the batch rounded up
    to ``multiple``; attention mask 1 on real tokens.  The window is per batch (bounded).
    """
    t = F.col(tokens) if max_len is None else F.slice(tokens, 1, max_len)
    d = batched.withColumn(tokens, t)
    longest = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    target = (F.ceil(longest / F.lit(multiple)) * multiple).cast("int")
    d = d.withColumn("_L", target)
    padn = F.col("_L") - F.size(tokens)
    return d.select("*", F.concat(F.col(tokens), F.array_repeat(F.lit(pad), padn)).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), padn)).alias("attention_mask")).drop("_L")


def labels_ignore_pad(labels, pad: int = S.PAD, ignore: int = S.IGNORE_LABEL):
    """label = -100 where the label is the pad id."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.transform(c, lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))


def prompt_batch(prompts: DataFrame, tokens: str, to_generate: int, add_leading_eod: bool = False, eod: int = S.EOD) -> DataFrame:
    """Optional leading EOD; pad every prompt with EOD to ``max_len + to_generate``; keep lengths.

    The maximum is one aggregate row cross-joined back.
    """
    t = F.concat(F.array(F.lit(eod)), F.col(tokens)) if add_leading_eod else F.col(tokens)
    d = prompts.withColumn(tokens, t).withColumn("length", F.size(tokens))
    mx = d.agg(F.max("length").alias("_m"))
    d = d.crossJoin(F.broadcast(mx))
    padn = F.col("_m") + to_generate - F.col("length")
    return d.withColumn(tokens, F.concat(F.col(tokens), F.array_repeat(F.lit(eod), padn))).drop("_m")


def skip_batches(batched: DataFrame, n: int, batch: str = "batch") -> DataFrame:
    """Resume by dropping the first ``n`` batches of the epoch."""
    return batched.filter(F.col(batch) >= n)
