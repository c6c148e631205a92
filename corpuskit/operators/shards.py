"""Shuffling, sharding, splits and sampling.

Global positions come from ``prefix.global_positions`` (no single-partition
window).  Shuffles are hash orders ``u(seed, key)``, so a permutation is a pure
function of the seed and the key set, whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import hashing as H
from corpuskit.functions import prefix as P


def _nb(df: DataFrame, n_buckets: int | None) -> int:
    return n_buckets or P.default_buckets(df.sparkSession)


def shuffle_rows(df: DataFrame, key: str, seed: int, out: str = "pos", n_buckets: int | None = None) -> DataFrame:
    """Seeded permutation; ``out`` = 0-based position in order ``(u(seed,key), key)``."""
    h = H.u(seed, key)
    d = df.withColumn("_h", h)
    return P.global_positions(d, [F.col("_h"), F.col(key)], P.hash_bucket(F.col("_h"), _nb(df, n_buckets)), rank_col=out).drop("_h")


def with_total(df: DataFrame, name: str = "_N") -> DataFrame:
    """Attach the row count as a column (one-row aggregate, broadcast cross join)."""
    return df.crossJoin(F.broadcast(P.total(df, name)))


def shard_equal(ranked: DataFrame, n_shards: int, pos: str = "pos", out: str = "shard") -> DataFrame:
    """``size = ceil(N/n)``, shard = ``floor(pos/size)``."""
    d = with_total(ranked)
    size = F.ceil(F.col("_N") / F.lit(n_shards))
    return d.withColumn(out, F.floor(F.col(pos) / size).cast("int")).drop("_N")


def short_valid_shard_size(n_train: int, n_valid: int, valid_fraction: float = 0.5):
    """D3 size expression over a ``_N`` column: s0 = ceil(N/(t+v)); s = ceil((N - s0*f)/t)."""
    s0 = F.ceil(F.col("_N") / F.lit(n_train + n_valid))
    return F.ceil((F.col("_N") - s0 * F.lit(valid_fraction)) / F.lit(n_train))


def shard_with_short_valid(ranked: DataFrame, n_train: int, n_valid: int = 1, valid_fraction: float = 0.5,
                           pos: str = "pos", out: str = "shard") -> DataFrame:
    """D3: training shards of size s, the last (shorter) shard is validation."""
    d = with_total(ranked)
    s = short_valid_shard_size(n_train, n_valid, valid_fraction)
    return d.withColumn(out, F.floor(F.col(pos) / s).cast("int")).drop("_N")


def assign_shards_to_workers(shards: DataFrame, n_workers: int, shard: str = "shard") -> DataFrame:
    """Sorted shards, ``k = n // workers`` contiguous shards each, remainder dropped.

    Input is the (small) list of distinct shard names; a window over it is bounded
    by the shard count.
    """
    d = shards.select(shard).distinct()
    w = Window.orderBy(shard)
    d = d.withColumn("_i", F.row_number().over(w) - 1)
    d = with_total(d, "_n")
    k = F.floor(F.col("_n") / F.lit(n_workers))
    return d.filter(F.col("_i") < k * n_workers).select(shard, F.floor(F.col("_i") / k).cast("int").alias("worker"))


def stride_shard(ranked: DataFrame, n_workers: int, pos: str = "pos", out: str = "worker") -> DataFrame:
    """D5 [spec]: row i goes to worker ``i % n``."""
    return ranked.withColumn(out, F.pmod(F.col(pos), F.lit(n_workers)).cast("int"))


def split_fractions(splits: str) -> list[float]:
    """Parse ``a,b,c`` or ``a/b/c``; missing parts are 0; normalised to sum 1."""
    sep = "," if "," in splits else ("/" if "/" in splits else None)
    parts = [float(x) for x in (splits.split(sep) if sep else [splits])]
    parts = (parts + [0.0, 0.0, 0.0])[:3]
    s = sum(parts)
    if s <= 0:
        raise ValueError("split weights must sum to a positive number")
    return [p / s for p in parts]


def split_bounds_cols(splits: str):
    """D6 boundaries as columns over ``_N``: half-even rounding, then the drift subtracted."""
    f = split_fractions(splits)
    b = [F.lit(0).cast("bigint")]
    for x in f:
        b.append(b[-1] + F.bround(F.lit(x) * F.col("_N").cast("double"), 0).cast("bigint"))
    diff = b[3] - F.col("_N")
    return [b[0]] + [bi - diff for bi in b[1:]]


def split_train_valid_test(ranked: DataFrame, splits: str, pos: str = "pos", out: str = "split") -> DataFrame:
    """Rows at positions [b0,b1) train, [b1,b2) valid, [b2,b3) test."""
    d = with_total(ranked)
    b = split_bounds_cols(splits)
    p = F.col(pos)
    name = F.when(p < b[1], "train").when(p < b[2], "valid").otherwise("test")
    return d.withColumn(out, name).drop("_N")


def sample_exact_k_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Exactly ``k`` rows (all if fewer), the ``k`` smallest ``u(seed, key)``: a top-k."""
    return df.withColumn("_h", H.u(seed, key)).orderBy("_h", key).limit(k).drop("_h")


def sample_exact_k(df: DataFrame, key: str, rate: float, seed: int, n_buckets: int | None = None) -> DataFrame:
    """Exactly ``int(N*rate)`` rows without replacement when rate < 1 (all otherwise).

    The cut is a global position under the hash order, so no collect and no
    single-task sort: rows with position < int(N*rate) are kept.
    """
    if rate >= 1:
        return df
    r = shuffle_rows(df, key, seed, out="_p", n_buckets=n_buckets)
    d = with_total(r)
    return d.filter(F.col("_p") < F.floor(F.col("_N") * F.lit(rate))).drop("_p", "_N")


def take_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """First n examples (a top-n: partial top-k per partition, then one merge)."""
    return df.orderBy(order).limit(n)


def class_fraction(df: DataFrame, cls: str, fraction: float) -> DataFrame:
    """Keep the first ``int(C*f)`` classes in name order.

    Ranks are computed on the distinct class list (small) and joined back.
    """
    classes = df.select(cls).distinct()
    w = Window.orderBy(cls)
    ranked = with_total(classes.withColumn("_r", F.row_number().over(w)), "_C")
    keep = ranked.filter(F.col("_r") <= F.floor(F.col("_C") * F.lit(fraction))).select(cls)
    return df.join(F.broadcast(keep), cls, "left_semi")


def per_class_fraction(df: DataFrame, cls: str, order: str, fraction: float, n_buckets: int = 32) -> DataFrame:
    """Keep the first ``int(n_c*f)`` rows of every class in ``order`` (numeric).

    Ranks per class use the two-level prefix partitioned by class, so a class
    holding a third of the rows is still ranked by many tasks (one per bucket).
    """
    bucket = P.range_bucket(df, order, n_buckets)
    r = P.global_positions(df, [F.col(order)], bucket, rank_col="_r", partition_by=[cls], broadcast_offsets=False)
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_nc"))
    d = r.join(counts, cls)
    return d.filter(F.col("_r") < F.floor(F.col("_nc") * F.lit(fraction))).drop("_r", "_nc")


def epoch_doc_order(docs: DataFrame, key: str, n_epochs: int, seed: int, separate_last: bool = False,
                    n_buckets: int | None = None) -> DataFrame:
    """Documents x epochs, all epochs shuffled together (last one apart if asked).

    Output ``(epoch, key, doc_ord)``; ``doc_ord`` is the global position.  The
    epoch range is a literal cross join (``n_epochs`` rows).
    """
    spark = docs.sparkSession
    ep = spark.range(n_epochs).select(F.col("id").cast("int").alias("epoch"))
    d = docs.select(key).crossJoin(F.broadcast(ep))
    grp = F.when(F.lit(separate_last) & (F.col("epoch") == n_epochs - 1), 1).otherwise(0) if n_epochs > 1 else F.lit(0)
    d = d.withColumn("_g", grp).withColumn("_h", H.u(seed, "_g", "epoch", key))
    nb = _nb(docs, n_buckets)
    bucket = F.col("_g") * nb + P.hash_bucket(F.col("_h"), nb)
    out = P.global_positions(d, [F.col("_g"), F.col("_h"), F.col("epoch"), F.col(key)], bucket, rank_col="doc_ord")
    return out.drop("_g", "_h")


def shuffle_samples(samples: DataFrame, sample: str, n_first: int | None, seed: int, n_buckets: int | None = None,
                    out: str = "shuffled_pos") -> DataFrame:
    """Permute ``[0, n_first)`` and ``[n_first, total)`` separately, in that order."""
    nb = _nb(samples, n_buckets)
    rng = F.lit(0) if n_first is None else F.when(F.col(sample) < n_first, 0).otherwise(1)
    d = samples.withColumn("_g", rng).withColumn("_h", H.u(seed, sample))
    bucket = F.col("_g") * nb + P.hash_bucket(F.col("_h"), nb)
    return P.global_positions(d, [F.col("_g"), F.col("_h"), F.col(sample)], bucket, rank_col=out).drop("_g", "_h")


# --- scalar planning helpers (D11, D12, D15) --------------------------------

def plan_epochs(tokens_per_epoch: int, seq_length: int, num_samples: int) -> int:
    """Smallest e with ``(e*T - 1)//S >= n`` (closed form of the reference's loop)."""
    e = max(1, math.ceil((num_samples * seq_length + 1) / tokens_per_epoch))
    while e > 1 and ((e - 1) * tokens_per_epoch - 1) // seq_length >= num_samples:
        e -= 1
    while (e * tokens_per_epoch - 1) // seq_length < num_samples:
        e += 1
    return e


def plan_epochs_col(tokens_per_epoch, seq_length: int, num_samples: int):
    """D11 as a column expression over a token-count column (one aggregate row)."""
    T = tokens_per_epoch
    e = F.greatest(F.lit(1), F.ceil((F.lit(num_samples * seq_length + 1)) / T))
    return e.cast("bigint")


def separate_last_epoch(tokens_per_epoch, seq_length: int, num_samples: int, num_epochs):
    """D12 column: last epoch shuffled apart if its samples < int(0.8 * per-epoch); never for e = 1."""
    T = tokens_per_epoch
    before = F.floor(((num_epochs - 1) * T - 1) / seq_length)
    last = F.lit(num_samples) - before
    per_epoch = F.floor((T - 1) / seq_length)
    return F.when(num_epochs == 1, F.lit(False)).otherwise(last < F.floor(per_epoch * F.lit(0.8)))


def target_sizes(train_iters: int, eval_interval: int, eval_iters: int, global_batch: int) -> dict[str, int]:
    """Requested train / valid / test sample counts."""
    return {
        "train": train_iters * global_batch,
        "valid": (train_iters // eval_interval + 1) * eval_iters * global_batch,
        "test": eval_iters * global_batch,
    }
