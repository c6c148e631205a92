"""Dataset mixtures.

``blend`` interleaves sets so that every prefix follows the weights.  The
reference walks a max-deficit greedy sequentially; here row ``k`` of set ``i``
gets the virtual time ``(k + 0.5) / w_i`` and rows are ordered by it (ties by
set).  Prefix counts then stay within 2 of ``w_i * t`` (tested), but the
sequence is not bit-equal to the greedy one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import prefix as P


def normalise_weights(weights: dict) -> dict:
    s = float(sum(weights.values()))
    if s <= 0:
        raise ValueError("weights must sum to a positive number")
    return {k: float(v) / s for k, v in weights.items()}


def blend_plan(prefixes_and_weights: list, n_samples: int) -> list[tuple[str, float, int]]:
    """``[w1, p1, w2, p2, ...]`` -> (prefix, normalised weight, ceil(n * w * 1.005))."""
    ws = [float(x) for x in prefixes_and_weights[0::2]]
    ps = [str(x) for x in prefixes_and_weights[1::2]]
    tot = sum(ws)
    return [(p, w / tot, int(math.ceil(n_samples * (w / tot) * 1.005))) for p, w in zip(ps, ws)]


def rank_within_sets(df: DataFrame, set_col: str, order: str, n_buckets: int = 32) -> DataFrame:
    """``k`` = 0-based rank of a row inside its set (two-level prefix: a hot set is still spread)."""
    b = P.range_bucket(df, order, n_buckets)
    return P.global_positions(df, [F.col(order)], b, rank_col="k", partition_by=[set_col], broadcast_offsets=False)


def blend(ranked: DataFrame, set_col: str, weights: dict, n_buckets: int | None = None, set_index: dict | None = None) -> DataFrame:
    """G1: ``(pos, set, k)``: as many slots as there are rows in all sets, shared out by weight.

    Slot ``k`` of a set has the virtual time ``(k + 0.5) / w``; the slots before time
    ``N`` are kept, in the order of time and set index, so each prefix follows the
    weights within two rows.  Past a set's end its rows come again from the
    beginning; rows of a set beyond its share do not come at all.  ``ranked`` has
    ``k`` (rank inside the set).  The virtual time is close to the final position,
    so ``floor(time * B / N)`` is a range bucket and the global order needs no
    sampling and no single-task sort.
    """
    w = normalise_weights(weights)
    idx = set_index or {s: i for i, s in enumerate(sorted(w))}
    spark = ranked.sparkSession
    wdf = spark.createDataFrame([(s, w[s], idx[s]) for s in w], f"{set_col} string, _w double, _si int")
    sizes = ranked.groupBy(set_col).agg(F.count(F.lit(1)).alias("_len")).join(F.broadcast(wdf), set_col)  # a row per set
    tot = sizes.agg(F.sum("_len").alias("_N"))
    slots = F.ceil(F.col("_w") * F.col("_N") - F.lit(0.5)).cast("bigint")
    d = ranked.join(F.broadcast(sizes.crossJoin(F.broadcast(tot)).withColumn("_slots", slots)), set_col).filter(F.col("k") < F.col("_slots"))
    turns = F.floor((F.col("_slots") - 1 - F.col("k")) / F.col("_len")).cast("bigint")
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), turns))).withColumn("k", F.col("k") + F.col("_j") * F.col("_len"))
    d = d.withColumn("_vt", (F.col("k") + F.lit(0.5)) / F.col("_w"))
    nb = n_buckets or P.default_buckets(spark)
    bucket = F.least(F.floor(F.col("_vt") * F.lit(nb) / F.col("_N")), F.lit(nb - 1)).cast("int")
    out = P.global_positions(d, [F.col("_vt"), F.col("_si")], bucket, rank_col="pos")
    return out.drop("_w", "_si", "_vt", "_N", "_slots", "_len", "_j")


def mixture(ranked: DataFrame, set_col: str, weights: dict, sizes: DataFrame) -> DataFrame:
    """Set i contributes ``size_i = ceil(w_i * len_i)`` rows; row r repeats for every
    ``k < size_i`` with ``k mod len_i = r`` (wraps instead of indexing past the end).

    ``sizes`` is ``(set, len)``; replication is an ``explode(sequence)`` per row.
    Output ``(set, k, r)`` with the new in-set rank ``k``.
    """
    spark = ranked.sparkSession
    wdf = spark.createDataFrame([(s, float(v)) for s, v in weights.items()], f"{set_col} string, _w double")
    s = sizes.join(F.broadcast(wdf), set_col).withColumn("_size", F.ceil(F.col("_w") * F.col("len")).cast("bigint"))
    d = ranked.join(F.broadcast(s.select(set_col, "len", "_size")), set_col)
    copies = F.when(F.col("k") < F.col("_size"), F.floor((F.col("_size") - 1 - F.col("k")) / F.col("len")) + 1).otherwise(0)
    e = d.withColumn("_c", copies).filter(F.col("_c") > 0)
    e = e.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_c") - 1).cast("bigint"))))
    return e.select("*", (F.col("k") + F.col("_j") * F.col("len")).alias("_k2")).drop("_c", "_j", "_size", "len") \
        .withColumnRenamed("k", "r").withColumnRenamed("_k2", "k")


def mixture_rates(counts: DataFrame, task: str = "task", n: str = "n", scale: float = 1.0, maximum: float | None = None,
                  temperature: float = 1.0, mode: str = "rate") -> DataFrame:
    """G3 [spec]: rate = ``min(n*scale, maximum) ^ (1/T)``; ``mode='equal'`` gives 1 each.

    Output ``(task, rate, share)`` with share = rate / sum(rate) (one aggregate row).
    """
    x = F.col(n) * F.lit(scale)
    if maximum is not None:
        x = F.least(x, F.lit(float(maximum)))
    rate = F.lit(1.0) if mode == "equal" else F.pow(x.cast("double"), F.lit(1.0 / temperature))
    r = counts.select(task, rate.alias("rate"))
    tot = r.agg(F.sum("rate").alias("_s"))
    return r.crossJoin(F.broadcast(tot)).select(task, "rate", (F.col("rate") / F.col("_s")).alias("share"))


def leave_one_out_rates(rates: DataFrame, task: str, left_out: str) -> DataFrame:
    """G3 variant: rate 0 for one task, shares renormalised."""
    r = rates.select(task, F.when(F.col(task) == left_out, F.lit(0.0)).otherwise(F.col("rate")).alias("rate"))
    tot = r.agg(F.sum("rate").alias("_s"))
    return r.crossJoin(F.broadcast(tot)).select(task, "rate", (F.col("rate") / F.col("_s")).alias("share"))


def achieved_ratios(blended: DataFrame, set_col: str, weights: dict) -> DataFrame:
    """Requested vs achieved share per set."""
    w = normalise_weights(weights)
    spark = blended.sparkSession
    wdf = spark.createDataFrame([(s, w[s]) for s in w], f"{set_col} string, requested double")
    c = blended.groupBy(set_col).agg(F.count(F.lit(1)).alias("_c"))
    tot = c.agg(F.sum("_c").alias("_t"))
    a = c.crossJoin(F.broadcast(tot)).select(set_col, (F.col("_c") / F.col("_t")).alias("achieved"))
    return wdf.join(a, set_col, "left")


def max_prefix_drift(blended: DataFrame, set_col: str, weights: dict) -> DataFrame:
    """Largest ``|count_i(t) - w_i * t|`` over prefixes t and sets i (the G1 test statistic)."""
    w = normalise_weights(weights)
    spark = blended.sparkSession
    wdf = spark.createDataFrame([(s, w[s]) for s in w], f"{set_col} string, _w double")
    # count_i(t) after position pos of a row of set i is k+1; between its rows it only
    # drifts further below w*t, which is largest just before the next row: check both ends.
    d = blended.join(F.broadcast(wdf), set_col)
    at = F.abs(F.col("k") + 1 - F.col("_w") * (F.col("pos") + 1))
    before = F.abs(F.col("k") - F.col("_w") * F.col("pos"))
    return d.agg(F.max(F.greatest(at, before)).alias("max_drift"))


def concat_sets(*dfs: DataFrame) -> DataFrame:
    """Plain union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
