"""Global positions without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task.  Global
ranks and running sums (packing, sharding, splits) are computed in two levels
instead:

1. every row gets a *bucket* that is monotone in the order key (a range bucket);
2. one aggregate row per bucket (count, sums) -> exclusive prefix over buckets,
   a table whose size is the bucket count we chose, broadcast back;
3. a window partitioned by bucket adds the local position.

The only full exchange is the one the local window needs (by bucket); the
per-bucket table is bounded by ``n_buckets``, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.session import written

MAX_BUCKETS = 1 << 16


def default_buckets(spark) -> int:
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(MAX_BUCKETS, n * 4))


def hash_bucket(h, n_buckets: int) -> Column:
    """Range bucket for a hash ``u`` uniform in [0, 2^32): the top bits."""
    c = F.col(h) if isinstance(h, str) else h
    return F.floor(c * F.lit(n_buckets) / F.lit(4294967296.0)).cast("int")


def range_bucket(df: DataFrame, col: str, n_buckets: int) -> Column:
    """Range bucket for any numeric key from approximate quantiles.

    One aggregate returns ``n_buckets - 1`` boundaries (bounded, independent of
    the data size); rows are placed with a JVM binary search over them.
    """
    if n_buckets <= 1:
        return F.lit(0)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, 10000).alias("b")).first()
    bounds = sorted(set(row["b"] or []))
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(float(b)) for b in bounds])
    # count of boundaries <= key, via array_position of the insertion point:
    # exact and monotone; cost is O(#boundaries) per row only for tiny bucket counts.
    key = F.col(col).cast("double")
    return F.size(F.filter(arr, lambda b: b <= key)).cast("int")


def global_positions(
    df: DataFrame,
    order: list,
    bucket: Column,
    rank_col: str | None = "_rank",
    sums: dict[str, Column] | None = None,
    partition_by: list[str] | None = None,
    broadcast_offsets: bool = True,
) -> DataFrame:
    """Add a 0-based global rank in ``order`` and exclusive running sums.

    ``bucket`` must be monotone in ``order`` (rows of a lower bucket come first).
    ``sums`` maps output name -> numeric column; the output is the sum over all
    rows strictly before this one.  With ``partition_by`` ranks restart per group
    and a hot group is still spread over its buckets; the offsets table then has
    (groups x buckets) rows and is broadcast only if ``broadcast_offsets``.
    """
    sums = sums or {}
    pb = list(partition_by or [])
    d = df.withColumn("_bkt", bucket)
    for name, c in sums.items():
        d = d.withColumn("_sz_" + name, c)
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum("_sz_" + n).alias("_t_" + n) for n in sums]
    per = d.groupBy(*pb, "_bkt").agg(*aggs)
    prev = Window.partitionBy(*pb).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(
        *pb,
        "_bkt",
        F.coalesce(F.sum("_n").over(prev), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum("_t_" + n).over(prev), F.lit(0)).alias("_o_" + n) for n in sums],
    )
    local = Window.partitionBy(*pb, "_bkt").orderBy(*order)
    local_prev = local.rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(F.broadcast(offs) if broadcast_offsets else offs, pb + ["_bkt"])
    if rank_col:
        out = out.withColumn(rank_col, (F.col("_o_n") + F.row_number().over(local) - 1).cast("bigint"))
    for n in sums:
        out = out.withColumn(n, (F.col("_o_" + n) + F.coalesce(F.sum("_sz_" + n).over(local_prev), F.lit(0))).cast("bigint"))
    drop = ["_bkt", "_o_n"] + [f"_sz_{n}" for n in sums] + [f"_o_{n}" for n in sums]
    return out.drop(*drop)


def total(df: DataFrame, name: str = "_total", expr: Column | None = None) -> DataFrame:
    """One-row DataFrame holding a count (or sum); cross-joined as a scalar."""
    e = F.count(F.lit(1)) if expr is None else expr
    return df.agg(e.cast("bigint").alias(name))


# --- associative scans ---------------------------------------------------------

def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


#: How the scan of earlier ranges and the scan inside a range combine, by kind.
SCANS = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, _added)}


def ranges(df: DataFrame, partition_by: list[str], order: list[str], n_ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, range buckets of (group, order), written: both levels of a scan must see the same cuts.

    A group of very many rows spans many ranges, and a range may hold many small groups.
    """
    n = n_ranges or default_buckets(df.sparkSession)
    return written(df.repartitionByRange(n, *partition_by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def scan(df: DataFrame, partition_by: list[str], order: list[str], out: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """Prefix aggregates per group in ``order``; ``out`` maps a name to (``max`` / ``min`` / ``sum``, column). Needs ``ranges``.

    Any associative aggregate scans in two levels: one row per group and range, a window over those
    few rows, and a window inside each range, so one group is scanned by as many tasks as it has ranges.
    A segmented scan is a ``max`` of the positions at which segments start.
    """
    pb = list(partition_by)
    d = df.withColumns({f"_x_{n}": c for n, (_, c) in out.items()})
    per = d.groupBy(*pb, "_range").agg(*[SCANS[kind][0](f"_x_{n}").alias(f"_t_{n}") for n, (kind, _) in out.items()])
    earlier = Window.partitionBy(*pb).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*pb, "_range", *[SCANS[kind][0](f"_t_{n}").over(earlier).alias(f"_o_{n}") for n, (kind, _) in out.items()])
    inside = Window.partitionBy(*pb, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    null_safe = [d[c].eqNullSafe(before[c]) for c in (*pb, "_range")]
    cond = null_safe[0]
    for c in null_safe[1:]:
        cond = cond & c
    j = d.join(before, cond, "left").drop(*[before[c] for c in (*pb, "_range")])
    j = j.withColumns({n: SCANS[kind][1](F.col(f"_o_{n}"), SCANS[kind][0](f"_x_{n}").over(inside)) for n, (kind, _) in out.items()})
    return j.drop(*[f"_{p}_{n}" for n in out for p in "xo"])
