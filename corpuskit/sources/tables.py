"""Parquet table source with a parallelism floor.

A scan yields one task per file split; a table stored as one row group is read
by one task, and every CPU-heavy text expression after it would run on one core.
When the scan has fewer partitions than the cluster's default parallelism the
rows are spread round-robin once (a no-op on large inputs, which already have
thousands of splits).  Column pruning and filters still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        return df.repartition(n)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str, parallel: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if cols:
        df = df.select(*cols)
    return spread(df) if parallel else df
