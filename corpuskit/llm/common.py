"""Helpers shared by the operators: written intermediates, words, folds, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import ensure_checkpoint_dir, write_parquet


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, which all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    write_parquet(df, path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str | Column, mod: int) -> Column:
    """``crc32(id as text) mod m``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % F.lit(mod)


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased (bytes split on ASCII white space)."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def unrolled(df: DataFrame, first: tuple, second: tuple, x: str, y: str) -> DataFrame:
    """Two rows ``(x, y)`` of each row of ``df``: one of the two ``first`` and one of the two ``second`` columns."""
    two = [F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(p, (x, y))]) for p in (first, second)]
    return df.select(F.explode(F.array(*two)).alias("_two")).select("_two.*")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` with the smallest reachable node, for every node that has an edge.

    Alternating large-star / small-star rounds over a written edge table: each
    round is two partial-aggregated minima and two joins on a node (a node with
    very many neighbours is split by AQE), and the rounds end when the edges are
    stars around the smallest nodes.  Edges with a
    null end and loops are ignored.
    """
    hi, lo = F.greatest(F.col(a), F.col(b)).alias("hi"), F.least(F.col(a), F.col(b)).alias("lo")
    e = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi, lo).distinct(), "edges")
    while True:
        both = e.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(e.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        e = written(large.join(small, "hi").select(pairs.alias("p")).select("p.hi", "p.lo").filter("hi > lo").distinct(), "edges")
        open_ = unrolled(e, ("hi", F.lit(1)), ("lo", F.lit(0)), "v", "up").groupBy("v").agg(F.sum("up").alias("up"), F.min("up").alias("least")).filter("up > 1 OR (up = 1 AND least = 0)")
        if not open_.head(1):  # every node is a center or has one edge: stars around their smallest nodes
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
