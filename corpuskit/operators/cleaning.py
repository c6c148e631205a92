"""Corpus cleaning operators (B1-B9): articles and dialogs.

All are narrow projections and filters except ``flatten_dialogs``, which groups
utterances by dialog (one shuffle keyed by dialog id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from corpuskit.functions import text as T


def split_title_body(df: DataFrame, text: str = "text") -> DataFrame:
    """B1: first line -> ``title``, the rest -> ``body``."""
    return df.withColumn("title", T.title_of(text)).withColumn("body", T.body_of(text))


def clean_article_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """``title`` and cleaned ``text`` (category lines dropped, tail cut, stripped)."""
    body = T.cut_at_tail_section(T.drop_category_lines(T.body_of(text)))
    return df.withColumn("title", T.title_of(text)).withColumn(text, body)


def article_filters(df: DataFrame) -> DataFrame:
    """Adds ``is_list`` (B4) and ``is_disambiguation`` (B5) on cleaned articles."""
    return df.withColumn("is_list", T.is_list_title("title")).withColumn(
        "is_disambiguation", T.is_disambiguation("title", "text")
    )


def clean_articles(df: DataFrame, text: str = "text") -> DataFrame:
    """B1 -> B2 -> B3 -> drop list articles (B4) -> drop disambiguation pages.

    One projection, no shuffle.  Rows are dropped by exploding an empty array
    instead of a ``filter``: Catalyst would push a filter below the projection
    (and below any repartition) by substituting the cleaning expressions, so the
    cleaning would run twice and, for single-split inputs, in the scan task.
    """
    c = clean_article_columns(df, text)
    return keep_rows(c, ~T.is_list_title("title") & ~T.is_disambiguation("title", text))


def keep_rows(df: DataFrame, cond) -> DataFrame:
    """Filter whose condition is evaluated on already-projected columns (not pushed down)."""
    cols = df.columns
    row = F.struct(*[F.col(c) for c in cols])
    kept = df.select(F.explode(F.when(cond, F.array(row)).otherwise(F.array().cast(ArrayType(row_type(df))))).alias("_r"))
    return kept.select(*[F.col("_r." + c).alias(c) for c in cols])


def row_type(df: DataFrame):
    from pyspark.sql.types import StructType

    return StructType(list(df.schema.fields))


def clean_report(df: DataFrame, text: str = "text") -> DataFrame:
    """Total / filtered / kept counts of B7, one aggregate row (partial aggregation)."""
    c = article_filters(clean_article_columns(df, text))
    dropped = F.col("is_list") | F.col("is_disambiguation")
    return c.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(dropped, 1).otherwise(0)).cast("bigint").alias("filtered"),
        F.sum(F.when(dropped, 0).otherwise(1)).cast("bigint").alias("kept"),
    )


def flatten_dialogs(turns: DataFrame, dialog: str = "conv_id", order: str = "turn", text: str = "utterance") -> DataFrame:
    """Utterances of a dialog joined by one space; speaker tokens get a trailing space.

    Empty dialogs are dropped.  One shuffle by dialog id; ordering inside the group
    is restored with ``array_sort`` over (turn, text) structs, so the result does
    not depend on partitioning.
    """
    g = turns.groupBy(dialog).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(text).alias("t")))).alias("u"))
    joined = F.array_join(F.transform("u", lambda s: s["t"]), " ")
    return g.select(dialog, T.space_speakers(joined).alias("text")).filter(F.length("text") > 0)


def json_roundtrip_filter(df: DataFrame, cols: list[str]) -> DataFrame:
    """B9 / A8 rule: keep rows whose JSON encoding parses back to the same values."""
    schema = df.select(*cols).schema
    enc = F.to_json(F.struct(*cols))
    back = F.from_json(enc, schema, {"mode": "PERMISSIVE"})
    same = F.lit(True)
    for c in cols:
        same = same & back[c].eqNullSafe(F.col(c))
    return df.withColumn("_json", enc).filter(back.isNotNull() & same).drop("_json")
